"""Feed app: session history, test design, monitoring, read-out."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import as_col, at_least, half_even
from ..operators import experiment as X, hypothesis as H, sketches as K
from ..operators.cohort import best_unit
from ..operators.joins import lookup_join
from ..operators.summarize import ranked, value_counts
from ..operators.trend import daily_ratio
from . import standins as S
from .sqltext import normal_two_sided, student_two_sided

# The design parameters and the session quality threshold.
GOOD_PAGES = 4
ALPHA, POWER, EFFECT = 0.05, 0.8, 0.03


def with_quality(sessions: DataFrame, pages: int = GOOD_PAGES) -> DataFrame:
    """Mark sessions that reached the page threshold; an unknown page count is not good."""
    return sessions.withColumn("good_session", at_least("page_counter", pages))


def session_sketches(sessions: DataFrame, segments: Sequence[str] = ("test_group", "device")) -> DataFrame:
    """Distinct users of each day and segment, to be stored and united for any span."""
    return K.daily_sketches(sessions, F.col("session_date"), "user_id", list(segments))


def sessions_per_user(sessions: DataFrame) -> DataFrame:
    counts = sessions.groupBy("user_id").agg(F.countDistinct("session_id").alias("sessions"))
    return ranked(counts, "sessions", ["user_id"])


def busiest_user(sessions: DataFrame) -> DataFrame:
    """All sessions of the user with the most sessions."""
    return best_unit(sessions.withColumn("_one", F.lit(1)), "user_id", "_one").drop("_one")


def registrations_per_day(sessions: DataFrame) -> DataFrame:
    """Daily users, registrations and their share."""
    return daily_ratio(
        sessions, "session_date", F.sum("registration_flag"), F.countDistinct("user_id"), 3,
        ("registrations", "users", "share"),
    )


def page_counts(sessions: DataFrame) -> DataFrame:
    return ranked(value_counts(sessions, "page_counter", name="sessions"), "sessions", ["page_counter"])


def good_share_per_day(sessions: DataFrame, pages: int = GOOD_PAGES) -> DataFrame:
    return daily_ratio(
        with_quality(sessions, pages), "session_date", F.sum("good_session"), F.count("session_id"), 2,
        ("good_sessions", "sessions", "share"),
    )


def mean_good_share(sessions: DataFrame, pages: int = GOOD_PAGES) -> DataFrame:
    """Unweighted mean of the already rounded daily shares."""
    return good_share_per_day(sessions, pages).agg(half_even(F.avg("share"), 2).alias("mean_share"))


def first_day_balance(sessions: DataFrame) -> DataFrame:
    """Group sizes and their gap on the first day of a running test."""
    first = sessions.agg(F.min("session_date").alias("first_date"))
    day_one = sessions.join(F.broadcast(first), F.col("session_date") == F.col("first_date"))
    return X.group_balance(day_one, "user_id", "test_group", "A", "B", ["session_date"])


def daily_session_test(sessions: DataFrame) -> DataFrame:
    """Welch test of the number of sessions per day."""
    daily = sessions.groupBy("session_date", "test_group").agg(F.countDistinct("session_id").alias("sessions"))
    return _rounded(H.ttest_welch(daily, "test_group", "sessions", "A", "B"))


def value_test_by_device(sessions: DataFrame, value: str) -> DataFrame:
    """Pooled test of a metric per device: one pass for all segments."""
    return _rounded(H.ttest_pooled(sessions, "test_group", value, "A", "B", by=["device"]))


def success_share(sessions: DataFrame, pages: int = GOOD_PAGES) -> DataFrame:
    out = X.group_share(with_quality(sessions, pages), "test_group", "good_session", "session_id")
    return out.withColumns({c: half_even(c, 6) for c in ("share_of_units", "share_of_rows")})


def success_gap(sessions: DataFrame, pages: int = GOOD_PAGES) -> DataFrame:
    out = X.share_gap(with_quality(sessions, pages), "test_group", "good_session", "A", "B")
    return out.withColumns({c: half_even(c, 6) for c in ("share_a", "share_b")})


def success_test(sessions: DataFrame, pages: int = GOOD_PAGES, by: tuple[str, ...] = ()) -> DataFrame:
    out = H.ztest_proportions(with_quality(sessions, pages), "test_group", "good_session", "A", "B", by=by)
    return _rounded(out)


def solved_sizes(sessions: DataFrame) -> DataFrame:
    """Per device the exact units of two equal arms, and of a first arm half the size of the second."""
    base = sessions.groupBy("device").agg(F.avg(F.col("good_session").cast("double")).alias("baseline"))
    effect = base.withColumn("effect", X.cohen_h(F.col("baseline"), EFFECT))
    return effect.select(
        "device",
        X.solve_arm_size(EFFECT, ALPHA, POWER).alias("n_standardised"),
        X.solve_arm_size(F.col("effect"), ALPHA, POWER).alias("n_equal"),
        X.solve_arm_size(F.col("effect"), ALPHA, POWER, 2.0).alias("n_first"),
    )


def detectable(sessions: DataFrame) -> DataFrame:
    """The effect that each device's users of the smaller group could show."""
    units = X.units_per_group(sessions, "user_id", "test_group", ["device"])
    arms = units.groupBy("device").agg(F.min("units").alias("n_per_arm"))
    return arms.withColumn("effect", X.detectable_effect(F.col("n_per_arm"), ALPHA, POWER))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    names = [c for c, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: half_even(as_col(c), digits) for c in names})


def _with_region(spark, folder) -> DataFrame:
    people = S.members(spark, folder).select("user_id", F.col("city").alias("region"))
    return lookup_join(S.feed_sessions(spark, folder), people, "user_id")


def _values(spark, folder) -> DataFrame:
    """Sessions with the event value as their metric."""
    events = S.load(spark, folder, "events")
    return events.select("user_id", F.col("event_type").alias("device"), "value", S.arm().alias("test_group"))


_PAGES = 50  # stand-in threshold: page counters run from 0 to 99

QUERIES = {
    "sessions_per_user": lambda s, d: sessions_per_user(S.feed_sessions(s, d)),
    "max_user_rows": lambda s, d: busiest_user(S.feed_sessions(s, d)),
    "daily_ratio": lambda s, d: registrations_per_day(S.feed_sessions(s, d)),
    "pages_freq": lambda s, d: page_counts(S.feed_sessions(s, d)),
    "good_session_share": lambda s, d: good_share_per_day(S.feed_sessions(s, d)),
    "good_session_mean": lambda s, d: mean_good_share(S.feed_sessions(s, d)),
    "sample_size": lambda s, d: _rounded(
        X.sample_size(with_quality(S.feed_sessions(s, d), _PAGES), "good_session", EFFECT, ALPHA, POWER, by=["device"])
    ),
    "sample_size_cohen_h": lambda s, d: _rounded(
        X.sample_size(
            with_quality(S.feed_sessions(s, d), _PAGES), "good_session", EFFECT, ALPHA, POWER, "cohen_h", ["device"]
        )
    ),
    "test_duration": lambda s, d: X.test_duration(S.feed_sessions(s, d), "user_id", "session_date", EFFECT, ALPHA, POWER),
    "sample_size_solved": lambda s, d: _rounded(solved_sizes(with_quality(S.feed_sessions(s, d), _PAGES)), 4),
    "detectable_effects": lambda s, d: _rounded(detectable(S.feed_sessions(s, d)), 9),
    "ab_ratio_test": lambda s, d: _rounded(X.ratio_test(S.feed_sessions(s, d), "user_id", "test_group", {"A": 1, "B": 1})),
    "ab_ratio_test_groups": lambda s, d: _rounded(
        X.ratio_test(S.feed_sessions(s, d), "session_id", "device", {"click": 2, "error": 2, "purchase": 2, "signup": 2, "view": 2.1}, ["test_group"])
    ),
    "ab_first_day": lambda s, d: first_day_balance(S.feed_sessions(s, d)),
    "ab_contamination": lambda s, d: X.contaminated_units(S.leaky_sessions(s, d), "user_id", "test_group"),
    "ab_covariates": lambda s, d: X.covariate_balance(
        _with_region(s, d), "user_id", "test_group", ["device", "region"]
    ),
    "units_span_sketch": lambda s, d: K.units_in_span(
        session_sketches(S.feed_sessions(s, d)), ["test_group"], dt.date(2024, 1, 5), dt.date(2024, 1, 20)
    ),
    "units_running_sketch": lambda s, d: K.running_units(session_sketches(S.feed_sessions(s, d)), ["test_group"]),
    "units_last_week_sketch": lambda s, d: K.running_units(session_sketches(S.feed_sessions(s, d)), ["device"], days=7),
    "ab_contamination_sketch": lambda s, d: K.shared_units(
        session_sketches(S.leaky_sessions(s, d), ["test_group"]), "test_group", "A", "B"
    ),
    "test_duration_sketch": lambda s, d: K.duration_from(
        session_sketches(S.feed_sessions(s, d)), X.arm_size(EFFECT, ALPHA, POWER) * 2
    ),
    "welch_daily": lambda s, d: daily_session_test(S.feed_sessions(s, d)),
    "ttest_by_segment": lambda s, d: value_test_by_device(_values(s, d), "value"),
    "ab_success_share": lambda s, d: success_share(S.feed_sessions(s, d), _PAGES),
    "ab_success_gap": lambda s, d: success_gap(S.feed_sessions(s, d), _PAGES),
    "ab_ztest": lambda s, d: success_test(S.feed_sessions(s, d), _PAGES),
    "ab_ztest_by_segment": lambda s, d: success_test(S.feed_sessions(s, d), _PAGES, ("device",)),
}

_SESSIONS = r"""
  WITH s AS (
    SELECT user_id, event_id AS session_id, CAST(ts AS DATE) AS session_date, ts AS session_start_ts,
           CAST(event_type = 'signup' AS INTEGER) AS registration_flag,
           CAST(regexp_extract(props, '"k": (\d+)', 1) AS INTEGER) AS page_counter,
           event_type AS device, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS test_group, value
    FROM events)"""
# Literal normal quantiles for alpha 0.05 (two-sided) and power 0.8.
_ARM = "(2 * pow(1.959963984540054e0 + 0.8416212335729143e0, 2))"
_HALF = "2 * asin(sqrt({p}))"

_Z = (
    _SESSIONS
    + """,
  w AS (SELECT {by} count(*) FILTER (WHERE test_group = 'A') AS n_a,
               count(*) FILTER (WHERE test_group = 'A' AND page_counter >= 50) AS x_a,
               count(*) FILTER (WHERE test_group = 'B') AS n_b,
               count(*) FILTER (WHERE test_group = 'B' AND page_counter >= 50) AS x_b
        FROM s {group}),
  t AS (SELECT *, (x_a + x_b) / CAST(n_a + n_b AS DOUBLE) AS pool FROM w),
  z AS (SELECT *, (x_a / CAST(n_a AS DOUBLE) - x_b / CAST(n_b AS DOUBLE))
                  / sqrt(pool * (1 - pool) * (1.0 / n_a + 1.0 / n_b)) AS z FROM t),
  p AS (SELECT *, """
    + normal_two_sided("z")
    + """ AS p FROM z)
  SELECT {by} n_a, x_a, n_b, x_b, round_even(z, 6) AS z, round_even(p, 6) AS p_value,
         CASE WHEN p < 0.05 THEN 'accept H1' ELSE 'cannot reject H0' END AS verdict FROM p"""
)

# Halving by recursion; the tail by Simpson's rule on 1,000 panels.
_TAIL = (
    "(0.5e0 - ({y}) / 3000 * list_sum(list_transform(range(1001), lambda i: (CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
    "* exp(-pow(({y}) * i / 1000, 2) / 2))) / sqrt(2 * pi()))"
)
_CRIT, _TOP = "1.959963984540054e0", "pow(1.959963984540054e0 + 0.8416212335729143e0, 2)"


def _halving(start: str, shift: str) -> str:
    power = f"{_TAIL.format(y=f'{_CRIT} - {shift}')} + {_TAIL.format(y=f'{_CRIT} + {shift}')}"
    return f"""
  r AS (SELECT *, 0e0 AS lo, 0 AS i FROM ({start})
        UNION ALL SELECT device, kind, e, r, CASE WHEN p < 0.8 THEN hi ELSE middle END, CASE WHEN p < 0.8 THEN middle ELSE lo END, i + 1
        FROM (SELECT *, (lo + hi) / 2 AS middle, {power} AS p FROM (SELECT *, (lo + hi) / 2 AS m FROM r WHERE i < 80)))"""


ORACLE = {
    "sample_size_solved": _SESSIONS.replace("WITH s", "WITH RECURSIVE s")
    + f""",
  b AS (SELECT device, avg(CAST(page_counter >= 50 AS INTEGER)) AS p FROM s GROUP BY 1),
  h AS (SELECT device, abs({_HALF.format(p='least(p + 0.03e0, 1e0)')} - {_HALF.format(p='p')}) AS h FROM b),
  {_halving(f"SELECT device, kind, e, r, {_TOP} * (1 + 1 / r) / (e * e) AS hi FROM (SELECT device, 1 AS kind, 0.03e0 AS e, 1e0 AS r FROM h "
            "UNION ALL SELECT device, 2, h, 1e0 FROM h UNION ALL SELECT device, 3, h, 2e0 FROM h)", "e * sqrt(m * r / (1 + r))")}
  SELECT device, round_even(max(hi) FILTER (WHERE kind = 1), 4) AS n_standardised, round_even(max(hi) FILTER (WHERE kind = 2), 4) AS n_equal,
         round_even(max(hi) FILTER (WHERE kind = 3), 4) AS n_first FROM r WHERE i = 80 GROUP BY 1""",
    "detectable_effects": _SESSIONS.replace("WITH s", "WITH RECURSIVE s")
    + f""",
  u AS (SELECT device, min(n) AS n FROM (SELECT device, test_group, count(DISTINCT user_id) AS n FROM s GROUP BY 1, 2) GROUP BY 1),
  {_halving(f"SELECT device, 1 AS kind, CAST(n AS DOUBLE) AS e, 1e0 AS r, sqrt(2 * {_TOP} / n) AS hi FROM u", "m * sqrt(e / 2)")}
  SELECT device, CAST(e AS BIGINT) AS n_per_arm, round_even(hi, 9) AS effect FROM r WHERE i = 80""",
    "ab_ratio_test": _SESSIONS
    + f""",
  w AS (SELECT count(DISTINCT user_id) FILTER (WHERE test_group = 'A') AS a, count(DISTINCT user_id) FILTER (WHERE test_group = 'B') AS b FROM s),
  x AS (SELECT a + b AS units, (pow(a - (a + b) / 2e0, 2) + pow(b - (a + b) / 2e0, 2)) / ((a + b) / 2e0) AS statistic FROM w),
  p AS (SELECT *, {normal_two_sided('sqrt(statistic)')} AS p FROM x)
  SELECT units, round_even(statistic, 6) AS statistic, CAST(1 AS BIGINT) AS df, round_even(p, 6) AS p_value,
         CASE WHEN p < 0.05 THEN 'accept H1' ELSE 'cannot reject H0' END AS verdict FROM p""",
    "ab_ratio_test_groups": _SESSIONS
    + """,
  n AS (SELECT test_group, device, count(DISTINCT session_id) AS n FROM s GROUP BY 1, 2),
  e AS (SELECT *, sum(n) OVER (PARTITION BY test_group) * CASE device WHEN 'view' THEN 2.1e0 ELSE 2e0 END / 10.1e0 AS e FROM n),
  x AS (SELECT test_group, CAST(sum(n) AS BIGINT) AS units, sum(pow(n - e, 2) / e) AS x FROM e GROUP BY 1),
  p AS (SELECT *, exp(-x / 2) * (1 + x / 2) AS p FROM x)
  SELECT test_group, units, round_even(x, 6) AS statistic, CAST(4 AS BIGINT) AS df, round_even(p, 6) AS p_value,
         CASE WHEN p < 0.05 THEN 'accept H1' ELSE 'cannot reject H0' END AS verdict FROM p""",
    "sessions_per_user": _SESSIONS + " SELECT user_id, count(DISTINCT session_id) AS sessions FROM s GROUP BY 1",
    "max_user_rows": _SESSIONS
    + """
  SELECT * EXCLUDE (value) FROM s
  WHERE user_id = (SELECT user_id FROM s GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 1)""",
    "daily_ratio": _SESSIONS
    + """,
  d AS (SELECT session_date AS date, CAST(sum(registration_flag) AS BIGINT) AS registrations,
               count(DISTINCT user_id) AS users FROM s GROUP BY 1)
  SELECT *, round_even(registrations / CAST(users AS DOUBLE), 3) AS share FROM d""",
    "pages_freq": _SESSIONS + " SELECT page_counter, count(*) AS sessions FROM s GROUP BY 1",
    "good_session_share": _SESSIONS
    + """,
  d AS (SELECT session_date AS date, count(*) FILTER (WHERE page_counter >= 4) AS good_sessions,
               count(session_id) AS sessions FROM s GROUP BY 1)
  SELECT *, round_even(good_sessions / CAST(sessions AS DOUBLE), 2) AS share FROM d""",
    "good_session_mean": _SESSIONS
    + """,
  d AS (SELECT round_even(count(*) FILTER (WHERE page_counter >= 4) / CAST(count(session_id) AS DOUBLE), 2) AS share
        FROM s GROUP BY session_date)
  SELECT round_even(avg(share), 2) AS mean_share FROM d""",
    "sample_size": _SESSIONS
    + f"""
  SELECT device, count(*) AS rows, round_even(avg(CAST(page_counter >= 50 AS INTEGER)), 6) AS baseline,
         0.03e0 AS effect, CAST(floor({_ARM} / pow(0.03e0, 2)) AS BIGINT) AS n_per_arm
  FROM s GROUP BY 1""",
    "sample_size_cohen_h": _SESSIONS
    + f""",
  b AS (SELECT device, count(*) AS rows, avg(CAST(page_counter >= 50 AS INTEGER)) AS p FROM s GROUP BY 1),
  e AS (SELECT *, abs({_HALF.format(p='least(p + 0.03e0, 1e0)')} - {_HALF.format(p='p')}) AS h FROM b)
  SELECT device, rows, round_even(p, 6) AS baseline, round_even(h, 6) AS effect,
         CAST(floor({_ARM} / (h * h)) AS BIGINT) AS n_per_arm FROM e""",
    "test_duration": _SESSIONS
    + f""",
  d AS (SELECT session_date, count(DISTINCT user_id) AS units FROM s GROUP BY 1),
  t AS (SELECT CAST(round_even(avg(units), 0) AS BIGINT) AS daily_units FROM d)
  SELECT daily_units, CAST(ceil(2 * {_ARM} / pow(0.03e0, 2) / daily_units) AS BIGINT) AS days FROM t""",
    "ab_first_day": _SESSIONS
    + """,
  w AS (SELECT session_date, count(DISTINCT user_id) FILTER (WHERE test_group = 'A') AS units_a,
               count(DISTINCT user_id) FILTER (WHERE test_group = 'B') AS units_b
        FROM s WHERE session_date = (SELECT min(session_date) FROM s) GROUP BY 1)
  SELECT *, round_even(abs(units_a - units_b) * 100 / CAST(units_a AS DOUBLE), 2) AS gap_percent FROM w""",
    "ab_contamination": """
  WITH s AS (SELECT user_id, (user_id % 2 = 0) <> (event_type = 'purchase' AND value > 200) AS is_a FROM events)
  SELECT user_id, 'A' AS first_group, 'B' AS last_group FROM s GROUP BY 1 HAVING count(DISTINCT is_a) > 1""",
    "ab_covariates": _SESSIONS
    + """,
  long AS (
    SELECT user_id, test_group, 'device' AS covariate, device AS category FROM s
    UNION ALL
    SELECT user_id, test_group, 'region', CAST(c_nationkey AS VARCHAR) FROM s JOIN customer ON c_custkey = user_id),
  c AS (SELECT covariate, test_group, category, count(DISTINCT user_id) AS units FROM long GROUP BY 1, 2, 3)
  SELECT *, round_even(units / CAST(sum(units) OVER (PARTITION BY covariate, test_group) AS DOUBLE), 2) AS share FROM c""",
    "units_span_sketch": _SESSIONS
    + """
  SELECT test_group, count(DISTINCT user_id) AS units FROM s
  WHERE session_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1""",
    "units_running_sketch": _SESSIONS
    + """,
  d AS (SELECT test_group, session_date AS date, count(DISTINCT user_id) AS units FROM s GROUP BY 1, 2)
  SELECT date, test_group, units,
         (SELECT count(DISTINCT user_id) FROM s WHERE s.test_group = d.test_group AND s.session_date <= d.date) AS cumulative
  FROM d""",
    "units_last_week_sketch": _SESSIONS
    + """,
  d AS (SELECT device, session_date AS date, count(DISTINCT user_id) AS units FROM s GROUP BY 1, 2)
  SELECT date, device, units, (SELECT count(DISTINCT user_id) FROM s
    WHERE s.device = d.device AND s.session_date BETWEEN d.date - 6 AND d.date) AS last_7_days
  FROM d""",
    "ab_contamination_sketch": """
  WITH s AS (SELECT DISTINCT user_id, (user_id % 2 = 0) <> (event_type = 'purchase' AND coalesce(value, 0) > 200) AS is_a FROM events),
  n AS (SELECT (SELECT count(*) FROM s WHERE is_a) AS units_a, (SELECT count(*) FROM s WHERE NOT is_a) AS units_b,
               (SELECT count(*) FROM s AS x JOIN s AS y USING (user_id) WHERE x.is_a AND NOT y.is_a) AS units_both)
  SELECT *, round_even(units_both * 100 / CAST(units_a + units_b - units_both AS DOUBLE), 2) AS both_percent FROM n""",
    "test_duration_sketch": _SESSIONS
    + f""",
  d AS (SELECT session_date, count(DISTINCT user_id) AS units FROM s GROUP BY 1),
  t AS (SELECT CAST(round_even(avg(units), 0) AS BIGINT) AS daily_units FROM d)
  SELECT daily_units, CAST(ceil(2 * {_ARM} / pow(0.03e0, 2) / daily_units) AS BIGINT) AS days FROM t""",
    "welch_daily": _SESSIONS
    + f""",
  d AS (SELECT session_date, test_group, count(DISTINCT session_id) AS n FROM s GROUP BY 1, 2),
  m AS (SELECT count(n) FILTER (WHERE test_group = 'A') AS n_a, avg(n) FILTER (WHERE test_group = 'A') AS mean_a,
               var_samp(n) FILTER (WHERE test_group = 'A') AS var_a,
               count(n) FILTER (WHERE test_group = 'B') AS n_b, avg(n) FILTER (WHERE test_group = 'B') AS mean_b,
               var_samp(n) FILTER (WHERE test_group = 'B') AS var_b FROM d),
  t AS (SELECT *, (mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b) AS t,
               pow(var_a / n_a + var_b / n_b, 2)
               / (pow(var_a / n_a, 2) / (n_a - 1) + pow(var_b / n_b, 2) / (n_b - 1)) AS df FROM m),
  p AS (SELECT *, {student_two_sided('t', 'df')} AS p FROM t)
  SELECT n_a, round_even(mean_a, 6) AS mean_a, round_even(var_a, 6) AS var_a,
         n_b, round_even(mean_b, 6) AS mean_b, round_even(var_b, 6) AS var_b,
         round_even(t, 6) AS t, round_even(df, 6) AS df, round_even(p, 6) AS p_value,
         CASE WHEN p < 0.05 THEN 'accept H1' ELSE 'cannot reject H0' END AS verdict FROM p""",
    "ttest_by_segment": _SESSIONS
    + f""",
  m AS (SELECT device, count(value) FILTER (WHERE test_group = 'A') AS n_a,
               avg(value) FILTER (WHERE test_group = 'A') AS mean_a,
               var_samp(value) FILTER (WHERE test_group = 'A') AS var_a,
               count(value) FILTER (WHERE test_group = 'B') AS n_b,
               avg(value) FILTER (WHERE test_group = 'B') AS mean_b,
               var_samp(value) FILTER (WHERE test_group = 'B') AS var_b FROM s GROUP BY 1),
  v AS (SELECT *, CAST(n_a + n_b - 2 AS DOUBLE) AS df FROM m),
  t AS (SELECT *, (mean_a - mean_b)
               / sqrt((var_a * (n_a - 1) + var_b * (n_b - 1)) / df * (1.0 / n_a + 1.0 / n_b)) AS t FROM v),
  p AS (SELECT *, {student_two_sided('t', 'df')} AS p FROM t)
  SELECT device, n_a, round_even(mean_a, 6) AS mean_a, round_even(var_a, 6) AS var_a,
         n_b, round_even(mean_b, 6) AS mean_b, round_even(var_b, 6) AS var_b,
         df, round_even(t, 6) AS t, round_even(p, 6) AS p_value,
         CASE WHEN p < 0.05 THEN 'accept H1' ELSE 'cannot reject H0' END AS verdict FROM p""",
    "ab_success_share": _SESSIONS
    + """,
  w AS (SELECT test_group, count(DISTINCT session_id) AS units, count(*) AS rows,
               count(*) FILTER (WHERE page_counter >= 50) AS successes FROM s GROUP BY 1)
  SELECT *, round_even(successes / CAST(units AS DOUBLE), 6) AS share_of_units,
         round_even(successes / CAST(rows AS DOUBLE), 6) AS share_of_rows FROM w""",
    "ab_success_gap": _SESSIONS
    + """,
  w AS (SELECT avg(CAST(page_counter >= 50 AS INTEGER)) FILTER (WHERE test_group = 'A') AS a,
               avg(CAST(page_counter >= 50 AS INTEGER)) FILTER (WHERE test_group = 'B') AS b FROM s)
  SELECT round_even(a, 6) AS share_a, round_even(b, 6) AS share_b, round_even(abs(a - b) * 100, 2) AS gap_points FROM w""",
    "ab_ztest": _Z.format(by="", group=""),
    "ab_ztest_by_segment": _Z.format(by="device,", group="GROUP BY device"),
}
