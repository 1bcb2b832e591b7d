"""Subscription service: cleaning, users, ride lengths, revenue, hypotheses, normal model."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numeric import as_col, half_even, mean
from ..operators import hypothesis as H
from ..operators.clean import duplicate_count, fill_missing
from ..operators.cohort import best_unit, tariff_revenue
from ..operators.inspect import null_profile
from ..operators.joins import lookup_join
from ..operators.outliers import histogram
from ..operators.quantiles import quantiles
from ..operators.summarize import condition_share, ranked, share_of_total, value_counts
from ..sources import schemas
from ..sources.tables import small_table
from . import standins as S
from .sqltext import normal_between, student_two_sided

# Thresholds of the published questions.
MAINTENANCE_DISTANCE = 3130
LONG_RIDE, RIDE_LOW, RIDE_HIGH, DISTANCE_SHARE = 30, 20, 30, 0.90
ADULT_AGE = 18


def tariff_table(spark: SparkSession, rows: list[tuple[str, int, int, int]]) -> DataFrame:
    """The price list: one row per subscription type."""
    return small_table(spark, rows, schemas.TARIFFS)


def cleaned_rides(rides: DataFrame) -> DataFrame:
    """Distinct rides; the month is taken before gaps are filled, minutes are whole."""
    out = rides.dropDuplicates().withColumn("month", F.month("date"))
    out = fill_missing(out, {"distance": 0, "duration": 0})
    return out.withColumn("duration", half_even("duration").cast("int"))


def cleaning_report(rides: DataFrame) -> DataFrame:
    cells = null_profile(rides).agg(F.sum("nulls").alias("nulls"))
    return cells.crossJoin(F.broadcast(duplicate_count(rides)))


def users_by(users: DataFrame, column: str) -> DataFrame:
    """Users per value with their percentage."""
    out = share_of_total(value_counts(users, column, name="users"), "users", "percent")
    return ranked(out.withColumn("percent", half_even(F.col("percent") * 100)), "users", [column])


def minors_share(users: DataFrame, age: int = ADULT_AGE) -> DataFrame:
    """Users under age as a whole percentage of all users; an unknown age does not count as minor."""
    under = F.count_if(F.col("age") < age)
    return users.agg(
        F.count("*").alias("users"),
        under.alias("minors"),
        half_even(under * 100 / F.count("*")).cast("int").alias("minors_percent"),
    )


def age_histogram(users: DataFrame, bins: int | None) -> DataFrame:
    """Members by age; without a number of bins, one for each year."""
    return histogram(users, "age", bins)


def duration_summary(rides: DataFrame, strategy: str = "auto") -> DataFrame:
    """Mean, deviation and quartiles in whole minutes."""
    d = F.col("duration").cast("double")
    basic = rides.agg(F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"))
    points = quantiles(
        rides, {"p25": ("duration", 0.25, "linear"), "p75": ("duration", 0.75, "linear")}, (), strategy
    )
    both = basic.crossJoin(F.broadcast(points))
    return both.select(*[half_even(c).cast("int").alias(c) for c in both.columns])


def rides_with_plan(rides: DataFrame, users: DataFrame, tariffs: DataFrame) -> DataFrame:
    """Rides with their user's plan and its prices."""
    priced = lookup_join(rides, users.dropDuplicates(), "user_id")
    return lookup_join(priced, tariffs, "subscription_type")


def duration_by_plan(joined: DataFrame) -> DataFrame:
    return joined.groupBy("subscription_type").agg(
        F.count("*").alias("rides"), mean("duration").alias("avg_duration"), mean("distance").alias("avg_distance")
    )


def monthly_revenue(users: DataFrame, rides: DataFrame, tariffs: DataFrame) -> DataFrame:
    out = tariff_revenue(users.dropDuplicates(), rides, tariffs)
    return out.select(
        "user_id", "name", "subscription_type", "month", "total_distance", "total_duration", "rides", "monthly_revenue"
    )


def best_customer(revenue: DataFrame) -> DataFrame:
    """Monthly rows of the user with the largest revenue."""
    return best_unit(revenue, "user_id", "monthly_revenue")


def plan_test(df: DataFrame, value: str) -> DataFrame:
    """Is the metric larger with the paid plan? Pooled one-sided test."""
    rows = df.filter(F.col(value).isNotNull())
    return _rounded(H.ttest_pooled(rows, "subscription_type", value, "ultra", "free", "greater"))


def distance_test(joined: DataFrame, mu: float = MAINTENANCE_DISTANCE) -> DataFrame:
    """Is the mean distance of the paid plan above the wear limit? One-sided test."""
    ultra = joined.filter(F.col("subscription_type") == "ultra")
    return _rounded(H.ttest_one_sample(ultra, "distance", mu, "greater"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: half_even(as_col(c), 6) for c, kind in df.dtypes if kind == "double"})


def _tariffs(spark: SparkSession) -> DataFrame:
    return tariff_table(spark, [("free", 8, 50, 0), ("ultra", 6, 0, 199)])


def _joined(s, d) -> DataFrame:
    return rides_with_plan(S.member_rides(s, d), S.members(s, d), _tariffs(s))


def _revenue(s, d) -> DataFrame:
    return monthly_revenue(S.members(s, d), S.member_rides(s, d), _tariffs(s))


def _dirty(s, d) -> DataFrame:
    """Rides reduced to user, date and a coarse length, so that repeats and gaps occur."""
    rides = S.member_rides(s, d)
    return rides.select(
        "user_id",
        F.when(F.year("date") > 1995, F.trunc("date", "MM")).alias("date"),
        F.when(F.col("duration") > 5, F.floor(F.col("duration") / 10) * 10 + 0.5).alias("duration"),
        F.when(F.col("duration") > 20, F.lit(1000.0)).alias("distance"),
    )


_MU = 250_000.0  # stand-in distances centre on 250,000 metres

QUERIES = {
    "clean_report": lambda s, d: cleaning_report(_dirty(s, d)),
    "clean_dedupe_fill": lambda s, d: cleaned_rides(_dirty(s, d)),
    "users_by_city": lambda s, d: users_by(S.members(s, d), "city"),
    "users_by_plan": lambda s, d: users_by(S.members(s, d), "subscription_type"),
    "minors_share": lambda s, d: minors_share(S.members(s, d)),
    "age_histogram": lambda s, d: _rounded(age_histogram(S.members(s, d), 30)),
    "age_histogram_by_year": lambda s, d: _rounded(age_histogram(S.members(s, d), None)),
    "duration_summary": lambda s, d: duration_summary(S.member_rides(s, d)),
    "duration_by_plan": lambda s, d: duration_by_plan(_joined(s, d)),
    "duration_histogram_by_plan": lambda s, d: _rounded(
        histogram(_joined(s, d), "duration", 30, by=["subscription_type"])
    ),
    "tariff_revenue": lambda s, d: _revenue(s, d),
    "best_customer": lambda s, d: best_customer(_revenue(s, d)),
    "ttest_pooled": lambda s, d: plan_test(_joined(s, d), "duration"),
    "ttest_one_sample": lambda s, d: distance_test(_joined(s, d), _MU),
    "ttest_revenue": lambda s, d: plan_test(_revenue(s, d), "monthly_revenue"),
    "normal_tail": lambda s, d: _rounded(
        H.normal_prob(_joined(s, d), "duration", lo=LONG_RIDE, by=["subscription_type"])
    ),
    "normal_interval": lambda s, d: _rounded(
        H.normal_prob(_joined(s, d), "duration", RIDE_LOW, RIDE_HIGH, ["subscription_type"])
    ),
    "normal_quantile": lambda s, d: _rounded(H.normal_quantile(S.member_rides(s, d), "distance", DISTANCE_SHARE)),
}

_BASE = """
  WITH members AS (
    SELECT c_custkey AS user_id, c_name AS name, CAST(floor(c_acctbal / 250) AS INTEGER) + 12 AS age, c_nationkey AS city,
           CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'ultra' ELSE 'free' END AS subscription_type
    FROM customer),
  rides AS (
    SELECT o_custkey AS user_id, CAST(o_orderdate AS DATE) AS date,
           CAST(o_totalprice AS DECIMAL(18, 2)) AS distance,
           CAST(round_even(o_totalprice / 10000, 0) AS INTEGER) AS duration FROM orders),
  tariffs AS (SELECT * FROM (VALUES ('free', 8, 50, 0), ('ultra', 6, 0, 199))
              t(subscription_type, minute_price, start_ride_price, subscription_fee)),
  joined AS (SELECT * FROM rides JOIN members USING (user_id) JOIN tariffs USING (subscription_type)),
  usage AS (
    SELECT user_id, name, subscription_type, CAST(month(date) AS INTEGER) AS month, sum(distance) AS total_distance,
           CAST(sum(duration) AS BIGINT) AS total_duration, count(duration) AS rides,
           CAST(any_value(start_ride_price) * count(duration) + any_value(minute_price) * sum(duration)
                + any_value(subscription_fee) AS BIGINT) AS monthly_revenue
    FROM joined GROUP BY ALL)"""

_REVENUE = """SELECT user_id, name, subscription_type, month,
         CAST(total_distance AS DECIMAL(28, 2)) AS total_distance, total_duration, rides, monthly_revenue FROM usage"""

_DIRTY = (
    _BASE
    + """,
  dirty AS (
    SELECT user_id, CASE WHEN year(date) > 1995 THEN CAST(date_trunc('month', date) AS DATE) END AS date,
           CASE WHEN duration > 5 THEN floor(duration / 10) * 10 + 0.5e0 END AS duration,
           CASE WHEN duration > 20 THEN 1000e0 END AS distance FROM rides)"""
)


def _pooled(table: str, value: str) -> str:
    side = lambda p, s: (
        f"count({value}) FILTER (WHERE subscription_type = '{p}') AS n_{s}, "
        f"avg({value}) FILTER (WHERE subscription_type = '{p}') AS mean_{s}, "
        f"var_samp({value}) FILTER (WHERE subscription_type = '{p}') AS var_{s}"
    )
    return (
        _BASE
        + f""",
  m AS (SELECT {side('ultra', 'a')}, {side('free', 'b')} FROM {table}),
  v AS (SELECT *, CAST(n_a + n_b - 2 AS DOUBLE) AS df FROM m),
  t AS (SELECT *, (mean_a - mean_b)
               / sqrt((var_a * (n_a - 1) + var_b * (n_b - 1)) / df * (1.0 / n_a + 1.0 / n_b)) AS t FROM v),
  p AS (SELECT *, CASE WHEN t > 0 THEN {student_two_sided('t', 'df')} / 2
                       ELSE 1 - {student_two_sided('t', 'df')} / 2 END AS p FROM t)
  SELECT n_a, round_even(mean_a, 6) AS mean_a, round_even(var_a, 6) AS var_a,
         n_b, round_even(mean_b, 6) AS mean_b, round_even(var_b, 6) AS var_b,
         df, round_even(t, 6) AS t, round_even(p, 6) AS p_value,
         CASE WHEN p < 0.05 THEN 'accept H1' ELSE 'cannot reject H0' END AS verdict FROM p"""
    )


def _histogram(table: str, x: str, bins: int, by: str = "") -> str:
    key, on, group, both = (f"{by},", f"USING ({by})", f"GROUP BY {by}", f"{by}, bin") if by else ("", "ON TRUE", "", "bin")
    return f"""
  w AS (SELECT {key} CAST(min({x}) AS DOUBLE) AS lo, (max({x}) - min({x})) / {bins}e0 AS step FROM {table} {group}),
  n AS (SELECT {key} CAST(least(floor(({x} - lo) / step), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
        FROM {table} JOIN w {on} GROUP BY ALL),
  f AS (SELECT w.*, CAST(i AS INTEGER) AS bin FROM w, range(0, {bins}) AS t(i))
  SELECT {key} bin, round_even(lo + bin * step, 6) AS bin_lo, round_even(lo + (bin + 1) * step, 6) AS bin_hi,
         coalesce(n.n, 0) AS n FROM f LEFT JOIN n USING ({both})"""


_FIT = """,
  fit AS (SELECT {by} count({x}) AS n, avg({x}) AS mu, stddev_samp({x}) AS sigma FROM {table} {group})"""
_PLAN_FIT = _BASE + _FIT.format(by="subscription_type,", x="duration", table="joined", group="GROUP BY 1")

ORACLE = {
    "clean_report": _DIRTY
    + """,
  g AS (SELECT count(*) AS n FROM dirty GROUP BY user_id, date, duration, distance)
  SELECT (SELECT 3 * count(*) - count(date) - count(duration) - count(distance) FROM dirty) AS nulls,
         CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM g""",
    "clean_dedupe_fill": _DIRTY
    + """
  SELECT user_id, date, CAST(round_even(coalesce(duration, 0), 0) AS INTEGER) AS duration,
         coalesce(distance, 0) AS distance, CAST(month(date) AS INTEGER) AS month
  FROM (SELECT DISTINCT * FROM dirty)""",
    "users_by_city": _BASE
    + """
  SELECT city, count(*) AS users, round_even(count(*) * 100 / CAST((SELECT count(*) FROM members) AS DOUBLE), 0) AS percent
  FROM members GROUP BY 1""",
    "users_by_plan": _BASE
    + """
  SELECT subscription_type, count(*) AS users,
         round_even(count(*) * 100 / CAST((SELECT count(*) FROM members) AS DOUBLE), 0) AS percent FROM members GROUP BY 1""",
    "minors_share": _BASE
    + """
  SELECT count(*) AS users, count(*) FILTER (WHERE age < 18) AS minors,
         CAST(round_even(count(*) FILTER (WHERE age < 18) * 100 / CAST(count(*) AS DOUBLE), 0) AS INTEGER) AS minors_percent
  FROM members""",
    "age_histogram": _BASE + "," + _histogram("members", "age", 30),
    "age_histogram_by_year": _BASE
    + """,
  e AS (SELECT CAST(min(age) AS DOUBLE) AS lo, CAST(greatest(ceil(max(age) - min(age)), 1) AS INTEGER) AS k, max(age) - min(age) AS span FROM members)
  SELECT CAST(i AS INTEGER) AS bin, round_even(lo + i * (span / CAST(k AS DOUBLE)), 6) AS bin_lo, round_even(lo + (i + 1) * (span / CAST(k AS DOUBLE)), 6) AS bin_hi,
         (SELECT count(*) FROM members WHERE least(floor((age - lo) / (span / CAST(k AS DOUBLE))), k - 1) = i) AS n
  FROM e, LATERAL (SELECT unnest(range(k)) AS i)""",
    "duration_summary": _BASE
    + """
  SELECT CAST(round_even(avg(duration), 0) AS INTEGER) AS mean, CAST(round_even(stddev_samp(duration), 0) AS INTEGER) AS std,
         CAST(round_even(quantile_cont(duration, 0.25), 0) AS INTEGER) AS p25,
         CAST(round_even(quantile_cont(duration, 0.75), 0) AS INTEGER) AS p75 FROM rides""",
    "duration_by_plan": _BASE
    + """
  SELECT subscription_type, count(*) AS rides, round_even(avg(duration), 6) AS avg_duration,
         round_even(avg(distance), 6) AS avg_distance FROM joined GROUP BY 1""",
    "duration_histogram_by_plan": _BASE + "," + _histogram("joined", "duration", 30, "subscription_type"),
    "tariff_revenue": f"{_BASE} {_REVENUE}",
    "best_customer": f"""{_BASE} {_REVENUE}
  WHERE user_id = (SELECT user_id FROM usage GROUP BY 1 ORDER BY sum(monthly_revenue) DESC, user_id LIMIT 1)""",
    "ttest_pooled": _pooled("joined", "duration"),
    "ttest_one_sample": _BASE
    + f""",
  m AS (SELECT count(distance) AS n, avg(distance) AS mean, stddev_samp(distance) AS std
        FROM joined WHERE subscription_type = 'ultra'),
  t AS (SELECT *, (mean - 250000) / (std / sqrt(n)) AS t, CAST(n - 1 AS DOUBLE) AS df FROM m),
  p AS (SELECT *, CASE WHEN t > 0 THEN {student_two_sided('t', 'df')} / 2
                       ELSE 1 - {student_two_sided('t', 'df')} / 2 END AS p FROM t)
  SELECT n, round_even(mean, 6) AS mean, round_even(std, 6) AS std, round_even(t, 6) AS t, df,
         round_even(p, 6) AS p_value, CASE WHEN p < 0.05 THEN 'accept H1' ELSE 'cannot reject H0' END AS verdict FROM p""",
    "ttest_revenue": _pooled("usage", "monthly_revenue"),
    "normal_tail": _PLAN_FIT
    + f"""
  SELECT subscription_type, n, round_even(mu, 6) AS mu, round_even(sigma, 6) AS sigma,
         round_even(0.5 - {normal_between('0.0', '(30 - mu) / sigma')}, 6) AS probability FROM fit""",
    "normal_interval": _PLAN_FIT
    + f"""
  SELECT subscription_type, n, round_even(mu, 6) AS mu, round_even(sigma, 6) AS sigma,
         round_even({normal_between('(20 - mu) / sigma', '(30 - mu) / sigma')}, 6) AS probability FROM fit""",
    "normal_quantile": _BASE
    + _FIT.format(by="", x="distance", table="rides", group="")
    + """
  SELECT n, round_even(mu, 6) AS mu, round_even(sigma, 6) AS sigma,
         round_even(mu + 1.2815515655446008e0 * sigma, 6) AS critical FROM fit""",
}
