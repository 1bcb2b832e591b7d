"""Scooter rides: profile, riders, prices, seasonality, durations, cashback, market share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import labels as L
from ..functions.dates import WEEKDAYS, minutes_between
from ..functions.numeric import half_even, mean
from ..operators.clean import duplicate_count, fill_missing, first_per_key
from ..operators.inspect import describe
from ..operators.joins import keep_members, with_one_row
from ..operators.outliers import box_stats, density, histogram, pair_bins, pair_stats
from ..operators.summarize import (
    distinct_values, market_share, ranked, share_of_total, top_k, units_by_category, value_counts,
)
from ..operators.trend import by_calendar, in_label_order
from . import standins as S

# Fill constants, age bands, and the industry's yearly ride totals.
NO_INFO = "No info"
AGE_BANDS = ((18, "до 18"), (25, "19-25"), (30, "26-30"), (35, "31-35"), (45, "36-45"))
OLDEST = "45+"
AGE_ORDER = tuple(label for _, label in AGE_BANDS) + (OLDEST,)
INDUSTRY_RIDES = {"industry_percent": 211_700_000, "operator_percent": 100_300_000}

FILLS = {
    "gender_cd": NO_INFO, "education_level_cd": NO_INFO, "marital_status_cd": NO_INFO, "lvn_state_nm": NO_INFO,
    "loyalty_accrual_rub_amt": 0, "loyalty_accrual_bns_amt": 0,
}
LOCAL_START = "local_book_start_dttm"


def cleaned(rides: DataFrame) -> DataFrame:
    return fill_missing(rides, FILLS)


def age_group(c: str = "age"):
    """Age band; a missing age falls into the last one."""
    return L.upper_bands(c, AGE_BANDS, OLDEST)


def quality(rides: DataFrame) -> DataFrame:
    """Missing cells in all, before and after filling, and repeated rows."""
    raw = {c: f"_raw_{c}" for c in FILLS}
    both = cleaned(rides.withColumns({name: F.col(c) for c, name in raw.items()}))

    def missing(columns: Sequence[str]) -> Column:
        return sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0))

    nulls = both.agg(
        missing([raw.get(c, c) for c in rides.columns]).cast("long").alias("nulls_before"),
        missing(rides.columns).cast("long").alias("nulls_after"),
    )
    return with_one_row(nulls, duplicate_count(rides).select("duplicates"))


def riders_by(rides: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Distinct riders per category and their share of the sum; optionally the top ``k``."""
    counts = units_by_category(cleaned(rides), "party_rk", column)
    out = share_of_total(counts, "units").withColumn("share", half_even("share", 2))
    return ranked(out, "units", [column]) if k is None else top_k(out, k, "units", [column])


def one_ride_per_rider(rides: DataFrame) -> DataFrame:
    return first_per_key(rides, "party_rk", ["order_rk"])


def rider_ages(rides: DataFrame, bins: int = 30) -> DataFrame:
    """Age histogram with every rider counted once."""
    return histogram(one_ride_per_rider(rides), "age", bins)


def rider_age_summary(rides: DataFrame) -> DataFrame:
    return _rounded(describe(one_ride_per_rider(rides), ["age"]), ["mean", "std", "p25", "p50", "p75"])


def riders_by_age(rides: DataFrame) -> DataFrame:
    rows = rides.withColumn("age_group", age_group())
    return ranked(units_by_category(rows, "party_rk", "age_group"), "units", ["age_group"])


def age_table(rides: DataFrame) -> DataFrame:
    """Rides, mean price and mean cashback per age group, in age order."""
    rows = cleaned(rides).withColumn("age_group", age_group())
    counted = rows.groupBy("age_group").agg(
        F.count("order_rk").alias("rides"),
        mean("nominal_price_rub_amt").alias("avg_price"),
        mean("loyalty_accrual_rub_amt").alias("avg_cashback"),
    )
    return in_label_order(counted, "age_group", AGE_ORDER)


def with_duration(rides: DataFrame) -> DataFrame:
    return rides.withColumn("duration_min", minutes_between("book_end_dttm", "book_start_dttm"))


def seasonality(rides: DataFrame, unit: str) -> DataFrame:
    """Rides, mean minute cost, mean activation cost and mean duration per calendar unit."""
    table = by_calendar(
        with_duration(rides), LOCAL_START, unit,
        F.count("order_rk").alias("rides"),
        mean("minute_cost").alias("avg_minute_cost"),
        mean("activation_cost").alias("avg_activation_cost"),
        mean("duration_min").alias("avg_duration"),
    )
    return in_label_order(table, "weekday", WEEKDAYS) if unit == "weekday" else table.orderBy(unit)


def hour_by_cost(rides: DataFrame) -> DataFrame:
    return by_calendar(rides, LOCAL_START, "hour", F.count("order_rk").alias("rides"), keys=["activation_cost"])


def cost_shares(rides: DataFrame, column: str) -> DataFrame:
    """Frequency of each value and its percentage of the present ones."""
    out = share_of_total(value_counts(rides, column), "n", "percent")
    return out.withColumn("percent", half_even(F.col("percent") * 100, 6)).orderBy(column)


def models(rides: DataFrame) -> DataFrame:
    """Rides per model with share, mean duration and mean price."""
    table = with_duration(rides).groupBy("transport_model").agg(
        F.count("order_rk").alias("rides"),
        mean("duration_min").alias("avg_duration"),
        mean("nominal_price_rub_amt").alias("avg_price"),
    )
    out = share_of_total(table, "rides").withColumn("share", half_even("share", 2))
    return ranked(out, "rides", ["transport_model"])


def duration_distance_summary(rides: DataFrame) -> DataFrame:
    out = describe(with_duration(rides), ["duration_min", "distance_km"])
    return _rounded(out, ["mean", "std", "p25", "p50", "p75"])


def rides_per_value(rides: DataFrame, column: str) -> DataFrame:
    return value_counts(with_duration(rides), column, name="rides").orderBy(column)


def has_cashback(rides: DataFrame, column: str) -> DataFrame:
    """Rides with and without cashback and their percentage."""
    flagged = rides.select(F.coalesce(F.col(column) > 0, F.lit(False)).alias("has_cashback"))
    out = share_of_total(value_counts(flagged, "has_cashback"), "n", "percent")
    return out.withColumn("percent", half_even(F.col("percent") * 100, 6))


def cashback_in_top_regions(rides: DataFrame, k: int = 10) -> DataFrame:
    """Mean cashback in the regions with the most riders."""
    top = riders_by(rides, "lvn_state_nm", k)
    rows = keep_members(cleaned(rides), top, "lvn_state_nm")
    return rows.groupBy("lvn_state_nm").agg(mean("loyalty_accrual_rub_amt").alias("avg_cashback"))


def association(rides: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Correlation and slope for several column pairs, one pass."""
    cells = [
        F.struct(
            F.lit(x).alias("x"), F.lit(y).alias("y"),
            F.col(x).cast("double").alias("vx"), F.col(y).cast("double").alias("vy"),
        )
        for x, y in pairs
    ]
    out = pair_stats(rides.select(F.inline(F.array(*cells))), "vx", "vy", ["x", "y"])
    return _rounded(out, ["corr", "slope", "intercept"])


def _rounded(df: DataFrame, names: Sequence[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: half_even(c, digits) for c in names})


_PAIRS = (
    ("minute_cost", "distance_km"),
    ("minute_cost", "nominal_price_rub_amt"),
    ("nominal_price_rub_amt", "loyalty_accrual_rub_amt"),
)
_BOX = ["q1", "median", "q3", "lower", "upper"]
_EDGES = ["bin_lo", "bin_hi"]


def _discounts(s, d) -> DataFrame:
    """Line discounts as cashback, for the large-table versions."""
    return S.lines(s, d).select(F.col("l_discount").alias("cashback"))


QUERIES = {
    "ride_quality": lambda s, d: quality(S.rides(s, d)),
    "share_by_category": lambda s, d: riders_by(S.rides(s, d), "education_level_cd"),
    "share_by_marital": lambda s, d: riders_by(S.rides(s, d), "marital_status_cd"),
    "share_by_gender": lambda s, d: riders_by(S.rides(s, d), "gender_cd"),
    "top_ride_regions": lambda s, d: riders_by(S.rides(s, d), "lvn_state_nm", 10),
    "first_per_key": lambda s, d: one_ride_per_rider(S.rides(s, d)).select("party_rk", "order_rk", "age", "minute_cost"),
    "rider_age_histogram": lambda s, d: _rounded(rider_ages(S.rides(s, d)), _EDGES),
    "rider_age_summary": lambda s, d: rider_age_summary(S.rides(s, d)),
    "age_groups": lambda s, d: riders_by_age(S.rides(s, d)),
    "age_table": lambda s, d: age_table(S.rides(s, d)),
    "by_month": lambda s, d: seasonality(S.trips(s, d), "month"),
    "by_weekday": lambda s, d: seasonality(S.trips(s, d), "weekday"),
    "by_hour": lambda s, d: seasonality(S.trips(s, d), "hour"),
    "hour_x_type": lambda s, d: hour_by_cost(S.trips(s, d)),
    "value_counts_norm": lambda s, d: cost_shares(S.trips(s, d), "activation_cost"),
    "distinct_values": lambda s, d: distinct_values(S.trips(s, d), "activation_cost"),
    "model_share_duration": lambda s, d: models(S.trips(s, d)),
    "ride_summary": lambda s, d: duration_distance_summary(S.trips(s, d)),
    "rides_per_duration": lambda s, d: rides_per_value(S.trips(s, d), "duration_min"),
    "duration_box": lambda s, d: _rounded(box_stats(with_duration(S.trips(s, d)), "duration_min"), _BOX),
    "minute_cost_box": lambda s, d: _rounded(box_stats(S.trips(s, d), "minute_cost", ["transport_model"]), _BOX),
    "distance_histogram": lambda s, d: _rounded(histogram(S.trips(s, d), "distance_km", 50, hi=8), _EDGES),
    "distance_density": lambda s, d: _rounded(density(S.trips(s, d), "distance_km", 120), ["x", "density"], 9),
    "minute_cost_density": lambda s, d: _rounded(
        density(S.trips(s, d), "minute_cost", 80, ["transport_model"]), ["x", "density"], 9
    ),
    "minute_cost_histogram": lambda s, d: _rounded(
        histogram(S.trips(s, d), "minute_cost", 50, by=["transport_model"]), _EDGES
    ),
    "cashback_share": lambda s, d: has_cashback(_discounts(s, d), "cashback"),
    "ride_cashback_share": lambda s, d: has_cashback(S.trips(s, d), "loyalty_accrual_rub_amt"),
    "ride_bonus_share": lambda s, d: has_cashback(S.trips(s, d), "loyalty_accrual_bns_amt"),
    "cashback_top_regions": lambda s, d: cashback_in_top_regions(S.rides(s, d)),
    "pair_bins": lambda s, d: pair_bins(S.trips(s, d), "distance_km", "minute_cost", 20),
    "corr_pairs": lambda s, d: association(S.trips(s, d), _PAIRS),
    "market_share": lambda s, d: market_share(S.lines(s, d), INDUSTRY_RIDES),
    "describe_cols": lambda s, d: _rounded(
        describe(S.lines(s, d), ["l_quantity", "l_extendedprice", "l_discount"], (0.25, 0.5, 0.99)),
        ["mean", "std", "p25", "p50", "p99"],
    ),
    "histogram": lambda s, d: _rounded(histogram(S.lines(s, d), "l_extendedprice", 50), _EDGES),
    "box_stats": lambda s, d: _rounded(box_stats(S.lines(s, d), "l_extendedprice", ["l_returnflag"]), _BOX),
}

_RIDES = r"""
  WITH pages AS (SELECT *, CAST(regexp_extract(props, '"k": (\d+)', 1) AS INTEGER) AS k FROM events),
  t AS (
    SELECT event_id AS order_rk, user_id AS party_rk, event_type AS transport_model, ts + INTERVAL 3 HOUR AS started,
           CAST(round_even(value, 0) AS INTEGER) AS duration_min, k / 10e0 AS distance_km,
           round_even(value / 10, 1) AS minute_cost, value AS price,
           CASE WHEN k < 20 THEN 0 WHEN k < 60 THEN 30 ELSE 50 END AS activation_cost,
           CASE WHEN k > 50 THEN round_even(value / 20, 2) END AS cashback,
           CASE WHEN k < 30 THEN round_even(value / 50, 2) END AS bonus
    FROM pages),
  r AS (
    SELECT t.*, CASE WHEN c_acctbal > 7000 THEN 'MAR' WHEN c_acctbal > 2000 THEN 'UNM' END AS marital,
           CASE WHEN c_acctbal > 5000 THEN 'M' WHEN c_acctbal > 500 THEN 'F' END AS gender,
           CASE WHEN c_acctbal > 1000 THEN c_mktsegment END AS education,
           CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal / 200) AS INTEGER) + 12 END AS age,
           n_name AS state
    FROM t JOIN customer ON c_custkey = party_rk JOIN nation ON n_nationkey = c_nationkey),
  a AS (SELECT *, CASE WHEN age <= 18 THEN 'до 18' WHEN age <= 25 THEN '19-25' WHEN age <= 30 THEN '26-30'
                       WHEN age <= 35 THEN '31-35' WHEN age <= 45 THEN '36-45' ELSE '45+' END AS age_group FROM r)"""


_ONE = " one AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY party_rk ORDER BY order_rk) = 1)"


def _riders(column: str, name: str, tail: str = "") -> str:
    return (
        _RIDES
        + f""",
  c AS (SELECT coalesce({column}, 'No info') AS {name}, count(DISTINCT party_rk) AS units FROM r GROUP BY 1)
  SELECT *, round_even(units / CAST(sum(units) OVER () AS DOUBLE), 2) AS share FROM c {tail}"""
    )


_MEANS = """count(order_rk) AS rides, round_even(avg(minute_cost), 6) AS avg_minute_cost,
         round_even(avg(activation_cost), 6) AS avg_activation_cost, round_even(avg(duration_min), 6) AS avg_duration"""


def _summary(table: str, columns: dict[str, str], points: Sequence[float]) -> str:
    parts = []
    for name, x in columns.items():
        q = ", ".join(
            f"round_even(percentile_cont({p}) WITHIN GROUP (ORDER BY CAST({x} AS DOUBLE)), 6) AS p{round(p * 100)}"
            for p in points
        )
        parts.append(
            f"SELECT '{name}' AS column_name, count({x}) AS n, round_even(avg({x}), 6) AS mean, "
            f"round_even(stddev_samp({x}), 6) AS std, CAST(min({x}) AS DOUBLE) AS min, "
            f"CAST(max({x}) AS DOUBLE) AS max, {q} FROM {table}"
        )
    return "\n  UNION ALL ".join(parts)


def _density(table: str, x: str, points: int, by: str = "") -> str:
    """Direct sum over all rows: each is shared out between its two neighbours on the grid."""
    key, group, on = (f"{by},", f"GROUP BY {by}", f"v.{by} = g.{by}") if by else ("", "", "TRUE")
    return f"""
  m AS (SELECT {key} count({x}) AS n, stddev_samp(CAST({x} AS DOUBLE)) * pow(count({x}), -0.2e0) AS h, min({x}) AS a, max({x}) AS b FROM {table} {group}),
  g AS (SELECT *, a - 3 * h AS lo, (b - a + 6 * h) / {points - 1}e0 AS step FROM m WHERE h > 0),
  d AS (SELECT g.*, floor((v.{x} - lo) / step) AS k, (v.{x} - lo) / step - floor((v.{x} - lo) / step) AS f
        FROM {table} AS v JOIN g ON {on} WHERE v.{x} IS NOT NULL),
  p AS (SELECT * FROM d, range({points}) AS r(i))
  SELECT {key} CAST(i AS INTEGER) AS point, round_even(max(lo) + i * max(step), 9) AS x,
         round_even(sum((1 - f) * exp(-pow((i - k) * step / h, 2) / 2) + f * exp(-pow((i - k - 1) * step / h, 2) / 2))
                    / (max(n) * max(h) * sqrt(2 * pi())), 9) AS density
  FROM p GROUP BY {key} i"""


def _box(table: str, x: str, by: str = "") -> str:
    key, on = (f"{by},", f"b.{by} = v.{by}") if by else ("", "TRUE")
    group = f"GROUP BY {by}" if by else ""
    return f"""
  q AS (SELECT {key} percentile_cont(0.25) WITHIN GROUP (ORDER BY CAST({x} AS DOUBLE)) AS q1,
               percentile_cont(0.5) WITHIN GROUP (ORDER BY CAST({x} AS DOUBLE)) AS median,
               percentile_cont(0.75) WITHIN GROUP (ORDER BY CAST({x} AS DOUBLE)) AS q3 FROM {table} {group}),
  b AS (SELECT *, q1 - 1.5e0 * (q3 - q1) AS lower, q3 + 1.5e0 * (q3 - q1) AS upper FROM q),
  j AS (SELECT b.*, CAST(v.{x} AS DOUBLE) AS x FROM {table} v JOIN b ON {on})
  SELECT {key} count(x) AS n, round_even(max(q1), 6) AS q1, round_even(max(median), 6) AS median,
         round_even(max(q3), 6) AS q3, round_even(max(lower), 6) AS lower, round_even(max(upper), 6) AS upper,
         min(x) FILTER (WHERE x BETWEEN lower AND upper) AS whisker_low,
         max(x) FILTER (WHERE x BETWEEN lower AND upper) AS whisker_high,
         count(*) FILTER (WHERE x < lower OR x > upper) AS outliers
  FROM j {group}"""


def _hist(table: str, x: str, bins: int, by: str = "", hi: str = "") -> str:
    key, on, group = (f"{by},", f"USING ({by})", f"GROUP BY {by}") if by else ("", "ON TRUE", "")
    top = hi or f"max({x})"
    both = f"{by}, bin" if by else "bin"
    return f"""
  e AS (SELECT {key} CAST(min({x}) AS DOUBLE) AS lo, CAST({top} AS DOUBLE) AS hi FROM {table} {group}),
  w AS (SELECT *, (hi - lo) / {bins} AS step FROM e),
  n AS (SELECT {key} CAST(least(floor(({x} - lo) / step), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
        FROM {table} JOIN w {on} WHERE {x} BETWEEN lo AND hi GROUP BY ALL),
  f AS (SELECT w.*, CAST(i AS INTEGER) AS bin FROM w, range(0, {bins}) AS t(i))
  SELECT {key} bin, round_even(lo + bin * step, 6) AS bin_lo, round_even(lo + (bin + 1) * step, 6) AS bin_hi,
         coalesce(n.n, 0) AS n FROM f LEFT JOIN n USING ({both})"""


def _pair(x: str, y: str, a: str, b: str) -> str:
    return (
        f"SELECT '{a}' AS x, '{b}' AS y, count(*) FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL) AS n, "
        f"round_even(corr({x}, {y}), 6) AS corr, round_even(regr_slope({y}, {x}), 6) AS slope, "
        f"round_even(regr_intercept({y}, {x}), 6) AS intercept FROM t"
    )


ORACLE = {
    "ride_quality": _RIDES
    + """,
  m AS (SELECT count(*) AS n, count(gender) AS g, count(education) AS e, count(age) AS a, count(cashback) AS c,
               count(bonus) AS b, count(marital) AS m FROM r)
  SELECT CAST(6 * n - g - e - a - c - b - m AS BIGINT) AS nulls_before, CAST(n - a AS BIGINT) AS nulls_after,
         (n - (SELECT count(*) FROM (SELECT DISTINCT * FROM r)))::BIGINT AS duplicates FROM m""",
    "share_by_category": _riders("education", "education_level_cd"),
    "share_by_marital": _riders("marital", "marital_status_cd"),
    "share_by_gender": _riders("gender", "gender_cd"),
    "top_ride_regions": _riders("state", "lvn_state_nm", "ORDER BY units DESC, lvn_state_nm LIMIT 10"),
    "first_per_key": _RIDES
    + """
  SELECT party_rk, order_rk, age, minute_cost FROM r
  QUALIFY row_number() OVER (PARTITION BY party_rk ORDER BY order_rk) = 1""",
    "rider_age_histogram": _RIDES + f",{_ONE}," + _hist("one", "age", 30),
    "rider_age_summary": _RIDES + f",{_ONE}" + _summary("one", {"age": "age"}, (0.25, 0.5, 0.75)),
    "age_groups": _RIDES + " SELECT age_group, count(DISTINCT party_rk) AS units FROM a GROUP BY 1",
    "age_table": _RIDES
    + """,
  o AS (SELECT * FROM (VALUES ('до 18', 1), ('19-25', 2), ('26-30', 3), ('31-35', 4), ('36-45', 5), ('45+', 6)) t(age_group, ord)),
  g AS (SELECT age_group, count(order_rk) AS rides, round_even(avg(price), 6) AS avg_price,
               round_even(avg(coalesce(cashback, 0)), 6) AS avg_cashback FROM a GROUP BY 1)
  SELECT age_group, CAST(ord AS INTEGER) AS ord, rides, avg_price, avg_cashback FROM o LEFT JOIN g USING (age_group)""",
    "by_month": _RIDES + f" SELECT CAST(month(started) AS INTEGER) AS month, {_MEANS} FROM t GROUP BY 1",
    "by_weekday": _RIDES
    + f""",
  g AS (SELECT dayname(started) AS weekday, CAST(isodow(started) AS INTEGER) AS ord, {_MEANS} FROM t GROUP BY 1, 2)
  SELECT * FROM g""",
    "by_hour": _RIDES + f" SELECT CAST(hour(started) AS INTEGER) AS hour, {_MEANS} FROM t GROUP BY 1",
    "hour_x_type": _RIDES
    + """ SELECT activation_cost, CAST(hour(started) AS INTEGER) AS hour, count(order_rk) AS rides FROM t GROUP BY 1, 2""",
    "value_counts_norm": _RIDES
    + """,
  c AS (SELECT activation_cost, count(*) AS n FROM t GROUP BY 1)
  SELECT *, round_even(n / CAST(sum(n) OVER () AS DOUBLE) * 100, 6) AS percent FROM c""",
    "distinct_values": _RIDES + " SELECT DISTINCT activation_cost FROM t",
    "model_share_duration": _RIDES
    + """,
  c AS (SELECT transport_model, count(*) AS rides, round_even(avg(duration_min), 6) AS avg_duration,
               round_even(avg(price), 6) AS avg_price FROM t GROUP BY 1)
  SELECT *, round_even(rides / CAST(sum(rides) OVER () AS DOUBLE), 2) AS share FROM c""",
    "ride_summary": _RIDES
    + _summary("t", {"duration_min": "duration_min", "distance_km": "distance_km"}, (0.25, 0.5, 0.75)),
    "rides_per_duration": _RIDES + " SELECT duration_min, count(*) AS rides FROM t GROUP BY 1",
    "duration_box": _RIDES + "," + _box("t", "duration_min"),
    "minute_cost_box": _RIDES + "," + _box("t", "minute_cost", "transport_model"),
    "distance_histogram": _RIDES + "," + _hist("t", "distance_km", 50, hi="8"),
    "distance_density": _RIDES + "," + _density("t", "distance_km", 120),
    "minute_cost_density": _RIDES + "," + _density("t", "minute_cost", 80, "transport_model"),
    "minute_cost_histogram": _RIDES + "," + _hist("t", "minute_cost", 50, by="transport_model"),
    "cashback_share": """
  WITH c AS (SELECT l_discount > 0 AS has_cashback, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT *, round_even(n / CAST(sum(n) OVER () AS DOUBLE) * 100, 6) AS percent FROM c""",
    "ride_cashback_share": _RIDES
    + """,
  c AS (SELECT coalesce(cashback > 0, FALSE) AS has_cashback, count(*) AS n FROM t GROUP BY 1)
  SELECT *, round_even(n / CAST(sum(n) OVER () AS DOUBLE) * 100, 6) AS percent FROM c""",
    "ride_bonus_share": _RIDES
    + """,
  c AS (SELECT coalesce(bonus > 0, FALSE) AS has_cashback, count(*) AS n FROM t GROUP BY 1)
  SELECT *, round_even(n / CAST(sum(n) OVER () AS DOUBLE) * 100, 6) AS percent FROM c""",
    "cashback_top_regions": _RIDES
    + """,
  top AS (SELECT state FROM r GROUP BY 1 ORDER BY count(DISTINCT party_rk) DESC, state LIMIT 10)
  SELECT state AS lvn_state_nm, round_even(avg(coalesce(cashback, 0)), 6) AS avg_cashback
  FROM r WHERE state IN (SELECT state FROM top) GROUP BY 1""",
    "pair_bins": _RIDES
    + """,
  e AS (SELECT CAST(min(distance_km) AS DOUBLE) AS a, (max(distance_km) - min(distance_km)) / 20e0 AS da,
               CAST(min(minute_cost) AS DOUBLE) AS b, (max(minute_cost) - min(minute_cost)) / 20e0 AS db
        FROM t WHERE distance_km IS NOT NULL AND minute_cost IS NOT NULL)
  SELECT CAST(least(floor((distance_km - a) / da), 19) AS INTEGER) AS x_bin,
         CAST(least(floor((minute_cost - b) / db), 19) AS INTEGER) AS y_bin, count(*) AS n
  FROM t, e WHERE distance_km IS NOT NULL AND minute_cost IS NOT NULL GROUP BY ALL""",
    "corr_pairs": _RIDES
    + "\n  UNION ALL ".join(
        [
            _pair("minute_cost", "distance_km", *_PAIRS[0]),
            _pair("minute_cost", "price", *_PAIRS[1]),
            _pair("price", "cashback", *_PAIRS[2]),
        ]
    ),
    "market_share": """
  SELECT count(*) AS rows, round_even(count(*) / 211700000e0 * 100, 6) AS industry_percent,
         round_even(count(*) / 100300000e0 * 100, 6) AS operator_percent FROM lineitem""",
    "describe_cols": _summary(
        "lineitem", {c: c for c in ("l_quantity", "l_extendedprice", "l_discount")}, (0.25, 0.5, 0.99)
    ),
    "histogram": "WITH" + _hist("lineitem", "l_extendedprice", 50),
    "box_stats": "WITH" + _box("lineitem", "l_extendedprice", "l_returnflag"),
}
