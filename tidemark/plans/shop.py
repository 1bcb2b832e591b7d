"""Shop A/B test: participants, balance, mix, cumulative dynamics, conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import half_even
from ..operators import experiment as X, hypothesis as H
from ..operators.inspect import table_profile
from ..operators.summarize import ranked, share_of_total, units_by_category
from ..operators.trend import cumulative_daily, cumulative_units
from ..sources.tables import accepted, parse_lines, reject_summary, rejected
from . import standins as S
from .sqltext import normal_two_sided


def participants_per_test(participants: DataFrame) -> DataFrame:
    return X.units_per_group(participants, "user_id", "group", ["ab_test"])


def balance(participants: DataFrame) -> DataFrame:
    """Group sizes of every test and their gap."""
    return X.group_balance(participants, "user_id", "group", "A", "B", ["ab_test"])


def region_mix(new_users: DataFrame, participants: DataFrame, test: str) -> DataFrame:
    """Participants per region and their share."""
    enrolled = X.enroll(new_users, participants, test=test)
    out = share_of_total(units_by_category(enrolled, "user_id", "region"), "units")
    return ranked(out.withColumn("share", half_even("share", 6)), "units", ["region"])


def cumulative_registrations(new_users: DataFrame, participants: DataFrame, test: str) -> DataFrame:
    return cumulative_units(X.enroll(new_users, participants, test=test), "first_date", "user_id", "group")


def cumulative_rows(fact: DataFrame, participants: DataFrame, test: str, date: str) -> DataFrame:
    """Sessions or purchases per day and group with their running total."""
    return cumulative_daily(X.enroll(fact, participants, test=test), date, "group", F.count("*"))


def conversion(purchases: DataFrame, new_users: DataFrame, participants: DataFrame, test: str) -> DataFrame:
    bought = X.enroll(purchases, participants, test=test)
    registered = X.enroll(new_users, participants, test=test)
    out = X.conversion(bought, registered, "user_id", "group")
    return out.withColumn("conversion", half_even("conversion", 6))


def conversion_test(purchases: DataFrame, new_users: DataFrame, participants: DataFrame, test: str) -> DataFrame:
    """Two-proportion test of the conversion of both groups."""
    sizes = conversion(purchases, new_users, participants, test)
    side = lambda label, c: F.coalesce(F.sum(F.when(F.col("group") == label, F.col(c))), F.lit(0))
    wide = sizes.agg(
        side("A", "converted").alias("x_a"), side("A", "registered").alias("n_a"),
        side("B", "converted").alias("x_b"), side("B", "registered").alias("n_b"),
    )
    return _rounded(H.ztest_counts(wide, "x_a", "n_a", "x_b", "n_b"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"z": half_even("z", 6), "p_value": half_even("p_value", 6)})


def _enrolled(fact):
    return lambda s, d: (fact(s, d), S.participants(s, d), S.SHOP_TEST)


def customer_file(lines: DataFrame) -> DataFrame:
    """The customers' file with its broken lines told apart."""
    return parse_lines(lines, "line", S.CUSTOMER_FILE, header="user_id,region,revenue,seen")


QUERIES = {
    "csv_rejects": lambda s, d: reject_summary(customer_file(S.customer_lines(s, d))),
    "csv_accepted": lambda s, d: accepted(customer_file(S.customer_lines(s, d))),
    "csv_broken_lines": lambda s, d: rejected(customer_file(S.customer_lines(s, d))).groupBy("_reason").agg(
        F.count("*").alias("rows"), F.min("_line").alias("first_line")
    ),
    "ab_profile": lambda s, d: table_profile(S.new_users(s, d)),
    "ab_participants": lambda s, d: participants_per_test(S.participants(s, d)),
    "ab_group_balance": lambda s, d: balance(S.participants(s, d)),
    "ab_region_mix": lambda s, d: region_mix(*_enrolled(S.new_users)(s, d)),
    "ab_cumulative": lambda s, d: cumulative_registrations(*_enrolled(S.new_users)(s, d)),
    "ab_cumulative_sessions": lambda s, d: cumulative_rows(*_enrolled(S.shop_sessions)(s, d), "session_start"),
    "ab_cumulative_purchases": lambda s, d: cumulative_rows(*_enrolled(S.shop_purchases)(s, d), "event_dt"),
    "ab_conversion": lambda s, d: conversion(S.shop_purchases(s, d), *_enrolled(S.new_users)(s, d)),
    "ab_conversion_ztest": lambda s, d: conversion_test(S.shop_purchases(s, d), *_enrolled(S.new_users)(s, d)),
}

_BASE = """
  WITH parts AS (
    SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS "group",
           'payment_test' AS ab_test FROM events
    UNION ALL
    SELECT DISTINCT user_id, 'B', 'recommender_test' FROM events WHERE event_type = 'error' AND value > 100),
  main AS (SELECT user_id, "group" FROM parts WHERE ab_test = 'payment_test'),
  firsts AS (SELECT user_id, min(CAST(ts AS DATE)) AS first_date FROM events GROUP BY user_id),
  fresh AS (
    SELECT f.user_id, f.first_date, n_name AS region, c_mktsegment AS device
    FROM firsts f JOIN customer ON c_custkey = f.user_id JOIN nation ON n_nationkey = c_nationkey),
  bought AS (SELECT user_id, CAST(ts AS DATE) AS event_dt FROM events WHERE event_type = 'purchase' AND value >= 100)"""

_SIZES = (
    _BASE
    + """,
  c AS (SELECT "group", count(DISTINCT user_id) AS converted FROM bought JOIN main USING (user_id) GROUP BY 1),
  r AS (SELECT "group", count(DISTINCT user_id) AS registered FROM fresh JOIN main USING (user_id) GROUP BY 1)"""
)


def _daily(source: str, date: str) -> str:
    return (
        _BASE
        + f""",
  daily AS (SELECT "group", {date} AS date, count(*) AS n FROM {source} JOIN main USING (user_id) GROUP BY 1, 2)
  SELECT "group", date, n, CAST(sum(n) OVER (PARTITION BY "group" ORDER BY date) AS BIGINT) AS cumulative
  FROM daily"""
    )


_FILE = """
  WITH c AS (SELECT c_custkey % 40 AS kind, c_custkey AS user_id, c_mktsegment || ', "' || c_nationkey || '"' AS region, c_acctbal AS revenue,
                    DATE '2024-01-01' + CAST(c_custkey % 300 AS INTEGER) AS seen FROM customer)"""
_REASONS = ["bad value: seen", "too few fields", "too many fields", "open quote", "bad value: user_id"]
_REASON = "CASE kind " + " ".join(f"WHEN {k} THEN '{r}'" for k, r in enumerate(_REASONS, 1)) + " ELSE 'accepted' END"

ORACLE = {
    "csv_rejects": _FILE + f" SELECT {_REASON} AS reason, count(*) AS rows FROM c GROUP BY 1",
    "csv_accepted": _FILE + " SELECT * EXCLUDE (kind) FROM c WHERE kind NOT BETWEEN 1 AND 5",
    "csv_broken_lines": _FILE + f""",
  l AS (SELECT {_REASON} AS _reason, '"' || CASE kind WHEN 4 THEN '"' ELSE '' END || CASE kind WHEN 5 THEN 'x1' ELSE CAST(user_id AS VARCHAR) END
          || '","' || replace(region, '"', '""') || '","' || revenue || CASE kind WHEN 2 THEN '"' ELSE '","'
          || CASE kind WHEN 1 THEN '2024-02-31' ELSE CAST(seen AS VARCHAR) END || '"' END || CASE kind WHEN 3 THEN ',more' ELSE '' END AS _line
        FROM c WHERE kind BETWEEN 1 AND 5)
  SELECT _reason, count(*) AS rows, min(_line) AS first_line FROM l GROUP BY 1""",
    "ab_profile": _BASE
    + """
  SELECT column_name, non_null, nulls, distinct_values, type_name FROM (
    SELECT 'user_id' AS column_name, count(user_id) AS non_null, count(*) - count(user_id) AS nulls,
           count(DISTINCT user_id) AS distinct_values, 'bigint' AS type_name FROM fresh
    UNION ALL SELECT 'first_date', count(first_date), count(*) - count(first_date), count(DISTINCT first_date), 'date' FROM fresh
    UNION ALL SELECT 'device', count(device), count(*) - count(device), count(DISTINCT device), 'string' FROM fresh
    UNION ALL SELECT 'region', count(region), count(*) - count(region), count(DISTINCT region), 'string' FROM fresh)""",
    "ab_participants": _BASE
    + """ SELECT ab_test, "group", count(DISTINCT user_id) AS units FROM parts GROUP BY 1, 2""",
    "ab_group_balance": _BASE
    + """,
  sizes AS (SELECT ab_test, count(DISTINCT user_id) FILTER (WHERE "group" = 'A') AS units_a,
                   count(DISTINCT user_id) FILTER (WHERE "group" = 'B') AS units_b FROM parts GROUP BY 1)
  SELECT ab_test, units_a, units_b,
         round_even(abs(units_a - units_b) * 100 / CAST(nullif(units_a, 0) AS DOUBLE), 2) AS gap_percent FROM sizes""",
    "ab_region_mix": _BASE
    + """,
  mix AS (SELECT region, count(DISTINCT user_id) AS units FROM fresh JOIN main USING (user_id) GROUP BY 1)
  SELECT region, units, round_even(units / CAST(sum(units) OVER () AS DOUBLE), 6) AS share FROM mix""",
    "ab_cumulative": _daily("fresh", "first_date"),
    "ab_cumulative_sessions": _daily(
        "(SELECT user_id, CAST(ts AS DATE) AS session_start FROM events) AS sessions", "session_start"
    ),
    "ab_cumulative_purchases": _daily("bought", "event_dt"),
    "ab_conversion": _SIZES
    + """
  SELECT coalesce(c."group", r."group") AS "group", converted, registered,
         round_even(converted / CAST(registered AS DOUBLE), 6) AS conversion
  FROM c FULL JOIN r ON c."group" = r."group" """,
    "ab_conversion_ztest": _SIZES
    + f""",
  w AS (SELECT CAST((SELECT converted FROM c WHERE "group" = 'A') AS BIGINT) AS x_a,
               CAST((SELECT registered FROM r WHERE "group" = 'A') AS BIGINT) AS n_a,
               CAST((SELECT converted FROM c WHERE "group" = 'B') AS BIGINT) AS x_b,
               CAST((SELECT registered FROM r WHERE "group" = 'B') AS BIGINT) AS n_b),
  t AS (SELECT *, (x_a + x_b) / CAST(n_a + n_b AS DOUBLE) AS pool FROM w),
  z AS (SELECT *, (x_a / CAST(n_a AS DOUBLE) - x_b / CAST(n_b AS DOUBLE))
                  / sqrt(pool * (1 - pool) * (1.0 / n_a + 1.0 / n_b)) AS z FROM t),
  p AS (SELECT *, {normal_two_sided('z')} AS p FROM z)
  SELECT x_a, n_a, x_b, n_b, round_even(z, 6) AS z, round_even(p, 6) AS p_value,
         CASE WHEN p < 0.05 THEN 'accept H1' ELSE 'cannot reject H0' END AS verdict FROM p""",
}
