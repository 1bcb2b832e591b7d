"""Road accidents: gaps, duplicates, calendar, driver experience, rate per inhabitants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dates import weekday_name
from ..functions.labels import cut, interval_labels
from ..operators.clean import duplicate_count, duplicate_rows, rename, select_through, unique_key_check
from ..operators.inspect import null_profile, preview
from ..operators.joins import keep_members, with_one_row
from ..operators.summarize import ranked, rate_by_dimension, value_counts
from ..operators.trend import in_label_order
from ..sources.tables import cast_columns, load, parse_times, reject_counts, small_table
from . import standins as S

# Experience bins in years.
DECADES = (0, 10, 20, 30, 40, 50, 60, 70)
FIVE_YEARS = (0, 5, 10, 15, 20, 25, 30, 35, 40, 50, 60, 70)
RAW_PREFIX = "properties."


def renamed(df: DataFrame) -> DataFrame:
    """Flattened headers such as ``properties.point.lat`` under plain names."""
    names = {}
    for c in df.columns:
        names[c] = c.removeprefix("geometry.").removeprefix(RAW_PREFIX).replace(".", "_")
    return rename(df, names)


def gaps_by_column(df: DataFrame) -> DataFrame:
    return ranked(null_profile(df), "nulls", ["column_name"])


def missing_address_places(df: DataFrame) -> DataFrame:
    """What lies nearby where the address is missing."""
    return ranked(value_counts(df.filter(F.col("address").isNull()), "nearby"), "n", ["nearby"])


def near_missing_addresses(df: DataFrame, pairs: bool = False) -> DataFrame:
    """Accidents whose latitude and longitude both occur among those without an address.

    The two are looked up on their own, as published; ``pairs`` asks for the same place instead.
    """
    gaps = df.filter(F.col("address").isNull())
    if pairs:
        return keep_members(df, gaps, ["point_lat", "point_long"])
    return keep_members(keep_members(df, gaps, "point_long"), gaps, "point_lat")


def duplicate_report(df: DataFrame, key: str) -> DataFrame:
    return with_one_row(duplicate_count(df), unique_key_check(df, key))


def by_weekday(df: DataFrame) -> DataFrame:
    rows = df.select(weekday_name("datetime").alias("weekday"))
    return ranked(value_counts(rows, "weekday", name="accidents"), "accidents", ["weekday"])


def by_month(df: DataFrame) -> DataFrame:
    rows = df.select(F.month("datetime").alias("month"))
    return ranked(value_counts(rows, "month", name="accidents"), "accidents", ["month"])


def experience_bins(drivers: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Drivers per experience bin, empty bins included; 0 years and beyond the last edge are left out."""
    rows = drivers.select(cut("years_of_driving_experience", edges).alias("years"))
    counted = in_label_order(value_counts(rows, "years"), "years", interval_labels(edges))
    return counted.select("ord", "years", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def per_100k(accidents: DataFrame, population: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Yearly accidents per 100,000 inhabitants (of each region); ``population`` has year, any ``by``
    columns and hundreds of thousands."""
    years = accidents.groupBy(*by, F.year("datetime").alias("year")).agg(F.count("*").alias("accidents"))
    return rate_by_dimension(years, population, [*by, "year"], "accidents", "population").orderBy(*by, "year")


def population_table(spark: SparkSession, rows: Sequence[tuple[int, int]]) -> DataFrame:
    return small_table(spark, list(rows), "year int, population int")


def parsed_report(orders: DataFrame, pattern: str) -> DataFrame:
    """Dates and prices read from text, and how many texts each reading rejects."""
    read = cast_columns(parse_times(orders, {"ordered": pattern}, "date", tolerant=True), {"price": "decimal(12,2)"}, tolerant=True)
    present = orders.agg(F.count("ordered").alias("dates"), F.count("price").alias("prices"))
    found = read.agg(
        F.count("ordered").alias("read_dates"), F.min("ordered").alias("first"), F.max("ordered").alias("last"),
        F.sum("price").cast("double").alias("total"),
    )
    lost = reject_counts(orders, {"price": "decimal(12,2)"}).withColumnRenamed("price", "rejected_prices")
    return with_one_row(with_one_row(present, found), lost)


_REGIONS = (("F", 1996, 70), ("F", 1997, 71), ("O", 1996, 80), ("O", 1997, 82))
_POPULATION = ((1995, 72), (1996, 73), (1997, 74), (1998, 75), (1999, 76), (2000, 77), (2001, 85))


def _raw(s, d) -> DataFrame:
    df = S.accidents(s, d).select("id", "datetime", "nearby", "address", "category", "point_lat", "point_long")
    return df.toDF(
        "id", "properties.datetime", "properties.nearby", "properties.address", "properties.category",
        "properties.point.lat", "properties.point.long",
    )


def _texts(s, d) -> DataFrame:
    """Orders as a text file would have them: some dates and prices that aren't any."""
    orders = load(s, d, "orders")
    odd = F.col("o_orderkey") % 7 == 0
    return orders.select(
        F.when(odd, "n/a").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("ordered"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("1 000,5")).otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string")).alias("price"),
    )


def _line_keys(s, d) -> DataFrame:
    return S.lines(s, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


QUERIES = {
    "preview_first": lambda s, d: preview(S.accidents(s, d), 5, ["id"]),
    "preview_last": lambda s, d: preview(S.accidents(s, d), 5, ["id"], tail=True),
    "columns_through": lambda s, d: select_through(S.accidents(s, d), "nearby"),
    "header_gaps": lambda s, d: gaps_by_column(renamed(_raw(s, d))),
    "missing_address": lambda s, d: missing_address_places(S.accidents(s, d)),
    "coord_semi": lambda s, d: near_missing_addresses(S.accidents(s, d)),
    "coord_semi_pairs": lambda s, d: near_missing_addresses(S.accidents(s, d), pairs=True),
    "dup_checks": lambda s, d: duplicate_report(S.lines(s, d), "l_orderkey"),
    "dup_rows": lambda s, d: duplicate_rows(
        _line_keys(s, d), ["l_orderkey", "l_linenumber"], ["l_extendedprice", "l_partkey", "l_suppkey"]
    ),
    "dup_rows_exact": lambda s, d: duplicate_rows(
        S.lines(s, d).select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey"], ["l_linenumber"]
    ),
    "accidents_by_weekday": lambda s, d: by_weekday(S.accidents(s, d)),
    "accidents_by_month": lambda s, d: by_month(S.accidents(s, d)),
    "cut_bins": lambda s, d: experience_bins(S.accident_drivers(s, d), DECADES),
    "cut_bins_fine": lambda s, d: experience_bins(S.accident_drivers(s, d).filter(F.col("role") == "R"), FIVE_YEARS),
    "parsed_orders": lambda s, d: parsed_report(_texts(s, d), "dd.MM.yyyy"),
    "rate_by_region": lambda s, d: per_100k(
        S.accidents(s, d), small_table(s, list(_REGIONS), "category string, year int, population int"), ["category"]
    ),
    "rate_per_100k": lambda s, d: per_100k(S.accidents(s, d), population_table(s, _POPULATION)),
}

_BASE = """
  WITH a AS (
    SELECT o_orderkey AS id, o_orderdate AS datetime, o_orderpriority AS nearby,
           CASE WHEN o_orderstatus <> 'P' OR o_totalprice < 400000 THEN o_orderstatus END AS address,
           round_even(o_totalprice / 10000, 3) AS point_lat, round_even(o_totalprice / 7000, 3) AS point_long,
           o_orderstatus AS category FROM orders)"""


def _bins(edges: Sequence[int], where: str) -> str:
    rows = ", ".join(f"({i}, {lo}, {hi}, '({lo}, {hi}]')" for i, (lo, hi) in enumerate(zip(edges, edges[1:]), 1))
    return f"""
  WITH b AS (SELECT * FROM (VALUES {rows}) t(ord, lo, hi, years)),
  x AS (SELECT CASE WHEN l_linenumber < 7 THEN (l_quantity - 1) * 1.5e0 END AS x FROM lineitem {where})
  SELECT CAST(ord AS INTEGER) AS ord, years, count(x) AS n FROM b LEFT JOIN x ON x > lo AND x <= hi GROUP BY ALL"""


ORACLE = {
    "preview_first": _BASE + " SELECT * FROM a ORDER BY id LIMIT 5",
    "preview_last": _BASE + " SELECT * FROM a ORDER BY id DESC LIMIT 5",
    "columns_through": _BASE + " SELECT id, datetime, nearby FROM a",
    "header_gaps": _BASE
    + "\n  UNION ALL ".join(
        f" SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, "
        f"round_even((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 6) AS null_share FROM a"
        for c in ("id", "datetime", "nearby", "address", "category", "point_lat", "point_long")
    ),
    "missing_address": _BASE + " SELECT nearby, count(*) AS n FROM a WHERE address IS NULL GROUP BY 1",
    "coord_semi": _BASE
    + """
  SELECT * FROM a WHERE point_lat IN (SELECT point_lat FROM a WHERE address IS NULL)
                    AND point_long IN (SELECT point_long FROM a WHERE address IS NULL)""",
    "coord_semi_pairs": _BASE
    + """
  SELECT * FROM a WHERE (point_lat, point_long) IN (SELECT (point_lat, point_long) FROM a WHERE address IS NULL)""",
    "dup_checks": """
  SELECT count(*) AS rows,
         count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicates,
         count(DISTINCT l_orderkey) AS distinct_values, count(l_orderkey) AS values,
         count(DISTINCT l_orderkey) = count(l_orderkey) AS is_unique FROM lineitem""",
    "dup_rows": """
  WITH k AS (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem)
  SELECT * FROM k QUALIFY row_number() OVER (
    PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice, l_partkey, l_suppkey) > 1""",
    "dup_rows_exact": """
  SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem QUALIFY row_number() OVER (
    PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) > 1""",
    "parsed_orders": """
  WITH t AS (
    SELECT if(o_orderkey % 7 = 0, NULL, CAST(o_orderdate AS DATE)) AS d, if(o_orderkey % 5 = 0, NULL, CAST(o_totalprice AS DECIMAL(12, 2))) AS p
    FROM orders)
  SELECT count(*) AS dates, count(*) AS prices, count(d) AS read_dates, min(d) AS first, max(d) AS last,
         CAST(sum(p) AS DOUBLE) AS total, count(*) - count(p) AS rejected_prices FROM t""",
    "rate_by_region": _BASE
    + """,
  p AS (SELECT * FROM (VALUES ('F', 1996, 70), ('F', 1997, 71), ('O', 1996, 80), ('O', 1997, 82)) t(category, year, population))
  SELECT category, CAST(year AS INTEGER) AS year, count(*) AS accidents, any_value(population) AS population,
         round_even(count(*) / CAST(any_value(population) AS DOUBLE), 2) AS rate
  FROM (SELECT category, year(datetime) AS year FROM a) JOIN p USING (category, year) GROUP BY ALL""",
    "accidents_by_weekday": _BASE + " SELECT dayname(datetime) AS weekday, count(*) AS accidents FROM a GROUP BY 1",
    "accidents_by_month": _BASE + " SELECT CAST(month(datetime) AS INTEGER) AS month, count(*) AS accidents FROM a GROUP BY 1",
    "cut_bins": _bins(DECADES, ""),
    "cut_bins_fine": _bins(FIVE_YEARS, "WHERE l_returnflag = 'R'"),
    "rate_per_100k": _BASE
    + """,
  p AS (SELECT * FROM (VALUES (1995, 72), (1996, 73), (1997, 74), (1998, 75), (1999, 76), (2000, 77), (2001, 85)) t(year, population)),
  y AS (SELECT CAST(year(datetime) AS INTEGER) AS year, count(*) AS accidents FROM a GROUP BY 1)
  SELECT year, accidents, population, round_even(accidents / CAST(population AS DOUBLE), 2) AS rate FROM y JOIN p USING (year)""",
}
