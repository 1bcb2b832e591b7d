"""Start-up funding: header repair, rounds, staff education, entity split, deals, prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import labels as L
from ..functions.numeric import half_even, mean
from ..operators.clean import common_keys, key_overlap, normalize_columns, split_entities
from ..operators.cohort import missing_child_share
from ..operators.inspect import describe, null_profile
from ..operators.joins import join_renamed
from ..operators.outliers import box_stats, histogram, iqr_bounds, outside_share, price_level, trim_percentile
from ..operators.quantiles import quantiles
from ..operators.summarize import ranked, top_k
from . import standins as S

# Staff size classes, the rounds a year needs, and the price trim.
STAFF_CLASSES = ((1, 1, "1"), (2, 2, "2"), (3, 3, "3"), (4, 5, "4-5"), (6, 10, "6-10"), (11, 25, "11-25"), (26, None, "26+"))
MIN_ROUNDS = 50
PRICE_TRIM = (0.01, 0.99)
COMPANY_LAST = "milestones"
ROUND_COLUMNS = ("funding_round_id", "company_id_rounds", "funded_at", "funding_round_type", "raised_amount")


def repaired(df: DataFrame) -> DataFrame:
    """Headers with doubled blanks become plain snake-case names."""
    return normalize_columns(df)


def rounds_per_year(rounds: DataFrame, at_least: int = MIN_ROUNDS, strategy: str = "auto") -> DataFrame:
    """Typical amount and number of rounds in years with more than ``at_least`` rounds."""
    dated = rounds.select(F.year("funded_at").alias("year"), "funding_round_id", "raised_amount").filter("year IS NOT NULL")
    counts = dated.groupBy("year").agg(F.count("funding_round_id").alias("rounds")).filter(F.col("rounds") > at_least)
    typical = quantiles(dated, {"median_raised": ("raised_amount", 0.5, "linear")}, ["year"], strategy)
    return counts.join(typical, "year").orderBy("year")


def education_gaps(staff: DataFrame, education: DataFrame) -> DataFrame:
    """Per company: people, education rows without an institution, and their percentage."""
    return missing_child_share(staff, education, "id", "person_id", "instituition", "company_id")


def education_by_size(staff: DataFrame, education: DataFrame) -> DataFrame:
    """Mean percentage and number of companies per staff size class."""
    rows = education_gaps(staff, education).withColumn("staff", L.segment("parents", STAFF_CLASSES))
    out = rows.groupBy("staff").agg(mean("lacking_percent").alias("avg_lacking_percent"), F.count("parents").alias("companies"))
    return ranked(out, "companies", ["staff"])


def split_rounds(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Companies and funding rounds out of the denormalised table."""
    owner = df.columns[: df.columns.index(COMPANY_LAST) + 1]
    return split_entities(df, owner, ROUND_COLUMNS)


def entity_counts(df: DataFrame) -> DataFrame:
    """How many rows the denormalised table and its two parts have."""
    owners, rounds = split_rounds(df)
    count = lambda part, name: part.agg(F.count("*").alias(name))
    both = count(owners, "companies").crossJoin(F.broadcast(count(rounds, "rounds")))
    return both.crossJoin(F.broadcast(count(df, "rows")))


def of_interest(companies: DataFrame) -> DataFrame:
    """Companies that funded, were funded, or were acquired."""
    wanted = (F.col("funding_rounds") > 0) | (F.col("investment_rounds") > 0) | (F.col("status") == "acquired")
    return companies.filter(F.coalesce(wanted, F.lit(False)))


def funding_summary(companies: DataFrame, percentiles: Sequence[float] = (0.25, 0.5, 0.99)) -> DataFrame:
    out = describe(of_interest(companies), ["funding_total"], percentiles)
    names = ["mean", "std", *[f"p{round(p * 100)}" for p in percentiles]]
    return out.withColumns({c: half_even(c, 6) for c in names})


def deals(companies: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """Acquisitions of companies of interest, with the company's columns."""
    return join_renamed(acquisitions, of_interest(companies), "acquired_company_id", "company_id", "inner")


def unpriced_deals(companies: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """Deals at a stated price of 0 or 1 for funded companies.

    The price test rejects companies without a deal, so the outer join of the two tables is an inner one.
    """
    cheap = acquisitions.filter(F.col("price_amount").isin(0, 1))
    return deals(companies, cheap).filter(F.col("funding_total") > 0)


def unpriced_summary(rows: DataFrame, strategy: str = "auto") -> DataFrame:
    counts = rows.groupBy("price_amount").agg(F.count("company_id").alias("deals"))
    typical = quantiles(rows, {"median_funding": ("funding_total", 0.5, "linear")}, ["price_amount"], strategy)
    return counts.join(typical, "price_amount")


def unpriced_outliers(rows: DataFrame, strategy: str = "auto") -> DataFrame:
    """Fences of the funding of unpriced deals and the percentage beyond each."""
    bounds = iqr_bounds(rows, "funding_total", (), strategy)
    outside = outside_share(rows, "funding_total", bounds)
    return bounds.crossJoin(F.broadcast(outside))


def price_spread(companies: DataFrame, acquisitions: DataFrame, k: int = 15, strategy: str = "auto") -> DataFrame:
    """Price level and spread per category, after trimming both ends of the positive prices."""
    paid = deals(companies, acquisitions.filter(F.col("price_amount") > 0))
    kept = trim_percentile(paid, {"price_amount": PRICE_TRIM}, "linear", (), strategy)
    return top_k(price_level(kept, "category_code", "price_amount", strategy), k, "median", ["category_code"])


def rounds_by_status(companies: DataFrame) -> DataFrame:
    funded = of_interest(companies).filter(F.col("funding_rounds") > 0)
    return funded.groupBy("status").agg(mean("funding_rounds").alias("avg_rounds"))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: half_even(c, digits) for c, kind in df.dtypes if kind == "double"})


def _raw_headers(s, d) -> DataFrame:
    """Companies under headers as exported: doubled blanks, capitals."""
    df = S.companies(s, d).withColumn("country_code", F.nullif("country_code", F.lit(3)))
    return df.toDF(*[c.replace("_", "  ").replace("company  id", "company  ID") for c in df.columns])


def _split(part: int):
    return lambda s, d: split_rounds(S.company_and_rounds(s, d))[part]


def _unpriced(s, d) -> DataFrame:
    return unpriced_deals(S.companies(s, d), S.acquisitions(s, d))


def _suppliers(s, d) -> DataFrame:
    return S.load(s, d, "supplier").select(F.col("s_nationkey").alias("country_code"))


QUERIES = {
    "null_profile": lambda s, d: null_profile(repaired(_raw_headers(s, d))),
    "rounds_per_year": lambda s, d: rounds_per_year(S.company_and_rounds(s, d)),
    "edu_completeness": lambda s, d: _rounded(education_gaps(S.staff(s, d), S.education(s, d))),
    "edu_by_size": lambda s, d: education_by_size(S.staff(s, d), S.education(s, d)),
    "key_overlap": lambda s, d: key_overlap(
        S.staff(s, d).select(F.col("id").alias("key")), S.education(s, d).select(F.col("person_id").alias("key")), "key"
    ),
    "common_keys": lambda s, d: common_keys(S.companies(s, d), _suppliers(s, d), "country_code"),
    "entity_split": lambda s, d: entity_counts(S.company_and_rounds(s, d)),
    "entity_companies": _split(0),
    "entity_rounds": _split(1),
    "select_companies": lambda s, d: of_interest(S.companies(s, d)),
    "funding_summary": lambda s, d: funding_summary(S.companies(s, d)),
    "funding_histogram": lambda s, d: _rounded(histogram(of_interest(S.companies(s, d)), "funding_total", 50)),
    "funding_box": lambda s, d: _rounded(box_stats(of_interest(S.companies(s, d)), "funding_total")),
    "zero_price_summary": lambda s, d: _rounded(unpriced_summary(_unpriced(s, d))),
    "zero_price_iqr": lambda s, d: _rounded(unpriced_outliers(_unpriced(s, d))),
    "price_spread": lambda s, d: _rounded(price_spread(S.companies(s, d), S.acquisitions(s, d))),
    "mean_by_status": lambda s, d: rounds_by_status(S.companies(s, d)),
}

_BASE = """
  WITH companies AS (
    SELECT c_custkey AS company_id, c_name AS name, c_mktsegment AS category_code,
           CASE WHEN c_acctbal < 0 THEN 'closed' WHEN c_acctbal > 9000 THEN 'acquired'
                WHEN c_acctbal > 8000 THEN 'ipo' ELSE 'operating' END AS status,
           c_nationkey AS country_code, CASE WHEN c_acctbal > 7000 THEN 1 ELSE 0 END AS investment_rounds,
           CASE WHEN c_acctbal > 1000 THEN CAST(floor(c_acctbal / 2500) AS INTEGER) + 1 ELSE 0 END AS funding_rounds,
           greatest(c_acctbal, 0e0) AS funding_total, CAST(floor(abs(c_acctbal) / 3000) AS INTEGER) AS milestones
    FROM customer),
  chosen AS (SELECT * FROM companies WHERE funding_rounds > 0 OR investment_rounds > 0 OR status = 'acquired'),
  deals AS (
    SELECT c.*, CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice) AS BIGINT)
                     WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS price_amount
    FROM orders JOIN chosen c ON company_id = o_custkey),
  unpriced AS (SELECT * FROM deals WHERE price_amount IN (0, 1) AND funding_total > 0),
  lacking AS (
    SELECT o_orderkey AS id, nullif(o_custkey, 0) AS company_id,
           CASE WHEN l_returnflag <> 'N' THEN l_linestatus END AS instituition
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey),
  gaps AS (
    SELECT company_id, count(DISTINCT id) AS parents, count(*) - count(instituition) AS lacking,
           (count(*) - count(instituition)) * 100e0 / count(DISTINCT id) AS share
    FROM lacking WHERE company_id IS NOT NULL GROUP BY 1)"""

_COMPANY = "company_id, name, category_code, status, country_code, investment_rounds, funding_rounds, funding_total, milestones"
_CELLS = "\n  UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({x}) AS nulls, "
    f"round_even((count(*) - count({x})) / CAST(count(*) AS DOUBLE), 6) AS null_share FROM companies"
    for c, x in ((c.strip(), "nullif(country_code, 3)" if c.strip() == "country_code" else c.strip()) for c in _COMPANY.split(","))
)

ORACLE = {
    "null_profile": _BASE + "\n  " + _CELLS,
    "rounds_per_year": """
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS rounds, median(o_totalprice) AS median_raised
  FROM orders GROUP BY 1 HAVING count(*) > 50""",
    "edu_completeness": _BASE
    + " SELECT company_id, parents, lacking, round_even(share, 6) AS lacking_percent FROM gaps",
    "edu_by_size": _BASE
    + """
  SELECT CASE WHEN parents <= 3 THEN CAST(parents AS VARCHAR) WHEN parents <= 5 THEN '4-5' WHEN parents <= 10 THEN '6-10'
              WHEN parents <= 25 THEN '11-25' ELSE '26+' END AS staff,
         round_even(avg(share), 6) AS avg_lacking_percent, count(*) AS companies FROM gaps GROUP BY 1""",
    "key_overlap": """
  SELECT (SELECT count(o_orderkey) FROM orders) AS rows_left,
         (SELECT count(DISTINCT o_orderkey) FROM orders) AS distinct_left,
         (SELECT count(l_orderkey) FROM lineitem) AS rows_right,
         (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS distinct_right,
         (SELECT count(*) FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem)) AS common""",
    "common_keys": "SELECT c_nationkey AS country_code FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "entity_split": """
  SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS companies, count(DISTINCT o_orderkey) AS rounds,
         count(*) AS rows FROM orders""",
    "entity_companies": _BASE + f" SELECT DISTINCT {_COMPANY} FROM companies JOIN orders ON o_custkey = company_id",
    "entity_rounds": """
  SELECT DISTINCT o_orderkey AS funding_round_id, o_custkey AS company_id_rounds, CAST(o_orderdate AS DATE) AS funded_at,
         o_orderpriority AS funding_round_type, o_totalprice AS raised_amount FROM orders""",
    "select_companies": _BASE + " SELECT * FROM chosen",
    "funding_summary": _BASE
    + """
  SELECT 'funding_total' AS column_name, count(funding_total) AS n, round_even(avg(funding_total), 6) AS mean,
         round_even(stddev_samp(funding_total), 6) AS std, min(funding_total) AS min, max(funding_total) AS max,
         round_even(quantile_cont(funding_total, 0.25), 6) AS p25, round_even(quantile_cont(funding_total, 0.5), 6) AS p50,
         round_even(quantile_cont(funding_total, 0.99), 6) AS p99 FROM chosen""",
    "funding_histogram": _BASE
    + """,
  w AS (SELECT min(funding_total) AS lo, (max(funding_total) - min(funding_total)) / 50 AS step FROM chosen),
  n AS (SELECT CAST(least(floor((funding_total - lo) / step), 49) AS INTEGER) AS bin, count(*) AS n FROM chosen, w GROUP BY 1)
  SELECT CAST(i AS INTEGER) AS bin, round_even(lo + i * step, 6) AS bin_lo, round_even(lo + (i + 1) * step, 6) AS bin_hi,
         coalesce(n, 0) AS n FROM w CROSS JOIN range(0, 50) AS t(i) LEFT JOIN n ON n.bin = i""",
    "funding_box": _BASE
    + """,
  q AS (SELECT quantile_cont(funding_total, 0.25) AS q1, quantile_cont(funding_total, 0.5) AS median,
               quantile_cont(funding_total, 0.75) AS q3 FROM chosen),
  b AS (SELECT *, q1 - 1.5e0 * (q3 - q1) AS lower, q3 + 1.5e0 * (q3 - q1) AS upper FROM q)
  SELECT count(*) AS n, round_even(max(q1), 6) AS q1, round_even(max(median), 6) AS median, round_even(max(q3), 6) AS q3,
         round_even(max(lower), 6) AS lower, round_even(max(upper), 6) AS upper,
         round_even(min(funding_total) FILTER (WHERE funding_total >= lower), 6) AS whisker_low,
         round_even(max(funding_total) FILTER (WHERE funding_total <= upper), 6) AS whisker_high,
         count(*) FILTER (WHERE funding_total < lower OR funding_total > upper) AS outliers FROM chosen, b""",
    "zero_price_summary": _BASE
    + """
  SELECT price_amount, count(company_id) AS deals, round_even(median(funding_total), 6) AS median_funding
  FROM unpriced GROUP BY 1""",
    "zero_price_iqr": _BASE
    + """,
  q AS (SELECT quantile_cont(funding_total, 0.25) AS q1, quantile_cont(funding_total, 0.5) AS median,
               quantile_cont(funding_total, 0.75) AS q3 FROM unpriced),
  b AS (SELECT *, q1 - 1.5e0 * (q3 - q1) AS lower, q3 + 1.5e0 * (q3 - q1) AS upper FROM q)
  SELECT round_even(max(q1), 6) AS q1, round_even(max(median), 6) AS median, round_even(max(q3), 6) AS q3,
         round_even(max(lower), 6) AS lower, round_even(max(upper), 6) AS upper, count(*) AS rows,
         round_even(count(*) FILTER (WHERE funding_total < lower) / CAST(count(*) AS DOUBLE) * 100, 6) AS below_percent,
         round_even(count(*) FILTER (WHERE funding_total > upper) / CAST(count(*) AS DOUBLE) * 100, 6) AS above_percent
  FROM unpriced, b""",
    "price_spread": _BASE
    + """,
  paid AS (SELECT * FROM deals WHERE price_amount > 0),
  q AS (SELECT quantile_cont(CAST(price_amount AS DOUBLE), 0.01) AS lo,
               quantile_cont(CAST(price_amount AS DOUBLE), 0.99) AS hi FROM paid)
  SELECT category_code, round_even(median(price_amount), 6) AS median, round_even(stddev_samp(price_amount), 6) AS std,
         count(price_amount) AS n
  FROM paid, q WHERE price_amount > lo AND price_amount < hi
  GROUP BY 1 HAVING count(*) > 1 ORDER BY median DESC, category_code LIMIT 15""",
    "mean_by_status": _BASE
    + " SELECT status, round_even(avg(funding_rounds), 6) AS avg_rounds FROM chosen WHERE funding_rounds > 0 GROUP BY 1",
}
