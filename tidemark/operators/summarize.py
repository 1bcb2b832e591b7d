"""Frequencies, shares and ratios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import half_even, percent, ratio
from .joins import with_group_rows, with_one_row


def value_counts(df: DataFrame, columns: str | Sequence[str], dropna: bool = True, name: str = "n") -> DataFrame:
    """Rows per value. ``dropna`` leaves missing values out; SQL grouping keeps them."""
    keys = [columns] if isinstance(columns, str) else list(columns)
    rows = df.na.drop(subset=keys) if dropna else df
    return rows.groupBy(*keys).agg(F.count("*").alias(name))


def ranked(df: DataFrame, by: str, ties: Sequence[str], nulls_first: bool = False) -> DataFrame:
    """Descending order with a tie-break; SQL style puts missing values first, pandas style last."""
    top = F.col(by).desc_nulls_first() if nulls_first else F.col(by).desc_nulls_last()
    return df.orderBy(top, *[F.col(t).asc_nulls_last() for t in ties])


def top_k(df: DataFrame, k: int, by: str, ties: Sequence[str], nulls_first: bool = False) -> DataFrame:
    return ranked(df, by, ties, nulls_first).limit(k)


def share_of_total(df: DataFrame, column: str, name: str = "share", within: Sequence[str] = ()) -> DataFrame:
    """Add each row's share of the column total (per ``within`` group) to an aggregated result.

    The totals are a second small aggregate over the same shuffled groups, not a window, so a result
    with very many rows is never pulled into one task.
    """
    total = f"_total_{column}"
    totals = df.groupBy(*within).agg(F.sum(column).alias(total))
    return with_group_rows(df, totals, list(within)).withColumn(name, ratio(column, total)).drop(total)


def percent_of_total(df: DataFrame, column: str, name: str = "percent", digits: int = 2) -> DataFrame:
    """As :func:`share_of_total`, in percent and rounded half away from zero."""
    totals = df.agg(F.sum(column).alias("_total"))
    return with_one_row(df, totals).withColumn(name, percent(column, "_total", digits)).drop("_total")


def units_by_category(df: DataFrame, unit: str, column: str, dropna: bool = True) -> DataFrame:
    """Distinct units per category."""
    rows = df.na.drop(subset=[column]) if dropna else df
    return rows.groupBy(column).agg(F.countDistinct(unit).alias("units"))


def multi_column_counts(df: DataFrame, columns: Sequence[str], trim: bool = False, dropna: bool = False) -> DataFrame:
    """Frequency of each value in each of several sibling columns, in one pass."""
    cells = df.select(*columns).unpivot([], list(columns), "position", "value")
    if trim:
        cells = cells.withColumn("value", F.trim("value"))
    if dropna:
        cells = cells.filter("value IS NOT NULL")
    return cells.groupBy("position", "value").agg(F.count("*").alias("mentions"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def condition_share(df: DataFrame, conditions: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Share of rows (per group) meeting each condition, in percent; unknown counts as not met."""
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"),
        *[percent(F.count_if(cond), F.count("*")).alias(name) for name, cond in conditions.items()],
    )


def rate_by_dimension(counts: DataFrame, dimension: DataFrame, on: str | Sequence[str], count: str, size: str, digits: int = 2) -> DataFrame:
    """Counts joined to an external size series by key and divided (half-even rounding)."""
    joined = counts.join(dimension, [on] if isinstance(on, str) else list(on), "inner")
    return joined.withColumn("rate", half_even(ratio(count, size), digits))


def market_share(df: DataFrame, totals: Mapping[str, int]) -> DataFrame:
    """Row count as a percentage of external totals given as parameters."""
    rows = df.agg(F.count("*").alias("rows"))
    return rows.withColumns(
        {name: half_even(F.col("rows") / F.lit(float(total)) * 100, 6) for name, total in totals.items()}
    )
