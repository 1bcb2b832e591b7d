"""Previews, profiles and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import half_even, ratio
from .joins import with_group_rows
from .quantiles import quantiles


def preview(df: DataFrame, n: int, order_by: Sequence[str], tail: bool = False) -> DataFrame:
    """First (or last) ``n`` rows by an explicit key; rows of a DataFrame have no other order."""
    keys = [F.col(c).desc_nulls_last() if tail else F.col(c).asc_nulls_last() for c in order_by]
    return df.orderBy(*keys).limit(n)


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: missing values and their share of all rows, from one aggregate pass."""
    columns = list(columns or df.columns)
    one = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    return one.unpivot("_rows", columns, "column_name", "nulls").select(
        "column_name",
        F.col("_rows").alias("rows"),
        "nulls",
        half_even(ratio("nulls", "_rows"), 6).alias("null_share"),
    )


def table_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: declared type, rows present, missing and distinct values.

    Distinct values are counted in two mergeable steps over (column, value) pairs, so neither a
    column with few values nor one with many ends up in a single task.
    """
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    pairs = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "column_name", "value"
    )
    per_value = pairs.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    type_name = F.create_map(*[F.lit(x) for c in columns for x in (c, types[c])])
    return (
        per_value.groupBy("column_name")
        .agg(
            F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("non_null"),
            F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
            F.count("value").alias("distinct_values"),
        )
        .withColumn("type_name", type_name[F.col("column_name")])
    )


def describe(
    df: DataFrame,
    columns: Sequence[str],
    percentiles: Sequence[float] = (0.25, 0.5, 0.75),
    by: Sequence[str] = (),
    strategy: str = "auto",
) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact percentiles, one row per column (and group).

    One aggregate over the columns as they are, and one for the percentiles; NaN counts as missing.
    """
    names = {p: f"p{round(p * 100)}" for p in percentiles}
    aggs, spec, rows = [], {}, []
    for i, c in enumerate(columns):
        value = F.nanvl(F.col(c).cast("double"), F.lit(None))
        figures = {
            "n": F.count(value), "mean": F.avg(value), "std": F.stddev_samp(value), "min": F.min(value), "max": F.max(value)
        }
        aggs += [figure.alias(f"_{name}_{i}") for name, figure in figures.items()]
        spec |= {f"_{name}_{i}": (c, p, "linear") for p, name in names.items()}
        cells = [F.col(f"_{name}_{i}").alias(name) for name in (*figures, *names.values())]
        rows.append(F.struct(F.lit(c).alias("column_name"), *cells))
    wide = with_group_rows(df.groupBy(*by).agg(*aggs), quantiles(df, spec, by, strategy), by)
    return wide.select(*by, F.inline(F.array(*rows)))
