"""Column selection, renaming, filling and de-duplication."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .joins import lookup_join


def select_through(df: DataFrame, last: str) -> DataFrame:
    """All columns up to and including ``last``."""
    return df.select(*[_quoted(c) for c in df.columns[: df.columns.index(last) + 1]])


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename by mapping; dotted names need no quoting here."""
    return df.toDF(*[names.get(c, c) for c in df.columns])


def normalize_columns(df: DataFrame, prefixes: Sequence[str] = ()) -> DataFrame:
    """Strip the given prefixes, join blanks and dots with an underscore, lower the case."""
    out = []
    for name in df.columns:
        for prefix in prefixes:
            name = name.removeprefix(prefix)
        out.append(re.sub(r"[\s.]+", "_", name.strip()).lower())
    return df.toDF(*out)


def fill_missing(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Constant per column for missing values."""
    return df.na.fill(dict(values))


def first_per_key(df: DataFrame, key: str | Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One whole row per key, the first by ``order_by``; merges map-side, so a hot key is no burden."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*order_by, *[c for c in rest if c not in order_by])
    picked = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order_by)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def duplicate_count(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier identical row."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"),
    )


def duplicate_rows(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Second and later rows of every key, by ``order_by`` and then by the whole row; exact copies count.

    Equal rows are counted together first, so n copies of a key's first row give n - 1 rows and n copies
    of a later one give n. The first row per key comes from a mergeable aggregate; only keys that do
    repeat are joined back. Missing keys count as equal to each other.
    """
    code = F.struct(*keys)
    whole = F.struct(*order_by, *[c for c in df.columns if c not in order_by])
    rows = df.groupBy(*df.columns).agg(F.count("*").alias("_n")).withColumn("_key", code)
    firsts = (
        rows.groupBy("_key").agg(F.min(whole).alias("_first"), F.sum("_n").alias("_rows")).filter("_rows > 1").drop("_rows")
    )
    joined = lookup_join(rows, firsts, "_key", grouped=True)
    # null cells make a plain comparison of rows unknown
    left = F.col("_n") - F.when(whole.eqNullSafe(F.col("_first")), 1).otherwise(0)
    copies = joined.withColumn("_left", left.cast("int")).filter("_left > 0")
    return copies.select(*df.columns, F.explode(F.sequence(F.lit(1), F.col("_left"))).alias("_copy")).drop("_copy")


def unique_key_check(df: DataFrame, key: str) -> DataFrame:
    """Whether the present values of a column are all different."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    return counts.agg(
        F.count("*").alias("distinct_values"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("values"),
    ).withColumn("is_unique", F.col("distinct_values") == F.col("values"))


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How well a column would serve as a join key: present and distinct values per side, and common ones."""
    sides = []
    for name, df in (("left", left), ("right", right)):
        sides.append(df.select(F.lit(name).alias("side"), F.col(key).alias("k")).filter("k IS NOT NULL"))
    per_key = (
        sides[0]
        .unionByName(sides[1])
        .groupBy("k")
        .agg(F.count_if(F.col("side") == "left").alias("l"), F.count_if(F.col("side") == "right").alias("r"))
    )
    return per_key.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("rows_left"),
        F.count_if(F.col("l") > 0).alias("distinct_left"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("rows_right"),
        F.count_if(F.col("r") > 0).alias("distinct_right"),
        F.count_if((F.col("l") > 0) & (F.col("r") > 0)).alias("common"),
    )


def common_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct key values present on both sides."""
    return left.select(key).intersect(right.select(key))


def split_entities(
    df: DataFrame, parent: Sequence[str], child: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Undo a denormalising outer join: distinct parents and distinct children, without empty rows."""
    parts = []
    for columns in (parent, child):
        present = F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()
        parts.append(df.select(*columns).filter(present).dropDuplicates())
    return parts[0], parts[1]
