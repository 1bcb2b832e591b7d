"""Distinct units from stored sketches: united for any span of days, intersected between groups.

A theta sketch keeps the smallest hashes of a set, ``2 ** lg_k`` at most. Sketches merge, so the distinct units
of each day and segment are summed up once, stored, and answer later questions without reading a row again: a
span is the union of its days, contamination the intersection of two groups. Counts are exact while a set has
fewer than ``2 ** lg_k`` units; beyond, the relative standard error is ``1 / sqrt(2 ** lg_k - 1)`` (0.8 % for the
default), and that of an intersection is larger by the square root of union over intersection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import half_even, ratio

LG_K = 14


def relative_error(lg_k: int = LG_K, sigmas: float = 2.0) -> float:
    """Bound of a count's relative error, held with the probability of so many standard deviations."""
    return sigmas / math.sqrt((1 << lg_k) - 1)


def daily_sketches(df: DataFrame, day: Column, unit: str, segments: Sequence[str] = (), lg_k: int = LG_K) -> DataFrame:
    """One row per day and segment: ``date``, the segments and ``units_sketch``; missing units are no units.

    Rows are folded into sketches on the map side, so what is shuffled per day and segment is bounded. Write
    the result with :func:`tidemark.sources.tables.write_table`, partitioned by ``date``.
    """
    present = df.select(day.alias("date"), *segments, F.col(unit).cast("string").alias("_unit")).filter("_unit IS NOT NULL")
    return present.groupBy("date", *segments).agg(F.theta_sketch_agg("_unit", F.lit(lg_k)).alias("units_sketch"))


def _units(sketch: Column | str) -> Column:
    return F.theta_sketch_estimate(sketch)


def _in_span(sketches: DataFrame, first: object, last: object) -> DataFrame:
    """Days from first to last, both included; None leaves a side open."""
    out = sketches if first is None else sketches.filter(F.col("date") >= F.lit(first))
    return out if last is None else out.filter(F.col("date") <= F.lit(last))


def units_in_span(sketches: DataFrame, by: Sequence[str] = (), first: object = None, last: object = None, lg_k: int = LG_K) -> DataFrame:
    """Distinct units of a span of days, per segment or over all segments."""
    spanned = _in_span(sketches, first, last).groupBy(*by).agg(F.theta_union_agg("units_sketch", F.lit(lg_k)).alias("_all"))
    return spanned.select(*by, F.coalesce(_units("_all"), F.lit(0).cast("long")).alias("units"))


def running_units(sketches: DataFrame, by: Sequence[str] = (), days: int | None = None, lg_k: int = LG_K) -> DataFrame:
    """Per day and segment the units of the day, and of all days up to it or of the last ``days`` calendar days."""
    daily = sketches.groupBy("date", *by).agg(F.theta_union_agg("units_sketch", F.lit(lg_k)).alias("_day"))
    order = W.partitionBy(*by).orderBy(F.unix_date("date"))
    frame = order.rowsBetween(W.unboundedPreceding, 0) if days is None else order.rangeBetween(1 - days, 0)
    name = "cumulative" if days is None else f"last_{days}_days"
    merged = daily.withColumn("_span", F.theta_union_agg("_day", F.lit(lg_k)).over(frame))
    return merged.select("date", *by, _units("_day").alias("units"), _units("_span").alias(name))


def shared_units(sketches: DataFrame, group: str, a: str, b: str, by: Sequence[str] = (), lg_k: int = LG_K) -> DataFrame:
    """Units of each group and those seen in both (contamination), in percent of all units of the two."""
    side = lambda label: F.theta_union_agg(F.when(F.col(group) == label, F.col("units_sketch")), F.lit(lg_k))
    both = sketches.groupBy(*by).agg(side(a).alias("_a"), side(b).alias("_b"))
    out = both.select(
        *by,
        F.coalesce(_units("_a"), F.lit(0).cast("long")).alias("units_a"),
        F.coalesce(_units("_b"), F.lit(0).cast("long")).alias("units_b"),
        F.coalesce(_units(F.theta_intersection("_a", "_b")), F.lit(0).cast("long")).alias("units_both"),
    )
    share = ratio(F.col("units_both") * 100, F.col("units_a") + F.col("units_b") - F.col("units_both"))
    return out.withColumn("both_percent", half_even(share, 2))


def duration_from(sketches: DataFrame, units_needed: Column, lg_k: int = LG_K) -> DataFrame:
    """Days until the units needed have been seen, at the rounded mean of daily units."""
    daily = sketches.groupBy("date").agg(_units(F.theta_union_agg("units_sketch", F.lit(lg_k))).alias("units"))
    traffic = daily.agg(half_even(F.avg("units")).cast("long").alias("daily_units"))
    return traffic.withColumn("days", F.ceil(F.try_divide(units_needed, F.col("daily_units").cast("double"))).cast("long"))
