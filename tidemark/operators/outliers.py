"""Outlier bounds, trimming, histograms and box-plot figures."""

from __future__ import annotations

import math
from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import half_even
from .joins import join_groups, with_group_rows, with_one_row
from .quantiles import quantiles


def percentile_limits(
    df: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]], method: str = "disc",
    strategy: str = "auto", few_values: bool = False,
) -> DataFrame:
    """One row of lower / upper percentile limits (``<column>_lo`` / ``<column>_hi``)."""
    spec = {}
    for column, (lo, hi) in bounds.items():
        if lo is not None:
            spec[f"{column}_lo"] = (column, lo, method)
        if hi is not None:
            spec[f"{column}_hi"] = (column, hi, method)
    return quantiles(df, spec, (), strategy, few_values)


def trim_percentile(
    df: DataFrame,
    bounds: Mapping[str, tuple[float | None, float | None]],
    method: str = "disc",
    null_tolerant: Collection[str] = (),
    strategy: str = "auto",
    few_values: bool = False,
    limits_from: DataFrame | None = None,
) -> DataFrame:
    """Rows strictly inside the percentile limits of every column.

    Limits come from all rows of ``df``, or of ``limits_from``: the same rows before joins that the bounded
    columns don't need. Columns in ``null_tolerant`` also keep missing values. A
    strict comparison drops every row at the maximum when a limit equals it.
    """
    limits = percentile_limits(df if limits_from is None else limits_from, bounds, method, strategy, few_values)
    keep = F.lit(True)
    for column, (lo, hi) in bounds.items():
        inside = F.lit(True)
        if lo is not None:
            inside = inside & (F.col(column) > F.col(f"{column}_lo"))
        if hi is not None:
            inside = inside & (F.col(column) < F.col(f"{column}_hi"))
        keep = keep & ((inside | F.col(column).isNull()) if column in null_tolerant else inside)
    return with_one_row(df, limits).filter(keep).select(*df.columns)


def iqr_bounds(df: DataFrame, column: str, by: Sequence[str] = (), strategy: str = "auto") -> DataFrame:
    """Quartiles and the fences 1.5 interquartile ranges beyond them."""
    spec = {"q1": (column, 0.25, "linear"), "median": (column, 0.5, "linear"), "q3": (column, 0.75, "linear")}
    spread = F.col("q3") - F.col("q1")
    return quantiles(df, spec, by, strategy).withColumns(
        {"lower": F.col("q1") - 1.5 * spread, "upper": F.col("q3") + 1.5 * spread}
    )


def outside_share(df: DataFrame, column: str, bounds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Percent of all rows below ``lower`` and above ``upper``."""
    joined = with_group_rows(df, bounds.select(*by, "lower", "upper"), by)
    value = F.col(column)
    return joined.groupBy(*by).agg(
        F.count("*").alias("rows"),
        half_even(F.count_if(value < F.col("lower")) / F.count("*") * 100, 6).alias("below_percent"),
        half_even(F.count_if(value > F.col("upper")) / F.count("*") * 100, 6).alias("above_percent"),
    )


def box_stats(df: DataFrame, column: str, by: Sequence[str] = (), strategy: str = "auto") -> DataFrame:
    """Box-plot figures: quartiles, fences, whiskers (outermost values inside the fences), outliers."""
    fences = iqr_bounds(df, column, by, strategy)
    value = F.col(column).cast("double")
    joined = with_group_rows(df.select(*by, column), fences, by)
    inside = (value >= F.col("lower")) & (value <= F.col("upper"))
    # The fences repeat on every row of their group, so any aggregate that keeps one will do.
    kept = [F.max(c).alias(c) for c in ("q1", "median", "q3", "lower", "upper")]
    return joined.groupBy(*by).agg(
        F.count(column).alias("n"),
        *kept,
        F.min(F.when(inside, value)).alias("whisker_low"),
        F.max(F.when(inside, value)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def histogram(
    df: DataFrame,
    column: str,
    bins: int | None,
    by: Sequence[str] = (),
    lo: float | None = None,
    hi: float | None = None,
) -> DataFrame:
    """Equal-width counts with empty bins present; the last bin is closed.

    The range is the data's own (per group) unless given. Rows outside a given range do not count. With
    ``bins`` None there are as many as the range has whole units (at least one), so that they are about
    one unit wide. Missing group keys are a group. Infinities and NaN lie in no bin and don't widen the range.
    """
    value = F.col(column).cast("double")
    value = F.when(F.abs(value) < F.lit(float("inf")), value)
    ranges = (
        df.groupBy(*by)
        .agg(
            (F.min(value) if lo is None else F.lit(float(lo))).alias("lo"),
            (F.max(value) if hi is None else F.lit(float(hi))).alias("hi"),
        )
        .filter("lo IS NOT NULL AND hi IS NOT NULL")
    )
    count = F.lit(bins) if bins is not None else F.greatest(F.ceil(F.col("hi") - F.col("lo")), F.lit(1)).cast("int")
    width = (F.col("hi") - F.col("lo")) / count
    number = F.when(width == 0, F.lit(0)).otherwise(F.floor((value - F.col("lo")) / width))
    counted = (
        with_group_rows(df.select(*by, column), ranges, by)
        .filter((value >= F.col("lo")) & (value <= F.col("hi")))
        .withColumn("bin", F.least(number, count - 1).cast("int"))
        .groupBy(*by, "bin")
        .agg(F.count("*").alias("n"))
    )
    frame = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), count - 1)))
    frame = frame.withColumns(
        {"bin_lo": F.col("lo") + F.col("bin") * width, "bin_hi": F.col("lo") + (F.col("bin") + 1) * width}
    )
    return join_groups(frame, counted, [*by, "bin"], "left").select(
        *by, "bin", "bin_lo", "bin_hi", F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )


def density(df: DataFrame, column: str, points: int = 200, by: Sequence[str] = (), cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density curve per group: ``point``, ``x`` and ``density`` on an equal grid.

    The bandwidth is Scott's, n^(-1/5) sample deviations, from one pass of moments; the grid reaches ``cut``
    bandwidths beyond the extremes. Every value is dealt to its two neighbours on the grid, in proportion to
    its distance (linear binning), so rows shrink to ``points`` weights a group before they are shuffled, and
    the kernel is summed over weights, whatever the number of rows. Missing values, NaN and infinities do not
    count; groups without two different values have no curve.
    """
    if points < 2:
        raise ValueError("a curve needs two points at least")
    number = F.col(column).cast("double")
    values = df.select(*by, F.when(F.abs(number) < F.lit(float("inf")), number).alias("_v")).filter("_v IS NOT NULL")
    moments = values.groupBy(*by).agg(
        F.count("_v").cast("double").alias("_n"), F.stddev_samp("_v").alias("_std"), F.min("_v").alias("_min"), F.max("_v").alias("_max")
    )
    width = F.col("_std") * F.pow(F.col("_n"), F.lit(-0.2))
    grid = moments.filter("_std > 0").select(*by, "_n", width.alias("_h"), (F.col("_min") - cut * width).alias("_lo"), (F.col("_max") + cut * width).alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(points - 1))
    grid = grid.withColumn("_step", step)
    place = (F.col("_v") - F.col("_lo")) / F.col("_step")
    left = F.least(F.floor(place).cast("int"), F.lit(points - 2))
    share = F.greatest(F.least(place - left, F.lit(1.0)), F.lit(0.0))
    # weights in whole billionths and millionths of these: sums don't depend on the order of rows
    right = F.round(share * 1e15).cast("long")
    weight = lambda w: [F.floor(w / 1_000_000).alias("_w"), F.pmod(w, F.lit(1_000_000)).alias("_rest")]
    halves = F.array(F.struct(left.alias("_at"), *weight(F.lit(10**15) - right)), F.struct((left + 1).alias("_at"), *weight(right)))
    dealt = with_group_rows(values, grid, by).select(*by, F.inline(halves))
    weights = dealt.groupBy(*by, "_at").agg((F.sum("_w") + F.sum("_rest") / 1_000_000).alias("_w"))
    binned = weights.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_at", "_w"))).alias("_bins"))
    curve = (join_groups(grid, binned, by) if by else with_one_row(grid, binned)).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))

    def add(total: Column, b: Column) -> Column:
        z = (F.col("point") - b["_at"]) * F.col("_step") / F.col("_h")
        return total + b["_w"].cast("double") * F.exp(z * z * -0.5)

    scale = F.col("_n") * 1e9 * F.col("_h") * F.lit(math.sqrt(2 * math.pi))
    return curve.select(
        *by, "point", (F.col("_lo") + F.col("point") * F.col("_step")).alias("x"), (F.aggregate("_bins", F.lit(0.0), add) / scale).alias("density")
    )


def price_level(df: DataFrame, category: str, price: str, strategy: str = "auto") -> DataFrame:
    """Median and sample deviation per category, without categories that have a single row."""
    spread = df.groupBy(category).agg(F.stddev_samp(price).alias("std"), F.count(price).alias("n"))
    level = quantiles(df, {"median": (price, 0.5, "linear")}, [category], strategy)
    return level.join(spread, category).filter("std IS NOT NULL")


def pair_stats(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Linear association of two numeric columns: correlation, slope and intercept, one pass."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*by).agg(
        F.count(F.when(a.isNotNull() & b.isNotNull(), 1)).alias("n"),
        F.corr(a, b).alias("corr"),
        F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"),
    )




def pair_bins(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Rows per cell of an equal-width grid over two numeric columns, for scatter plots; empty cells are left out.

    The ranges are the data's own; the last bin of either side is closed. Rows lacking a value do not count.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = df.select(a.alias("_x"), b.alias("_y")).filter("_x IS NOT NULL AND _y IS NOT NULL")
    ranges = both.agg(*[f(c).alias(f"{c}{n}") for c in ("_x", "_y") for f, n in ((F.min, "_lo"), (F.max, "_hi"))])

    def place(c: str) -> Column:
        width = (F.col(f"{c}_hi") - F.col(f"{c}_lo")) / F.lit(bins)
        number = F.when(width == 0, F.lit(0)).otherwise(F.floor((F.col(c) - F.col(f"{c}_lo")) / width))
        return F.least(number, F.lit(bins - 1)).cast("int")

    cells = with_one_row(both, ranges).select(place("_x").alias("x_bin"), place("_y").alias("y_bin"))
    return cells.groupBy("x_bin", "y_bin").agg(F.count("*").alias("n"))
