"""Exact percentiles for inputs of any size.

Every way gives the same answers: missing values and NaN are left out, infinities are values like any
other, and -0.0 is 0.0. Spark's percentile aggregates keep every distinct value of a group in one task,
so they serve only inputs that Catalyst estimates to be small, and columns whose values all come from one
small table, whatever a join multiplies its rows to. Small tables with a larger estimate, and columns of few values, are counted value by value
and sorted, which spills where an aggregate's map could not. Large tables are narrowed: rows are counted
per coarse band of values, only values of the bands that hold a wanted rank are shuffled, and the ranks
are followed through ever finer bands, so that no step needs more than a few thousand bands or values of
one group in one task. All plans are lazy.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .sizing import distinct_bytes, plan_bytes, small_limit, source_bytes

# alias -> (column, probability, "linear" or "disc")
Spec = Mapping[str, tuple[str, float, str]]

# Steps per power of two of the successive levels. A step holds 4096 of the next level's, and the last
# one 2 ** 12 different doubles at most.
_COARSE = 1 << 8
_LEVELS = {"fine": 1 << 20, "finer": 1 << 32, "finest": 1 << 40}
_NO_VALUE = -(1 << 62)
_INFINITE = 3000.0


def disc(column: str, p: float) -> Column:
    """Discrete percentile aggregate for a column with few distinct values."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{column}`)").cast("double")


def linear(column: str, p: float) -> Column:
    """Interpolated percentile aggregate for a column with few distinct values."""
    return F.percentile(F.col(column).cast("double"), F.lit(p))


def quantiles(df: DataFrame, spec: Spec, by: Sequence[str] = (), strategy: str = "auto", few_values: bool = False) -> DataFrame:
    """One row (per group) with one column per entry of ``spec``; missing values and NaN are ignored.

    ``auto`` takes Spark's percentile aggregates while the input is estimated to be small, or each column's
    distinct values are bounded by one small table; else it counts and sorts the values in one scan, if the tables read are small or the caller knows that the columns
    have ``few_values``; else it narrows in two scans. ``"builtin"``, ``"counting"`` and ``"narrowing"``
    force a way; all give the same answers.
    """
    for _, p, method in spec.values():
        if method not in ("linear", "disc") or not 0 <= p <= 1:
            raise ValueError("a percentile is (column, p in [0, 1], 'linear' or 'disc')")
    by = list(by)
    places = {c: f"_value_{i}" for i, c in enumerate(dict.fromkeys(c for c, _, _ in spec.values()))}
    values = df.select(*by, *[_number(c).alias(place) for c, place in places.items()])
    inner = {alias: (places[c], p, method) for alias, (c, p, method) in spec.items()}
    if strategy == "auto":
        limit = small_limit(df.sparkSession)
        sizes = distinct_bytes(values.select(*places.values())) if plan_bytes(values) > limit else []
        if all(size is not None and size <= limit for size in sizes):
            strategy = "builtin"
        else:
            strategy = "counting" if few_values or source_bytes(values) <= limit else "narrowing"
    if strategy == "builtin":
        return _builtin(values, inner, by)
    if strategy not in ("narrowing", "counting"):
        raise ValueError(f"unknown strategy {strategy!r}")
    return _by_rank(values, inner, by, narrow=strategy == "narrowing")


def _number(column: str) -> Column:
    """The value as every way sees it: NaN is missing, and there is one zero."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None)) + F.lit(0.0)


def _builtin(df: DataFrame, spec: Spec, by: Sequence[str]) -> DataFrame:
    """Percentile aggregates; interpolated ones on the same column share one value map."""
    shared: dict[str, list[float]] = {}
    for column, p, method in spec.values():
        if method == "linear" and p not in shared.setdefault(column, []):
            shared[column].append(p)
    places = {c: f"_points_{i}" for i, c in enumerate(shared)}
    aggs = [
        F.percentile(F.col(c), F.array(*[F.lit(p) for p in ps])).alias(places[c]) for c, ps in shared.items()
    ]
    aggs += [disc(c, p).alias(a) for a, (c, p, method) in spec.items() if method == "disc"]
    wide = df.groupBy(*by).agg(*aggs)
    answers = [
        F.col(places[c])[shared[c].index(p)].alias(a) if method == "linear" else F.col(a)
        for a, (c, p, method) in spec.items()
    ]
    return wide.select(*by, *answers)


def medians(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), strategy: str = "auto") -> DataFrame:
    return quantiles(df, {c: (c, 0.5, "linear") for c in columns}, by, strategy)


def _band(value: Column, resolution: int) -> Column:
    """A non-decreasing step function of the value with ``resolution`` steps per power of two.

    Missing values get a band of their own. The result is never NULL, so Catalyst adds no null
    filters below the value counts, and all levels read the same shuffle.
    """
    size = F.abs(value)
    power = F.floor(F.log2(size))
    position = F.when(size == math.inf, _INFINITE).otherwise(power + F.lit(1100) + (size / F.pow(F.lit(2.0), power) - 1))
    step = F.floor(position * resolution).cast("long")
    zero = F.lit(0).cast("long")
    return F.coalesce(F.when(value == 0, zero).when(value > 0, step).otherwise(-step), F.lit(_NO_VALUE))


def _targets(spec: Spec, item: Column, n: Column) -> Column:
    """The ranks to look up for one item of n values, each with its weight in the answer."""
    out = None
    for name in dict.fromkeys(c for c, _, _ in spec.values()):
        wanted = []
        for alias, (column, p, method) in spec.items():
            if column != name:
                continue
            exact_p = F.lit(Decimal(str(p)))
            if method == "disc":
                rank = F.greatest(F.ceil(exact_p * n.cast("decimal(20,0)")).cast("long"), F.lit(1).cast("long"))
                parts = [(rank, F.lit(1.0))]
            else:
                at = F.lit(float(p)) * (n - 1).cast("double")
                low, high = F.floor(at), F.ceil(at)
                same = low == high
                parts = [
                    (low + 1, F.when(same, F.lit(1.0)).otherwise(high - at)),
                    (high + 1, F.when(same, F.lit(0.0)).otherwise(at - low)),
                ]
            wanted += [
                F.struct(F.lit(alias).alias("alias"), rank.alias("rank"), weight.alias("weight"))
                for rank, weight in parts
            ]
        entry = F.array(*wanted)
        out = F.when(item == name, entry) if out is None else out.when(item == name, entry)
    return out


def _by_rank(df: DataFrame, spec: Spec, by: list[str], narrow: bool) -> DataFrame:
    items = list(dict.fromkeys(c for c, _, _ in spec.values()))
    key = F.struct(*by) if by else F.lit(0)
    cells = [F.struct(F.lit(c).alias("item"), F.col(c).alias("value")) for c in items]
    long = df.select(key.alias("key"), F.inline(F.array(*cells)))
    if narrow:
        hits, found = _narrowed(long, spec, bool(by))
    else:
        hits = _hits(long.groupBy("key", "item", "value").agg(F.count("value").alias("n")), spec, "value")
        found = hits.filter("alias IS NOT NULL")
    found = found.select("key", "alias", (F.col("weight") * F.col("value")).alias("part"))

    answers = [F.sum(F.when(F.col("alias") == a, F.col("part"))).alias(a) for a in spec]
    if not by:
        return found.agg(*answers)
    nothing = F.lit(None)
    empty = hits.filter("alias IS NULL").select(
        "key", nothing.cast("string").alias("alias"), nothing.cast("double").alias("part")
    )
    wide = found.unionByName(empty).groupBy("key").agg(*answers)
    return wide.select("key.*", *spec)


def _narrowed(long: DataFrame, spec: Spec, grouped: bool) -> tuple[DataFrame, DataFrame]:
    """The coarse bands that were hit, and the value at each wanted rank."""
    coarse = _band(F.col("value"), _COARSE).alias("coarse")
    # A few hundred bands per power of two: the counts shrink to that on the map side.
    hits = _hits(long.groupBy("key", "item", coarse).agg(F.count("value").alias("n")), spec, "coarse")
    chosen = hits.select("key", "item", "coarse").distinct()
    # Without groups there are at most two hits for each entry of the spec.
    side = (lambda rows: rows) if grouped else F.broadcast
    near = long.withColumn("coarse", coarse).join(side(chosen), ["key", "item", "coarse"], "left_semi")
    counts = near.groupBy("key", "item", "value").agg(F.count("value").alias("n"))
    counts = counts.select("*", coarse, *[_band(F.col("value"), steps).alias(name) for name, steps in _LEVELS.items()])
    found, on = hits.filter("alias IS NOT NULL"), ["coarse"]
    for name in _LEVELS:
        steps = counts.groupBy("key", "item", *on, name).agg(F.sum("n").alias("n"))
        found = _follow(steps, side(found), on, name)
        on = [*on, name]
    return hits, _follow(counts, side(found), on, "value")


def _hits(level: DataFrame, spec: Spec, order: str) -> DataFrame:
    """The row of ``level`` that holds each wanted rank, with the number of values below it.

    A group without any value yields one row without an alias.
    """
    group = W.partitionBy("key", "item")
    running = group.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    targets = F.when(F.col("total") > 0, _targets(spec, F.col("item"), F.col("total")))
    return (
        level.withColumn("upto", F.sum("n").over(running))
        .withColumn("total", F.sum("n").over(group))
        .select("*", F.explode_outer(targets).alias("t"))
        .filter("t IS NULL OR (t.weight > 0 AND t.rank > upto - n AND t.rank <= upto)")
        .select("key", "item", order, "t.alias", "t.rank", "t.weight", (F.col("upto") - F.col("n")).alias("below"))
    )


def _follow(level: DataFrame, found: DataFrame, on: list[str], order: str) -> DataFrame:
    """One step down: the row of the finer ``level`` that holds each wanted rank."""
    path = W.partitionBy("key", "item", "alias", "rank").orderBy(order)
    upto = F.col("below") + F.sum("n").over(path.rowsBetween(W.unboundedPreceding, W.currentRow))
    return (
        level.join(found, ["key", "item", *on])
        .withColumn("upto", upto)
        .filter("rank > upto - n AND rank <= upto")
        .withColumn("below", F.col("upto") - F.col("n"))
        .drop("n", "upto")
    )
