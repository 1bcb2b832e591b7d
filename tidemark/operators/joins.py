"""Joins of facts to lookup sides, members, one-row and per-group figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


#: A column that only joins use: a second join key that follows from the first ones.
_SECOND = "_second_key"


def lookup_join(
    fact: DataFrame, dim: DataFrame, on: str | Sequence[str], how: str = "inner", grouped: bool = False, null_keys: bool = False
) -> DataFrame:
    """Join a fact table to a lookup side; ``how`` is inner, left, left_semi or left_anti.

    The plan is Catalyst's own for every size: pruned and filtered scans, a broadcast where the lookup
    side is under the session's threshold (by estimate, or by its real size at run time), else a sorted
    join whose hot keys adaptive execution splits on the fact side, where all four kinds allow it. A key
    is hot by the sizes of the shuffled partitions, not by a share of the rows.

    Adaptive execution can only split between an exchange and the join. A lookup side that is an aggregate
    or distinct on the very join keys (``grouped``) has none there of its own, so both sides get a second
    key, a hash of the others: it changes no match, but the aggregate's partitioning no longer serves the
    join and its few rows are exchanged once more. With ``null_keys`` missing keys match each other.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"lookup_join cannot keep the unmatched side of {how!r}")
    keys = [on] if isinstance(on, str) else list(on)
    if not grouped and not null_keys:
        return fact.join(dim, keys, how)
    names = {k: f"_{k}_of_lookup" for k in keys}
    left, right, same = fact, dim.withColumnsRenamed(names), F.lit(True)
    if grouped:
        left = left.withColumn(_SECOND, F.xxhash64(*keys))
        right = right.withColumn(f"{_SECOND}_", F.xxhash64(*names.values()))
        same = F.col(_SECOND) == F.col(f"{_SECOND}_")
    for k, other in names.items():
        same = same & (null_safe(F.col(k), F.col(other)) if null_keys else F.col(k) == F.col(other))
    return left.join(right, same, how).drop(_SECOND, f"{_SECOND}_", *names.values())


def keep_members(fact: DataFrame, members: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``members`` (SQL ``IN``); never multiplies rows."""
    keys = [on] if isinstance(on, str) else list(on)
    return lookup_join(fact, members.select(*keys).distinct(), keys, "left_semi", grouped=True)


def match_flag(left: DataFrame, right: DataFrame, on: str | Sequence[str], name: str = "matched") -> DataFrame:
    """All left rows with 1 when their key occurs on the right, else 0."""
    keys = [on] if isinstance(on, str) else list(on)
    probe = right.select(*keys).distinct().withColumn("_hit", F.lit(1))
    joined = lookup_join(left, probe, keys, "left", grouped=True)
    return joined.withColumn(name, F.coalesce("_hit", F.lit(0))).drop("_hit")


def with_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row relation (the result of an aggregate without keys) to every row."""
    return df.crossJoin(F.broadcast(one_row))


#: Per-group figures are broadcast while they are at most so many groups and bytes (of their text form).
GROUP_ROWS = 50_000
GROUP_BYTES = 8 * 1024 * 1024


def with_group_rows(df: DataFrame, stats: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Attach per-group statistics to the rows of their group; missing group keys match each other.

    No ``by``: ``stats`` is one row. Rows of groups without statistics are dropped, or kept with ``how``
    left.

    Groups are few as a rule, so that shuffling the rows by their group would leave most tasks idle. The
    figures are therefore counted first, in the plan itself: while they are within GROUP_ROWS and
    GROUP_BYTES they are broadcast and the rows stay where they are, else the sides are shuffled. Both ways
    stand in the plan, each behind a one-row gate; adaptive execution removes the one whose gate is empty
    before it reads anything.
    """
    if not by:
        return with_one_row(df, stats)
    names = {k: f"_{k}_of_group" for k in by}
    side = stats.withColumnsRenamed(names)
    same = F.lit(True)
    for k, other in names.items():
        same = same & null_safe(F.col(k), F.col(other))
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*side.columns)))), F.lit(0))
    gate = side.agg((size <= GROUP_BYTES).alias("_small"), F.count("*").alias("_groups"))
    few = F.col("_small") & (F.col("_groups") <= GROUP_ROWS)
    near = with_one_row(df, gate.filter(few).select()).join(F.broadcast(side.limit(GROUP_ROWS)), same, how)
    far = with_one_row(df, gate.filter(~few).select()).join(side, same, how)
    return near.unionByName(far).drop(*names.values())


def join_groups(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join of two grouped results on their group; missing group keys match each other."""
    return lookup_join(left, right, by, how, null_keys=True)


def align_groups(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Full outer join of two grouped results, one row per label of either side."""
    return left.join(right, on, "full_outer")


def join_renamed(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left", suffix: str = "_r", null_keys: bool = False
) -> DataFrame:
    """Lookup join on differently named keys; clashing right columns get ``suffix``.

    Missing keys match nothing, or each other with ``null_keys``.
    """
    clash = {c: c + suffix for c in right.columns if c in left.columns}
    side = right.withColumnsRenamed(clash)
    right_name = clash.get(right_key, right_key)
    probe = side.withColumn("_key", F.col(right_name))
    return lookup_join(left.withColumn("_key", F.col(left_key)), probe, "_key", how, null_keys=null_keys).drop("_key")


def null_safe(left: Column, right: Column) -> Column:
    """Equality that also matches two missing keys."""
    return left.eqNullSafe(right)
