"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, running_total, stored, word_count


def rank_cycle_weights(sources: DataFrame, source: str, cycle: Sequence[int]) -> DataFrame:
    """Weights that repeat along the sources in code point order, null last: columns `source`, weight."""
    ranked = running_total(sources.select(source, F.lit(1).alias("_one")), [source], "_one", "_rank", name="source-rank")
    place = F.element_at(F.array(*[F.lit(int(w)) for w in cycle]), F.pmod(F.col("_rank") - 1, F.lit(len(cycle))).cast("int") + 1)
    return ranked.select(source, place.alias("weight"))


def fill_targets(sources: DataFrame, budget: float, cap: float) -> DataFrame:
    """Adds `target`: budget shared by `weight`, at most cap * `source_size`; what is over the cap is reshared.

    The level (budget per unit of weight) is raised until no target is above its cap: every round is one
    aggregate over the sources, and each round but the last caps at least one more source.
    """
    ceiling = cap * F.col("source_size")
    level, capped = 0.0, -1
    while True:
        full = ceiling <= level * F.col("weight")
        row = sources.agg(
            F.count_if(full).alias("n"),
            F.sum(F.when(full, F.col("source_size"))).alias("size"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
        ).first()
        if not row["weight"]:
            return sources.withColumn("target", ceiling.cast("double"))
        if row["n"] == capped:
            return sources.withColumn("target", F.least(ceiling.cast("double"), F.lit(level) * F.col("weight")))
        capped, level = row["n"], (budget - cap * (row["size"] or 0)) / row["weight"]


def mix(
    sized: DataFrame, targets: DataFrame, *, seed: str = "mix", passes: int = 2, doc_id: str = "doc_id", source: str = "source", size: str = "size",
) -> DataFrame:
    """Adds source_size, target and taken to the rows of `sized` (doc_id, source, size and any others).

    The documents of a source stand in one shuffled order (by md5 of seed and doc_id), repeated `passes` times. A
    copy's virtual finish time is the words of its source up to and with it, divided by the source's target. All
    copies are sorted by that time over all sources, and the mix ends with the last copy that fits the total of
    the targets. taken is the words of a document's copies in the mix.

    Documents without words take nothing. Null sources form a source. Rows that agree in source, doc_id and size
    share one finish time (that of the last of them is theirs) and are taken together. Columns that are called as the
    added ones are replaced.
    """
    sized = sized.drop("source_size", "target", "taken")
    place = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    # rows that agree are summed, so that ties need no order
    alike = sized.groupBy(F.col(source).alias("_source"), place.alias("_place"), F.col(doc_id).alias("_id"), F.col(size).alias("_size")).agg(
        (F.count(F.lit(1)) * F.first(F.col(size))).alias("_words")
    )
    lined = running_total(alike, ["_source", "_place", "_id", "_size"], "_words", "_upto", within="_source", name="line")
    shares = targets.select(F.col(source).alias("_of"), "source_size", "target")
    lined = stored(
        lined.join(shares, F.col("_source").eqNullSafe(F.col("_of")), "left").select(
            "_source", "_place", "_id", "_size", "_words", "_upto", "source_size", "target"
        ),
        "lined",
    )
    copies = lined.where((F.col("_words") > 0) & (F.col("target") > 0)).select(
        F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("_pass"), "*"
    )
    finish = (F.col("_pass") * F.col("source_size") + F.col("_upto")) / F.col("target")
    queue = copies.select(finish.alias("_finish"), "_source", "_place", "_id", "_size", "_pass", "_words")
    order = ["_finish", "_source", "_place", "_id", "_size", "_pass"]
    queue = running_total(queue, order, "_words", "_queued", name="queue")
    budget = targets.agg(F.sum("target").alias("budget"))
    cut = (
        queue.crossJoin(F.broadcast(budget))  # one row
        .where(F.col("_queued") <= F.round("budget"))
        .agg(F.max("_finish").alias("cut"))
        .first()["cut"]
    )
    taken = F.lit(0)
    for k in range(passes):
        done = (F.lit(k) * F.col("source_size") + F.col("_upto")) / F.col("target")
        taken = taken + F.when((F.col("target") > 0) & (done <= F.lit(cut)), F.col("_size")).otherwise(F.lit(0))
    decided = lined.select("_source", "_place", "_id", "_size", "source_size", "target", taken.cast("long").alias("taken"))
    given = sized.withColumn(fresh(sized, "_at"), place)
    same = (
        given[source].eqNullSafe(decided["_source"])
        & (given[given.columns[-1]] == decided["_place"])
        & given[doc_id].eqNullSafe(decided["_id"])
        & given[size].eqNullSafe(decided["_size"])
    )
    return given.join(decided, same, "left").select(*[given[c] for c in sized.columns], *[decided[c] for c in ("source_size", "target", "taken")])


def mix_documents(
    docs: DataFrame, *, cycle: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2, seed: str = "mix",
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken.

    Sources weigh `cycle`, repeating, in code point order; together they get `share` of all words, and no source
    more than `cap` times its own. A null text has no words. An empty table gives an empty result.
    """
    sized = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "sized")
    return mix(sized, cycle_targets(sized, cycle, share, cap), seed=seed, passes=int(cap))


def cycle_targets(sized: DataFrame, cycle: Sequence[int], share: float, cap: float) -> DataFrame:
    """source, source_size, weight and target of every source of `sized` (source, size)."""
    sums = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    weights = rank_cycle_weights(sums, "source", cycle).withColumnRenamed("source", "_s")
    weighted = stored(sums.join(weights, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "weights")
    total = sums.agg(F.sum("source_size")).first()[0] or 0
    return fill_targets(weighted, share * total, cap)


def mixed(
    docs: DataFrame, *, cycle: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2, seed: str = "mix",
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """The rows of `docs` that `mix_documents` takes, with size, source_size, target and taken (columns of these names are
    replaced): a document that the mix takes twice has twice its size taken."""
    given = docs.drop("size", "source_size", "target", "taken").withColumn("size", word_count(F.col(text)))
    sized = stored(given.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), "size"), "sized")
    targets = cycle_targets(sized, cycle, share, cap).withColumnRenamed("source", source)
    return mix(given, targets, seed=seed, passes=int(cap), doc_id=doc_id, source=source).where(F.col("taken") > 0)
