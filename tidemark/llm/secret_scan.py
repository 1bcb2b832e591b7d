"""Secret scans: fixed formats, and random-looking strings by two character Markov models."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.probability import bound

from .common import fresh

#: Characters the models tell apart; all others are one further symbol (fixed value).
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(ALPHABET) + 1

#: The formats (fixed values). `hex` and `access` need no look at lengths afterwards: a run that is too short
#: holds no longer one. `assign` does, as a match that fails still uses up its characters.
_KEYWORDS = "password|passwd|secret|token|api_?key"
_KEYWORD = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in _KEYWORDS)
ASSIGN = rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
MIN_VALUE = 6
KINDS = ("assign", "access", "hex", "markov")

_INSIDE = r"A-Za-z0-9+/_=-"
#: Transitions that the usual next symbol counts for.
_PRIOR = 5.0


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios of the transitions, random over identifier: STATES * STATES values, row by row."""

    ratios: tuple[float, ...]


@dataclass(frozen=True)
class Limits:
    """A string of at least min_length characters with a letter is a secret if its log-likelihood ratio is at
    least min_total, and at least min_mean for each transition."""

    min_length: int = 16
    min_total: float = 14.0
    min_mean: float = 0.8


def candidate_pattern(limits: Limits) -> str:
    """Whole runs of the alphabet with a letter; what they are made of otherwise is for the models to judge."""
    return rf"(?<![{_INSIDE}])(?=[0-9+/_=-]*+[A-Za-z])[{_INSIDE}]{{{limits.min_length},}}+"


def _codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.position(c, F.lit(ALPHABET)))


def _spans(text: Column, pattern: str, kind: str, keep: Callable[[Column], Column] | None = None, group: int = 0) -> Column:
    """Spans of all matches, leftmost first. What stands between matches gives their places.

    keep gets the text of the group of each match and says whether the match counts.
    """
    order = KINDS.index(kind)
    parts = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"),
        F.split(text, pattern, -1).alias("gap"),
    )
    none = F.array().cast("array<struct<start:int,order:int,end:int,kept:boolean>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["gap"])
        end = begin + F.length(part["m"])
        kept = F.lit(True) if keep is None else keep(part["g"])
        span = F.struct(begin.alias("start"), F.lit(order).alias("order"), end.alias("end"), kept.alias("kept"))
        # the last part is the text behind the last match
        return F.struct(
            F.coalesce(end, begin).alias("at"),
            F.when(part["m"].isNull(), state["found"]).otherwise(F.concat(state["found"], F.array(span))).alias("found"),
        )

    # A growing list is copied at every step. With n matches, lists of sqrt(n) are grown side by side from 0 on, and
    # moved to their places afterwards: the work is n * sqrt(n) where one list would take n * n.
    def places(parts: Column) -> Column:
        wide = F.ceil(F.sqrt(F.size(parts))).cast("int")
        runs = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / wide).cast("int")), lambda k: F.aggregate(F.slice(parts, k * wide + 1, wide), start, step)
        )
        return bound(moved, runs)

    def moved(runs: Column) -> Column:
        origin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(
            runs, origin,
            lambda s, run: F.struct((s["at"] + run["at"]).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")),
            lambda s: s["starts"],
        )
        shift = lambda span, by: F.struct((span["start"] + by).alias("start"), span["order"], (span["end"] + by).alias("end"), span["kept"])
        return F.flatten(F.zip_with(runs, starts, lambda run, by: F.transform(run["found"], lambda span: shift(span, by))))

    every = bound(places, parts)
    kept = F.transform(F.filter(every, lambda s: s["kept"]), lambda s: F.struct(s["start"], s["order"], s["end"]))
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast("array<struct<start:int,order:int,end:int>>"))


def base_spans(text: Column) -> Column:
    """Sorted spans (start, order of the kind, end; in code points, end exclusive) of the fixed formats."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(
        F.concat(
            _spans(text, ASSIGN, "assign", lambda value: F.length(value) >= MIN_VALUE, 2),
            _spans(text, ACCESS, "access"),
            _spans(text, HEX, "hex"),
        )
    )


def random_samples(spark: SparkSession, n: int) -> DataFrame:
    """n strings of each of four random makes, from digests of the numbers below n: column token."""
    number = F.col("id").cast("string")
    raw = F.unhex(F.sha2(number, 256))
    makes = F.array(
        F.md5(number),
        F.upper(F.md5(F.concat(number, F.lit("u")))),
        F.translate(F.base64(raw), "=", ""),
        F.translate(F.base64(F.unhex(F.sha2(F.concat(number, F.lit("b")), 512))), "+/=\r\n", "-_"),
    )
    return spark.range(n).select(F.explode(makes).alias("token"))


def word_samples(docs: DataFrame, text: str, doc_id: str, max_docs: int, max_chars: int) -> DataFrame:
    """Ordinary words and identifiers: the words outside base spans of about max_docs documents, chosen by hash.

    This sample only fits the model; of each sampled document max_chars characters are used.
    """
    total = docs.count()
    part = min(1.0, max_docs / total) if total else 1.0
    chosen = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit("words")), F.lit(1_000_000)) < F.lit(int(part * 1_000_000) + 1)
    pieces = docs.where(chosen).select(F.substring(F.coalesce(F.col(text), F.lit("")), 1, max_chars).alias("piece")).limit(2 * max_docs)
    plain = F.col("piece")
    for pattern in (ASSIGN, ACCESS, HEX):
        plain = F.regexp_replace(plain, pattern, " ")
    return pieces.select(F.explode(F.regexp_extract_all(plain, F.lit(f"[{_INSIDE}]{{3,}}+"), F.lit(0))).alias("token"))


def train(random: DataFrame, identifiers: DataFrame) -> Model:
    """Fit both models from labelled samples (column token): transition counts, smoothed by how often the next
    symbol comes at all, so that a symbol never seen before says as much as what follows it usually does.

    Only the counts, at most STATES * STATES of each label, come to the driver. Null and one-letter tokens teach
    nothing; with no sample at all every ratio is 0.
    """
    both = random.select("token", F.lit(1).alias("label")).unionAll(identifiers.select("token", F.lit(0).alias("label")))
    codes = both.select("label", _codes(F.col("token")).alias("c")).where(F.size("c") > 1)
    pairs = codes.select(
        "label",
        F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: a * STATES + b)).alias("pair"),
    )
    counts = [[0.0] * (STATES * STATES), [0.0] * (STATES * STATES)]
    for row in pairs.groupBy("label", "pair").count().collect():
        counts[row["label"]][row["pair"]] += row["count"]
    logs = []
    for table in counts:
        seen = [sum(table[b::STATES]) + 0.5 for b in range(STATES)]
        usual = [n / sum(seen) for n in seen]
        log = []
        for a in range(STATES):
            line = table[a * STATES : (a + 1) * STATES]
            total = sum(line) + _PRIOR
            log += [math.log((n + _PRIOR * usual[b]) / total) for b, n in enumerate(line)]
        logs.append(log)
    return Model(tuple(round(r - i, 4) for i, r in zip(*logs)))


def log_ratio(token: Column, model: Model) -> Column:
    """Log-likelihood ratio of a token: positive if it is more like a random string."""
    table = F.split(F.lit(",".join(map(str, model.ratios))), ",").cast("array<double>")  # a constant
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("before"))

    def step(state: Column, code: Column) -> Column:
        ratio = F.element_at(table, state["before"] * STATES + code + 1)
        return F.struct((state["sum"] + F.when(state["before"] >= 0, ratio).otherwise(0.0)).alias("sum"), code.alias("before"))

    return F.aggregate(_codes(token), start, step, lambda s: s["sum"])


def find(docs: DataFrame, model: Model, limits: Limits = Limits(), *, text: str = "text", base: str = "base_spans", extra: str = "markov_spans") -> DataFrame:
    """Adds two columns of sorted spans: those of the formats, and the models' own that overlap none of them.

    A null text is empty and has no spans; an empty table stays empty; repeated rows are scanned one by one; columns that
    are called as the added ones are replaced.
    """
    docs = docs.drop(base, extra)

    def secret(token: Column) -> Column:
        ratio = log_ratio(token, model)
        return (ratio >= limits.min_total) & (ratio >= limits.min_mean * (F.length(token) - 1))

    found = docs.withColumn(base, base_spans(F.col(text)))
    random = _spans(F.coalesce(F.col(text), F.lit("")), candidate_pattern(limits), "markov", secret)
    return found.withColumn(extra, bound(_clear_of, random, F.col(base), F.length(F.coalesce(F.col(text), F.lit("")))))


def _clear_of(spans: Column, others: Column, length: Column) -> Column:
    """The spans that overlap none of the others. The text is cut into about as many stretches as the square root of the
    others' number, and a span is held against those of its own stretches only."""

    def kept(spans: Column, others: Column, wide: Column, count: Column) -> Column:
        near = F.transform(
            F.sequence(F.lit(0), count - 1), lambda k: F.filter(others, lambda b: (b["start"] < (k + 1) * wide) & (b["end"] > k * wide))
        )
        return bound(lambda spans, wide, near: F.filter(spans, lambda s: ~hit(s, wide, near)), spans, wide, near)

    def hit(s: Column, wide: Column, near: Column) -> Column:
        first, last = F.floor(s["start"] / wide).cast("int"), F.floor((s["end"] - 1) / wide).cast("int")
        return F.exists(F.slice(near, first + 1, last - first + 1), lambda some: F.exists(some, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    count = F.greatest(F.ceil(F.sqrt(F.size(others))), F.lit(1)).cast("int")
    wide = F.floor(length / count).cast("int") + 1
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(bound(kept, spans, others, wide, count))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["order"] + 1), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def redact(docs: DataFrame, model: Model, limits: Limits = Limits(), *, text: str = "text", length: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """The rows of `docs` with every span, overlapping ones together, replaced by `mark`.

    `length`, if `docs` has it, becomes the new length of texts that changed. Other rows and columns stay.
    """
    base, extra, spans, new = (fresh(docs, x) for x in ("_base", "_markov", "_spans", "_new"))
    found = find(docs, model, limits, text=text, base=base, extra=extra)
    found = found.withColumn(spans, F.array_sort(F.concat(base, extra))).drop(base, extra)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        piece = F.concat(F.substring(F.col(text), state["at"] + 1, s["start"] - state["at"]), F.lit(mark))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.concat(state["out"], F.when((s["start"] >= state["at"]), piece).otherwise("")).alias("out"),
        )

    whole = F.aggregate(
        spans, start, step, lambda s: F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, F.length(F.col(text))))
    )
    hit = F.size(spans) > 0
    result = found.withColumn(new, F.when(hit, whole).otherwise(F.col(text)))
    columns = []
    for name in docs.columns:
        if name == text:
            columns.append(F.col(new).alias(name))
        elif name == length:
            kind = docs.schema[name].dataType
            columns.append(F.when(hit, F.length(new).cast(kind)).otherwise(F.col(name)).alias(name))
        else:
            columns.append(F.col(name))
    return result.select(*columns)


def trained_on(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", max_docs: int = 2000, max_chars: int = 20_000, n_random: int = 5000) -> Model:
    """The model from generated random strings and the ordinary words of a bounded sample of `docs`."""
    return train(random_samples(docs.sparkSession, n_random), word_samples(docs, text, doc_id, max_docs, max_chars))
