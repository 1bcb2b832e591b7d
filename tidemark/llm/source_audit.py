"""Source divergence audit: how far the word use of each source lies from its language and from the others.

Chunk factorization. A chunk is a run of bytes between the six ASCII blanks; no term crosses one. A task counts
the chunks of its documents and sums them per (lang, source) before anything is shuffled. Chunks are shuffled and
sorted by their bytes, so that each globally distinct chunk is split into terms once, where all its counts are;
its terms are joined to the counts there and summed per task before they are shuffled by (lang, term).

The number of documents with a term isn't a sum over chunks, as one document can hold the term in several. The
counts of a chunk with few documents in a task (fewer than the limit) therefore carry those documents. A term with
more in one count is kept for sure; the documents of all others are known one by one, and distinct ones counted.

Defined results: null text, lang and source are ''. Every row is a document, repeated rows and ids too. An
empty table gives no rows; a language without kept terms has pairs of value 0 and no terms. Other columns
are ignored whatever their names. A task holds some batches of texts, or one longer text, at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: What lies between terms: terms are runs of A-Z, a-z and everything from U+0080 on (fixed value).
NOT_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"

#: Documents of a language that a kept term needs, and terms reported for each group.
LEAST_DOCS = 10
TOP_TERMS = 10

#: Bytes of texts and counts of chunks that a task sums at once, rows of its batches, cells of a task's matrix of
#: terms by sources, and sources whose pairs one task adds up. They bound memory and change no result.
TEXT_BYTES = 16 << 20
COUNTS = 200_000
BATCH_ROWS = 2000
CELLS = 1 << 16
TILE = 512

CHUNKS = "chunk binary, lang string, source_key long, n long, some binary"
TERMS = "lang string, source_key long, term string, n long, low int, some array<long>"


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted keys."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), type=pa.int32()), pa.array(values, type=pa.int64()))


def _packed(values: np.ndarray, sizes: np.ndarray) -> pa.BinaryArray:
    """So many of the values for each row, as eight bytes each."""
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32) * 8
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values, dtype=np.int64))])


def _unpacked(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's values begin (and the last one's end), and all values."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return ends // 8, np.frombuffer(column.buffers()[2] or b"", dtype=np.int64, count=ends[-1] // 8)


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _together(batches: list[pa.RecordBatch]) -> dict[str, pa.Array]:
    table = pa.Table.from_batches(batches).combine_chunks()
    return {name: table.column(name).chunk(0) for name in table.column_names}


def _summed_chunks(batches: list[pa.RecordBatch], least: int) -> pa.RecordBatch:
    """Counts of the chunks of some documents for each (chunk, lang, source)."""
    docs = _together(batches)
    lang, langs = _codes(docs["lang"])
    source, sources = _codes(docs["source_key"])
    pair, group = np.unique(lang.astype(np.int64) * len(sources) + source, return_inverse=True)
    split = pc.ascii_split_whitespace(docs["text"])
    words, doc = split.flatten(), pc.list_parent_indices(split).cast(pa.int32())
    del split
    real = pc.greater(pc.binary_length(words), 0)
    words, doc = words.filter(real), doc.filter(real).to_numpy(zero_copy_only=False)
    keys, chunks = _codes(words)
    del words, real
    # one sort brings the occurrences in the order of (chunk, group, document)
    keys = keys.astype(np.int64)
    keys *= len(pair)
    keys += group[doc]
    keys *= len(group)
    keys += doc
    keys.sort()
    at = _starts(keys)
    times = np.diff(np.append(at, len(keys)))
    each, doc = np.divmod(keys[at], max(len(group), 1))
    del keys, at
    first = _starts(each)
    n_docs = np.diff(np.append(first, len(each)))
    chunk, group = np.divmod(each[first], max(len(pair), 1))
    del each
    few = n_docs < least
    some = docs["doc"].to_numpy(zero_copy_only=False)[doc[np.repeat(few, n_docs)]]
    return pa.RecordBatch.from_arrays(
        [
            chunks.take(pa.array(chunk)).cast(pa.binary()),
            langs.take(pa.array(pair[group] // max(len(sources), 1))),
            sources.take(pa.array(pair[group] % max(len(sources), 1))),
            pa.array(np.add.reduceat(times, first) if len(first) else times, type=pa.int64()),
            _packed(some, np.where(few, n_docs, 0)),
        ],
        names=["chunk", "lang", "source_key", "n", "some"],
    )


def chunk_counts(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """Counts per task: chunk, lang, source_key, n, and the documents if fewer than `least` (`some`, else empty)."""
    plain = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source", "text")}
    texts = docs.select(
        plain["lang"].alias("lang"),
        F.xxhash64(plain["source"]).alias("source_key"),
        plain["text"].alias("text"),
        F.monotonically_increasing_id().alias("doc"),
    )
    most = TEXT_BYTES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= most:
                yield _summed_chunks(held, least)
                held, size = [], 0
                pa.default_memory_pool().release_unused()
        if sum(len(b) for b in held):
            yield _summed_chunks(held, least)

    return texts.mapInArrow(count, CHUNKS)


class _Splitter:
    """Splits distinct chunks into terms; the last chunk of one call isn't split again at the start of the next."""

    def __init__(self) -> None:
        self.last: tuple[bytes, pa.Array] | None = None
        self.n_split = 0

    def terms(self, chunks: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """For chunks in ascending order: the place of its chunk for each term, and the terms."""
        known = self.last is not None and len(chunks) > 0 and chunks[0].as_py() == self.last[0]
        new = chunks.slice(1) if known else chunks
        self.n_split += len(new)
        parts = pc.split_pattern_regex(pc.ascii_lower(new.cast(pa.string())), pattern=NOT_TERM)
        words, place = parts.flatten(), pc.list_parent_indices(parts)
        real = pc.greater(pc.binary_length(words), 0)
        words, place = words.filter(real), place.filter(real).to_numpy(zero_copy_only=False).astype(np.int64)
        if known:
            words = pa.concat_arrays([self.last[1], words])
            place = np.concatenate((np.zeros(len(self.last[1]), dtype=np.int64), place + 1))
        if len(chunks):
            of_last = pa.array(place == len(chunks) - 1)
            self.last = (chunks[len(chunks) - 1].as_py(), words.filter(of_last))
        return place, words


def _summed_terms(batches: list[pa.RecordBatch], splitter: _Splitter, least: int) -> pa.RecordBatch:
    """Counts of some chunks in the order of their bytes, joined to their terms and summed per (lang, source, term)."""
    counts = _together(batches)
    row_chunk, chunks = _codes(counts["chunk"])
    place, words = splitter.terms(chunks)
    term, terms = _codes(words)
    term = term.astype(np.int64)
    # (chunk, term, k), in the order of the chunks
    keys = place * max(len(terms), 1) + term
    keys.sort()
    at = _starts(keys)
    k = np.diff(np.append(at, len(keys)))
    place, term = np.divmod(keys[at], max(len(terms), 1))
    begin = np.searchsorted(place, np.arange(len(chunks)))
    size = np.diff(np.append(begin, len(place)))

    # each count meets the terms of its chunk
    row = np.repeat(np.arange(len(row_chunk)), size[row_chunk])
    inner = np.arange(len(row)) - np.repeat(np.cumsum(size[row_chunk]) - size[row_chunk], size[row_chunk])
    entry = begin[row_chunk[row]] + inner
    lang, langs = _codes(counts["lang"])
    source, sources = _codes(counts["source_key"])
    group = (lang.astype(np.int64) * max(len(sources), 1) + source)[row] * max(len(terms), 1) + term[entry]
    order = np.argsort(group, kind="stable")
    group, row, entry = group[order], row[order], entry[order]
    first = _starts(group)
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(group))))
    n = counts["n"].to_numpy(zero_copy_only=False)[row] * k[entry]
    offsets, known = _unpacked(counts["some"])
    some_of = np.diff(offsets)[row]
    docs = np.where(some_of > 0, some_of, least)

    # distinct documents of each sum, as far as they are known one by one
    spot = np.repeat(offsets[row], some_of) + np.arange(some_of.sum()) - np.repeat(np.cumsum(some_of) - some_of, some_of)
    ids, code = np.unique(known[spot], return_inverse=True)
    seen = np.unique(np.repeat(owner, some_of) * max(len(ids), 1) + code)
    seen_owner, seen_id = np.divmod(seen, max(len(ids), 1))
    n_seen = np.bincount(seen_owner, minlength=len(first))
    low = np.maximum(np.maximum.reduceat(docs, first) if len(first) else docs, n_seen)
    open_ = low < least
    code = group[first] // max(len(terms), 1)
    return pa.RecordBatch.from_arrays(
        [
            langs.take(pa.array(code // max(len(sources), 1))),
            sources.take(pa.array(code % max(len(sources), 1))),
            terms.take(pa.array(group[first] % max(len(terms), 1))),
            pa.array(np.add.reduceat(n, first) if len(first) else n, type=pa.int64()),
            pa.array(np.minimum(low, least), type=pa.int32()),
            _lists(ids[seen_id[open_[seen_owner]]], np.where(open_, n_seen, 0)),
        ],
        names=["lang", "source_key", "term", "n", "low", "some"],
    )


def term_counts(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """Counts of terms per task: lang, source_key, term, n, at least `low` documents and, where low < least, which."""
    most = COUNTS

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, held, size = _Splitter(), [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= most:
                yield _summed_terms(held, splitter, least)
                held, size = [], 0
                pa.default_memory_pool().release_unused()
        if size:
            yield _summed_terms(held, splitter, least)

    return counts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(split, TERMS)


def kept_counts(sums: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source_key, term, n) of the terms that at least `least` documents of their language hold."""
    known = F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.size("some") > 0, F.col("some"))))))
    per_source = sums.repartition("lang", "term").groupBy("lang", "term", "source_key").agg(F.sum("n").alias("n"), F.max("low").alias("low"), known.alias("known"))
    # a document has one source, so the sources' documents add up
    docs = F.sum(F.greatest("low", "known")).over(Window.partitionBy("lang", "term"))
    return per_source.withColumn("docs", docs).filter(F.col("docs") >= least).select("lang", "source_key", "term", "n")


def _share(n: str, total: str, kept: str) -> Column:
    """p = 1 + floor(1e9 * (n + 2) / (total + 2 * kept)), exactly."""
    return F.expr(
        f"1L + (CAST(1000000000 AS DECIMAL(10,0)) * (CAST({n} AS DECIMAL(19,0)) + 2)) div "
        f"(CAST({total} AS DECIMAL(19,0)) + 2 * CAST({kept} AS DECIMAL(19,0)))"
    )


def _distance(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); shares are below 2^30, so the square fits a long."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each two sources of a language, summed over all its kept terms.

    A task holds the dense matrix of some terms by all sources of their language, and adds up the pairs of a tile
    of sources; a term that a source lacks has the source's share of a count of 0.
    """

    def sums(entries: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        names = sources["source"].to_numpy()
        place = {s: i for i, s in enumerate(names)}
        row, terms = pd.factorize(entries["term"])
        shares = np.repeat(sources["p0"].to_numpy(dtype="int64")[None, :], len(terms), axis=0)
        shares[row, entries["source"].map(place).to_numpy(dtype="int64")] = entries["p"].to_numpy(dtype="int64")
        none = np.array([], dtype=object)
        found = [pd.DataFrame({"lang": none, "source": none, "item": none, "value": none.astype("int64")})]
        for i in np.flatnonzero(sources["mine"].to_numpy(dtype=bool)):
            own = shares[:, [i]]
            value = ((shares - own) ** 2 // (shares + own)).sum(axis=0)
            others = np.arange(len(names)) != i
            found.append(pd.DataFrame({"lang": sources["lang"].iloc[0], "source": names[i], "item": names[others], "value": value[others]}))
        return pd.concat(found)

    block = F.pmod(F.xxhash64("term"), F.col("blocks"))
    entries = shares.withColumn("block", block).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    sides = (
        groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        .withColumn("mine", F.pmod(F.xxhash64("source"), F.col("tiles")) == F.col("tile"))
    )
    keys = ["lang", "block", "tile"]
    summed = (
        entries.select(*keys, "source", "term", "p")
        .groupBy(*keys)
        .cogroup(sides.select(*keys, "source", "p0", "mine").groupBy(*keys))
        .applyInPandas(sums, "lang string, source string, item string, value long")
    )
    return summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` rows for each other source, `term` rows for the top terms."""
    used = stored(kept_counts(term_counts(chunk_counts(docs, least), least), least), "kept-counts", BATCH_ROWS)
    each = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    each = each.withColumn("source_key", F.xxhash64("source"))
    of_lang = each.groupBy("lang").agg(F.count("*").alias("n_sources"))
    n_terms = used.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("n_terms"))
    of_lang = of_lang.join(n_terms, "lang", "left").fillna(0, ["n_terms"])
    totals = used.groupBy("lang", "source_key").agg(F.sum("n").cast("long").alias("total"))
    groups = each.join(totals, ["lang", "source_key"], "left").fillna(0, ["total"]).join(of_lang, "lang")
    cells = (F.col("n_terms") * F.col("n_sources")).cast("double")
    groups = groups.withColumns({
        "blocks": F.greatest(F.ceil(cells / CELLS), F.lit(1)).cast("long"),
        "tiles": F.ceil(F.col("n_sources") / TILE).cast("long"),
        "p0": F.when(F.col("n_terms") > 0, _share("0", "total", "n_terms")).otherwise(F.lit(1).cast("long")),
    })
    # two sources with one key would be counted as one: that stops the run
    twice = F.count("*").over(Window.partitionBy("lang", "source_key")) > 1
    groups = stored(groups.withColumn("p0", F.when(twice, F.raise_error(F.lit("two sources have one key"))).otherwise(F.col("p0"))), "groups")

    shares = used.join(groups.toDF(*groups.columns), ["lang", "source_key"]).withColumn("p", _share("n", "total", "n_terms"))
    lang_total = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("n_terms").alias("n_terms"))
    whole = used.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(lang_total, "lang")
    whole = whole.select("lang", "term", _share("n", "total", "n_terms").alias("q"))
    above = shares.select("lang", "source", "term", "p").join(whole, ["lang", "term"]).filter(F.col("p") > F.col("q"))
    terms = above.select("lang", "source", F.col("term").alias("item"), _distance("p", "q").alias("value"))
    return _ranked(_pairs(shares, groups), "pair").unionByName(_ranked(terms, "term").filter(F.col("rank") <= top))
