"""Conversation prefix trie over padded turn-id matrices.

Every conversation is a path of turn ids (the first 16 bytes of a SHA-256 over role and text). Paths are
range-sorted with the conversation's id behind them, so that all members of a node are neighbours and a path that
very many share still splits between tasks. A task takes its paths in runs of bounded size. A run becomes matrices
of small turn ids, some depths wide and padded with 0; numpy's lexsort orders their rows, a mask of changed columns,
OR-accumulated from left to right, marks where nodes start, and reduceat aggregates each depth.

A node that holds the first or last path of a run may go on in the next one. Such nodes (two paths a run, no more)
are handed on as partial sums under a digest of their path, and added up. All sums count a node where it starts:
within a partition a run knows the path before it, and for the first path of each partition the part that it shares
with the path before is taken off afterwards, from one row per partition.

Defined results: rows without conv_id belong to no conversation and are left out. Turns are ordered by turn (null
first), role, text (null is empty); repeated rows are turns of their own. No conversations give no rows; without
any turn there is the root alone. Other columns are ignored whatever their names. A conversation's path (16 bytes
a turn) must fit in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, stored

ID_BYTES = 16
#: Conversations that take their first turns from one, and one more than the turns that they can take (fixed values).
FAMILY, HEADS = 20, 4

#: Bytes of paths in a run, depths of a matrix, ids of a piece of a node's list, and rows of a batch. They bound
#: memory and change no result.
RUN_BYTES = 2 << 20
DEPTHS = 32
PIECE_IDS = 4096
BATCH_ROWS = 2000

NO_ENDS = hashlib.sha256(b"").digest()
SUMS = ("n_convs", "n_children", "n_nodes", "n_parents", "saved")
SHAPE = (
    "kind string, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, first_id long, "
    + ", ".join(f"{c} long" for c in SUMS)
    + ", words long, ends binary, path binary, last_path binary, last_id long, path_words array<long>"
)


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path, words): each conversation as it is given, ids of its turns joined and words of each."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text")
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256), 1, 2 * ID_BYTES))
    words = F.regexp_count("text", F.lit(WORD)).cast("long")
    numbered = named.select("conv_id", place.alias("place"), digest.alias("id"), words.alias("words"))
    rows = F.array_sort(F.collect_list(F.struct("place", "id", "words")))
    return numbered.groupBy("conv_id").agg(rows.alias("t")).select("conv_id", *_joined(F.col("t")))


def _joined(rows: Column) -> tuple[Column, Column]:
    ids = F.transform(rows, lambda r: F.hex(r["id"]))
    return F.unhex(F.array_join(ids, "")).alias("path"), F.transform(rows, lambda r: r["words"]).alias("words")


def rebuilt(given: DataFrame) -> DataFrame:
    """Each conversation with the first turns of its family's first one in place of its own."""
    heads = given.filter(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("head_id"),
        F.expr(f"substring(path, 1, {(HEADS - 1) * ID_BYTES})").alias("head_path"),
        F.slice("words", 1, HEADS - 1).alias("head_words"),
    )
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEADS)).cast("int")
    joined = given.withColumn("head_id", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", h).join(heads, "head_id", "left")
    none = F.lit(None)
    path = F.concat(
        F.coalesce(F.expr(f"substring(head_path, 1, h * {ID_BYTES})"), F.unhex(F.lit(""))),
        F.expr(f"substring(path, h * {ID_BYTES} + 1)"),
    )
    own = F.slice("words", F.col("h") + 1, F.greatest(F.size("words"), F.lit(1)))
    head = F.when(F.col("head_words").isNotNull() & (F.col("h") > 0), F.slice("head_words", 1, F.greatest(F.col("h"), F.lit(1)))).otherwise(none)
    return joined.select("conv_id", path.alias("path"), F.concat(F.coalesce(head, F.array().cast("array<long>")), own).alias("words"))


def _turn_ids(raw: bytes) -> np.ndarray:
    """Small numbers from 1 on, equal for equal ids of turns."""
    halves = np.frombuffer(raw, dtype=np.uint64).reshape(-1, 2)
    order = np.lexsort(halves.T)
    ordered = halves[order]
    ids = np.ones(len(halves), dtype=np.int32)
    ids[order[1:]] += np.cumsum((ordered[1:] != ordered[:-1]).any(axis=1), dtype=np.int32)
    return ids


def _shared(a: bytes, b: bytes) -> int:
    """Number of turns that two paths have in common at their start."""
    n = min(len(a), len(b)) // ID_BYTES
    x, y = (np.frombuffer(p, dtype=np.uint8, count=n * ID_BYTES).reshape(n, ID_BYTES) for p in (a, b))
    differ = np.flatnonzero((x != y).any(axis=1))
    return int(differ[0]) if len(differ) else n


def _prefix_keys(path: bytes) -> list[bytes]:
    """Digest of each prefix of a path, the empty one first."""
    h = hashlib.sha256()
    keys = [h.digest()]
    for k in range(0, len(path), ID_BYTES):
        h.update(path[k : k + ID_BYTES])
        keys.append(h.copy().digest())
    return keys


class _Level(NamedTuple):
    """The nodes of one depth in one run. A node's rows are neighbours in the run, from `first` to before `end`."""

    first: np.ndarray
    end: np.ndarray
    conv: np.ndarray  # smallest member
    parent: np.ndarray  # place in the level above
    words: np.ndarray
    ends: np.ndarray  # paths that end here


def _levels(ids: np.ndarray, conv: np.ndarray, words: np.ndarray, begin: np.ndarray, length: np.ndarray) -> Iterator[_Level]:
    """Nodes depth by depth. Only rows that reach a depth take part in its matrix."""
    alive = np.arange(len(conv))
    node = np.zeros(len(conv), dtype=np.int64)  # of each alive row, at the depth before
    yield _Level(np.array([0]), np.array([len(conv)]), np.array([conv.min()]), np.array([-1]), np.array([0]), np.array([np.count_nonzero(length == 0)]))
    depth = 0
    while True:
        stay = length[alive] > depth
        alive, node = alive[stay], node[stay]
        if not len(alive):
            return
        reach = length[alive]
        wide = int(min(DEPTHS, reach.max() - depth))
        # the padded matrix of this part: 0 stands behind a path's end
        at = begin[alive][:, None] + depth + np.arange(wide)
        inside = np.arange(wide)[None, :] < (reach - depth)[:, None]
        matrix = np.where(inside, ids[np.where(inside, at, 0)], 0)
        order = np.lexsort((*matrix.T[::-1], node))
        # rows come in the order of their paths and lexsort is stable, so each node's rows stay neighbours
        alive, node, matrix, inside, at, reach = (x[order] for x in (alive, node, matrix, inside, at, reach))
        changed = np.concatenate(([True], node[1:] != node[:-1]))
        masks = np.empty(matrix.shape, dtype=bool)
        masks[0] = True
        masks[1:] = matrix[1:] != matrix[:-1]
        masks[:, 0] |= changed
        masks = np.logical_or.accumulate(masks, axis=1)
        for k in range(wide):
            held = np.flatnonzero(inside[:, k])
            starts = np.flatnonzero(masks[held, k])
            of = np.cumsum(masks[held, k]) - 1
            rows = alive[held]
            yield _Level(
                np.minimum.reduceat(rows, starts),
                np.maximum.reduceat(rows, starts) + 1,
                np.minimum.reduceat(conv[rows], starts),
                node[held[starts]],
                words[at[held[starts], k]],
                np.add.reduceat((reach[held] == depth + k + 1).astype(np.int64), starts),
            )
            node = np.full(len(alive), -1, dtype=np.int64)
            node[held] = of
        depth += wide


def _run_rows(conv: np.ndarray, path: list[bytes], words: list[np.ndarray], before: bytes | None) -> Iterator[pd.DataFrame]:
    """Finished nodes and partial sums of one run; `before` is the path in front of it, if any is known."""
    length = np.array([len(p) // ID_BYTES for p in path])
    begin = np.cumsum(length) - length
    ids = _turn_ids(b"".join(path))
    flat = np.concatenate([*words, np.zeros(1, dtype=np.int64)]).astype(np.int64)
    shared = -1 if before is None else _shared(before, path[0])
    # whether a path ends where the one before the run ended decides if a node gets its first child here
    before_depth = -1 if before is None else len(before) // ID_BYTES
    levels = list(_levels(ids, conv, flat, begin, length))
    n_rows = len(conv)

    sums: list[dict[str, np.ndarray]] = []
    for d, level in enumerate(levels):
        n = level.end - level.first
        new = ~((level.first == 0) & (d <= shared))
        sums.append({
            "n_convs": n,
            "n_children": np.zeros(len(n), np.int64),
            "n_nodes": new.astype(np.int64),
            "n_parents": np.zeros(len(n), np.int64),
            "saved": (n - new) * level.words,
            "new": new,
        })
    for d in range(len(levels) - 1, 0, -1):
        level, own, up = levels[d], sums[d], sums[d - 1]
        np.add.at(up["n_children"], level.parent, own["new"])
        # a parent counts where its first child starts: nothing but paths that end in it come before
        opener = np.zeros(len(up["n_children"]), dtype=bool)
        opener[level.parent] = True
        # the run's first row may continue a parent that had children before the run
        if shared >= d - 1 and before_depth > d - 1:
            opener[levels[d - 1].first == 0] = False
        up["n_parents"] += opener
        for c in ("n_nodes", "n_parents", "saved"):
            np.add.at(up[c], level.parent, own[c])

    keys = [_prefix_keys(path[0]), _prefix_keys(path[-1])]
    found: dict[str, list[np.ndarray]] = {c: [] for c in ("kind", "key", "parent_key", "depth", "conv_id", "parent_conv_id", *SUMS, "words", "ends")}
    pieces = []
    for d, (level, own) in enumerate(zip(levels, sums, strict=True)):
        open_ = (level.first == 0) | (level.end == n_rows)
        up = levels[d - 1] if d else None
        up_open = (up.first == 0) | (up.end == n_rows) if d else np.zeros(1, bool)
        key = np.full(len(level.first), None, dtype=object)
        parent_key = np.full(len(level.first), None, dtype=object)
        if d < len(keys[0]):
            key[level.first == 0] = keys[0][d]
        if d < len(keys[1]):
            key[level.end == n_rows] = keys[1][d]
        if d:
            for i in np.flatnonzero(up_open[level.parent]):
                parent_key[i] = (keys[0] if up.first[level.parent[i]] == 0 else keys[1])[d - 1]
        ends = np.full(len(level.first), NO_ENDS, dtype=object)
        for i in np.flatnonzero(level.ends):
            # paths that end in a node come first among its rows, in the order of their ids
            own_ids = conv[level.first[i] : level.first[i] + level.ends[i]]
            if open_[i]:
                for k in range(0, len(own_ids), PIECE_IDS):
                    part = own_ids[k : k + PIECE_IDS]
                    pieces.append((key[i], int(part[0]), ",".join(map(str, part)).encode()))
            else:
                ends[i] = hashlib.sha256(",".join(map(str, own_ids)).encode()).digest()
        columns = {
            "kind": np.where(open_, "part", "node"),
            "key": key,
            "parent_key": parent_key,
            "depth": np.full(len(key), d),
            "conv_id": level.conv,
            "parent_conv_id": up.conv[level.parent] if d else np.array([-1]),
            **{c: own[c] for c in SUMS},
            "words": level.words,
            "ends": ends,
        }
        for c, values in columns.items():
            found[c].append(values)
    yield pd.DataFrame({c: np.concatenate(values) for c, values in found.items()})
    if pieces:
        key, first_id, text = zip(*pieces, strict=True)
        yield pd.DataFrame({"kind": "ends", "key": key, "first_id": first_id, "ends": text})


_COLUMNS = [c.split()[0] for c in SHAPE.split(", ")]


def _framed(df: pd.DataFrame) -> pd.DataFrame:
    whole = {c: df[c] if c in df else pd.Series([None] * len(df), dtype=object) for c in _COLUMNS}
    return pd.DataFrame(whole, columns=_COLUMNS)


def _partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, path, words, size = [], [], [], 0
    first = before = None

    def run() -> Iterator[pd.DataFrame]:
        for rows in _run_rows(np.array(conv, dtype=np.int64), path, words, before):
            yield _framed(rows)

    for batch in batches:
        for c, p, w in zip(batch["conv_id"], batch["path"], batch["words"], strict=True):
            if first is None:
                first = (bytes(p), int(c), w)
            conv.append(c)
            path.append(bytes(p))
            words.append(np.asarray(w, dtype=np.int64))
            size += len(p) + 64
            if size >= RUN_BYTES:
                yield from run()
                before, last_id = path[-1], int(conv[-1])
                conv, path, words, size = [], [], [], 0
    if conv:
        yield from run()
        before, last_id = path[-1], int(conv[-1])
    if first is not None:
        edge = {"kind": ["edge"], "path": [first[0]], "first_id": [first[1]], "last_path": [before], "last_id": [last_id], "path_words": [first[2]]}
        yield _framed(pd.DataFrame(edge))


def _corrections(edges: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each partition counted twice: the part of its first path that the path before it has too."""
    for batch in edges:
        for path, words, before in zip(batch["path"], batch["path_words"], batch["before"], strict=True):
            if before is None:
                continue
            path, before = bytes(path), bytes(before)
            shared = _shared(before, path)
            keys = _prefix_keys(path)[: shared + 1]
            own_words = np.concatenate(([0], np.asarray(words, dtype=np.int64)[:shared]))
            # nodes of the shared part, and those of them that had a child before and get one here
            depth = np.arange(shared + 1)
            parents = ((depth < len(before) // ID_BYTES) & (depth < len(path) // ID_BYTES)).astype(np.int64)
            below = lambda x: np.cumsum(x[::-1])[::-1]
            yield pd.DataFrame({
                "key": keys,
                "n_convs": np.zeros(shared + 1, np.int64),
                "n_children": -(depth < shared).astype(np.int64),
                "n_nodes": -below(np.ones(shared + 1, np.int64)),
                "n_parents": -below(parents),
                "saved": below(own_words),
            })


def _digests(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's pieces, which come one after another."""
    key, h = None, None
    done: list[tuple[bytes, bytes]] = []
    for batch in pieces:
        for k, text in zip(batch["key"], batch["ends"], strict=True):
            k, text = bytes(k), bytes(text)
            if k == key:
                h.update(b"," + text)
                continue
            if key is not None:
                done.append((key, h.digest()))
            key, h = k, hashlib.sha256(text)
        if done:
            yield pd.DataFrame(done, columns=["key", "all_ends"])
            done = []
    if key is not None:
        yield pd.DataFrame([(key, h.digest())], columns=["key", "all_ends"])


def nodes(conversations: DataFrame) -> DataFrame:
    """All nodes of the trie over (conv_id, path, words): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    table = stored(conversations, "paths", BATCH_ROWS)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = table.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    rows = stored(ordered.mapInPandas(_partition, SHAPE), "trie-rows", BATCH_ROWS)

    edges = rows.filter("kind = 'edge'").select("path", "first_id", "last_path", "last_id", "path_words")
    # one row per partition
    ahead = edges.withColumn("before", F.lag("last_path").over(Window.orderBy("path", "first_id"))).filter(F.col("before").isNotNull())
    twice = ahead.select("path", "path_words", "before").mapInPandas(_corrections, "key binary, " + ", ".join(f"{c} long" for c in SUMS))
    partial = rows.filter("kind = 'part'").select("key", "parent_key", "depth", "conv_id", "words", *SUMS)
    missing = {c: F.lit(None).cast(t) for c, t in (("parent_key", "binary"), ("depth", "long"), ("conv_id", "long"), ("words", "long"))}
    joined = partial.unionByName(twice.withColumns(missing))
    whole = joined.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in SUMS]
    )
    pieces = rows.filter("kind = 'ends'").select("key", "first_id", "ends")
    ends = pieces.repartition("key").sortWithinPartitions("key", "first_id").mapInPandas(_digests, "key binary, all_ends binary")
    whole = stored(whole.join(ends, "key", "left").withColumn("ends", F.coalesce("all_ends", F.lit(NO_ENDS))).drop("all_ends"), "trie-edges")

    ids = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_id"))
    finished = rows.filter("kind = 'node'").select("parent_key", "depth", "conv_id", "parent_conv_id", *SUMS, "ends")
    every = finished.unionByName(whole.select("parent_key", "depth", "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), *SUMS, "ends"))
    placed = every.filter(F.col("parent_key").isNotNull()).join(ids, "parent_key", "left").withColumn("parent_conv_id", F.col("parent_id")).drop("parent_id")
    placed = placed.unionByName(every.filter(F.col("parent_key").isNull()))
    return placed.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("n_nodes") - F.col("n_parents")).alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.lower(F.hex("ends")).alias("ends_sha256"),
    )


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of all rebuilt conversations of a table of turns."""
    return nodes(rebuilt(paths(turns)))
