"""Conversation prefix trie against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import prefix_trie

CONV = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_paths(rows):
    given = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            given[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    for turns in given.values():
        turns.sort()
    out = {}
    for c in given:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = tuple(t[2:] for t in given.get(c - c % 20, [])[:h] + given[c][h:])
    return out


def brute(paths):
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(p[-1][1].split()) if p else 0
        leaves[p] = sum(leaves[k] for k in children[p]) if children[p] else 1
        saved[p] = sum(saved[k] for k in children[p]) + (len(members[p]) - 1) * words
    out = []
    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(paths[c]) == len(p))))
        up = min(members[p[:-1]]) if p else None
        out.append((min(cs), len(p), up, len(cs), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def turns(seed, n=150):
    """Few different turns, so that paths share much; one path of a third of all, one long conversation, odd rows."""
    rng = random.Random(seed)
    rows = []
    for c in range(0, 2 * n, 2):
        if rng.random() < 0.35:
            path = [("user", "the same words"), ("assistant", "again here"), ("user", "end")]
        else:
            path = [(rng.choice(["user", "a", None]), rng.choice(["x y", "x  y z", "", None, " \t", "é w"])) for _ in range(rng.randrange(0, 6))]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(path)]
    rows += [(1001, i, "user", "long" if i % 3 else "long way") for i in range(90)]
    rows += [(1003, i, "user", "long" if i % 3 or i > 80 else "long way") for i in range(95)]
    rows += [(None, 0, "user", "nobody"), (5, None, "user", "no turn"), (5, 1, None, None), (5, 1, None, None), (5, 1, "b", "tie"), (5, 1, "a", "tie")]
    rows += [(21, 0, "user", "short"), (7, 0, "user", "w " * 5000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, run_bytes, depths, piece", [(1, 2 << 20, 32, 4096), (2, 300, 3, 2), (3, 1, 1, 1), (4, 1500, 7, 3)])
def test_trie_matches_plain_python(spark, monkeypatch, seed, run_bytes, depths, piece):
    for name, value in (("RUN_BYTES", run_bytes), ("DEPTHS", depths), ("PIECE_IDS", piece), ("BATCH_ROWS", 7)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = turns(seed)
    assert got(prefix_trie.trie(spark.createDataFrame(rows, CONV).repartition(5))) == brute(brute_paths(rows))


def test_one_conversation_that_most_share_splits_between_partitions(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN_BYTES", 2000)
    rows = [(c, i, "user", f"t{i}") for c in range(0, 900) for i in range(4)]
    made = prefix_trie.rebuilt(prefix_trie.paths(spark.createDataFrame(rows, CONV)))
    assert got(prefix_trie.nodes(made)) == brute(brute_paths(rows))
    ranged = made.repartitionByRange(8, "path", "conv_id")
    sizes = [r["count"] for r in ranged.groupBy(prefix_trie.F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 250


def test_turnless_conversations_belong_to_the_root(spark):
    # 23 has two turns, takes three from an absent family head and keeps none of its own
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    assert got(prefix_trie.trie(spark.createDataFrame(rows, CONV))) == [
        (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())
    ]


def test_empty_tables_and_clashing_columns(spark):
    assert got(prefix_trie.trie(spark.createDataFrame([], CONV))) == []
    assert got(prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "b")], CONV))) == []
    rows = turns(5, 30)
    wide = spark.createDataFrame([(*r, "path", 1, b"k") for r in rows], CONV + ", path string, words int, key binary")
    assert got(prefix_trie.trie(wide)) == brute(brute_paths(rows))
