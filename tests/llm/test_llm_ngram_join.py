"""The shingle join against brute force."""

import random

import numpy as np
import pytest

from tidemark.llm import ngram_join
from tidemark.llm.ngram_join import Settings, choose_boundary, components, join, keep_one, least_overlap, prefix_length
from tidemark.llm.shingles import parity_bits, parity_distance, set_key, shingle_set

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(docs):
    sets = [plain_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                parent[root(i)] = root(j)
    smallest = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            smallest[root(i)] = min(smallest.get(root(i), d), d)
    return sorted(((d, len(sets[i]), smallest.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)), key=str)


def made(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = []
    passage = [rng.choice(words) for _ in range(60)]
    for g in range(14):
        base = [rng.choice(words) for _ in range(rng.choice([5, 6, 8, 9, 11, 14, 18, 30, 80, 200]))]
        if g % 3 == 0:
            base = passage + base
        for _ in range(rng.choice([1, 2, 5, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[rng.choice(words)], [], ["x", copy[k]]])
            docs.append(rng.choice([" ", "\n", "\t "]).join(rng.choice([w, w.upper()]) for w in copy))
    docs += [None, "", "  \n", "one", "ONE", "two words", "two  words", "a b c d", "é É", "é é"]
    rng.shuffle(docs)
    return [(i * 3 + 1, t) for i, t in enumerate(docs)]


def frame(spark, docs):
    return spark.createDataFrame([(d, t, None, None, None) for d, t in docs], DOC)


@pytest.mark.parametrize(
    "seed, s",
    [(1, Settings()), (2, Settings(max_light=0)), (3, Settings(scan_cost=50.0)), (4, Settings(block=4, hot_count=2, tally=300)), (5, Settings(max_broadcast_rows=0))],
)
def test_components_match_brute_force(spark, seed, s):
    docs = made(seed)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in join(frame(spark, docs), s).collect()]
    assert sorted(got, key=str) == brute(docs)


def test_star_of_copies_that_are_not_linked_to_one_another(spark):
    rng = random.Random(9)
    base = [f"b{rng.randrange(10**6)}" for _ in range(120)]
    docs = [(0, " ".join(base))]
    for i in range(1, 60):
        copy = list(base)
        for k in rng.sample(range(len(base)), 3):
            copy[k] = f"c{rng.randrange(10**6)}"
        docs.append((i, " ".join(copy)))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in join(frame(spark, docs), Settings(block=16)).collect()]
    assert sorted(got, key=str) == brute(docs)


def test_repeated_rows_null_ids_and_one_document_of_each_group(spark):
    long = " ".join(f"w{i}" for i in range(50))
    near = long.replace("w3 ", "other ")
    docs = [(5, long), (5, long), (2, near), (None, long), (None, "lonely text of no one at all"), (None, "lonely text of no one at all"), (9, "alone here"), (7, None), (8, "")]
    df = frame(spark, docs)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in join(df).collect()], key=str) == brute(docs)
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted(
        [(2, near), (None, "lonely text of no one at all"), (9, "alone here"), (7, None), (8, "")], key=str
    )
    odd = df.withColumnsRenamed({"lang": "_id", "source": "_k", "n_chars": "key"})
    assert keep_one(odd).columns == odd.columns and keep_one(odd).count() == 5


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOC)
    assert join(empty).count() == 0 and keep_one(empty).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (202, 201), (-5, 200)]
    got = {r.key: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(30))
    assert {got[i] for i in (-5, 200, 201, 202)} == {-5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingle_sets_are_the_same_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["a", "bb", "ccc" * 200, "é"]) for _ in range(500))
    whole = shingle_set(text)
    monkeypatch.setattr("tidemark.llm.shingles.PIECE", 37)
    assert np.array_equal(whole, shingle_set(text)) and len(whole) == len(plain_set(text))


def test_parities_never_overstate_a_difference():
    rng = np.random.default_rng(2)
    for _ in range(300):
        pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a = np.unique(rng.choice(pool, rng.integers(1, 300)))
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.choice(pool, rng.integers(1, 200))]))
        assert parity_distance(parity_bits(a), parity_bits(b)) <= len(np.setxor1d(a, b))
    assert set_key(a) == set_key(a.copy()) and set_key(a) != set_key(a[1:])


def test_bounds_of_the_join():
    for n in range(1, 60):
        for m in range(n, 80):
            o = least_overlap(n, m, 75)
            assert 100 * o >= 75 * (n + m - o) and not 100 * (o - 1) >= 75 * (n + m - o + 1)
        assert 1 <= prefix_length(n, 75) <= n
    assert choose_boundary({}, Settings()) == 0
    assert choose_boundary({n: 1000 for n in range(1, 9)}, Settings(scan_cost=100)) > choose_boundary({n: 1000 for n in range(1, 9)}, Settings(scan_cost=0.01))
    assert ngram_join.sizes_linked_to(4, 75) == range(3, 6)


def near_misses(n, common=84, own=16):
    """Documents that share a passage, each two of them just below the threshold."""
    shared = [f"s{k}" for k in range(common)]
    return [(i, " ".join(shared + [f"d{i}w{k}" for k in range(own)])) for i in range(n)]


def test_near_misses_make_rows_for_documents_not_for_pairs(spark, monkeypatch):
    rows = near_misses(300)
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for _, t in rows[:2]]
    share = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert 0.7 < share < 0.75
    written = {}
    real = ngram_join.stored

    def counted(df, name, *more):
        out = real(df, name, *more)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(ngram_join, "stored", counted)
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i) for i, _ in rows}
    assert written["near-members"] >= 300 and written["rest-links"] == 0
    # lists are as many as shared shingles; no table grows with the pairs (44,850)
    assert written["near-members"] <= 300 * 30 and written["near"] <= 300 * 30 and written["sets"] <= 600


@pytest.mark.parametrize("block, block_bytes", [(1024, 16 << 20), (7, 16 << 20), (1024, 4000)])
def test_links_among_near_misses_are_found(spark, block, block_bytes):
    rows = near_misses(60)
    rows += [(100 + i, f"{t} tail") for i, t in rows[:20]]
    rows += [(200 + i, t.replace("s0 ", f"z{i} ").replace("s83", f"y{i}")) for i, t in rows[20:30]]
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), ngram_join.Settings(block=block, block_bytes=block_bytes)).collect()}
    sets = {i: set(zip(*[t.split()[k:] for k in range(5)])) for i, t in rows}
    want = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and want[a] != want[b]:
                    want[a] = want[b] = min(want[a], want[b])
                    changed = True
    assert got == want


def test_intersections_by_columns(monkeypatch):
    rng = random.Random(8)
    sets = [np.array(sorted(rng.sample(range(90), rng.randrange(0, 40))), dtype=np.uint64) for _ in range(30)] + [np.array([10**15], dtype=np.uint64)]
    monkeypatch.setattr(ngram_join, "_COLUMNS", 16)
    got = ngram_join._common(sets)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            if i != j:
                assert got[i, j] == len(set(x.tolist()) & set(y.tolist()))
