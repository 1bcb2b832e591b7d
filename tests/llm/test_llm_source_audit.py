"""Source divergence audit against plain Python."""

import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from tidemark.llm import source_audit

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def terms_of(text):
    found, t = [], ""
    for c in (text or "") + " ":
        if ("A" <= c <= "Z") or ("a" <= c <= "z") or ord(c) >= 128:
            t += chr(ord(c) + 32) if "A" <= c <= "Z" else c
        elif t:
            found.append(t)
            t = ""
    return found


def brute(rows, least=10, top=10):
    per, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = terms_of(text)
        per[lang, source].update(found)
        held[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        share = {}
        for s in [*sources, None]:
            count = per[lang, s] if s is not None else sum((per[lang, x] for x in sources), Counter())
            total = sum(count[t] for t in kept)
            share[s] = {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(sum(f(share[s][t], share[o][t]) for t in kept), o) for o in sources if o != s]
            own = [(f(share[s][t], share[None][t]), t) for t in kept if per[lang, s][t] and share[s][t] > share[None][t]]
            for part, found, limit in (("pair", pairs, len(pairs)), ("term", own, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:limit])]
    return sorted(out)


def corpus():
    """Common words, terms that only rare chunks hold, several chunks of a term in one document, ties, nulls."""
    rng = random.Random(3)
    words = ["The", "the", "THE,", "of", "(of)", "naïve", "NaÏve", "a1b", "x", "don't", "über", "e f", "　", "42", "==", "Ab,ab;AB"]
    rows = []
    for i in range(120):
        picked = [rng.choice(words) for _ in range(rng.randrange(0, 30))]
        if i % 7 == 0:
            picked += [f"rare{i}", f"{i}rare", f"rare-{i}"]
        if i < 27:
            picked += [f"few{i}few" if i % 3 else "few", f"{i}.few"]
        if i % 11 < 2 and i < 60:
            picked += [f"q{i}", "q,q"] if i % 2 else ["qq"]
        rows.append((i % 100, rng.choice([" ", "\n", "\t\x0b"]).join(picked), ["en", "de", None][i % 3], ["s", "S", "é", "z", None][i % 5], 1))
    rows += rows[:9] + [(None, None, None, None, None), (1, "", "xx", "s", 0), (2, "lone", "xx", "t", 0), (3, " \n", "yy", "s", 0)]
    rows += [(900 + i, ("tie " * 3 + "Long" * 50 + " ") * (2000 if i == 4 else 1), "en", "tall", 0) for i in range(12)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_audit_matches_plain_python(spark, monkeypatch, small):
    if small:  # many partial sums, blocks of terms and tiles of sources
        for name, value in (("TEXT_BYTES", 200), ("COUNTS", 3), ("BATCH_ROWS", 2), ("CELLS", 40), ("TILE", 2)):
            monkeypatch.setattr(source_audit, name, value)
    rows = corpus()
    got = source_audit.audit(spark.createDataFrame(rows, DOC).repartition(5)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    assert {r.part for r in got} == {"pair", "term"}


def test_rare_chunks_keep_their_documents_and_common_ones_do_not(spark):
    docs = spark.createDataFrame([(i, f"all a{i}a a", "en", "s", 1) for i in range(12)], DOC).coalesce(1)
    counts = {bytes(r.chunk): r for r in source_audit.chunk_counts(docs).collect()}
    assert (counts[b"all"].n, bytes(counts[b"all"].some)) == (12, b"")
    assert counts[b"a3a"].n == 1 and len(counts[b"a3a"].some) == 8


def test_each_distinct_chunk_is_split_once(spark):
    splitter = source_audit._Splitter()
    arrow = lambda *chunks: pa.array([c.encode() for c in chunks], type=pa.binary())
    assert [x.to_pylist() for x in splitter.terms(arrow("1", "Ab,ab;AB", "x"))[1:]] == [["ab", "ab", "ab", "x"]]
    place, words = splitter.terms(arrow("x", "yÉ"))
    assert (place.tolist(), words.to_pylist(), splitter.n_split) == ([0, 1], ["x", "yÉ"], 4)
    docs = spark.createDataFrame([(i, "Ab,ab;AB x", lang, s, 1) for i, (lang, s) in enumerate([("en", "s"), ("de", "t")] * 3)], DOC)
    sums = source_audit.term_counts(source_audit.chunk_counts(docs.coalesce(1))).collect()
    assert sorted((r.lang, r.term, r.n, r.low) for r in sums) == [("de", "ab", 9, 3), ("de", "x", 3, 3), ("en", "ab", 9, 3), ("en", "x", 3, 3)]


@pytest.mark.parametrize("parts", [1, 7])
def test_terms_are_kept_by_distinct_documents_not_by_chunks(spark, parts):
    # nine documents with many chunks of one term each, and ten with one, spread over two sources
    rows = [(i, " ".join(f"dense{k}{i}" for k in range(5)), "en", "s", 1) for i in range(9)]
    rows += [(20 + i, f"wide{i}", "en", "st"[i % 2], 1) for i in range(10)]
    counts = source_audit.chunk_counts(spark.createDataFrame(rows, DOC).repartition(parts))
    kept = source_audit.kept_counts(source_audit.term_counts(counts)).collect()
    assert sorted((r.term, r.n) for r in kept) == [("wide", 5), ("wide", 5)]


def test_empty_and_odd_tables(spark):
    assert source_audit.audit(spark.createDataFrame([], DOC)).collect() == []
    # no kept term: pairs of value 0 by the order of the names; clashing extra columns are left alone
    docs = spark.createDataFrame([("a", "en", s, 1, "x", 2) for s in ("b", "ä", "B")], "text string, lang string, source string, n long, term string, chunk int")
    got = source_audit.audit(docs).collect()
    assert sorted((r.source, r["item"], r.value, r["rank"]) for r in got if r.source == "b") == [("b", "B", 0, 1), ("b", "ä", 0, 2)]
    assert all(r.part == "pair" for r in got) and len(got) == 6
