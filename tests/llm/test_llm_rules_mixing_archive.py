"""Quality rules, mixing and the archive: small cases against plain Python."""

import base64
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, quality_rules, warc_archive
from tidemark.llm.common import running_total, stored

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def brute_counts(text):
    text = text or ""
    words, w = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            if w:
                words.append(w)
            w = ""
        else:
            w += c
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


TEXTS = [
    None, "", "   \n\t ", "one", "a b c d e a b c d e", "a a a a a a a", "x y z\nx y z\n\nx y z \nq", "é ñ ü # $ % | <b> &&\n" * 4,
    "w " * 20_000 + "end", " ".join(str(i) for i in range(3000)), "a b c d e f a b c d e", " word\u0085two",
]


def rows(texts=TEXTS, source="s"):
    return [(i, t, None, source, None) for i, t in enumerate(texts)]


def test_counts_match_plain_python(spark):
    got = spark.createDataFrame(rows(), DOC).select("doc_id", quality_rules.text_counts(F.col("text")).alias("c")).select("doc_id", "c.*").collect()
    for r in got:
        assert tuple(r)[1:] == brute_counts(TEXTS[r.doc_id]), r.doc_id


def test_host_rates_are_shrunk_and_bad_hosts_rejected(spark):
    good = "these are enough different words to pass each of the simple rules here"
    data = [(i, "bad", None, "junk", 0) for i in range(200)] + [(300, good, None, "junk", 0)]
    data += [(400 + i, good, None, "fine", 0) for i in range(200)] + [(700, "bad", None, "small", 0), (701, good, None, None, 0), (702, good, None, None, 0)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(data, DOC)).collect()}
    assert len(got) == len(data)
    assert not got[300].base_failed and not got[300].kept  # its host fails nearly always
    assert got[400].kept and got[701].kept and got[701].shrunk_rate is None
    assert 0 < got[700].shrunk_rate < 1.0  # one failure alone says little
    kept = quality_rules.keep(spark.createDataFrame(data, DOC))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)


def test_rules_on_empty_and_odd_tables(spark):
    empty = spark.createDataFrame([], DOC)
    assert quality_rules.judge(empty).count() == 0 and quality_rules.keep(empty).count() == 0
    good = "these are enough different words to pass each of the simple rules here"
    odd = spark.createDataFrame([(None, good, "s", 1, "x", True), (None, good, "s", 1, "x", True)], "doc_id long, text string, source string, _counts int, host string, kept boolean")
    kept = quality_rules.keep(odd)
    assert kept.columns == odd.columns and kept.count() == 2
    assert [r.kept for r in quality_rules.judge(odd).collect()] == [True, True]


@pytest.mark.parametrize("seed", [1, 2])
def test_running_total(spark, seed):
    rng = random.Random(seed)
    data = [(rng.choice(["a", "b", None]), rng.randrange(50), i, rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(data, "g string, k int, i int, v long")
    got = {r.i: r.total for r in running_total(df, ["g", "k", "i"], "v", "total", within="g").collect()}
    for g in ("a", "b", None):
        total = 0
        for _, k, i, v in sorted((x for x in data if x[0] == g), key=lambda x: x[1:3]):
            total += v
            assert got[i] == total


def brute_mix(sizes, cycle=(3, 1, 2), share=1.5, cap=2):
    """sizes: source -> {doc_id: size}."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    total = {s: sum(sizes[s].values()) for s in order}
    budget, full = share * sum(total.values()), set()
    while True:
        free = [s for s in order if s not in full]
        level = (budget - sum(cap * total[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if cap * total[s] <= level * weight[s]}
        if not more:
            break
        full |= more
    target = {s: float(cap * total[s]) if s in full else level * weight[s] for s in order}
    queue = []
    for s in order:
        line = sorted((hashlib.md5(f"mix:{d}".encode()).hexdigest(), d, n) for d, n in sizes[s].items())
        for p in range(cap):
            upto = p * total[s]
            for place, d, n in line:
                upto += n
                if n and target[s]:
                    queue.append((upto / target[s], s is None, s or "", place, d, n, p))
    taken, spent = Counter(), 0
    for q in sorted(queue):
        spent += q[5]
        if spent > round(sum(target.values())):
            break
        taken[q[4]] += q[5]
    return target, taken


def test_mix_matches_plain_python_and_reruns(spark):
    rng = random.Random(4)
    sizes, data, n = {}, [], 0
    for s, k in (("b", 40), ("a", 300), (None, 20), ("ß", 5), ("zero", 2), ("B", 80)):
        sizes[s] = {}
        for _ in range(k):
            size = 0 if s == "zero" else rng.choice([0, 1, 7, 30, 200])
            sizes[s][n] = size
            data.append((n, " ".join(["w"] * size) if size else rng.choice([None, "", "  "]), None, s, None))
            n += 1
    df = spark.createDataFrame(data, DOC)
    target, taken = brute_mix(sizes)
    got = mixing.mix_documents(df).collect()
    assert len(got) == n
    by_source = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.taken == taken[r.doc_id] and r.taken <= 2 * r.size
        by_source[r.source] += r.taken
    for s, t in target.items():
        assert abs(by_source[s] - t) <= 400
    assert sorted(map(tuple, ((r.doc_id, r.taken) for r in mixing.mix_documents(df.repartition(5)).collect()))) == sorted((r.doc_id, r.taken) for r in got)


def test_mix_on_empty_repeated_and_odd_tables(spark):
    assert mixing.mix_documents(spark.createDataFrame([], DOC)).count() == 0
    assert mixing.mixed(spark.createDataFrame([], DOC)).count() == 0
    assert [r.taken for r in mixing.mix_documents(spark.createDataFrame([(1, None, None, "a", 0), (2, "", None, None, 0)], DOC)).collect()] == [0, 0]
    same = spark.createDataFrame([(7, "a b c", "s", 9, "t")] * 4 + [(None, "x y", "s", 9, "t")] * 2, "doc_id long, text string, source string, taken int, _at string")
    got = mixing.mixed(same)
    assert got.columns == ["doc_id", "text", "source", "_at", "size", "source_size", "target", "taken"]
    assert {(r.doc_id, r.taken) for r in got.collect()} <= {(7, 3), (7, 6), (None, 2), (None, 4)}


PAGE = "page_id long, url string, html string"


def pages(spark):
    data = [(1, "http://a/", "same"), (5, "http://b/\r\nWARC-Type: response", "same"), (3, None, "same"), (9, "u%0A", "other ü"), (4, "", None), (6, "x", "")]
    data += [(8, "dup", "twice")] * 3 + [(None, "n", "nobody"), (None, "m", "same"), (11, "long", "é" * 300_000)]
    return data, spark.createDataFrame(data, PAGE)


def test_archive_round_trip(spark):
    data, df = pages(spark)
    archive = warc_archive.write_archive(df)
    got = warc_archive.read_archive(spark, archive).collect()
    assert sorted(((r.page_id, r.url, r.payload.decode()) for r in got), key=str) == sorted(((p, u, h or "") for p, u, h in data), key=str)
    assert spark.read.parquet(archive.payloads).count() == len({h or "" for _, _, h in data})
    largest = {}
    for p, _, h in data:
        largest[h or ""] = max(largest.get(h or "", p or -1), p if p is not None else -1)
    seen = Counter()
    for r in got:
        text = r.payload.decode()
        raw = text.encode()
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        seen[text, r.record_type] += 1
        if r.record_type == "response":
            assert r.refers_to is None and (r.page_id if r.page_id is not None else -1) == largest[text]
            assert bytes(r.record) == bytes(r.header) + raw + b"\r\n\r\n"
        else:
            assert (r.refers_to if r.refers_to is not None else -1) == largest[text]
            assert bytes(r.record).endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    assert all(seen[t, "response"] == 1 for t in largest)


def test_small_payloads_can_all_be_responses(spark):
    _, df = pages(spark)
    got = warc_archive.read_archive(spark, warc_archive.write_archive(df, min_revisit_bytes=5)).collect()
    for r in got:
        if r.payload_bytes < 5:
            assert r.record_type == "response"
    assert sum(r.record_type == "revisit" for r in got) == 2  # the two further copies of "twice"


def test_damaged_payload_fails_the_read(spark):
    _, df = pages(spark)
    archive = warc_archive.write_archive(df)
    wrong = stored(spark.read.parquet(archive.payloads).withColumn("payload", F.concat("payload", F.lit(b"!"))), "damaged")
    broken = warc_archive.Archive(archive.headers, wrong.inputFiles()[0].rsplit("/", 1)[0])
    with pytest.raises(Exception, match="damaged payload"):
        warc_archive.read_archive(spark, broken).collect()


def test_empty_archive(spark):
    archive = warc_archive.write_archive(spark.createDataFrame([], PAGE))
    assert warc_archive.read_archive(spark, archive).count() == 0
