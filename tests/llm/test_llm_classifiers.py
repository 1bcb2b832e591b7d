"""Language, toxicity, quality and url classifiers on small labelled tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id, quality_classifier, toxicity, url_filter
from tidemark.llm.common import crc_remainder, python_crc_remainder
from tidemark.llm.url_filter import Rule

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LABEL = "doc_id long, quality int, toxic int"
SYLLABLES = {"xa": ["ka", "to", "mi", "ru", "sen"], "yb": ["öl", "ung", "sch", "ein", "ber"], "zc": ["qu", "eau", "oi", "ier", "ç"]}


def prose(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words)) + "."


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, prose(rng, lang, rng.choice([3, 10, 60])), lang, "s", 0))
    return rows, spark.createDataFrame(rows, DOC)


def test_language_of_held_out_texts(spark, tongues):
    rows, df = tongues
    net = language_id.train(df, crc_remainder(F.col("doc_id"), 4) != 2)
    assert net.languages == ("xa", "yb", "zc")
    got = {r.doc_id: r.p for r in df.select("doc_id", language_id.predict(F.col("text"), net).alias("p")).collect()}
    held = [r for r in rows if python_crc_remainder(r[0], 4) == 2]
    right = sum(got[r[0]].lang_pred == r[2] for r in held)
    assert len(held) > 80 and right >= 0.97 * len(held)
    assert all(0 <= p.score <= 1 for p in got.values())
    odd = [(1, None), (2, ""), (3, " 12 34 !! \n"), (4, "ö"), (5, prose(random.Random(1), "yb", 60_000)), (None, "tomika rusen kato"), (7, "\0\0 senrumi kato tomi")]
    odd += odd[-1:]
    frame = spark.createDataFrame(odd, "doc_id long, text string").withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit("clash"))
    found = [r.p for r in frame.select("doc_id", language_id.predict(F.col("text"), net).alias("p")).collect()]
    assert [(p.lang_pred, p.score) for p in found[:3]] == [("und", 0.0)] * 3
    assert [p.lang_pred for p in found[3:]] == ["yb", "yb", "xa", "xa", "xa"]


def test_language_windows_cover_every_byte(tongues):
    shape = language_id.Shape()
    for n in (1, 3, 4, 127, 128, 129, 253, 1000):
        codes = np.arange(n, dtype=np.int64) % 250 + 1
        windows = language_id._windows(codes.astype(np.uint8), shape)
        runs = {tuple(w[i : i + 4]) for w in windows for i in range(len(w) - 3)}
        assert all(tuple(codes[i : i + 4]) in runs for i in range(n - 3)) and windows.shape[1] == shape.window


def test_language_convolution_matches_plain_loops(tongues, spark):
    rng = np.random.default_rng(0)
    net = language_id.fit(["tomikato", "ungsch"], ["xa", "yb"], training=language_id.Training(epochs=1))
    windows = rng.integers(0, 256, (3, net.shape.window), dtype=np.uint8)
    got = language_id._responses(net, windows)
    flat = net.embed[windows]
    for w in range(3):
        for f in (0, 17, 40):
            kernel = net.filters[:, f].reshape(4, -1)
            assert got[w, f] == pytest.approx(max((flat[w, i : i + 4] * kernel).sum() for i in range(net.shape.window - 3)), rel=1e-4)


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", None, None, None)], DOC)
    assert language_id.train(df, F.lit(True)) is None
    assert df.select(language_id.predict(F.col("text"), None).alias("p")).first().p.lang_pred == "und"
    assert language_id.train(df.limit(0), F.lit(True)) is None


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(6)
    bad = ["vilx", "scumz", "mornq"]
    docs, labels = [], []
    for i in range(900):
        sentences = [prose(rng, "xa", rng.randint(3, 9)) for _ in range(rng.randint(1, 25))]
        flag = int(i % 4 == 0)
        if flag:
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(sentences))
                sentences[k] = f"toka {rng.choice(bad)} " + sentences[k]
        docs.append((i, "\n".join(sentences), "xa", "s", 0))
        labels.append((i, 1, flag))
    return docs, labels, spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL)


def test_toxic_documents_and_their_sentences(spark, toxic):
    docs, labels, df, marks = toxic
    held = crc_remainder(F.col("doc_id"), 5) == 0
    model = toxicity.train(df, marks, ~held)
    got = {r.doc_id: r.p for r in df.where(held).select("doc_id", toxicity.score(F.col("text"), model).alias("p")).collect()}
    y = {i: t for i, _, t in labels}
    right = sum((p.score >= 0.5) == bool(y[i]) for i, p in got.items())
    assert len(got) > 100 and right >= 0.97 * len(got)
    found = toxicity.offending_sentences(df.where("doc_id % 4 = 0"), model).collect()
    hits = sum(any(b in s.sentence for b in ("vilx", "scumz", "mornq")) for r in found for s in r.offending)
    assert hits >= 0.95 * sum(len(r.offending) for r in found) and sum(bool(r.offending) for r in found) >= 0.95 * len(found)
    odd = spark.createDataFrame([(None,), ("",), (" .!\n",), ("12 34",), ("to ka. " * 40_000,)], "text string")
    scores = [r.p.score for r in odd.select(toxicity.score(F.col("text"), model).alias("p")).collect()]
    assert scores[:3] == [0.0, 0.0, 0.0] and all(0 <= s <= 1 for s in scores)


def test_toxicity_labels_may_be_missing_or_repeated(spark, toxic):
    _, _, df, marks = toxic
    assert toxicity.train(df, marks.limit(0), F.lit(True)) is None
    assert toxicity.train(df, marks.where("false"), F.lit(True)) is None
    twice = marks.union(marks).union(spark.createDataFrame([(None, 1, 1), (5, None, None)], LABEL))
    a = toxicity.train(df, marks, F.lit(True))
    b = toxicity.train(df.withColumn("toxic", F.lit("clash")), twice, F.lit(True))
    assert np.allclose(a.weights, b.weights) and a.bias == b.bias
    only = toxicity.train(df, marks.where("toxic = 0"), F.lit(True))
    assert only.weights.any() == False  # noqa: E712
    assert df.limit(1).select(toxicity.score(F.col("text"), None).alias("p")).first().p.score == 0.0


def test_noisy_or():
    assert toxicity.noisy_or(np.array([])) == 0.0
    p = np.array([0.1, 0.5, 0.0])
    assert toxicity.noisy_or(p) == pytest.approx(1 - 0.9 * 0.5)
    assert toxicity.noisy_or(np.full(10_000, 1e-9)) == pytest.approx(1e-5, rel=1e-3)


def test_quality_of_held_out_texts(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(900):
        text = prose(rng, "xa", rng.randint(5, 80))
        good = int(rng.random() < 0.7)
        if not good:
            text = rng.choice([text.upper() + "!!", " | ".join(text.split()), " ".join(w + "###" for w in text.split())])
        docs.append((i, text, "xa", "s", 0))
        labels.append((i, good, 0))
    df, marks = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL)
    held = crc_remainder(F.col("doc_id"), 3) == 1
    measured = df.select("doc_id", quality_classifier.statistics(F.col("text")).alias("stats"))
    model = quality_classifier.train(measured, marks, ~held)
    assert 0 < len(model.rules) < 200 and all(len(r.conditions) <= 3 for r in model.rules)
    got = {r.doc_id: r.s for r in measured.where(held).select("doc_id", quality_classifier.score(model).alias("s")).collect()}
    y = {i: g for i, g, _ in labels}
    assert sum((s >= 0.5) == bool(y[i]) for i, s in got.items()) >= 0.97 * len(got)
    # the compiled column says what the rules say
    rows = measured.select("doc_id", "stats.*", quality_classifier.score(model).alias("s")).limit(50).toPandas()
    x = rows[list(quality_classifier.STATISTICS)].to_numpy()
    z = model.bias + sum(r.weight * quality_classifier.holds(r, x) for r in model.rules)
    assert np.allclose(1 / (1 + np.exp(-z)), rows["s"])
    odd = spark.createDataFrame([(None, "x"), ("", "x"), ("\n \t", "x"), ("w" * 100_000, "x"), ("a " * 50_000, "x")], "text string, score string")
    scores = [r.s for r in odd.select(quality_classifier.statistics(F.col("text")).alias("stats")).select(quality_classifier.score(model).alias("s")).collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores) and scores[0] == scores[1] == scores[2]
    assert quality_classifier.train(measured, marks.limit(0), F.lit(True)) is None
    assert measured.limit(1).select(quality_classifier.score(None).alias("s")).first().s == 0.5
    assert quality_classifier.train(measured, marks.where("quality = 1"), F.lit(True)).rules == ()


PAGE = "page_id long, url string, html string"
URLS = [
    ("http://A.Example.NET/en/x?q", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://example.net/en", "example.net", "/en", "net/", "block"),
    ("https://x.example.com/de/1#f", "x.example.com", "/de/1", "example.com/de/", "block"),
    ("ftp://sub.org/fr/2", "sub.org", "/fr/2", "org/fr/", "allow"),
    ("http://notnet/", "notnet", "/", None, "allow"),
    ("http://net", "net", "", None, "allow"),
    ("http://net/", "net", "/", "net/", "block"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("http://casinowin.example.com/freebets", "casinowin.example.com", "/freebets", None, "block"),
    ("http://citylibrary.example.org/history/museum", "citylibrary.example.org", "/history/museum", None, "allow"),
    ("http://" + "q" * 5000 + "/" + "cheappills", "q" * 5000, "/cheappills", None, "block"),
]


def test_urls(spark):
    rows = [(i, u, "<p>the quick city library</p>" if i % 2 else None) for i, (u, *_) in enumerate(URLS)]
    rows += [rows[-3], (None, URLS[0][0], None)]
    df = spark.createDataFrame(rows, PAGE).withColumn("host", F.lit("clash")).withColumn("words", F.lit(1))
    got = url_filter.judge(df).collect()
    assert len(got) == len(rows)
    for r in got:
        want = URLS[r.page_id if r.page_id is not None else 0]
        assert (r.host, r.path, r.rule, r.verdict) == want[1:], want[0][:40]
    words = {r.page_id: r.words for r in got}
    assert words[11][:2] == ["casino", "win"] and words[11][-2:] == ["free", "bets"]
    assert url_filter.judge(spark.createDataFrame([], PAGE)).count() == 0


def test_longest_rule_wins_and_viterbi_is_optimal(spark):
    rules = [Rule("b.c", "/", "block"), Rule("c", "/long/path/", "allow"), Rule("a.b.c", "/", "allow")]
    df = spark.createDataFrame([("a.b.c", "/x"), ("z.b.c", "/x"), ("z.b.c", "/long/path/1"), ("xb.c", "/x"), ("b.c", "")], "h string, p string")
    name, verdict = url_filter.match_rule(F.col("h"), F.col("p"), rules)
    assert [tuple(r) for r in df.select(name, verdict).collect()] == [("a.b.c/", "allow"), ("b.c/", "block"), ("c/long/path/", "allow"), (None, None), (None, None)]
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 7)))
        lexicon = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 3))): -rng.random() * 5 for _ in range(4)}
        parts = [{"start": i + 1, "size": j - i, "log_p": lexicon[text[i:j]]} for i in range(len(text)) for j in range(i + 1, len(text) + 1) if text[i:j] in lexicon]

        def price(words):
            return sum(max(lexicon.get(w, -math.inf), -9.0 if len(w) == 1 else -math.inf) for w in words)

        def splits(t):
            return [[]] if not t else [[t[:k], *rest] for k in range(1, len(t) + 1) for rest in splits(t[k:])]

        assert price(url_filter.best_split(text, parts, -9.0)) == pytest.approx(max(map(price, splits(text))))


def test_every_language_of_the_table_can_be_learned(spark):
    """More languages than a fixed limit would keep, the rarest with one document."""
    rows = [(i, f"word{i % 230} text of it", f"l{i % 230:03d}") for i in range(460)] + [(999, "only one here", "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    training = language_id.Training(sample_per_language=3, cuts=1, epochs=0)
    _, languages = language_id.labelled_sample(docs, F.lit(True), language_id.Shape(), training, text="text", lang="lang", doc_id="doc_id")
    assert len(set(languages)) == 231 and "rare" in languages


def test_empty_tables_of_the_classifiers(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, extra int")
    assert language_id.train(none, F.lit(True)) is None
    assert none.select(language_id.predict(F.col("text"), None).alias("p")).collect() == []
