"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, trained from document labels."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE = re.compile(r"[.!?\n]+")
TOKEN = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Training:
    """max_per_label bounds the labelled sample of each label (by hash of the doc_id); documents of more than max_chars
    characters are not learned from. slots: number of hashed features. A feature gets a weight if at least min_docs
    documents of the sample have it and its shares among the two labels differ by min_z standard errors, so that
    single documents aren't learned by heart."""

    max_per_label: int = 5000
    max_chars: int = 30_000
    slots: int = 1 << 18
    min_docs: int = 5
    min_z: float = 4.0
    rounds: int = 300
    rate: float = 0.05
    decay: float = 0.02
    first_bias: float = -6.0


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slots: int


def slot_of(word: str, slots: int) -> int:
    return xxhash.xxh32_intdigest(word.encode()) % slots


def features(sentence: str, slots: int) -> set[int]:
    """Hashed different words of a lower-cased sentence."""
    return {slot_of(w, slots) for w in TOKEN.findall(sentence)}


def sentences(text: str | None) -> list[str]:
    return [s for s in SENTENCE.split((text or "").lower()) if s and not s.isspace()]


def sentence_scores(model: Model, text: str | None, known: dict[str, float]) -> np.ndarray:
    """Probability of every sentence, in order. known keeps the weights of words met before; it may be empty."""
    z = []
    for sentence in sentences(text):
        total = model.bias
        for w in set(TOKEN.findall(sentence)):
            weight = known.get(w)
            if weight is None:
                if len(known) > 300_000:
                    known.clear()
                weight = known[w] = float(model.weights[slot_of(w, model.slots)])
            total += weight
        z.append(total)
    return 1 / (1 + np.exp(-np.clip(np.array(z, dtype=np.float64), -40, 40)))


def noisy_or(p: np.ndarray) -> float:
    """1 less the chance that no sentence is toxic; 0 without sentences."""
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def fit(bags: list[list[np.ndarray]], labels: np.ndarray, weights: np.ndarray, training: Training) -> Model:
    """Gradient ascent (Adam) on the noisy-or likelihood of the document labels.

    bags holds for every document the feature arrays of its sentences, each feature once. Documents without sentences
    teach nothing. The weights start at the log-odds of the features' documents.
    """
    w = np.zeros(training.slots)
    use = [i for i, b in enumerate(bags) if b]
    labels, weights = np.asarray(labels)[use].astype(bool), np.asarray(weights, dtype=np.float64)[use]
    if not use or labels.all() or not labels.any():
        bias = training.first_bias if not use or not labels.any() else 6.0
        return Model(w.astype(np.float32), float(bias), training.slots)
    in_docs = np.zeros((2, training.slots))
    for y, i in zip(labels, use):
        in_docs[int(y), np.unique(np.concatenate(bags[i]))] += 1
    n_clean, n_toxic = (~labels).sum(), labels.sum()
    both = in_docs.sum(axis=0)
    share = both / len(use)
    error = np.sqrt(share * (1 - share) * (1 / n_clean + 1 / n_toxic)) + 1e-12
    known = (both >= training.min_docs) & (np.abs(in_docs[1] / n_toxic - in_docs[0] / n_clean) >= training.min_z * error)
    w[known] = (np.log((in_docs[1] + 0.5) / (n_toxic + 1)) - np.log((in_docs[0] + 0.5) / (n_clean + 1)))[known]
    first = w.copy()
    # sentences with a known feature stand on their own; of the others only their number per document counts
    of_doc, of_sentence, feature, empty = [], [], [], np.zeros(len(use))
    for d, i in enumerate(use):
        for sentence in bags[i]:
            told = sentence[known[sentence]]
            if len(told):
                of_sentence += [len(of_doc)] * len(told)
                feature += told.tolist()
                of_doc.append(d)
            else:
                empty[d] += 1
    of_doc, of_sentence, feature = (np.array(v, dtype=np.int64) for v in (of_doc, of_sentence, feature))
    slots, place = np.unique(feature, return_inverse=True)
    v, v0, bias = w[slots], first[slots], training.first_bias
    m1, m2, b1, b2 = np.zeros_like(v), np.zeros_like(v), 0.0, 0.0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for k in range(1, training.rounds + 1):
        p = sigmoid(bias + np.bincount(of_sentence, weights=v[place], minlength=len(of_doc)))
        p0 = sigmoid(bias)
        clean = np.bincount(of_doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(use)) + empty * np.log1p(-p0)
        pull = np.where(labels, -np.exp(clean) / np.maximum(-np.expm1(clean), 1e-9), 1.0) * weights
        g_sentence = p * pull[of_doc]
        g = np.bincount(place, weights=g_sentence[of_sentence], minlength=len(v)) + training.decay * (v - v0)
        g_bias = g_sentence.sum() + (empty * p0 * pull).sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        b1, b2 = 0.9 * b1 + 0.1 * g_bias, 0.99 * b2 + 0.01 * g_bias * g_bias
        scale = np.sqrt(1 - 0.99**k) / (1 - 0.9**k)
        v = v - training.rate * scale * m1 / (np.sqrt(m2) + 1e-8)
        bias = bias - training.rate * scale * b1 / (np.sqrt(b2) + 1e-8)
    w[:] = 0
    w[slots] = v
    return Model(w.astype(np.float32), float(bias), training.slots)


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, training: Training = Training(), *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Model | None:
    """A model from a bounded, hash-chosen sample of the labelled documents; None without labelled documents.

    may_learn is a condition on the doc_id. Each label is sampled on its own; the more frequent one's documents weigh
    as many as they stand for. A doc_id with several labels counts once, with the largest.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    known = known.withColumnRenamed("_id", doc_id).where(may_learn).withColumnRenamed(doc_id, "_id")
    sizes = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    if not sizes:
        return None
    steps = 1_000_000
    rates = {y: min(steps, training.max_per_label * steps // n + 1) for y, n in sizes.items()}
    rate = F.lit(0)
    for y, r in rates.items():
        rate = F.when(F.col("_y") == y, F.lit(r)).otherwise(rate)
    place = F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit("sample")), F.lit(steps))
    chosen = known.where(place < rate).limit(3 * training.max_per_label)  # bounded, so it may be broadcast
    slots = training.slots

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, t, y in zip(batch["i"], batch["x"], batch["y"]):
                each = [sorted(features(s, slots)) for s in sentences(t)]
                each = [s for s in each if s]
                rows.append((i, y, [len(s) for s in each], [f for s in each for f in s]))
            yield pd.DataFrame(rows, columns=["i", "y", "lengths", "features"])

    sample = (
        docs.join(F.broadcast(chosen), docs[doc_id] == chosen["_id"])
        .where(F.length(docs[text]) <= training.max_chars)
        .select(docs[doc_id].cast("string").alias("i"), docs[text].alias("x"), F.col("_y").alias("y"))
        .mapInPandas(bags, "i string, y int, lengths array<int>, features array<int>")
    )
    rows = sample.toPandas().sort_values("i", kind="stable")
    each = [
        list(np.split(np.asarray(f, dtype=np.int64), np.cumsum(n)[:-1])) if len(n) else [] for n, f in zip(rows["lengths"], rows["features"])
    ]
    y = rows["y"].to_numpy()
    weights = np.array([steps / rates[v] for v in y]) if len(y) else np.empty(0)
    weights = weights / weights.min() if len(y) else weights
    return fit(each, (y > 0).astype(int), np.minimum(weights, 20.0), training)


def score(text: Column, model: Model | None) -> Column:
    """Struct of score, worst_sentence (from 0; null without sentences) and worst_score for every whole text.

    Null and empty texts, and all texts without a model, score 0.
    """

    @F.pandas_udf("score double, worst_sentence int, worst_score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, float] = {}
        for texts in batches:
            rows = []
            for t in texts:
                p = sentence_scores(model, t, known) if model is not None else np.empty(0)
                rows.append((noisy_or(p), int(p.argmax()), float(p.max())) if len(p) else (0.0, None, None))
            frame = pd.DataFrame(rows, columns=["score", "worst_sentence", "worst_score"])
            yield frame.astype({"worst_sentence": "Int32", "worst_score": "float64", "score": "float64"})

    return scored(text)


def offending_sentences(docs: DataFrame, model: Model, *, least: float = 0.5, text: str = "text") -> DataFrame:
    """Adds `offending`: place, score and text of every sentence that scores at least `least`, in order."""

    @F.pandas_udf("array<struct<place:int,score:double,sentence:string>>")
    def located(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for texts in batches:
            found = []
            for t in texts:
                p = sentence_scores(model, t, known)
                found.append([{"place": k, "score": float(p[k]), "sentence": s} for k, s in enumerate(sentences(t)) if p[k] >= least])
            yield pd.Series(found)

    return docs.withColumn("offending", located(F.col(text)))
