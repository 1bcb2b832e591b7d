"""Language identification by a byte convolutional network, trained here in numpy."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UNKNOWN = "und"


@dataclass(frozen=True)
class Shape:
    """Of the network and its windows. Windows overlap by the widest filter less one byte, so that every run of
    bytes that a filter can see lies within a window."""

    window: int = 128
    embedding: int = 6
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    batch: int = 256


@dataclass(frozen=True)
class Training:
    """sample_per_language is the bound of the labelled sample: so many documents of each language, give or take the
    chance of a choice by hash, each giving `cuts` pieces of a window's length from places chosen by hash."""

    sample_per_language: int = 1500
    cuts: int = 2
    epochs: int = 14
    rate: float = 0.004
    seed: int = 5


@dataclass(frozen=True)
class Network:
    shape: Shape
    languages: tuple[str, ...]
    embed: np.ndarray  # 256 x embedding; row 0 (padding) is zero
    filters: np.ndarray  # widest * embedding x all filters; narrow filters are zero behind their width
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray


def normal_bytes(text: str) -> np.ndarray:
    """Lower-cased UTF-8 bytes; digits are one symbol, a zero byte is a blank (0 is padding)."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)
    out = raw.copy()
    out[(raw >= 48) & (raw <= 57)] = 48
    out[raw == 0] = 32
    return out


def _windows(codes: np.ndarray, shape: Shape) -> np.ndarray:
    """Zero-padded windows over all bytes."""
    step = shape.window - max(shape.widths) + 1
    n = max(1, -(-(len(codes) - max(shape.widths) + 1) // step))
    padded = np.zeros((n - 1) * step + shape.window, dtype=np.uint8)
    padded[: len(codes)] = codes[: len(padded)]
    return np.lib.stride_tricks.sliding_window_view(padded, shape.window)[::step]


def _responses(net: Network, windows: np.ndarray) -> np.ndarray:
    """Largest response of each filter in each window, batches of windows at a time."""
    widest, e = max(net.shape.widths), net.shape.embedding
    out = np.empty((len(windows), net.filters.shape[1]), dtype=np.float32)
    for k in range(0, len(windows), net.shape.batch):
        x = net.embed[windows[k : k + net.shape.batch]].reshape(-1, net.shape.window * e)
        # every run of `widest` bytes, side by side
        runs = np.lib.stride_tricks.sliding_window_view(x, widest * e, axis=1)[:, ::e]
        out[k : k + len(x)] = (runs.reshape(-1, widest * e) @ net.filters).reshape(len(x), -1, net.filters.shape[1]).max(axis=1)
    return out


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def window_scores(net: Network, windows: np.ndarray) -> np.ndarray:
    """Log-probabilities of the languages for each window."""
    hidden = np.maximum(_responses(net, windows) + net.bias, 0)
    return _log_softmax(hidden @ net.dense + net.dense_bias)


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text[:200]) or any(unicodedata.category(c)[0] == "L" for c in set(text[200:]))


def score_text(net: Network, text: str | None) -> tuple[str, float]:
    """Language and probability of one whole text: its windows' log-probabilities, weighted by their bytes.

    `und` with probability 0 for null and for texts without a letter.
    """
    if not text or not _has_letter(text):
        return UNKNOWN, 0.0
    codes = normal_bytes(text)
    total, weight = np.zeros(len(net.languages)), 0.0
    step = net.shape.window - max(net.shape.widths) + 1
    piece = step * net.shape.batch * 8
    for k in range(0, len(codes), piece):  # long texts in pieces, so that memory stays bounded
        windows = _windows(codes[k : k + piece + max(net.shape.widths) - 1], net.shape)
        filled = (windows != 0).sum(axis=1)
        total += filled @ window_scores(net, windows).astype(np.float64)
        weight += filled.sum()
    mean = total / max(weight, 1)
    p = np.exp(_log_softmax(mean[None, :])[0])
    best = int(p.argmax())
    return net.languages[best], float(p[best])


def fit(texts: list[str], languages: list[str], shape: Shape = Shape(), training: Training = Training()) -> Network:
    """Train on labelled pieces of text by Adam; classes weigh the same.

    Pieces are cut again at random in every epoch, from a few bytes to the whole window, so that short texts are
    learned too. One language gives a network that always answers it; no sample is an error.
    """
    if not texts:
        raise ValueError("no labelled text to learn from")
    rng = np.random.default_rng(training.seed)
    names = tuple(sorted(set(languages)))
    y = np.array([names.index(x) for x in languages])
    pieces = [normal_bytes(t)[: shape.window] for t in texts]
    share = np.bincount(y, minlength=len(names)) / len(y)
    weight = (1 / len(names)) / share[y]
    widest, e, n_filters = max(shape.widths), shape.embedding, shape.filters * len(shape.widths)
    mask = np.zeros((widest * e, n_filters), dtype=np.float32)
    for i, w in enumerate(shape.widths):
        mask[: w * e, i * shape.filters : (i + 1) * shape.filters] = 1
    p = {
        "embed": rng.normal(0, 0.5, (256, e)),
        "filters": rng.normal(0, 1 / np.sqrt(widest * e), (widest * e, n_filters)) * mask,
        "bias": np.zeros(n_filters),
        "dense": rng.normal(0, 1 / np.sqrt(n_filters), (n_filters, len(names))),
        "dense_bias": np.zeros(len(names)),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["embed"][0] = 0
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    moves = 0
    for epoch in range(training.epochs):
        rate = training.rate * (0.5 if epoch >= training.epochs * 2 // 3 else 1)
        order = rng.permutation(len(pieces))
        for k in range(0, len(order), 64):
            take = order[k : k + 64]
            x = np.zeros((len(take), shape.window), dtype=np.uint8)
            for r, i in enumerate(take):
                codes = pieces[i]
                n = len(codes) if rng.random() < 0.4 else int(rng.integers(min(6, len(codes)), len(codes) + 1))
                at = int(rng.integers(0, len(codes) - n + 1))
                x[r, :n] = codes[at : at + n]
            runs = np.lib.stride_tricks.sliding_window_view(x, widest, axis=1)  # rows, places, widest
            seen = p["embed"][runs].reshape(len(take), -1, widest * e)
            z = seen @ p["filters"]
            at = z.argmax(axis=1)
            rows = np.arange(len(take))[:, None]
            top = z[rows, at, np.arange(n_filters)[None, :]] + p["bias"]
            hidden = np.maximum(top, 0)
            log_p = _log_softmax(hidden @ p["dense"] + p["dense_bias"])
            d = np.exp(log_p)
            d[np.arange(len(take)), y[take]] -= 1
            d *= (weight[take] / len(take))[:, None]
            d = d.astype(np.float32)
            d_hidden = (d @ p["dense"].T) * (top > 0)
            g = {"dense": hidden.T @ d, "dense_bias": d.sum(axis=0), "bias": d_hidden.sum(axis=0)}
            best = seen[rows, at]  # rows, filters, widest * e
            g["filters"] = np.einsum("rf,rfk->kf", d_hidden, best) * mask
            d_best = d_hidden[:, :, None] * (p["filters"] * mask).T[None]
            where = runs[rows, at]  # rows, filters, widest
            g["embed"] = np.zeros_like(p["embed"])
            np.add.at(g["embed"], where.reshape(-1), d_best.reshape(-1, e))
            g["embed"][0] = 0
            moves += 1
            for name in p:
                first[name] = 0.9 * first[name] + 0.1 * g[name]
                second[name] = 0.999 * second[name] + 0.001 * g[name] ** 2
                p[name] -= rate * (first[name] / (1 - 0.9**moves)) / (np.sqrt(second[name] / (1 - 0.999**moves)) + 1e-8)
    return Network(shape, names, p["embed"], p["filters"] * mask, p["bias"], p["dense"], p["dense_bias"])


def labelled_sample(docs: DataFrame, may_learn: Column, shape: Shape, training: Training, *, text: str, lang: str, doc_id: str) -> tuple[list[str], list[str]]:
    """Pieces of text and their languages, a bounded number for each language.

    The choice is by hash of the doc_id, at a rate that follows from the number of documents of each language, so
    no language is left out, however many there are, and one more pass over the texts is enough. The sample on the
    driver and the network's last layer grow with the number of languages, and with nothing else.
    """
    labelled = docs.where(may_learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = stored(labelled.groupBy(F.col(lang).alias("y")).agg(F.count("*").alias("n")), "languages")
    languages = sizes.count()
    if not languages:
        return [], []
    pieces = []
    for k in range(training.cuts):
        room = F.greatest(F.length(text) - shape.window, F.lit(0)) + 1
        at = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit(k)), room) + 1
        pieces.append(F.substring(F.col(text), at.cast("int"), F.lit(shape.window)))
    steps = 1_000_000
    place = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit("sample")), F.lit(steps))
    rate = F.least(F.lit(steps), F.floor(F.lit(training.sample_per_language * steps) / F.col("n")) + 1)
    cut = labelled.select(F.col(lang).alias("y"), place.alias("place"), F.array(*pieces).alias("pieces"))
    rows = (
        cut.join(sizes, "y")
        .where(F.col("place") < rate)
        .select("y", F.explode("pieces").alias("x"))
        .where(F.col("x").rlike(r"\p{L}"))
        .limit(2 * training.cuts * training.sample_per_language * languages)
        .toPandas()
        .sort_values(["y", "x"])
    )
    return rows["x"].tolist(), rows["y"].tolist()


def train(docs: DataFrame, may_learn: Column, shape: Shape = Shape(), training: Training = Training(), *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Network | None:
    """A network from the labelled documents that may be learned from; None if there are none."""
    texts, languages = labelled_sample(docs, may_learn, shape, training, text=text, lang=lang, doc_id=doc_id)
    return fit(texts, languages, shape, training) if texts else None


def predict(text: Column, net: Network | None) -> Column:
    """Struct of lang_pred and score for every whole text.

    Null, empty and letterless texts, and all texts without a network, are `und` with score 0. Only the text is looked at:
    repeated rows get the same answer, other columns and their names don't matter. Of equal scores the language that comes
    first by name wins. Very long texts are read whole, some windows at a time.
    """

    @F.pandas_udf("lang_pred string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [score_text(net, t) if net is not None else (UNKNOWN, 0.0) for t in texts]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return scored(text)
