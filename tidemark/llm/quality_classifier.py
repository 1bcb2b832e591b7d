"""Quality classifier: tree paths as rules over text statistics, a lasso logistic model over the rules, compiled to Spark columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters counted as symbols and as sentence ends (fixed values).
SYMBOLS = "#*$%&|<>"
ENDS = ".!?"

STATISTICS = (
    "n_words", "n_lines", "mean_word", "longest_word", "distinct_words", "top_word", "symbols", "bars", "bangs", "digits", "capitals",
    "letters", "ends", "commas", "line_words", "dup_lines", "marked_words", "short_words",
)
_KIND = T.StructType([T.StructField(n, T.DoubleType()) for n in STATISTICS])
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Training:
    """max_docs bounds the labelled sample (by hash of the doc_id)."""

    max_docs: int = 16_000
    trees: int = 30
    depth: int = 3
    bins: int = 32
    shrinkage: float = 0.3
    least_rows: int = 20
    penalty: float = 1e-3
    rounds: int = 400


@dataclass(frozen=True)
class Rule:
    """All of its conditions (statistic, is over, limit) hold; the weight counts then."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0


@dataclass(frozen=True)
class Model:
    rules: tuple[Rule, ...]
    bias: float


def _statistics(text: str | None) -> tuple[float, ...]:
    if not text:
        return (0.0,) * len(STATISTICS)
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return (0.0,) * len(STATISTICS)
    different: dict[str, int] = {}
    longest = short = marked = letters_in_words = 0
    for w in words:
        different[w] = different.get(w, 0) + 1
        k = len(w)
        letters_in_words += k
        longest = max(longest, k)
        short += k <= 2
        marked += w[-1] in "#*$%&"
    lines = [x for x in text.split("\n") if not x.isspace() and x]
    return (
        float(n),
        float(len(lines)),
        letters_in_words / n,
        float(longest),
        len(different) / n,
        max(different.values()) / n,
        sum(map(text.count, SYMBOLS)) / n,
        text.count("|") / n,
        text.count("!") / n,
        len(_DIGIT.findall(text)) / chars,
        len(_UPPER.findall(text)) / chars,
        (chars - len(_LETTER.sub("", text))) / chars,
        sum(map(text.count, ENDS)) / n,
        text.count(",") / n,
        n / max(1, len(lines)),
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        marked / n,
        short / n,
    )


def statistics(text: Column) -> Column:
    """Struct of the statistics of every whole text; zeros for null and for texts without words."""

    @F.pandas_udf(_KIND)
    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_statistics(t) for t in texts], columns=list(STATISTICS), dtype="float64")

    return measured(text)


def grow_rules(x: np.ndarray, y: np.ndarray, training: Training) -> list[Rule]:
    """Paths of boosted shallow trees (logistic loss), each node but the root one rule; repeated rules once."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, training.bins + 1)[1:-1])) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(x.shape[1])], axis=1)
    score = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    found: dict[tuple, None] = {}
    for _ in range(training.trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        leaves = [(np.arange(len(y)), ())]
        for _ in range(training.depth):
            grown = []
            for rows, path in leaves:
                best = _best_split(codes[rows], g[rows], h[rows], cuts, training.least_rows)
                if best is None:
                    grown.append((rows, path))
                    continue
                j, k = best
                over = codes[rows, j] > k
                for side, part in ((False, rows[~over]), (True, rows[over])):
                    longer = (*path, (STATISTICS[j], side, float(cuts[j][k])))
                    found[_short(longer)] = None
                    grown.append((part, longer))
            leaves = grown
        for rows, _ in leaves:
            score[rows] += training.shrinkage * g[rows].sum() / (h[rows].sum() + 1.0)
    return [Rule(c) for c in found]


def _best_split(codes: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], least: int) -> tuple[int, int] | None:
    base, best, at = g.sum() ** 2 / (h.sum() + 1.0), 1e-6, None
    for j, limits in enumerate(cuts):
        n = len(limits) + 1
        gs, hs = np.cumsum(np.bincount(codes[:, j], g, n)), np.cumsum(np.bincount(codes[:, j], h, n))
        rows = np.cumsum(np.bincount(codes[:, j], minlength=n))
        left, right = rows[:-1], rows[-1] - rows[:-1]
        gain = gs[:-1] ** 2 / (hs[:-1] + 1.0) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1.0) - base
        gain[(left < least) | (right < least)] = -1
        if len(gain) and gain.max() > best:
            best, at = gain.max(), (j, int(gain.argmax()))
    return at


def _short(path: tuple) -> tuple:
    """The path with the narrowest limit of each statistic and side only."""
    narrowest: dict[tuple[str, bool], float] = {}
    for name, over, limit in path:
        key = (name, over)
        narrowest[key] = limit if key not in narrowest else (max if over else min)(limit, narrowest[key])
    return tuple(sorted((name, over, limit) for (name, over), limit in narrowest.items()))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for name, over, limit in rule.conditions:
        column = x[:, STATISTICS.index(name)]
        out &= column > limit if over else column <= limit
    return out


def fit(x: np.ndarray, y: np.ndarray, training: Training = Training()) -> Model:
    """Rules with lasso weights, by accelerated proximal gradient steps; rules of weight 0 are dropped.

    If all labels agree there are no rules, and every score is near that label.
    """
    mean = float(y.mean())
    if mean in (0.0, 1.0):
        return Model((), 6.0 if mean else -6.0)
    rules = grow_rules(x, y, training)
    if not rules:
        return Model((), float(np.log(mean / (1 - mean))))
    raw = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float32)
    share = raw.mean(axis=0)
    use = (share > 1e-3) & (share < 1 - 1e-3)
    rules, raw, share = [r for r, u in zip(rules, use) if u], raw[:, use], share[use]
    scale = np.sqrt(share * (1 - share))
    a = (raw - share) / scale
    top = np.ones(a.shape[1], dtype=np.float32)
    for _ in range(20):
        top = a.T @ (a @ top)
        top /= np.linalg.norm(top)
    step = 4.0 / (np.linalg.norm(a @ top) ** 2 / len(y) * 1.05 + 1e-9)
    w = np.zeros(a.shape[1], dtype=np.float32)
    ahead, t, bias = w.copy(), 1.0, float(np.log(mean / (1 - mean)))
    for _ in range(training.rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ ahead + bias, -30, 30)))
        g = a.T @ (p - y).astype(np.float32) / len(y)
        moved = ahead - step * g
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * training.penalty, 0)
        bias -= float((p - y).mean()) * 2
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    weights = w / scale
    kept = [Rule(r.conditions, float(v)) for r, v in zip(rules, weights) if abs(v) > 1e-4]
    return Model(tuple(kept), bias - float((weights * share).sum()))


def train(measured: DataFrame, labels: DataFrame, may_learn: Column, training: Training = Training(), *, stats: str = "stats", doc_id: str = "doc_id", label: str = "quality") -> Model | None:
    """A model from a bounded sample of the labelled documents; None without any.

    measured has the doc_id and the statistics; may_learn is a condition on the doc_id. A doc_id with several labels
    counts once, with the largest.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id)).agg(F.max(label).cast("int").alias("_y"))
        .where(may_learn)
        .withColumnRenamed(doc_id, "_id")
    )
    n = known.count()
    if not n:
        return None
    steps = 1_000_000
    chosen = known.where(
        F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit("sample")), F.lit(steps)) < min(steps, training.max_docs * steps // n + 1)
    ).limit(2 * training.max_docs)  # bounded, so it may be broadcast
    rows = (
        measured.join(F.broadcast(chosen), F.col(doc_id) == F.col("_id"))
        .select(F.col(doc_id).cast("string").alias("_order"), "_y", f"{stats}.*")
        .toPandas()
        .sort_values("_order", kind="stable")
    )
    if not len(rows):
        return None
    return fit(rows[list(STATISTICS)].to_numpy(dtype=np.float64), (rows["_y"] > 0).to_numpy(dtype=np.float64), training)


def score(model: Model | None, stats: str = "stats") -> Column:
    """The model as one Spark expression over the statistics; 0.5 without a model."""
    if model is None:
        return F.lit(0.5)
    total = F.lit(model.bias)
    for rule in model.rules:
        condition = None
        for name, over, limit in rule.conditions:
            column = F.col(f"{stats}.{name}")
            part = column > limit if over else column <= limit
            condition = part if condition is None else condition & part
        total = total + F.when(condition, F.lit(rule.weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-F.least(F.greatest(total, F.lit(-40.0)), F.lit(40.0))))
