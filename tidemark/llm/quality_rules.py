"""Quality rules of single texts, and host verdicts from their failure rates."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, stored

#: Characters counted as symbols (fixed value).
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])


@dataclass(frozen=True)
class Rules:
    """Limits of the rules. A host is rejected if its shrunk failure rate is over `max_host_rate`."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    max_host_rate: float = 0.8


def _repeated(words: list[bytes], window: int) -> int:
    """Words inside windows that occur twice or more."""
    windows = list(zip(*[words[i:] for i in range(window)]))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + window - max(i, upto)
            upto = i + window
    return covered


def _duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def text_counts(text: Column, window: int = 5) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of whole texts; zeros for null."""

    @F.pandas_udf(COUNTS)
    def count(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            if not t:
                rows.append((0, 0, 0, 0, 0))
                continue
            words = t.encode().split()
            rows.append(
                (
                    len(words),
                    len(t) - sum(map(t.count, BLANKS)),
                    sum(map(t.count, SYMBOLS)),
                    _duplicate_lines(t),
                    _repeated(words, window),
                )
            )
        return pd.DataFrame(rows, columns=COUNTS.names, dtype="int64")

    return count(text)


def base_failed(counts: str, rules: Rules) -> Column:
    """Whether a text itself fails, from its counts."""
    n = F.col(f"{counts}.n_words")
    return (n < rules.min_words) | (100 * F.col(f"{counts}.n_repeat_words") > rules.max_repeat_percent * n)


def host_verdicts(flags: DataFrame, host: str, failed: str, rules: Rules = Rules()) -> DataFrame:
    """One row per host: n_docs, n_failed, shrunk_rate, host_kept.

    The rates get a beta prior whose mean is the overall rate and whose strength fits the spread of the rates
    between hosts (method of moments, hosts weighted by their documents). Rows without a host get no row.
    With no spread at all the prior is as strong as `1e6` documents; it is never weaker than one document.
    """
    hosts = (
        flags.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col(failed)).alias("n_failed"))
    )
    rate = F.col("n_failed") / F.col("n_docs")
    total = hosts.agg(
        F.sum("n_docs").alias("n"),
        F.sum("n_failed").alias("f"),
        F.sum(F.col("n_failed") * rate).alias("ff"),
    ).select(
        (F.col("f") / F.col("n")).alias("mean"),
        (F.col("ff") / F.col("n") - F.pow(F.col("f") / F.col("n"), F.lit(2.0))).alias("spread"),
    )
    strength = F.when(
        F.col("spread") > 1e-12, F.col("mean") * (1 - F.col("mean")) / F.col("spread") - 1
    ).otherwise(F.lit(1e6))
    total = total.select("mean", F.least(F.greatest(strength, F.lit(1.0)), F.lit(1e6)).alias("strength"))
    shrunk = (F.col("n_failed") + F.col("mean") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    return (
        hosts.crossJoin(F.broadcast(total))  # one row
        .withColumn("shrunk_rate", shrunk)
        .select("host", "n_docs", "n_failed", "shrunk_rate", (F.col("shrunk_rate") <= rules.max_host_rate).alias("host_kept"))
    )


def judge(docs: DataFrame, rules: Rules = Rules(), *, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per document: doc_id, host, counts, base_failed, shrunk_rate, kept.

    A null text has no words and fails. A document without a host is judged by its own rules alone. Repeated
    rows are judged one by one and all count for their host. An empty table gives an empty result. Other columns
    of `docs`, whatever their names, play no part.
    """
    counted = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), text_counts(F.col(text), rules.window).alias("c"))
    own = stored(counted.withColumn("base_failed", base_failed("c", rules)), "rule-counts")
    verdicts = host_verdicts(own, "host", "base_failed", rules).select(F.col("host").alias("_host"), "shrunk_rate", "host_kept")
    return own.join(verdicts, F.col("host") == F.col("_host"), "left").select(
        "doc_id", "host", "c.*", "base_failed", "shrunk_rate",
        (~F.col("base_failed") & F.coalesce(F.col("host_kept"), F.lit(True))).alias("kept"),
    )


def keep(docs: DataFrame, rules: Rules = Rules(), *, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of `docs`, unchanged, that `judge` keeps.

    Only rejected hosts are joined to the texts, from a stored table of known size.
    """
    flags = docs.select(F.col(host).alias("host"), text_counts(F.col(text), rules.window).alias("c")).select(
        "host", base_failed("c", rules).alias("failed")
    )
    verdicts = host_verdicts(flags, "host", "failed", rules)
    rejected = stored(verdicts.where(~F.col("host_kept")).select(F.col("host").alias("_rejected_host")), "rejected-hosts")
    counts = fresh(docs, "_counts")
    own = docs.withColumn(counts, text_counts(F.col(text), rules.window)).where(~base_failed(counts, rules)).drop(counts)
    return own.join(rejected, own[host] == rejected["_rejected_host"], "left_anti")
