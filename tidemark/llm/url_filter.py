"""URL filters: listed rules, and naive Bayes over words that unigram Viterbi splits out of hosts and paths."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored


@dataclass(frozen=True)
class Rule:
    """host and its subdomains, where the path starts with path: allow or block."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules that the registered query applies (fixed values).
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))

#: Labelled host names and paths that the classifier learns from, written as words.
BLOCKED = (
    "casino win", "online casino bonus", "free bets", "free spins slots", "poker bets", "jackpot slots", "cheap pills", "cheap viagra pills",
    "online pharmacy discount", "weight loss pills", "ads track", "ads click track", "pixel track", "popup ads banner", "affiliate ads",
    "win cash prize", "lottery win", "crypto giveaway", "payday loans cheap", "replica watches cheap", "adult cams free", "xxx videos free",
    "sports betting odds", "clickbait ads", "cheap followers", "warez crack keygen", "torrent crack", "spam mail bulk", "link spam farm", "escort adult",
)
ALLOWED = (
    "daily news", "city library", "state university", "open science journal", "school district", "public health service", "history museum",
    "garden club", "weather service", "travel guide", "cooking recipes", "city council", "research institute", "national park", "music school",
    "local sports club", "book review", "language courses", "developer docs", "community forum", "art gallery", "medical journal", "news archive",
    "government portal", "energy agency", "film festival", "bicycle club", "street map", "encyclopedia article", "technical manual", "farm and garden shop",
)


@dataclass(frozen=True)
class Settings:
    """max_word: longest word of the segmentation. seed_count: what a word of the labelled names counts for in the
    unigram counts. smoothing: added to every word count of the classifier. least: log-odds from which a url is blocked."""

    max_word: int = 16
    seed_count: int = 1000
    smoothing: float = 0.5
    least: float = 0.69


@dataclass(frozen=True)
class Bayes:
    """Log-odds of block over allow for every learned word; words that weren't learned say nothing."""

    odds: dict[str, float]
    prior: float


def lower_az(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first `://`, A-Z lower-cased) and path; both empty without one and for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_az(host), path


def match_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (the first of equally long ones); nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def train(blocked: Sequence[str], allowed: Sequence[str], s: Settings) -> Bayes:
    """Multinomial naive Bayes from labelled names that are written as words."""
    counts: dict[str, list[int]] = {}
    totals = [0, 0]
    for label, names in ((0, allowed), (1, blocked)):
        for name in names:
            for w in name.split():
                counts.setdefault(w, [0, 0])[label] += 1
                totals[label] += 1
    size = s.smoothing * len(counts)
    rate = lambda n, label: math.log((n + s.smoothing) / (totals[label] + size))
    odds = {w: rate(n[1], 1) - rate(n[0], 0) for w, n in counts.items()}
    prior = math.log(max(len(blocked), 1) / max(len(allowed), 1))
    return Bayes(odds, prior)


def unigrams(pages: DataFrame, bayes: Bayes, s: Settings, *, html: str) -> DataFrame:
    """word, count: the words of a-z of all pages' visible text, and the labelled words. Counts cover all pages."""
    visible = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"<[^>]*+>", " ")
    words = pages.select(F.explode(F.regexp_extract_all(lower_az(visible), F.lit(rf"(?<![a-z])[a-z]{{2,{s.max_word}}}+(?![a-z])"), F.lit(0))).alias("word"))
    spark = pages.sparkSession
    seeds = spark.createDataFrame([(w, s.seed_count) for w in sorted(bayes.odds)], "word string, count long")
    return words.groupBy("word").count().union(seeds).groupBy("word").agg(F.sum("count").alias("count"))


def segment(names: DataFrame, lexicon: DataFrame, s: Settings) -> DataFrame:
    """Adds words to the distinct names (column name, of a-z only): the likeliest split under the unigram model.

    Every substring of up to max_word letters meets the lexicon in a join; the dynamic programme then runs over the
    ones that were found. A letter that no word covers stands alone, at the price of a word seen less than once.
    """
    total = F.lit(math.log(max(lexicon.agg(F.sum("count")).first()[0] or 1, 1)))
    at = F.sequence(F.lit(1), F.length("name"))
    last = F.least(F.lit(s.max_word), F.length("name") - F.col("start") + 1)
    pieces = names.select("name", F.explode(at).alias("start")).select("name", "start", F.explode(F.sequence(F.lit(1), last)).alias("size"))
    pieces = pieces.withColumn("piece", F.substring(F.col("name"), F.col("start"), F.col("size")))
    found = pieces.join(lexicon, F.col("piece") == F.col("word")).groupBy("name").agg(
        F.collect_list(F.struct("start", "size", (F.log("count") - total).alias("log_p"))).alias("parts")
    )
    known = names.join(found.withColumnRenamed("name", "_name"), F.col("name") == F.col("_name"), "left")
    # a letter alone is unlikelier than any word seen once
    alone = -(math.log(max(lexicon.agg(F.sum("count")).first()[0] or 1, 1)) + 3.0)

    @F.pandas_udf("array<string>")
    def viterbi(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for all_names, all_parts in batches:
            yield pd.Series([best_split(n, p, alone) for n, p in zip(all_names, all_parts)])

    return known.select("name", viterbi("name", "parts").alias("words"))


def best_split(name: str, parts: list | None, alone: float) -> list[str]:
    """Viterbi over the found pieces; of equally likely splits the one with the longer last word."""
    ends: dict[int, list[tuple[int, float]]] = {}
    for p in parts if parts is not None else ():
        ends.setdefault(p["start"] - 1 + p["size"], []).append((p["start"] - 1, p["log_p"]))
    best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        for start, log_p in sorted(ends.get(end, []) + [(end - 1, alone)]):
            if best[start] + log_p > best[end]:
                best[end], back[end] = best[start] + log_p, start
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def judge(
    pages: DataFrame, rules: Sequence[Rule] = RULES, *, blocked: Sequence[str] = BLOCKED, allowed: Sequence[str] = ALLOWED, s: Settings = Settings(),
    page_id: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, log_odds, words.

    The longest rule that fits decides; else naive Bayes over the words that host and path split into. Words are
    runs of a-z, digits and other characters separate them; each different host and path is split once. A url that is
    null or has no `://` has empty host and path, no words, and the prior's verdict. Repeated rows are judged alike.
    An empty table gives an empty result; other columns play no part.
    """
    host, path = split_url(F.col(url))
    urls = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    bayes = train(blocked, allowed, s)
    lexicon = stored(unigrams(pages, bayes, s, html=html), "unigrams")
    different = stored(urls.select("host", "path").distinct(), "urls")
    names_of = F.regexp_extract_all(lower_az(F.concat_ws(" ", "host", "path")), F.lit("[a-z]+"), F.lit(0))
    pieces = stored(different.select("host", "path", F.posexplode(names_of).alias("place", "name")), "url-names")
    split = segment(pieces.select("name").distinct(), lexicon, s)
    odds = F.create_map(*[x for w, v in bayes.odds.items() for x in (F.lit(w), F.lit(v))])
    split = stored(
        split.select(
            F.col("name").alias("_name"), "words",
            F.aggregate("words", F.lit(0.0), lambda total, w: total + F.coalesce(F.try_element_at(odds, w), F.lit(0.0))).alias("log_odds"),
        ),
        "splits",
    )
    scored = (
        pieces.join(split, F.col("name") == F.col("_name"))
        .groupBy(F.col("host").alias("_host"), F.col("path").alias("_path"))
        .agg(
            F.sum("log_odds").alias("log_odds"),
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "words"))), lambda x: x["words"])).alias("words"),
        )
    )
    named, ruled = match_rule(F.col("host"), F.col("path"), rules)
    log_odds = F.coalesce("log_odds", F.lit(0.0)) + bayes.prior
    return (
        urls.join(scored, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
        .withColumn("log_odds", log_odds)
        .select(
            "page_id", "host", "path", named.alias("rule"),
            F.coalesce(ruled, F.when(F.col("log_odds") >= s.least, "block").otherwise("allow")).alias("verdict"),
            "log_odds", F.coalesce("words", F.array().cast("array<string>")).alias("words"),
        )
    )
