"""Benchmark decontamination by template canonicalisation, window joins and slot checks."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Units that count as such behind a number (fixed values).
UNITS = (
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "oz", "lb", "lbs", "ml", "cl", "l", "ms", "s", "min", "h",
    "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilometre", "kilometres", "mile", "miles", "inch", "inches",
    "foot", "feet", "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "ton", "tons", "liter", "liters", "litre", "litres",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "degree", "degrees", "mph", "kmh", "w", "kw", "v", "hz",
)
#: Placeholders begin with a character of the private use area, which no word has.
MARK = "\ue000"
NUMBER, UNIT, NAME = MARK + "n", MARK + "u", MARK + "p"

_NUMBER = r"\p{N}+(?:[.,]\p{N}+)*+"
_MEASURE = _NUMBER + r"\x20?(?i:" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?![\p{L}\p{M}])"
#: Letters of scripts that put no blanks between words; each is a token, with the marks that follow it.
_SCRIPTS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
#: None of them comes before U+0E00, which tells most letters apart without a look at their script.
_UNSPACED = rf"[\u0e00-\x{{10ffff}}&&{_SCRIPTS}&&\p{{L}}]\p{{M}}*+"
#: Ends of lines and sentences.
_LINE, _SENTENCE = r"[\n\r\u2028\u2029]+", r"[\n\r\u2028\u2029.!?\u2026\u3002\uff01\uff1f]+"
#: White space other than one blank.
_SPACES = r"[\s\p{Z}]{2,}+|[\s\p{Z}&&[^\x20]]"
#: A capitalised word inside a sentence: a word, a comma or the like stands before it.
_NAME = r"(?<=[\p{L}\p{M},;:)]\x20{1,2})\p{Lu}\p{Ll}++(?![\p{L}\p{M}])"


@dataclass(frozen=True)
class Limits:
    """window: template tokens to a window. A window of the benchmark counts if min_plain of its tokens are plain words
    (if none has as many, all of the item's do). A document holds an item if consistent windows are min_share of the
    item's, or if min_run of them stand one behind another (13 tokens) with plain words in the proportion that a window
    needs. Items of fewer than min_tokens tokens are held where they are a whole line or sentence; those of fewer than
    min_line_tokens can't be told from common speech and are left out. Sides of joins are broadcast up to
    max_broadcast_rows rows and max_broadcast_bytes bytes (of their text form)."""

    window: int = 8
    min_plain: int = 4
    min_tokens: int = 5
    min_line_tokens: int = 3
    min_share: float = 0.3
    min_run: int = 6
    max_broadcast_rows: int = 500_000
    max_broadcast_bytes: int = 64 << 20


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, " "), "")


def _parted(text: Column) -> Column:
    """Blanks around the letters of unspaced scripts; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _UNSPACED, " $0 ")


def marked(text: Column) -> Column:
    """The tokens of both keys, joined by blanks: lower-case words, those of names with NAME before them, and
    placeholders for numbers and units behind them. Any white space is as good as a blank; letters of scripts without
    blanks are words of their own."""
    spaced = F.regexp_replace(F.replace(_parted(text), F.lit(MARK), F.lit(" ")), _SPACES, " ")
    numbered = F.regexp_replace(F.regexp_replace(spaced, _MEASURE, f" {NUMBER} {UNIT} "), _NUMBER, f" {NUMBER} ")
    named = F.regexp_replace(numbered, _NAME, f"{NAME}$0")
    return F.regexp_replace(F.lower(named), rf"[^\p{{L}}\p{{M}}{MARK}]++", " ")


def template(line: Column) -> Column:
    """Template tokens of a marked text: names are placeholders."""
    return _split(F.regexp_replace(line, rf"{NAME}[\p{{L}}\p{{M}}]++", NAME))


def words(line: Column) -> Column:
    """Tokens of the second key of a marked text, which no capital letter changes: names are words."""
    return _split(F.replace(line, F.lit(NAME), F.lit("")))


def raw_tokens(text: Column) -> Column:
    """The text's own words and numbers (without separators), lower-case, one for each template token."""
    joined = F.regexp_replace(_parted(text), r"(?<=\p{N})[.,](?=\p{N})", "")
    return _split(F.regexp_replace(F.lower(F.regexp_replace(joined, r"\p{N}+", " $0 ")), r"[^\p{L}\p{M}\p{N}]++", " "))


def block_size(window: Column) -> Column:
    """Any run of `window` tokens has a whole block of so many in it, whatever the blocks' start."""
    return F.floor((window + 1) / 2).cast("int")


def _plain(token: Column) -> Column:
    """Whether a token is a word: no placeholder, and there at all."""
    return token.isNotNull() & ~token.startswith(MARK)


def _wordless(tokens: str, first: Column, size: int) -> Column:
    """Whether the tokens from `first` on are placeholders only."""
    none = F.lit(True)
    for k in range(size):
        none = none & ~_plain(F.get(F.col(tokens), first + k))
    return none


def _up_to(last: Column) -> Column:
    """0, 1 and so on up to `last`; nothing below 0. So texts shorter than a block need no filter, which Catalyst would
    push below the parsed columns, parsing each text twice."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _blocks(tokens: str, last: Column, size: int, step: int, skip: Column | None = None) -> Column:
    """Hashes of the blocks of so many tokens that begin at 0, step, 2 * step and so on, up to the block `last`; where
    `skip` holds, blocks without a word have none."""
    hashed = lambda i: F.xxhash64(*[F.get(F.col(tokens), i * step + k) for k in range(size)])
    block = hashed if skip is None else lambda i: F.when(~(skip & _wordless(tokens, i * step, size)), hashed(i))
    return F.transform(_up_to(last), block)


def _anchored(tokens: str, last: Column, size: int, step: int) -> Column:
    """The blocks without a word, hashed together with the word right before or right behind them, if one is there."""
    token = lambda i: F.get(F.col(tokens), i)
    hashed = lambda side, first: F.xxhash64(F.lit(side), *[token(first + k) for k in range(size + 1)])

    def both(b: Column) -> Column:
        before = F.when(_plain(token(b * step - 1)), hashed("before", b * step - 1))
        behind = F.when(_plain(token(b * step + size)), hashed("behind", b * step))
        return F.array(*[F.struct(b.alias("_b"), h.alias("_anchor")) for h in (before, behind)])

    return F.flatten(F.transform(F.filter(_up_to(last), lambda b: _wordless(tokens, b * step, size)), both))


_KEYS = ("_named", "_plain")


def _block_rows(frame: DataFrame, columns: list[str], last: Column, size: int, step: int, place: str, to: str, skip: Column | None = None) -> DataFrame:
    """A row for each block and key."""
    hashes = F.concat(*[_blocks(k, last, size, step, skip) for k in _KEYS])
    rows = frame.withColumn("_of", last + 1).select(*columns, "_of", F.posexplode(hashes).alias("_at", to))
    return rows.select(*columns, F.pmod("_at", "_of").cast("int").alias(place), to)


def _anchor_rows(frame: DataFrame, columns: list[str], last: Column, size: int, step: int, place: str, to: str) -> DataFrame:
    """A row for each block without a word, key and word next to it."""
    rows = frame.select(*columns, F.inline(F.concat(*[_anchored(k, last, size, step) for k in _KEYS])))
    return rows.where("_anchor IS NOT NULL").toDF(*columns, place, to)


def _parsed(docs: DataFrame) -> DataFrame:
    """doc_id, _key, the tokens of both keys and their number _n."""
    parsed = docs.select("doc_id", "_key", marked(F.col("_text")).alias("_line"))
    parsed = parsed.select("doc_id", "_key", template(F.col("_line")).alias("_named"), words(F.col("_line")).alias("_plain"))
    # the size keeps the tokens columns of their own, so that they are made once for each text
    return parsed.select("doc_id", "_key", *_KEYS, F.size("_named").alias("_n"))


def document_blocks(docs: DataFrame, width: int, *, anchors: bool = False) -> DataFrame:
    """doc_id, _key, _block, _g (its hash) of the blocks of so many tokens that stand one behind another in each text;
    with `anchors`, of those without a word, with the word next to them. Each text is parsed once."""
    rows = _anchor_rows if anchors else _block_rows
    return rows(_parsed(docs), ["doc_id", "_key"], F.floor(F.col("_n") / width).cast("int") - 1, width, width, "_block", "_g")


def _telling(tokens: str, limits: Limits) -> Column:
    """Starts of an item's windows that hold enough words."""
    starts = F.sequence(F.lit(0), F.size("item_template") - F.col("size"))
    words_in = lambda p: F.size(F.filter(F.slice(tokens, p + 1, F.col("size")), lambda t: ~t.startswith(MARK)))
    return F.filter(starts, lambda p: words_in(p) >= F.least(F.lit(limits.min_plain), F.col("size")))


def benchmark_items(benchmark: DataFrame, limits: Limits, *, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, item_template, item_words, item_raw and size (window, or all tokens of a shorter item), stored.

    Null, empty and too short items are left out; repeated items count once. `anchored` items are those whose windows
    that count all have a word next to any block without one.
    """
    named = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("_text")).distinct()
    named = named.select("item_id", marked(F.col("_text")).alias("_line"), raw_tokens(F.col("_text")).alias("item_raw"))
    items = named.select("item_id", template(F.col("_line")).alias("item_template"), words(F.col("_line")).alias("item_words"), "item_raw")
    items = items.where(F.size("item_template") >= limits.min_tokens)
    items = items.withColumn("size", F.least(F.size("item_template"), F.lit(limits.window)))
    # a block leaves half of a window; if all of that must be words, one is next to a block that has none
    close = F.lit(limits.min_plain >= limits.window // 2) & (F.size(_telling("item_template", limits)) > 0)
    return stored(items.withColumn("anchored", close), "items")


def _lookup(small: DataFrame, limits: Limits) -> DataFrame:
    """The side of a join as a broadcast one if its rows and bytes have been counted to be few; else the join shuffles."""
    size = small.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct(*small.columns)))).alias("bytes")).first()
    return F.broadcast(small) if size.n <= limits.max_broadcast_rows and (size.bytes or 0) <= limits.max_broadcast_bytes else small


def short_items(docs: DataFrame, benchmark: DataFrame, limits: Limits, *, item_id: str, text: str) -> DataFrame:
    """doc_id, _key, item_id where a short item is a whole line or sentence; case, signs and white space play no part."""
    line = lambda t: F.array_join(raw_tokens(t), " ")
    short = benchmark.select(F.col(item_id).alias("item_id"), line(F.col(text)).alias("_item"))
    number = F.size(_split(F.col("_item")))
    short = stored(short.where((number >= limits.min_line_tokens) & (number < limits.min_tokens)).distinct(), "short-items")
    if short.isEmpty():
        return docs.limit(0).join(short).select("doc_id", "_key", "item_id")
    whole = F.coalesce(F.col("_text"), F.lit(""))
    lines = docs.select("doc_id", "_key", F.explode(F.array_union(F.split(whole, _LINE), F.split(whole, _SENTENCE))).alias("_line"))
    lines = lines.select("doc_id", "_key", line(F.col("_line")).alias("_line"))
    return lines.join(_lookup(short, limits), F.col("_line") == F.col("_item")).select("doc_id", "_key", "item_id").distinct()


def candidates(docs: DataFrame, items: DataFrame, limits: Limits) -> DataFrame:
    """doc_id, _key, item_id, _n (the item's tokens), offset (document place less item place) where a document's block of
    tokens, by either key, is in an item.

    The documents' blocks stand one behind another, the items' at every place, so each shared window holds one of them.
    Blocks of placeholders only, which lists of numbers are full of, meet together with the word next to them.
    """
    blocks = items.select("item_id", "item_template", "item_words", "anchored", block_size(F.col("size")).alias("block"))
    widths = [r["block"] for r in blocks.select("block").distinct().collect()]  # a few: half of the sizes up to `window`
    found = None
    for width in widths:
        own = blocks.where(F.col("block") == width)
        own = own.select("item_id", "anchored", F.col("item_template").alias("_named"), F.col("item_words").alias("_plain"))
        own = own.select("item_id", "anchored", *_KEYS, F.size("_named").alias("_n")).where(F.col("_n") >= width)
        last = F.col("_n") - width
        offset = (F.col("_block") * width - F.col("_place")).alias("offset")
        places = _block_rows(own, ["item_id", "_n"], last, width, 1, "_place", "_h", F.col("anchored")).where("_h IS NOT NULL")
        hits = document_blocks(docs, width).join(_lookup(stored(places.distinct(), "blocks"), limits), F.col("_g") == F.col("_h"))
        hits = hits.select("doc_id", "_key", "item_id", "_n", offset)
        found = hits if found is None else found.union(hits)
        anchors = _anchor_rows(own.where("anchored"), ["item_id", "_n"], last, width, 1, "_place", "_h")
        anchors = stored(anchors.distinct(), "anchors")
        if not anchors.isEmpty():
            theirs = document_blocks(docs, width, anchors=True)
            found = found.union(theirs.join(_lookup(anchors, limits), F.col("_g") == F.col("_h")).select("doc_id", "_key", "item_id", "_n", offset))
    if found is None:
        nothing = [F.lit(0).alias("_n"), F.lit(0).alias("offset")]
        found = docs.limit(0).join(items.select("item_id").limit(0)).select("doc_id", "_key", "item_id", *nothing)
    return stored(found.distinct(), "candidates")


def matches(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents that hold benchmark items: doc_id, _key, item_id, n_windows, share, n_slots, exact.

    Blocks of tokens are joined by hash, and at each offset that they give, document and item are laid side by side.
    A window matches if all of its tokens are equal by one of two keys: templates with names as placeholders, or words
    without case. The share is the larger one of the two: of the windows that tell something as templates, and of those
    that do as words, which must match as words.

    A slot that holds the item's own value is always right. Another value conflicts if the same value of the item stands
    for several ones in the document at this offset, or if it stands for several units or names of the item (numbers
    chosen anew may happen to be equal). Windows that hold a conflicting slot don't count; all others do. exact says
    that all slots of the windows that count hold the item's own values. _key tells apart texts of one doc_id; rows that agree
    in doc_id and text give one result. A short item that is a whole line or sentence counts as one window without slots.
    Null and empty texts hold nothing; empty tables give an empty result.
    """
    items = benchmark_items(benchmark, limits, item_id=item_id, text=item_text)
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_key"))
    runs = candidates(named, items, limits)
    # only documents with candidates are parsed again
    hit = runs.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k")).distinct()
    again = named.join(_lookup(hit, limits), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left_semi")
    again = again.dropDuplicates(["doc_id", "_key"]).select(
        F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), marked(F.col("_text")).alias("_line"), raw_tokens(F.col("_text")).alias("doc_raw")
    )
    again = again.select("_d", "_k", template(F.col("_line")).alias("doc_template"), words(F.col("_line")).alias("doc_words"), "doc_raw")
    starts = F.sequence(F.lit(0), F.size("item_template") - F.col("size"))
    counting = lambda told: F.when(F.size(told) > 0, told).otherwise(starts)
    own = items.withColumnsRenamed({"item_id": "_i"}).withColumns(
        {"_of_n": F.size("item_template"), "_starts": counting(_telling("item_template", limits)), "_word_starts": counting(_telling("item_words", limits))}
    )
    # of a document, each alignment takes only the tokens beside the item
    beside = lambda doc: F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda p: F.get(doc, p + F.col("offset"))).alias(doc)
    laid = runs.join(again, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")))
    laid = laid.select("doc_id", "_key", "item_id", "_n", *[beside(c) for c in ("doc_template", "doc_words", "doc_raw")])
    aligned = laid.join(_lookup(own, limits), F.col("item_id").eqNullSafe(F.col("_i")) & (F.col("_n") == F.col("_of_n"))).drop("_n")

    def same(item: str, doc: str) -> Column:
        """Whether the tokens at each place of the item are equal."""
        return F.transform(F.sequence(F.lit(0), F.size(item) - 1), lambda p: F.get(item, p) == F.coalesce(F.get(doc, p), F.lit("")))

    whole = lambda flags, p: F.forall(F.slice(flags, p + 1, F.col("size")), lambda x: x)
    counted = aligned.withColumn("_same", same("item_template", "doc_template")).withColumn("_same_words", same("item_words", "doc_words"))
    counted = counted.withColumn("_found", F.filter(starts, lambda p: whole("_same", p) | whole("_same_words", p))).where(F.size("_found") > 0)
    covered = lambda places: F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + F.col("size") - 1))))
    slot = lambda p: F.struct(
        F.get("item_template", p).alias("kind"), F.get("item_raw", p).alias("theirs"), F.get("doc_raw", p).alias("ours")
    )
    slots = lambda places: F.transform(F.filter(covered(places), lambda p: F.get("item_template", p).startswith(MARK)), lambda p: F.struct(p.alias("at"), slot(p).alias("slot")))
    counted = counted.withColumn("_slots", slots(F.col("_found")))
    counted = counted.withColumn("_values", F.array_distinct(F.transform("_slots", lambda s: s["slot"])))

    def conflicts(x: Column) -> Column:
        several = lambda v: (v["theirs"] == x["theirs"]) & (v["ours"] != x["ours"])
        fallen = lambda v: (v["theirs"] != x["theirs"]) & (v["ours"] == x["ours"]) & (x["kind"] != NUMBER)
        return (x["theirs"] != x["ours"]) & F.exists("_values", lambda v: (v["kind"] == x["kind"]) & (several(v) | fallen(v)))

    # two references to _wrong and _odd keep them columns of their own, so that they are made once for each alignment
    none = F.array().cast("array<int>")
    odd = F.transform(F.filter("_slots", lambda s: F.array_contains("_wrong", s["slot"])), lambda s: s["at"])
    good = F.filter("_found", lambda p: ~F.exists("_odd", lambda at: (at >= p) & (at < p + F.col("size"))))
    counted = counted.withColumn("_wrong", F.filter("_values", conflicts)).withColumn("_odd", F.when(F.size("_wrong") > 0, odd).otherwise(none))
    counted = counted.withColumn("_good", F.when(F.size("_odd") > 0, good).otherwise(F.col("_found")))
    span = limits.window + limits.min_run - 1
    needed = math.ceil(span * limits.min_plain / limits.window)

    def run(places: Column, tokens: str) -> Column:
        """Whether min_run places (sorted) follow one another, with enough plain words in their tokens."""
        last = F.size(places) - limits.min_run
        plain = lambda p: F.size(F.filter(F.slice(tokens, p + 1, span), lambda t: ~t.startswith(MARK))) >= needed
        follows = lambda i: (F.get(places, i + limits.min_run - 1) == F.get(places, i) + limits.min_run - 1) & plain(F.get(places, i))
        return F.when(last >= 0, F.exists(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), follows)).otherwise(False)

    counted = counted.withColumn("_good_words", F.filter("_good", lambda p: whole("_same_words", p))).withColumn(
        "_run", run(F.col("_good"), "item_template") | run(F.col("_good_words"), "item_words")
    )
    counted = counted.withColumn("places", F.array_intersect("_good", "_starts")).withColumn("word_places", F.array_intersect("_good_words", "_word_starts"))
    checked = counted.where((F.size("places") > 0) | (F.size("word_places") > 0)).withColumn(
        "_held", F.array_distinct(F.transform(slots(F.array_union("places", "word_places")), lambda s: s["slot"]))
    )
    lines = short_items(named, benchmark, limits, item_id=item_id, text=item_text)
    whole_lines = lines.select(
        "doc_id", "_key", "item_id", F.lit(1).cast("long").alias("n_windows"), F.lit(1.0).alias("share"), F.lit(0).cast("long").alias("n_slots"), F.lit(True).alias("exact")
    )
    number = lambda places: F.size(F.array_distinct(F.flatten(F.collect_list(places)))).cast("long")
    return whole_lines.union(
        checked.groupBy("doc_id", "_key", "item_id")
        .agg(
            number("places").alias("_n"),
            number("word_places").alias("_n_words"),
            F.max(F.size("_starts")).alias("_of"),
            F.max(F.size("_word_starts")).alias("_of_words"),
            F.max("_run").alias("_run"),
            F.max(F.size("_held")).cast("long").alias("n_slots"),
            F.min(F.forall("_held", lambda s: s["theirs"] == s["ours"])).alias("exact"),
        )
        .withColumn("_by_words", F.col("_n_words") / F.col("_of_words") > F.col("_n") / F.col("_of"))
        .withColumn("n_windows", F.when(F.col("_by_words"), F.col("_n_words")).otherwise(F.col("_n")))
        .withColumn("share", F.col("n_windows") / F.when(F.col("_by_words"), F.col("_of_words")).otherwise(F.col("_of")))
        .where((F.col("share") >= limits.min_share) | F.col("_run"))
        .select("doc_id", "_key", "item_id", "n_windows", "share", "n_slots", "exact")
    )


def clean(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, unchanged, that hold no benchmark item."""
    held = stored(
        matches(docs, benchmark, limits, doc_id=doc_id, text=text).select(F.col("doc_id").alias("_held"), F.col("_key").alias("_held_key")).distinct(), "held"
    )
    same = docs[doc_id].eqNullSafe(held["_held"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == held["_held_key"])
    return docs.join(_lookup(held, limits), same, "left_anti")
