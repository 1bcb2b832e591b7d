"""N-gram Jaccard self-join of documents by a size-aware heavy-light overlap join, and its connected components."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored
from .shingles import mix, parity_bits, parity_distance, set_key, shingle_set


@dataclass(frozen=True)
class Settings:
    """Two sets link if 100 * intersection >= percent * union.

    hot_list bounds the broadcast list of frequent shingles. The list only orders shingles: whichever are on it, the
    join finds the same links. A list of more than `block` documents, or whose sets may take more than `block_bytes`, is
    compared block by block.
    """

    words: int = 5
    percent: int = 75
    max_light: int = 16
    scan_cost: float = 4.0
    hot_list: int = 200_000
    hot_count: int = 16
    tally: int = 2_000_000
    block: int = 1024
    block_bytes: int = 16 << 20
    max_broadcast_rows: int = 500_000


def least_overlap(n: int, m: int, percent: int) -> int:
    """Smallest intersection with which sets of n and m members link."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """Of two linked sets, in any one order of all members, each has a common member among so many first ones."""
    return n - -(-percent * n // 100) + 1


def sizes_linked_to(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_count(n: int, largest: int, percent: int) -> int:
    """Subsets that a light set of n members is listed under, with light partners of up to `largest` members."""
    return sum(math.comb(n, least_overlap(n, m, percent)) for m in sizes_linked_to(n, percent) if m <= largest)


def choose_boundary(histogram: dict[int, int], s: Settings) -> int:
    """Largest size of a light set: where listing subsets and scanning inverted lists together cost least."""
    best, boundary = None, 0
    for b in range(0, s.max_light + 1):
        light = sum(k * subset_count(n, b, s.percent) for n, k in histogram.items() if 0 < n <= b)
        heavy = sum(k * prefix_length(n, s.percent) * s.scan_cost for n, k in histogram.items() if n >= -(-s.percent * (b + 1) // 100) and n)
        if best is None or light + heavy < best:
            best, boundary = light + heavy, b
    return boundary


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def profile(docs: DataFrame, s: Settings, *, doc_id: str, text: str) -> DataFrame:
    """One row per document (doc_id, text_key, n, key, check, bits) and rows (hot_token, hot_count) of shingles that a
    task meets in two documents or more. key and check name the set, bits are its parities."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pending: list[np.ndarray] = []
        held = 0

        def tallied() -> pd.DataFrame:
            tokens, counts = np.unique(np.concatenate(pending), return_counts=True)
            often = counts > 1
            return pd.DataFrame({"hot_token": _signed(tokens[often]), "hot_count": counts[often].astype(np.int64)})

        columns = ["doc_id", "text_key", "n", "key", "check", "bits", "hot_token", "hot_count"]
        kinds = {"doc_id": "Int64", "text_key": "Int64", "n": "Int64", "key": "Int64", "check": "Int64", "hot_token": "Int64", "hot_count": "Int64"}
        for batch in batches:
            out = []
            for i, k, t in zip(batch["doc_id"].tolist(), batch["text_key"].tolist(), batch["text"].tolist()):
                tokens = shingle_set(t, s.words)
                a, b = set_key(tokens)
                out.append((None if i is None else int(i), k, len(tokens), a, b, parity_bits(tokens) if len(tokens) else None, None, None))
                pending.append(tokens)
                held += len(tokens)
                if held > s.tally:
                    yield tallied().reindex(columns=columns).astype(kinds)
                    pending, held = [], 0
            yield pd.DataFrame(out, columns=columns).astype(kinds)
        if held:
            yield tallied().reindex(columns=columns).astype(kinds)

    given = docs.select(
        F.col(doc_id).cast("long").cast("string").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"),
        F.col(text).alias("text"),
    )
    kind = "doc_id long, text_key long, n long, key long, check long, bits binary, hot_token long, hot_count long"
    return stored(given.mapInPandas(rows, kind), "profile")


def classes_of(profiled: DataFrame) -> DataFrame:
    """One row per different non-empty set: key, n, bits, smallest doc_id. Two sets of one key stop the run."""
    found = (
        profiled.where(F.col("n") > 0)
        .groupBy("key")
        .agg(F.min("n").alias("n"), F.max("n").alias("_n"), F.min("check").alias("_c0"), F.max("check").alias("_c1"), F.first("bits").alias("bits"), F.min("doc_id").alias("smallest"))
    )
    one = (F.col("n") == F.col("_n")) & (F.col("_c0") == F.col("_c1"))
    key = F.when(one, F.col("key")).otherwise(F.raise_error(F.lit("two different sets have one key")).cast("long"))
    return stored(found.select(key.alias("key"), "n", "bits", "smallest"), "classes")


def hot_tokens(profiled: DataFrame, s: Settings) -> np.ndarray:
    """The most frequent shingles, rarest first; at most hot_list of them."""
    counted = profiled.where(F.col("hot_token").isNotNull()).groupBy("hot_token").agg(F.sum("hot_count").alias("count")).where(F.col("count") >= s.hot_count)
    top = counted.orderBy(F.desc("count"), "hot_token").limit(s.hot_list).toPandas()
    return top["hot_token"].to_numpy(dtype=np.int64)[::-1].copy().view(np.uint64)


def listings(docs: DataFrame, boundary: int, hot: np.ndarray, s: Settings, *, text: str) -> DataFrame:
    """Rows (pair, token, key, n). pair 0: a member of the prefix of a set that may have a heavy partner; other pairs: a subset
    of a light set, for partners of one size (pair is 1000 * smaller + larger size)."""
    by_value = np.argsort(hot)
    values = hot[by_value]
    percent = s.percent
    from_size = -(-percent * (boundary + 1) // 100)

    def prefix(tokens: np.ndarray) -> np.ndarray:
        if len(values):
            at = np.minimum(np.searchsorted(values, tokens), len(values) - 1)
            often = values[at] == tokens
            if often.any():
                tokens = np.concatenate([tokens[~often], tokens[often][np.argsort(by_value[at[often]])]])
        return tokens[: prefix_length(len(tokens), percent)]

    def light(tokens: np.ndarray) -> Iterator[tuple[int, int]]:
        n = len(tokens)
        for m in sizes_linked_to(n, percent):
            if 0 < m <= boundary:
                pair = 1000 * min(n, m) + max(n, m)
                for subset in itertools.combinations(tokens, least_overlap(n, m, percent)):
                    yield pair, set_key(np.array(subset, dtype=np.uint64))[0]

    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs, found, keys, sizes, seen = [], [], [], [], set()
            for t in batch["text"].tolist():
                tokens = shingle_set(t, s.words)
                n = len(tokens)
                key = set_key(tokens)[0] if n else 0
                if not n or key in seen:
                    continue
                seen.add(key)
                if n >= from_size:
                    first = prefix(tokens)
                    pairs.append(np.zeros(len(first), dtype=np.int32))
                    found.append(_signed(first))
                    keys.append(np.full(len(first), key, dtype=np.int64))
                    sizes.append(np.full(len(first), n, dtype=np.int64))
                if n <= boundary:
                    for pair, subset in light(tokens):
                        pairs.append(np.array([pair], dtype=np.int32))
                        found.append(np.array([subset], dtype=np.int64))
                        keys.append(np.array([key], dtype=np.int64))
                        sizes.append(np.array([n], dtype=np.int64))
            for k in range(0, len(pairs), 500):
                part = slice(k, k + 500)
                yield pd.DataFrame(
                    {"pair": np.concatenate(pairs[part]), "token": np.concatenate(found[part]), "key": np.concatenate(keys[part]), "n": np.concatenate(sizes[part])}
                )

    kind = "pair int, token long, key long, n long"
    return stored(docs.select(F.col(text).alias("text")).mapInPandas(rows, kind), "listings")


def light_links(listed: DataFrame) -> DataFrame:
    """Links (a, b) among light sets: all that share a subset for their two sizes are linked to one another, or, of two
    different sizes, to those of the other size; so all of them are one component, and its smallest key a star's centre."""
    rows = listed.where(F.col("pair") > 0).select("pair", "token", "key", "n").distinct()
    shared = (
        rows.groupBy("pair", "token")
        .agg(F.min("key").alias("a"), F.max("key").alias("_b"), F.min("n").alias("_n0"), F.max("n").alias("_n1"))
        .where((F.col("a") != F.col("_b")) & ((F.col("_n0") != F.col("_n1")) | (F.floor(F.col("pair") / 1000) == F.col("pair") % 1000)))
        .select("pair", "token", "a")
    )
    return rows.join(shared, ["pair", "token"]).where(F.col("a") != F.col("key")).select("a", F.col("key").alias("b")).distinct()


def inverted_lists(listed: DataFrame, boundary: int, s: Settings) -> DataFrame:
    """Rows (token, key, n, size, times) of the inverted lists of two sets or more, of which one is heavy.

    Of lists with the same members one stays; times says how many they are.
    """
    rows = listed.where(F.col("pair") == 0).select("token", "key", "n")
    # of most shingles only that one set has them is ever known: two keys are all that is summed for them
    several = rows.groupBy("token").agg(F.min("key").alias("_k0"), F.max("key").alias("_k1")).where("_k0 != _k1").select(F.col("token").alias("_token"))
    members = stored(rows.join(several, F.col("token") == F.col("_token")).select("token", "key", "n").distinct(), "members")
    named = F.xxhash64("key")
    lists = (
        members.groupBy("token")
        .agg(
            F.min("key").alias("_k0"), F.max("key").alias("_k1"), F.max("n").alias("_n1"), F.count(F.lit(1)).alias("size"),
            F.bit_xor(named).alias("_x"), F.sum(F.shiftright(F.xxhash64("key", F.lit(1)), 32)).alias("_s"),
        )
        .where(F.col("_n1") > boundary)
    )
    chosen = lists.groupBy("_k0", "_k1", "size", "_x", "_s").agg(F.min("token").alias("_token"), F.count(F.lit(1)).alias("times"))
    return stored(members.join(chosen.select("_token", "size", "times"), F.col("token") == F.col("_token")).drop("_token"), "lists")


def star_pairs(lists: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) of each list's most central member with each other one that has a fitting size.

    A copy's changed places give it shingles that it has to itself, so the document that others were copied from has
    the most and longest lists for its size.
    """
    whole = F.col("n") - F.ceil(F.lit(s.percent) * F.col("n") / 100) + 1
    central = lists.groupBy("key").agg((F.sum(F.col("times") * F.log("size")) / F.first(whole)).alias("central"))
    scored = lists.join(central.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"))
    top = scored.groupBy(F.col("token").alias("_token")).agg(F.max(F.struct("central", "key", "n")).alias("top"))
    pairs = lists.join(top, F.col("token") == F.col("_token")).where((F.col("key") != F.col("top.key")) & _fit(F.col("n"), F.col("top.n"), s))
    return pairs.select(F.least("key", F.col("top.key")).alias("a"), F.greatest("key", F.col("top.key")).alias("b")).distinct()


def _fit(n, m, s: Settings):
    return F.least(n, m) * 100 >= F.greatest(n, m) * s.percent


def near_pairs(pairs: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """The pairs whose parities don't rule a link out."""
    left = classes.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    right = classes.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    percent = s.percent

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            far = np.array([parity_distance(p, q) for p, q in zip(x["bits_a"], x["bits_b"])], dtype=np.int64)
            near = _may_link(x["na"].to_numpy() + x["nb"].to_numpy(), far, percent)
            yield x.loc[near, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").mapInPandas(kept, "a long, b long")


def _may_link(sizes: np.ndarray, differing: np.ndarray, percent: int) -> np.ndarray:
    """Linked sets differ in at most (100 - percent) / (100 + percent) of their sizes together."""
    return differing * (100 + percent) <= sizes * (100 - percent)


def sets_of(keys: DataFrame, docs: DataFrame, profiled: DataFrame, s: Settings, *, doc_id: str, text: str) -> DataFrame:
    """The whole sets (key, tokens) of the given keys, made again from the text of one document each."""
    wanted = keys.select(F.col("key").alias("_w")).distinct()
    owners = (
        profiled.where(F.col("n") > 0).join(wanted, F.col("key") == F.col("_w"), "left_semi")
        .groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("o"))
        .select(F.col("o.doc_id").alias("_id"), F.col("o.text_key").alias("_text_key"))
    )
    owners = stored(owners.distinct(), "owners")
    small = owners.count() <= s.max_broadcast_rows
    words = s.words

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingle_set(t, words) for t in batch["text"].tolist()]
            yield pd.DataFrame({"key": [set_key(x)[0] for x in found], "tokens": [x.tobytes() for x in found]})

    given = docs.select(F.col(doc_id).cast("long").alias("_doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_k"), F.col(text).alias("text"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_text_key"))
    chosen = given.join(F.broadcast(owners) if small else owners, same, "left_semi").select("text")
    return stored(chosen.mapInPandas(sets, "key long, tokens binary"), "sets").dropDuplicates(["key"])


def verified(near: DataFrame, docs: DataFrame, profiled: DataFrame, s: Settings, *, doc_id: str, text: str) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets; only the sets in pairs are made again from their texts."""
    near = stored(near, "near")
    made = sets_of(near.select(F.col("a").alias("key")).union(near.select("b")), docs, profiled, s, doc_id=doc_id, text=text)
    percent = s.percent

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            keep = []
            for p, q in zip(x["tokens_a"], x["tokens_b"]):
                p, q = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield x.loc[keep, ["a", "b"]]

    left = made.select(F.col("key").alias("a"), F.col("tokens").alias("tokens_a"))
    right = made.select(F.col("key").alias("b"), F.col("tokens").alias("tokens_b"))
    return stored(near.join(left, "a").join(right, "b").mapInPandas(linked, "a long, b long"), "links")


def rest_links(
    lists: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, profiled: DataFrame, s: Settings, *, doc_id: str, text: str
) -> DataFrame:
    """Links (a, b) between members of a list that aren't in one component yet, enough of them to join what links.

    A list comes as one group, a longer one as a group for each two of its blocks. First the parities tell which
    members may link at all with one of another component; only their whole sets come to the group, which compares
    them and hands on the links that join two components of its own. So rows follow the members, however many pairs
    of them come close without a link.
    """
    known = labels.select(F.col("key").alias("_key"), "component")
    rows = lists.join(known, F.col("key") == F.col("_key"), "left").select("token", "key", "n", "size", F.coalesce("component", "key").alias("component"))
    rows = stored(rows, "labelled")
    mixed = (
        rows.groupBy(F.col("token").alias("_token"))
        .agg(F.min("component").alias("_c0"), F.max("component").alias("_c1"), F.max("n").alias("_most"))
        .where(F.col("_c0") != F.col("_c1"))
    )
    by_size, by_bytes = F.ceil(F.col("size") / s.block), F.ceil(F.col("size") * F.col("_most") * 8 / s.block_bytes)
    blocks = F.least(F.greatest(by_size, by_bytes, F.lit(1)), F.col("size")).cast("int")
    own = F.pmod(F.xxhash64("key"), F.col("_blocks")).cast("int")
    dealt = (
        rows.join(mixed, F.col("token") == F.col("_token"))
        .withColumn("_blocks", blocks)
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select("token", "key", "component", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"))
    )
    told = classes.select(F.col("key").alias("_k"), "n", "bits")
    groups = (
        dealt.join(told, F.col("key") == F.col("_k"))
        .groupBy("token", "i", "j")
        .agg(F.collect_list(F.struct("key", "component", "n", "bits")).alias("members"))
        .where(F.size("members") > 1)
    )
    percent = s.percent

    def may_link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for token, i, j, members in zip(batch["token"], batch["i"], batch["j"], batch["members"]):
                found = _near_members(members, percent)
                if found:
                    yield pd.DataFrame({"token": token, "i": i, "j": j, "key": [m["key"] for m in found], "component": [m["component"] for m in found]})

    near = stored(groups.mapInPandas(may_link, "token long, i int, j int, key long, component long"), "near-members")
    made = sets_of(near, docs, profiled, s, doc_id=doc_id, text=text).withColumnRenamed("key", "_key")

    def compared(group: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(t, dtype=np.uint64) for t in group["tokens"]]
        found = _joining_links(group["key"].to_numpy(), group["component"].to_numpy(), sets, percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    with_sets = near.join(made, F.col("key") == F.col("_key")).select("token", "i", "j", "key", "component", "tokens")
    return stored(with_sets.groupBy("token", "i", "j").applyInPandas(compared, "a long, b long").distinct(), "rest-links")


def _near_members(members: list, percent: int) -> list:
    """The members whose parities don't rule out a link with a member of another component."""
    members = sorted(members, key=lambda m: m["n"])
    sizes = np.array([m["n"] for m in members], dtype=np.int64)
    parts = np.array([m["component"] for m in members], dtype=np.int64)
    raw = [np.frombuffer(m["bits"], dtype=np.uint8) for m in members]
    lengths = np.array([len(r) for r in raw])
    found = np.zeros(len(members), dtype=bool)
    for i in range(len(members) - 1):
        top = int(np.searchsorted(sizes, 100 * sizes[i] // percent, side="right"))
        other = np.flatnonzero(parts[i + 1 : top] != parts[i]) + i + 1
        if found[i]:
            other = other[~found[other]]  # what is known already needs no other witness
        if len(other) < 4:
            near = [j for j in other if _may_link(sizes[i] + sizes[j], np.int64(parity_distance(members[i]["bits"], members[j]["bits"])), percent)]
        else:
            near = []
            for length in np.unique(lengths[other]):  # one or two lengths, as the sizes fit
                those = other[lengths[other] == length]
                table = np.stack([raw[j] for j in those])
                mine = raw[i]
                if length > len(mine):
                    table = np.bitwise_xor.reduce(table.reshape(len(those), -1, len(mine)), axis=1)
                differing = np.bitwise_count(table ^ mine).sum(axis=1, dtype=np.int64)
                near += those[_may_link(sizes[i] + sizes[those], differing, percent)].tolist()
        if len(near):
            found[i] = True
            found[near] = True
    return [m for m, hit in zip(members, found) if hit]


#: Shared shingles that a matrix of members holds at once.
_COLUMNS = 2048


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each two sets. Shingles of one set only are left out; the others are columns of a
    matrix of zeros and ones, some at a time, whose products add up (exactly: counts stay far below 2^24)."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + _COLUMNS])
        rows, places = np.unique(owner[lo:hi], return_inverse=True)
        table = np.zeros((len(rows), _COLUMNS), dtype=np.float32)
        table[places, column[lo:hi] - first] = 1
        out[np.ix_(rows, rows)] += table @ table.T
    return out


def _joining_links(keys: np.ndarray, components: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Linked pairs that join two components of the group, until no link is left between components."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    common = _common(sets)
    parts = np.unique(components, return_inverse=True)[1]
    found = []
    for i in range(len(sets) - 1):
        both = common[i, i + 1 :].astype(np.int64)
        linked = np.flatnonzero(100 * both >= percent * (sizes[i] + sizes[i + 1 :] - both)) + i + 1
        for j in linked:
            if parts[j] != parts[i]:
                parts[parts == parts[j]] = parts[i]
                found.append((min(keys[i], keys[j]), max(keys[i], keys[j])))
    return found


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a, b) by large-star and small-star rounds: key and component, its smallest key.

    Every round is joins and mergeable minima over the edges, which never become more.
    """
    at = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), name)
    before = None
    while True:
        both = at.union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m")).select("_u", F.least("_u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, name)
        small = large.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"))
        joined = large.join(small, F.col("u") == F.col("_u"))
        starred = joined.select("u", F.col("m").alias("v")).union(joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        at = stored(starred, name)
        now = at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = at.select(F.col("v").alias("key")).distinct()
    return at.select(F.col("u").alias("key"), F.col("v").alias("component")).union(roots.select("key", F.col("key").alias("component")))


def join(docs: DataFrame, s: Settings = Settings(), *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, text_key, n_shingles, component_id.

    Sets of at most a boundary of members (chosen by cost from the sizes) meet by shared fixed-size subsets; all
    others scan inverted lists of prefixes in one order of all shingles, frequent ones last. Equal sets are one class
    throughout, so copies are never paired. First each list's most central member is compared to the others; then
    members that aren't connected yet are compared in full, so that no link between components is lost.

    component_id is the smallest doc_id that links reach, the row's own included; documents without words link with
    nothing. Rows without a doc_id take part; if no row of a component has one, component_id is null. Rows that
    agree get equal results. An empty table gives an empty result. Extra columns play no part.
    """
    profiled = profile(docs, s, doc_id=doc_id, text=text)
    classes = classes_of(profiled)
    histogram = {r["n"]: r["count"] for r in classes.where(F.col("n") <= 2 * s.max_light).groupBy("n").count().collect()}
    boundary = choose_boundary(histogram, s)
    listed = listings(docs, boundary, hot_tokens(profiled, s), s, text=text)
    lists = inverted_lists(listed, boundary, s)
    light = stored(light_links(listed), "light-links")
    heavy = verified(near_pairs(star_pairs(lists, s), classes, s), docs, profiled, s, doc_id=doc_id, text=text)
    links = light.union(heavy)
    labels = stored(components(links), "labels")
    rest = rest_links(lists, labels, classes, docs, profiled, s, doc_id=doc_id, text=text)
    if not rest.isEmpty():
        labels = stored(components(labels.select(F.col("key").alias("a"), F.col("component").alias("b")).union(rest)), "labels")
    named = classes.select("key", "smallest").join(labels.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"), "left")
    named = stored(named.select("key", "smallest", F.coalesce("component", "key").alias("component")), "named")
    least = named.groupBy(F.col("component").alias("_c")).agg(F.min("smallest").alias("component_id"))
    of_class = stored(named.join(least, F.col("component") == F.col("_c")).select(F.col("key").alias("_key"), "component_id"), "class-components")
    rows = profiled.where(F.col("n").isNotNull()).select("doc_id", "text_key", "n", F.when(F.col("n") > 0, F.col("key")).alias("key"))
    return rows.join(of_class, F.col("key") == F.col("_key"), "left").select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, s: Settings = Settings(), *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, unchanged, without those whose component has a smaller doc_id.

    Of rows that agree in doc_id and text one stays. A row without a doc_id stays if its whole component has none.
    Only what goes is joined to the texts.
    """
    joined = stored(join(docs, s, doc_id=doc_id, text=text), "joined")
    goes = stored(
        joined.where(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text_key")).distinct(),
        "goes",
    )
    repeated = stored(joined.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text_key")).count().where("count > 1").select("_id", "_text_key"), "repeated")
    k, d = fresh(docs, "_k"), fresh(docs, "_doc")
    given = docs.withColumn(k, F.xxhash64(F.coalesce(F.col(text), F.lit("")))).withColumn(d, F.col(doc_id).cast("long"))

    def beside(rows: DataFrame, small: DataFrame, how: str) -> DataFrame:
        same = rows[d].eqNullSafe(small["_id"]) & (rows[k] == small["_text_key"])
        return rows.join(F.broadcast(small) if small.count() <= s.max_broadcast_rows else small, same, how)

    left = beside(given, goes, "left_anti")
    if not repeated.isEmpty():
        left = beside(left, repeated, "left_anti").unionByName(beside(left, repeated, "left_semi").dropDuplicates([d, k]))
    return left.drop(k, d)
