"""The ways taken on large inputs, against brute force, with hot keys and hot values."""

import math
import random
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from oracle import compare, connect

from tidemark import plans
from tidemark.operators import joins
from tidemark.operators.clean import duplicate_rows
from tidemark.operators.joins import join_renamed, keep_members, lookup_join, match_flag, with_group_rows
from tidemark.operators.quantiles import quantiles
from tidemark.operators.outliers import box_stats, histogram, iqr_bounds, outside_share
from tidemark.operators.sizing import distinct_bytes, plan_bytes, source_bytes
from tidemark.sources.tables import small_table


def disc(values, p):
    values = sorted(values)
    return values[max(math.ceil(round(p * len(values), 9)), 1) - 1]


def skewed(seed=5, n=4000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        value = rng.choice([None, 0.0, 7.0, rng.uniform(-1e6, 1e6), rng.lognormvariate(0, 3), 1.7e15 + i])
        rows.append((group, value))
    return rows + [("empty", None)]


SPEC = {
    "d01": ("v", 0.01, "disc"), "d50": ("v", 0.5, "disc"), "d99": ("v", 0.99, "disc"), "d100": ("v", 1.0, "disc"),
    "c00": ("v", 0.0, "linear"), "c25": ("v", 0.25, "linear"), "c50": ("v", 0.5, "linear"), "c99": ("v", 0.99, "linear"),
}


def expect(values):
    if not values:
        return [None] * len(SPEC)
    return [disc(values, p) if m == "disc" else float(np.quantile(values, p)) for _, p, m in SPEC.values()]


@pytest.mark.parametrize("strategy", ["narrowing", "counting", "builtin"])
def test_quantiles_against_brute_force(spark, strategy):
    rows = skewed()
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = quantiles(df, SPEC, (), strategy).first()
    assert list(got) == pytest.approx(expect([v for _, v in rows if v is not None]), rel=1e-12)
    groups = {r["g"]: list(r)[1:] for r in quantiles(df, SPEC, ["g"], strategy).collect()}
    assert set(groups) == {"hot", "a", "b", None, "empty"}
    for g, found in groups.items():
        want = expect([v for k, v in rows if k == g and v is not None])
        assert found == (want if want[0] is None else pytest.approx(want, rel=1e-12))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.floats(-1e9, 1e9), st.integers(-3, 3).map(float)), min_size=1, max_size=40), st.floats(0, 1))
def test_narrowing_equals_sorting(spark, values, p):
    p = round(p, 3)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = quantiles(df, {"d": ("v", p, "disc"), "c": ("v", p, "linear")}, (), "narrowing").first()
    assert got["d"] == disc(values, p)
    assert got["c"] == pytest.approx(float(np.quantile(values, p)), rel=1e-9, abs=1e-9)


def test_narrowing_of_nothing_is_one_empty_row(spark):
    df = spark.createDataFrame([], "v double")
    assert quantiles(df, {"m": ("v", 0.5, "linear")}, (), "narrowing").collect()[0]["m"] is None


def final_plan(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[: plan.index("== Initial Plan ==")]


def test_counting_reads_its_input_once(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    out = quantiles(df, {"m": ("l_extendedprice", 0.5, "linear")}, ["l_returnflag"], "counting")
    assert final_plan(out).count("FileScan") == 1


ODD = [math.nan, math.inf, -math.inf, 0.0, -0.0, 5e-324, -1.5, 1.0, 2.0, 3.0, 1.7976931348623157e308, None]


@pytest.mark.parametrize("seed", range(4))
def test_all_ways_agree_on_odd_values(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", None]), rng.choice(ODD)) for _ in range(25)] + [("nan", math.nan), ("none", None)]
    if seed == 0:
        rows = [("a", x) for x in (1.0, 2.0, 3.0, math.nan)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("half", F.col("v") / 2)
    spec = {"d99": ("v", 0.99, "disc"), "d01": ("v", 0.01, "disc"), "h50": ("half", 0.5, "disc"), "m": ("half", 0.5, "linear")}
    found = {}
    for way in ("builtin", "counting", "narrowing"):
        found[way] = sorted(str(tuple(r)) for r in quantiles(df, spec, ["g"], way).collect())
        found[way].append(str(tuple(quantiles(df, spec, (), way).first())))
    assert found["builtin"] == found["counting"] == found["narrowing"]
    if seed == 0:
        assert quantiles(df, spec, (), "narrowing").first()["d99"] == 3.0


def test_ways_follow_the_estimate_of_the_derived_input(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    derived = lines.join(parts, lines.l_partkey == parts.p_partkey).withColumn("x", F.col("l_extendedprice") * F.col("p_size"))
    spec = {"m": ("x", 0.5, "linear"), "d": ("x", 0.9, "disc")}
    spark.conf.set("tidemark.smallSourceBytes", str(10 * source_bytes(derived)))
    try:
        plan = quantiles(derived, spec)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("tidemark.smallSourceBytes")
    assert "percentile" not in plan
    ways = {tuple(quantiles(derived, spec, (), way).first()) for way in ("builtin", "counting", "narrowing")}
    assert len(ways) == 1


def test_missing_groups_keep_their_rows(spark):
    rows = [(None, 1.0), (None, 2.0), (None, 90.0), ("a", 1.0), ("a", 5.0)] + [(None, 1.5)] * 8
    df = spark.createDataFrame(rows, "g string, v double")
    assert {r["g"]: r["n"] for r in box_stats(df, "v", ["g"]).collect()} == {None: 11, "a": 2}
    assert {r["g"]: r["rows"] for r in outside_share(df, "v", iqr_bounds(df, "v", ["g"]), ["g"]).collect()} == {None: 11, "a": 2}
    counts = {}
    for r in histogram(df, "v", 3, by=["g"]).collect():
        counts[r["g"]] = counts.get(r["g"], 0) + r["n"]
    assert counts == {None: 11, "a": 2}


def test_narrowing_shuffles_only_the_chosen_bands(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    out = quantiles(df, {"m": ("l_extendedprice", 0.5, "linear")}, (), "narrowing")
    plan = final_plan(out)
    assert plan.count("FileScan") == 2 and "LeftSemi" in plan
    assert out.first()["m"] == quantiles(df, {"m": ("l_extendedprice", 0.5, "linear")}, (), "builtin").first()["m"]


@pytest.fixture(scope="module")
def fact_and_dim(spark):
    rng = random.Random(3)
    rows = [(i, None if i % 11 == 0 else 1 if i % 3 == 0 else rng.randrange(60)) for i in range(3000)]
    copies = [(-1, 1)] * 500
    fact = spark.createDataFrame(rows + copies, "id int, k int").repartition(6)
    dim = small_table(spark, [(k, f"name {k}") for k in range(0, 60, 2)] + [(1, "one")], "k int, name string")
    return fact, dim


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("share", [3, 40])
def test_hot_keys_are_split_by_adaptive_execution(spark, how, share):
    """A key with a third of the rows, and one that would miss a fixed share of the rows."""
    hot = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "64",
    }
    for name, value in hot.items():
        spark.conf.set(name, value)
    try:
        fact = spark.range(0, 60_000, 1, 12).select("id", F.when(F.col("id") % share == 0, 1).otherwise(F.col("id") + 5).alias("k"))
        dim = spark.range(0, 30_000, 1, 4).select((F.col("id") * 2 + 1).alias("k"), F.col("id").alias("name"))
        joined = lookup_join(fact, dim, "k", how)
        assert "skew=true" in final_plan(joined)
        assert joined.count() == fact.join(F.broadcast(dim), "k", how).count()
    finally:
        for name in hot:
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "8")


SPLIT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}
GROUPED = {
    "members": lambda fact, dim: keep_members(fact, dim, "k"),
    "flag": lambda fact, dim: match_flag(fact, dim, "k"),
    "repeats": lambda fact, dim: duplicate_rows(fact, ["k"], ["id"]),
    "figures": lambda fact, dim: lookup_join(fact, dim.groupBy("k").agg(F.count("*").alias("n")), "k", "left", grouped=True),
}


@pytest.mark.parametrize("form", GROUPED)
@pytest.mark.parametrize("share, partitions", [(2, 64), (250, 400)])
def test_hot_keys_are_split_before_sides_grouped_by_the_key(spark, form, share, partitions):
    """A key with half of the rows, and one with 0.4 % of them."""
    fact = spark.range(0, 60_000, 1, 12).select("id", F.when(F.col("id") % share == 0, 1).otherwise(F.col("id") + 5).alias("k"), F.md5(F.col("id").cast("string")).alias("v"))
    dim = spark.range(0, 30_000, 1, 4).select((F.col("id") * 2 + 1).alias("k"))
    want = sorted(map(str, GROUPED[form](fact, dim).collect()))
    for name, value in {**SPLIT, "spark.sql.shuffle.partitions": str(partitions)}.items():
        spark.conf.set(name, value)
    try:
        joined = GROUPED[form](fact, dim)
        assert "skew=true" in final_plan(joined)
        assert sorted(map(str, joined.collect())) == want
    finally:
        for name in SPLIT:
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "8")


HOT_QUERIES = ("coord_semi", "coord_semi_pairs", "cashback_top_regions", "dup_rows", "dup_rows_exact", "bonus_effect", "plan_completion")


@pytest.mark.parametrize("name", HOT_QUERIES)
def test_queries_with_split_keys_match_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    for key, value in SPLIT.items():
        spark.conf.set(key, value)
    try:
        got = plans.all_queries()[name](spark, folder).toArrow()
    finally:
        for key in SPLIT:
            spark.conf.unset(key)
    con = connect(folder)
    assert compare(got, con.sql(plans.all_oracles()[name]).to_arrow_table()) == []
    con.close()


def test_few_group_figures_leave_the_rows_where_they_are(spark):
    rows = spark.range(0, 300_000, 1, 8).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    plans_of = {
        "box": box_stats(rows, "v", ["g"]),
        "outside": outside_share(rows, "v", rows.groupBy("g").agg(F.min("v").alias("lower"), F.max("v").alias("upper")), ["g"]),
        "histogram": histogram(rows, "v", 5, ["g"]),
    }
    for name, df in plans_of.items():
        plan = final_plan(df)
        final = plan.split("Initial Plan")[0]
        assert "BroadcastNestedLoopJoin" in final or "BroadcastHashJoin" in final, name
        # what is exchanged by the group are partial aggregates, never the rows with their values
        assert "SortMergeJoin" not in final, name
        lines = final.splitlines()
        for line, below in zip(lines, lines[1:]):
            if "Reused" not in line and re.search(r" Exchange hashpartitioning\(g#\d+L, \d+\)", line):
                assert "HashAggregate" in below, (name, below)


def test_many_group_figures_are_shuffled(spark, monkeypatch):
    rows = spark.range(0, 5000, 1, 4).select(F.when(F.col("id") % 500 > 0, F.col("id") % 500).alias("g"), "id")
    stats = rows.groupBy("g").agg(F.max("id").alias("top"))
    want = sorted(map(str, with_group_rows(rows, stats, ["g"]).collect()))
    assert len(want) == 5000
    for limit, value in (("GROUP_ROWS", 20), ("GROUP_BYTES", 100)):
        monkeypatch.setattr(joins, limit, value)
        assert sorted(map(str, with_group_rows(rows, stats, ["g"]).collect())) == want
        left = with_group_rows(rows, stats.filter("g > 250"), ["g"], "left")
        assert left.count() == 5000 and left.filter("top IS NULL").count() == 2510
        monkeypatch.undo()


def test_distinct_values_are_bounded_by_the_table_they_come_from(spark):
    a = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    b = spark.read.parquet("/root/testdata/sf0.01/part.parquet")
    joined = a.join(b, a.l_partkey == b.p_partkey).filter("l_quantity > 3")
    size = a.select("l_tax")._jdf.queryExecution().optimizedPlan().collectLeaves().apply(0).stats().sizeInBytes()
    part = b._jdf.queryExecution().optimizedPlan().collectLeaves().apply(0).stats().sizeInBytes()
    values = joined.select(F.col("l_tax") * 2, (F.col("p_size") + 1).alias("s"), F.col("l_tax") * F.col("p_size"))
    assert distinct_bytes(values) == [size, part, None]
    assert plan_bytes(joined) > size + part
    summed = joined.groupBy("p_size").agg(F.sum("l_tax").alias("t"))
    assert distinct_bytes(summed.select("t")) == [part]
    assert distinct_bytes(joined.groupBy("p_size", "l_tax").agg(F.max("l_quantity").alias("t")).select("t")) == [None]
    assert distinct_bytes(joined.select(F.rand())) == [None]
    assert distinct_bytes(a.select("l_tax").union(b.select("p_size"))) == [None]


def test_missing_keys_match_on_request(spark):
    left = spark.createDataFrame([(None, 1), (2, 2)], "a int, v int")
    right = spark.createDataFrame([(None, "x"), (2, "y")], "b int, w string")
    assert [r.w for r in join_renamed(left, right, "a", "b").orderBy("v").collect()] == [None, "y"]
    assert [r.w for r in join_renamed(left, right, "a", "b", null_keys=True).orderBy("v").collect()] == ["x", "y"]


def test_infinities_lie_in_no_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(float("inf"),), (float("-inf"),), (float("nan"),), (None,)], "v double")
    assert [(r["bin"], r.bin_lo, r.n) for r in histogram(df, "v", 3).orderBy("bin").collect()] == [(0, 0.0, 3), (1, 3.0, 3), (2, 6.0, 4)]


def test_joins_reject_sides_they_cannot_keep(fact_and_dim):
    with pytest.raises(ValueError):
        lookup_join(*fact_and_dim, "k", "full_outer")


def test_members_never_multiply_rows(spark):
    fact = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "k int, v string")
    members = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert keep_members(fact, members, "k").count() == 2
    assert sorted(r["hit"] for r in match_flag(fact, members, "k", "hit").collect()) == [0, 0, 1, 1]


def test_group_rows_match_missing_keys(spark):
    df = spark.range(300).select(F.when(F.col("id") % 30 > 0, F.col("id") % 30).alias("g"), "id")
    stats = df.groupBy("g").agg(F.max("id").alias("top"))
    got = with_group_rows(df, stats, ["g"])
    assert got.columns == ["g", "id", "top"] and got.count() == 300
    assert {r["top"] for r in got.filter("g IS NULL").collect()} == {270}


def test_source_size_is_the_sum_of_the_tables(spark):
    a = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    b = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    joined = a.join(b, a.l_partkey == b.p_partkey)
    assert source_bytes(joined) == source_bytes(a) + source_bytes(b) < plan_bytes(joined)


def test_repeats_of_a_hot_key(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i}" if i % 5 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k string")
    got = sorted(r["id"] for r in duplicate_rows(df, ["k"], ["id"]).collect())
    seen, want = set(), []
    for i, k in rows:
        if k in seen:
            want.append(i)
        seen.add(k)
    assert got == want


def test_exact_copies_are_repeats(spark):
    rows = [(1, 10, None), (1, 10, None), (1, 11, "x"), (2, 5, "y"), (None, 1, None), (None, 1, None), (None, 1, None), (3, 7, "a"), (3, 7, "b")]
    df = spark.createDataFrame(rows, "k int, v int, t string")
    got = sorted(map(str, map(tuple, duplicate_rows(df, ["k"], ["v"]).collect())))
    assert got == sorted(map(str, [(1, 10, None), (1, 11, "x"), (None, 1, None), (None, 1, None), (3, 7, "b")]))
