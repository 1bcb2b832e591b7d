"""Operators on hand-made tables with missing values, ties, repeats and edge values."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cohort as C, experiment as X, hypothesis as H, summarize as A, trend as T
from tidemark.operators.clean import (
    common_keys, duplicate_count, fill_missing, first_per_key, key_overlap, normalize_columns, rename, select_through,
    split_entities, unique_key_check,
)
from tidemark.operators.inspect import describe, null_profile, preview, table_profile
from tidemark.operators.joins import align_groups, join_renamed, null_safe
from tidemark.operators.outliers import box_stats, histogram, iqr_bounds, outside_share, pair_stats, price_level, trim_percentile
from tidemark.operators.quantiles import medians


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def ab(spark):
    """Three days, two groups; u1 is in both groups, B is absent on day two, t2 is another test."""
    data = [
        ("u1", "A", "t1", "2024-01-01", 1), ("u1", "B", "t1", "2024-01-01", 0), ("u2", "A", "t1", "2024-01-01", 0),
        ("u2", "A", "t1", "2024-01-02", 1), ("u3", "B", "t1", "2024-01-03", 1), ("u4", "B", "t1", "2024-01-03", 0),
        ("u5", "B", "t2", "2024-01-03", 1),
    ]
    df = spark.createDataFrame(data, "user_id string, `group` string, ab_test string, d string, ok int")
    return df.withColumn("d", F.to_date("d"))


# Missing keys and values


def test_frequencies_drop_or_keep_missing(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert rows(A.value_counts(df, "k")) == [("a", 2)]
    assert rows(A.value_counts(df, "k", dropna=False)) == [("a", 2), (None, 1)]


def test_sum_of_nothing_is_zero_in_usage(spark):
    rides = spark.createDataFrame(
        [(1, dt.date(2024, 1, 5), None, None)], "user_id int, date date, distance double, duration int"
    )
    assert rows(C.monthly_usage(rides, "user_id", "date", "distance", "duration")) == [(1, 1, 0.0, 0, 0)]


def test_profiles(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "i int, s string")
    assert rows(null_profile(df)) == [("i", 3, 0, 0.0), ("s", 3, 2, 0.666667)]
    assert rows(table_profile(df)) == [("i", 3, 0, 2, "int"), ("s", 1, 2, 1, "string")]


@pytest.mark.parametrize("strategy", ["builtin", "narrowing", "counting"])
def test_describe_per_group_with_a_single_row(spark, strategy):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, None)], "g string, v double")
    got = {r["g"]: r for r in describe(df, ["v"], (0.5,), ["g"], strategy).collect()}
    assert (got["a"]["n"], got["a"]["mean"], got["a"]["p50"]) == (2, 2.0, 2.0)
    assert got["b"]["std"] is None and got[None]["n"] == 0 and got[None]["p50"] is None


# Duplicates and keys


def test_duplicates_treat_missing_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "x"), (2, "x")], "a int, b string")
    assert rows(duplicate_count(df)) == [(4, 1)]
    assert rows(unique_key_check(df, "b")) == [(1, 2, False)]


def test_first_per_key_takes_whole_rows(spark):
    df = spark.createDataFrame([(1, 2, None), (1, 1, "late"), (2, 9, "only")], "k int, o int, v string")
    assert rows(first_per_key(df, "k", ["o"])) == [(1, 1, "late"), (2, 9, "only")]


def test_key_overlap_counts_present_and_distinct(spark):
    left = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    right = spark.createDataFrame([("b",), ("c",), (None,)], "k string")
    assert rows(key_overlap(left, right, "k")) == [(3, 2, 2, 2, 1)]
    assert rows(common_keys(left.na.drop(), right.na.drop(), "k")) == [("b",)]


def test_split_of_an_outer_join(spark):
    wide = spark.createDataFrame(
        [(1, "p", 10), (1, "p", 11), (2, "q", None), (None, None, 12)], "pid int, name string, cid int"
    )
    parents, children = split_entities(wide, ["pid", "name"], ["cid"])
    assert rows(parents) == [(1, "p"), (2, "q")]
    assert rows(children) == [(10,), (11,), (12,)]


# Columns


def test_headers(spark):
    df = spark.createDataFrame([(1, 2)], "`company  ID` int, `properties.point.lat` int")
    assert normalize_columns(df, ["properties."]).columns == ["company_id", "point_lat"]
    assert rename(df, {"properties.point.lat": "lat"}).columns == ["company  ID", "lat"]
    assert select_through(df, "company  ID").columns == ["company  ID"]


def test_fill_is_per_column(spark):
    df = spark.createDataFrame([(None, None)], "a int, b string")
    assert rows(fill_missing(df, {"a": 0})) == [(0, None)]


def test_preview_has_an_explicit_order(spark):
    df = spark.createDataFrame([(3,), (None,), (1,)], "a int")
    assert [r[0] for r in preview(df, 2, ["a"]).collect()] == [1, 3]
    assert [r[0] for r in preview(df, 2, ["a"], tail=True).collect()] == [3, 1]


# Joins


def test_missing_keys_do_not_match_unless_asked(spark):
    left = spark.createDataFrame([(1, "l"), (None, "n")], "id int, v string")
    right = spark.createDataFrame([(1, "r"), (None, "m")], "rid int, v string")
    assert rows(join_renamed(left, right, "id", "rid")) == [(1, "l", 1, "r"), (None, "n", None, None)]
    both = left.alias("l").join(right.alias("r"), null_safe(F.col("l.id"), F.col("r.rid")))
    assert both.count() == 2


def test_alignment_keeps_labels_of_either_side(spark):
    a = spark.createDataFrame([("A", 1)], "g string, x int")
    b = spark.createDataFrame([("B", 2)], "g string, y int")
    assert rows(align_groups(a, b, "g")) == [("A", 1, None), ("B", None, 2)]


# Order and shares


def test_top_k_places_missing_as_asked(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 5)], "id int, v int")
    assert [r["id"] for r in A.top_k(df, 2, "v", ["id"], nulls_first=True).collect()] == [2, 1]
    assert [r["id"] for r in A.top_k(df, 2, "v", ["id"]).collect()] == [1, 3]


def test_shares_sum_to_one_and_a_zero_total_gives_null(spark):
    df = spark.createDataFrame([("x", "a", 1), ("x", "b", 3), ("y", "a", 0)], "g string, k string, n int")
    got = A.share_of_total(df, "n", "share", ["g"]).collect()
    assert sum(r["share"] for r in got if r["g"] == "x") == 1.0
    assert [r["share"] for r in got if r["g"] == "y"] == [None]


def test_sibling_columns_equal_single_column_counts(spark):
    df = spark.createDataFrame([("a", " a"), ("b", None), (None, "b")], "s1 string, s2 string")
    whole = rows(A.multi_column_counts(df, ["s1", "s2"]))
    single = [(c, v, n) for c in ("s1", "s2") for v, n in rows(A.value_counts(df, c, dropna=False))]
    assert whole == sorted(single, key=str)
    trimmed = A.multi_column_counts(df, ["s1", "s2"], trim=True, dropna=True)
    assert rows(trimmed.groupBy("value").agg(F.sum("mentions"))) == [("a", 2), ("b", 2)]


def test_label_order_shows_missing_labels(spark):
    df = spark.createDataFrame([("Tue", 2)], "d string, n int")
    got = T.in_label_order(df, "d", ["Mon", "Tue"]).collect()
    assert [(r["d"], r["n"]) for r in got] == [("Mon", None), ("Tue", 2)]


# Running totals


def test_cumulative_total_ends_at_the_total(ab):
    got = T.cumulative_daily(ab, "d", "group", F.count("*")).collect()
    last = {r["group"]: r["cumulative"] for r in sorted(got, key=lambda r: r["date"])}
    assert last == {"A": 3, "B": 4}
    assert len(got) == 4


def test_cumulative_units_count_a_unit_once(ab):
    got = {(r["group"], str(r["date"])): r["cumulative"] for r in T.cumulative_units(ab, "d", "user_id", "group").collect()}
    assert got == {("A", "2024-01-01"): 2, ("B", "2024-01-01"): 1, ("B", "2024-01-03"): 4}


# Outliers


def test_trim_is_strict_at_the_maximum_and_keeps_missing_where_told(spark):
    df = spark.createDataFrame([(float(v), v) for v in (1, 2, 3, 3)] + [(2.0, None)], "a double, b int")
    kept = trim_percentile(df, {"a": (None, 0.99), "b": (None, 0.99)}, "disc", ("b",))
    assert rows(kept) == [(1.0, 1), (2.0, 2), (2.0, None)]
    assert rows(trim_percentile(df, {"b": (None, 0.99)}, "disc")) == [(1.0, 1), (2.0, 2)]


def test_trim_is_idempotent_only_with_fixed_bounds(spark):
    df = spark.range(1, 201).select(F.col("id").cast("double").alias("v"))
    once = trim_percentile(df, {"v": (0.01, 0.99)})
    assert trim_percentile(once, {"v": (0.01, 0.99)}).count() < once.count()


def test_box_figures(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5, 100)], "v double")
    r = box_stats(df, "v").first()
    assert (r["q1"], r["median"], r["q3"], r["whisker_low"], r["whisker_high"], r["outliers"]) == (2.25, 3.5, 4.75, 1.0, 5.0, 1)
    out = outside_share(df, "v", iqr_bounds(df, "v")).first()
    assert out["above_percent"] == pytest.approx(100 / 6, abs=1e-6) and out["below_percent"] == 0


def test_box_figures_per_group_when_groups_exceed_the_bound(spark):
    df = spark.range(400).select((F.col("id") % 8).alias("g"), F.col("id").cast("double").alias("v"))
    assert box_stats(df, "v", ["g"]).agg(F.sum("n")).first()[0] == 400


def test_histogram_closes_the_last_bin_and_shows_empty_ones(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,), (None,)], "v double")
    assert [r["n"] for r in histogram(df, "v", 5).orderBy("bin").collect()] == [2, 0, 0, 0, 1]
    assert [r["n"] for r in histogram(df, "v", 2, lo=0, hi=2).orderBy("bin").collect()] == [1, 1]
    flat = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert sum(r["n"] for r in histogram(flat, "v", 4).collect()) == 2


def test_histogram_ranges_are_per_group(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("b", 100.0), ("b", 200.0)], "g string, v double")
    got = histogram(df, "v", 2, by=["g"]).collect()
    assert {(r["g"], r["bin"]): r["n"] for r in got} == {("a", 0): 1, ("a", 1): 1, ("b", 0): 1, ("b", 1): 1}


def test_price_level_drops_single_row_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 9.0)], "c string, p double")
    assert [tuple(r)[:2] for r in price_level(df, "c", "p").collect()] == [("a", 2.0)]
    assert medians(df, ["p"]).first()["p"] == 3.0


def test_pair_stats_of_a_line(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(5)] + [(9.0, None)], "x double, y double")
    r = pair_stats(df, "x", "y").first()
    assert (r["n"], r["corr"], r["slope"], r["intercept"]) == (5, pytest.approx(1), pytest.approx(2), pytest.approx(1))


# Cohorts and revenue


def test_repeat_cohorts_skip_single_events_and_divide_whole(spark):
    days = {1: [0], 2: [0, 5, 8], 3: [0, 1]}
    data = [(u, dt.date(2020, 1, 1) + dt.timedelta(d)) for u, ds in days.items() for d in ds]
    spans = C.activity_spans(spark.createDataFrame(data, "u int, d date"), "u", "d", F.lit(dt.date(2023, 1, 1)))
    got = {r["u"]: (r["events"], r["span_days"], r["gap_days"], r["tenure_years"]) for r in spans.collect()}
    assert got == {2: (3, 8, 4, 3), 3: (2, 1, 1, 3)}


@pytest.mark.parametrize("span,events,gap", [(663670, 26, 26546), (661775, 37, 18382), (660907, 7, 110151), (658841, 39, 17337), (366097, 33, 11440), (45136, 7, 7522)])
def test_published_gaps(spark, span, events, gap):
    df = spark.createDataFrame([(span, events)], "span_days int, events bigint")
    assert df.select(F.expr("span_days div (events - 1)")).first()[0] == gap


def test_plan_completion_counts_distinct_items(spark):
    plan = spark.createDataFrame([(1, "d1", "x"), (1, "d1", "x"), (2, "d1", "x"), (2, "d2", "y")], "u int, d string, kind string")
    done = spark.createDataFrame([(1, "d1"), (1, "d1"), (2, "d9")], "u int, d string")
    assert rows(C.completion_rate(plan, done, ["u", "d"], "kind")) == [("x", 2, 1, 50.0), ("y", 1, 0, 0.0)]


def test_revenue_by_month(spark):
    users = spark.createDataFrame([(1, "ann", "ultra"), (2, "bob", "free"), (3, "eve", "free")], "user_id int, name string, subscription_type string")
    rides = spark.createDataFrame(
        [(1, dt.date(2024, 1, 3), 100.0, 10), (1, dt.date(2024, 1, 9), 50.0, 5), (2, dt.date(2024, 2, 1), 10.0, 2), (9, dt.date(2024, 2, 1), 10.0, 2)],
        "user_id int, date date, distance double, duration int",
    )
    tariffs = spark.createDataFrame([("ultra", 6, 0, 199), ("free", 8, 50, 0)], "subscription_type string, minute_price int, start_ride_price int, subscription_fee int")
    out = C.tariff_revenue(users, rides, tariffs)
    got = {(r["user_id"], r["month"]): r["monthly_revenue"] for r in out.collect()}
    assert got == {(1, 1): 6 * 15 + 199, (2, 2): 50 + 16}
    assert [r["user_id"] for r in C.best_unit(out, "user_id", "monthly_revenue").collect()] == [1]


def test_missing_child_share_counts_fanned_out_rows(spark):
    people = spark.createDataFrame([(1, 7), (2, 7), (3, None)], "id int, company_id int")
    education = spark.createDataFrame([(1, None), (1, None), (1, "u")], "person_id int, school string")
    got = C.missing_child_share(people, education, "id", "person_id", "school", "company_id")
    assert rows(got) == [(7, 2, 3, 150.0)]


# Experiments


def test_balance_contamination_and_mix(ab):
    t1 = ab.filter("ab_test = 't1'")
    r = X.group_balance(t1, "user_id", "group", "A", "B").first()
    assert (r["units_a"], r["units_b"], r["gap_percent"]) == (2, 3, 50.0)
    assert [r["user_id"] for r in X.contaminated_units(t1, "user_id", "group").collect()] == ["u1"]
    mix = X.covariate_balance(t1, "user_id", "group", ["ab_test"]).collect()
    assert {(r["group"], r["units"], r["share"]) for r in mix} == {("A", 2, 1.0), ("B", 3, 1.0)}


def test_enrolment_keeps_both_tags_and_one_test(spark, ab):
    fact = spark.createDataFrame([("u1", 1), ("u5", 2), ("zz", 3)], "user_id string, v int")
    assert rows(X.enroll(fact, ab, test="t1")) == [("u1", 1, "A"), ("u1", 1, "B")]


def test_conversion_covers_the_union_of_groups(spark):
    bought = spark.createDataFrame([("u1", "A"), ("u1", "A")], "u string, g string")
    seen = spark.createDataFrame([("u1", "A"), ("u2", "A"), ("u3", "B")], "u string, g string")
    assert rows(X.conversion(bought, seen, "u", "g")) == [("A", 1, 2, 0.5), ("B", None, 1, None)]


def test_success_share_readings(ab):
    t1 = ab.filter("ab_test = 't1'")
    got = {r["group"]: (r["share_of_units"], r["share_of_rows"]) for r in X.group_share(t1, "group", "ok", "user_id").collect()}
    assert got["A"] == (1.0, pytest.approx(2 / 3)) and got["B"] == (pytest.approx(1 / 3),) * 2
    assert X.share_gap(t1, "group", "ok", "A", "B").first()["gap_points"] == 33.33


def test_published_sample_size_and_duration(spark, ab):
    r = X.sample_size(ab, "ok", 0.03).first()
    assert r["n_per_arm"] == 17441
    d = X.test_duration(ab, "user_id", "d", 0.03).first()
    assert (d["daily_units"], d["days"]) == (2, math.ceil(2 * 17441.95 / 2))
    with pytest.raises(ValueError):
        X.sample_size(ab, "ok", 0.03, effect="other")


def test_published_z_test(spark):
    df = spark.createDataFrame([(0.3077, 49551, 0.3183, 50454)], "pa double, na int, pb double, nb int")
    df = df.selectExpr("pa * na AS xa", "na", "pb * nb AS xb", "nb")
    r = H.ztest_counts(df, "xa", "na", "xb", "nb").first()
    assert round(r["p_value"], 4) == 0.0003 and r["verdict"] == "accept H1"


def test_swapping_groups_flips_the_sign(spark):
    df = spark.createDataFrame([("A", 1), ("A", 0), ("B", 1), ("B", 1), ("A", 0)], "g string, ok int")
    ab_, ba = (H.ztest_proportions(df, "g", "ok", *pair).first() for pair in (("A", "B"), ("B", "A")))
    assert ab_["z"] == -ba["z"] and ab_["p_value"] == ba["p_value"]
    up, down = (H.ztest_proportions(df, "g", "ok", "A", "B", alt).first()["p_value"] for alt in ("greater", "less"))
    assert up + down == pytest.approx(1)


def test_t_tests_by_hand(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("A", 4.0), ("B", 2.0), ("B", 6.0), ("B", None)], "g string, v double")
    w = H.ttest_welch(df, "g", "v", "A", "B").first()
    se = 7 / 9 + 4
    assert w["t"] == pytest.approx((7 / 3 - 4) / math.sqrt(se))
    assert w["df"] == pytest.approx(se**2 / ((7 / 9) ** 2 / 2 + 16))
    p = H.ttest_pooled(df, "g", "v", "A", "B", "less").first()
    pooled = (14 / 3 + 8) / 3
    assert p["t"] == pytest.approx((7 / 3 - 4) / math.sqrt(pooled * (1 / 3 + 1 / 2))) and p["df"] == 3
    o = H.ttest_one_sample(df.filter("g = 'A'"), "v", 1.0, "greater").first()
    assert o["t"] == pytest.approx((4 / 3) / math.sqrt(7 / 9)) and o["df"] == 2


def test_a_test_without_spread_cannot_reject(spark):
    df = spark.createDataFrame([("A", 1.0), ("B", 1.0)], "g string, v double")
    assert H.ttest_pooled(df, "g", "v", "A", "B").first()["verdict"] == "cannot reject H0"


def test_normal_model(spark):
    df = spark.createDataFrame([(float(v),) for v in (10, 20, 30)], "v double")
    assert H.normal_prob(df, "v", lo=20).first()["probability"] == pytest.approx(0.5)
    assert H.normal_prob(df, "v", 10, 30).first()["probability"] == pytest.approx(0.6826894921, abs=1e-9)
    assert H.normal_quantile(df, "v", 0.9).first()["critical"] == pytest.approx(32.815515655, abs=1e-8)


def test_market_share(spark):
    assert A.market_share(spark.range(396749), {"a": 211_700_000, "b": 100_300_000}).select(
        F.round("a", 2), F.round("b", 2)
    ).first()[:] == (0.19, 0.4)


def test_sketches_unite_and_intersect(spark, tmp_path):
    from tidemark.operators import sketches as K
    from tidemark.sources.tables import write_table

    rows = spark.range(0, 60_000, 1, 6).select(
        (F.col("id") * 7919 % 20_000).alias("user"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 20).cast("int")).alias("d"),
        F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("g"),
    )
    path = str(tmp_path / "sketches")
    write_table(K.daily_sketches(rows.unionByName(rows.limit(50).withColumn("user", F.lit(None).cast("long"))), F.col("d"), "user", ["g"]), path, partition_by=("date",))
    stored = spark.read.parquet(path)
    bound = K.relative_error(sigmas=4)
    exact = {r.g: r.n for r in rows.groupBy("g").agg(F.countDistinct("user").alias("n")).collect()}
    got = {r.g: r.units for r in K.units_in_span(stored, ["g"]).collect()}
    assert all(abs(got[g] - n) <= bound * n for g, n in exact.items())
    # below the sketch's size counts are exact, in any span
    first, last = dt.date(2024, 1, 3), dt.date(2024, 1, 6)
    want = rows.filter(F.col("d").between(first, last)).select("user").distinct().count()
    assert want < 2**K.LG_K and K.units_in_span(stored, (), first, last).first().units == want
    assert K.units_in_span(stored, (), dt.date(2030, 1, 1)).first().units == 0
    both = K.shared_units(stored, "g", "A", "B").first()
    a, b = ({r.user for r in rows.filter(F.col("g") == x).collect()} for x in "AB")
    assert both.units_both == pytest.approx(len(a & b), rel=4 * bound)
    last_days = {(r["date"], r.g): r.last_3_days for r in K.running_units(stored, ["g"], 3).collect()}
    day = dt.date(2024, 1, 10)
    want = rows.filter((F.col("g") == "A") & F.col("d").between(day - dt.timedelta(2), day)).select("user").distinct().count()
    assert last_days[day, "A"] == want


def test_ratio_test(spark):
    from tidemark.operators.experiment import ratio_test

    rows = [(i, "A" if i % 10 < 6 else "B", "x") for i in range(1000)] + [(1, "A", "x")] * 50 + [(5000 + i, "C", "x") for i in range(9)] + [(7, "A", "y")]
    df = spark.createDataFrame(rows, "u long, g string, s string")
    one = ratio_test(df, "u", "g", {"A": 0.5, "B": 0.5}, ["s"]).collect()
    by = {r.s: r for r in one}
    assert (by["x"].units, by["x"].statistic, by["x"].verdict) == (1000, pytest.approx(40.0), "accept H1")
    assert by["x"].p_value == pytest.approx(2.539629e-10, rel=1e-5)
    assert (by["y"].units, by["y"].statistic) == (1, pytest.approx(1.0))
    three = ratio_test(df, "u", "g", {"A": 6, "B": 4, "C": 0.09}).first()
    assert three.df == 2 and three.units == 1010 and three.verdict == "cannot reject H0"
    empty = ratio_test(df.limit(0), "u", "g", {"A": 1, "B": 1}).first()
    assert (empty.units, empty.statistic is None or empty.statistic == 0, empty.verdict) == (0, True, "cannot reject H0")
    with pytest.raises(ValueError):
        ratio_test(df, "u", "g", {"A": 1})


def test_density_matches_direct_sums(spark):
    from tidemark.operators.outliers import density

    rng = random.Random(4)
    values = {"a": [rng.gauss(0, 1) for _ in range(400)] + [5.0] * 30, None: [rng.uniform(-3, 9) for _ in range(200)], "same": [2.0] * 9, "one": [1.0]}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("a", None), ("a", float("nan")), ("a", float("inf"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = density(df, "v", 400, ["g"]).collect()
    assert {r.g for r in got} == {"a", None} and len(got) == 800
    for g in ("a", None):
        curve = sorted((r.x, r.density) for r in got if r.g == g)
        vs = values[g]
        n, mean = len(vs), sum(vs) / len(vs)
        h = math.sqrt(sum((v - mean) ** 2 for v in vs) / (n - 1)) * n**-0.2
        for x, d in curve:
            want = sum(math.exp(-(((x - v) / h) ** 2) / 2) for v in vs) / (n * h * math.sqrt(2 * math.pi))
            assert d == pytest.approx(want, abs=2e-4)
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:]))
        assert area == pytest.approx(1, abs=5e-3)
    assert density(df.limit(0), "v").count() == 0


def test_density_weights_are_exact(spark):
    from tidemark.operators.outliers import density

    vs = [1.0, 1.7, 2.3, 4.1, 4.1, 9.9]
    n, mean, points = len(vs), sum(vs) / len(vs), 30
    h = math.sqrt(sum((v - mean) ** 2 for v in vs) / (n - 1)) * n**-0.2
    lo, step = min(vs) - 3 * h, (max(vs) - min(vs) + 6 * h) / (points - 1)
    kernel = lambda steps: math.exp(-((steps * step / h) ** 2) / 2)
    places = [((v - lo) / step) for v in vs]
    for r in density(spark.createDataFrame([(v,) for v in vs], "v double"), "v", points).collect():
        dealt = sum((1 - p % 1) * kernel(r.point - p // 1) + p % 1 * kernel(r.point - p // 1 - 1) for p in places)
        assert r.density == pytest.approx(dealt / (n * h * math.sqrt(2 * math.pi)), rel=0, abs=1e-13)
