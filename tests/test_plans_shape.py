"""Plans of all queries: no Python in them, no window over raw rows, narrow scans."""

import re

import pytest

from tidemark import plans

FOLDER = "/root/testdata/sf0.001"
QUERIES = plans.all_queries()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def frames(spark):
    return {name: query(spark, FOLDER) for name, query in QUERIES.items()}


def test_no_python_and_no_cartesian_product(frames):
    for name, df in frames.items():
        plan = physical(df)
        assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups", plan), name
        assert "CartesianProduct" not in plan, name


def test_windows_stand_on_aggregates(frames):
    for name, df in frames.items():
        plan = optimized(df)
        for window in re.finditer(r"Window \[", plan):
            assert "Aggregate" in plan[window.start() :], name


def test_unpartitioned_windows_only_rank_months(frames):
    found = set()
    for name, df in frames.items():
        # "windowspecdefinition(x DESC" without a leading partition column means one task.
        if re.search(r"row_number\(\) windowspecdefinition\(\S+ DESC", optimized(df)):
            found.add(name)
        assert not re.search(r"sum\([^)]*\) windowspecdefinition\(specifiedwindowframe", optimized(df)), name
    assert found == {"re_publish_rank", "re_remove_rank"}


def test_scans_read_only_what_is_used(frames):
    columns = lambda name: set(re.findall(r"ReadSchema: struct<([^>]*)>", physical(frames[name])))
    assert columns("histogram") == {"l_extendedprice:double"}
    assert columns("like_count") == {"text:string"}
    assert columns("users_by_plan") == {"c_mktsegment:string"}
    assert columns("ab_group_balance") <= {"user_id:bigint", "user_id:bigint,event_type:string,value:double"}


def test_filters_reach_the_scan(frames):
    plan = physical(frames["orders_per_month"])
    assert "GreaterThanOrEqual(o_orderdate,1997-01-01T00:00)" in plan and "LessThan(o_orderdate,1999-01-01T00:00)" in plan
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01T00:00)" in physical(frames["re_publish_rank"])
    plan = physical(frames["ab_cumulative_purchases"])
    assert "EqualTo(event_type,purchase)" in plan and "GreaterThanOrEqual(value,100.0)" in plan


def test_broadcasts_are_bounded(frames):
    """Explicit hints stand on one-row aggregates, limits, hot-key lists or rows read back."""
    for name, df in frames.items():
        for hint in re.findall(r"ResolvedHint \(strategy=broadcast\)\s+[:+\-| ]*(\w+)", df._jdf.queryExecution().analyzed().toString()):
            assert hint in {"Aggregate", "Project", "Filter", "LocalRelation", "GlobalLimit", "Join"}, (name, hint)


def test_building_starts_no_job(spark):
    spark.sparkContext.setJobGroup("building", "queries are built, not run")
    try:
        for query in QUERIES.values():
            query(spark, FOLDER)
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def scans(df):
    """Table, columns read and filters pushed (but for null checks) of every scan."""
    found = set()
    for line in re.findall(r"FileScan parquet .*", physical(df)):
        table = re.search(r"/(\w+)\.parquet", line).group(1)
        pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema: struct<(.*?)>", line)
        found.add((table, frozenset(re.findall(r"(\w+):", pushed.group(2))), frozenset(re.findall(r"(?!IsNotNull)\b\w+\(.*?\)", pushed.group(1)))))
    return found


def test_large_ways_read_no_more(spark, frames):
    """Without broadcasts and with every percentile narrowed, scans are as narrow and filtered as before."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("tidemark.smallSourceBytes", "0")
    try:
        for name, query in QUERIES.items():
            small = scans(frames[name])
            for table, columns, filters in scans(query(spark, FOLDER)):
                assert any(t == table and columns <= c and f <= filters for t, c, f in small), (name, table, columns, filters)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("tidemark.smallSourceBytes")
