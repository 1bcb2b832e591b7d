"""Every named query against independently written SQL on the same tables."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from tidemark import plans

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

QUERIES, ORACLE = plans.all_queries(), plans.all_oracles()


@pytest.fixture(scope="module")
def duck():
    con = connect(FOLDER)
    yield con
    con.close()


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toArrow()
    want = duck.sql(ORACLE[name]).to_arrow_table()
    assert compare(got, want) == []
    assert got.num_rows > 0


@pytest.fixture
def large_ways(spark):
    """Every operator takes its large-input way."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("tidemark.smallSourceBytes", "0")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("tidemark.smallSourceBytes")


PERCENTILES_AND_JOINS = (
    "re_profile", "re_publish_rank", "re_remove_rank", "re_top_towns", "balcony_box", "balcony_histogram", "balcony_outliers",
    "rider_age_summary", "ride_summary", "duration_box", "minute_cost_box", "minute_cost_histogram", "box_stats", "describe_cols",
    "duration_summary", "duration_histogram_by_plan", "rounds_per_year", "funding_summary", "funding_box", "zero_price_summary",
    "zero_price_iqr", "price_spread", "plan_completion", "dup_rows", "dup_rows_exact", "coord_semi_pairs", "tariff_revenue",
    "ab_conversion", "ab_covariates", "cashback_top_regions",
)


@pytest.mark.parametrize("name", PERCENTILES_AND_JOINS)
def test_large_ways_match_sql(spark, duck, large_ways, name):
    got = QUERIES[name](spark, FOLDER).toArrow()
    assert compare(got, duck.sql(ORACLE[name]).to_arrow_table()) == []


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["region", "segment", "listings"]
    assert df.count() > 0
