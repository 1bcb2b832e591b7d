"""Broken lines, sorted buckets, replaced partitions."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources.tables import accepted, parse_lines, read_lines, reject_summary, rejected, replace_partitions, write_bucketed

SCHEMA = "a int, b double, c string, d date"


def test_broken_lines_are_counted_by_reason(spark, tmp_path):
    lines = [
        "a,b,c,d", '1,2.5,"x, y",2024-01-02', "2,bad,y,2024-01-02", "3,4.5,z", '4,5.5,"z,more",2024-01-02,extra', 'x,y,"q,q",2024-13-01',
        "", "6,,,", '7,1.5,"open,2024-01-02', '8,1,"say ""hi"", you",2024-02-29', "   ", "99999999999,1,c,2024-01-02", "9,1e3,c,2024-01-02\r",
    ]
    (tmp_path / "one.csv").write_text("\n".join(lines[:7]) + "\n")
    (tmp_path / "two.csv").write_text("\n".join(["a,b,c,d", *lines[7:]]))
    parsed = read_lines(spark, str(tmp_path), SCHEMA)
    assert {r.reason: r.rows for r in reject_summary(parsed).collect()} == {
        "accepted": 4, "bad value: b": 1, "too few fields": 1, "too many fields": 1, "bad value: a, b, d": 1, "open quote": 1, "bad value: a": 1,
    }
    good = sorted((r.a, r.b, r.c) for r in accepted(parsed).collect())
    assert good == [(1, 2.5, "x, y"), (6, None, None), (8, 1.0, 'say "hi", you'), (9, 1000.0, "c")]
    assert {r._line for r in rejected(parsed).collect()} >= {"3,4.5,z", "2,bad,y,2024-01-02"}


def test_a_column_that_is_not_read_still_rejects(spark):
    lines = spark.createDataFrame([("1;x",), ("z;y",), (None,)], "l string")
    assert [r.c for r in accepted(parse_lines(lines, "l", "a int, c string", ";")).select("c").collect()] == ["x"]
    assert reject_summary(parse_lines(lines.limit(0), "l", "a int")).collect() == []


def test_sorted_buckets_join_without_an_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fact = spark.range(0, 5000, 1, 6).select((F.col("id") % 700).alias("unit"), "id")
        dim = spark.range(0, 700).select(F.col("id").alias("unit"), (F.col("id") % 2).alias("g"))
        for name in ("bucketed_fact", "bucketed_units"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        facts, units = write_bucketed(fact, "bucketed_fact", ["unit"], 8), write_bucketed(dim, "bucketed_units", ["unit"], 8)
        joined = facts.join(units, "unit").groupBy("unit", "g").agg(F.count("*").alias("n"))
        assert joined.agg(F.sum("n")).first()[0] == 5000
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert len(facts.inputFiles()) <= 8
        with pytest.raises(Exception):
            write_bucketed(fact, "bucketed_fact", ["unit"], 8)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("bucketed_fact", "bucketed_units"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_running_a_day_again_replaces_that_day_only(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-03", 3)], "day string, v int")
    replace_partitions(rows, path, ["day"])
    replace_partitions(spark.createDataFrame([("2024-01-02", 20), ("2024-01-02", 21)], "day string, v int"), path, ["day"])
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 3, 20, 21]
