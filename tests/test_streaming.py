"""The streamed daily figures equal the batch ones for every finished day."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.experiment import group_balance
from tidemark.operators.trend import cumulative_daily
from tidemark.plans import standins as S
from tidemark.streaming import monitor as M

FOLDER = "/root/testdata/sf0.001"


def arrivals(spark, tmp_path):
    """Sessions written as several files, later days in later files."""
    sessions = S.feed_sessions(spark, FOLDER)
    path = str(tmp_path / "in")
    for low, high in ((1, 10), (11, 20), (21, 31)):
        part = sessions.filter(F.dayofmonth("session_date").between(low, high))
        part.coalesce(1).write.mode("append").parquet(path)
    return sessions, path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def run(daily, tmp_path, name):
    out = str(tmp_path / name)
    query = M.append_to(daily, out, str(tmp_path / f"{name}_checkpoint"))
    query.awaitTermination()
    assert query.exception() is None
    return out


def test_daily_sessions(spark, tmp_path):
    sessions, path = arrivals(spark, tmp_path)
    stream = M.read_arrivals(spark, path, sessions.schema, per_trigger=1)
    out = run(M.daily_sessions(stream, "session_start_ts", "test_group", ["registration_flag"], lateness="1 day"), tmp_path, "daily")
    got = M.cumulative_sessions(spark, out, "test_group")
    last = got.agg(F.max("date")).first()[0]
    batch = cumulative_daily(sessions.filter(F.col("session_date") <= last), "session_start_ts", "test_group", F.count("*"), "sessions")
    columns = ["date", "test_group", "sessions", "cumulative"]
    assert rows(got.select(columns)) == rows(batch.select(columns))
    assert got.select("date").distinct().count() >= 28


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_units_and_balance(spark, tmp_path, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        check_units_and_balance(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def check_units_and_balance(spark, tmp_path):
    sessions, path = arrivals(spark, tmp_path)
    stream = M.read_arrivals(spark, path, sessions.schema, per_trigger=1)
    out = run(M.daily_units(stream, "session_start_ts", "user_id", "test_group", lateness="1 day"), tmp_path, "units")
    last = spark.read.parquet(out).agg(F.max("date")).first()[0]
    days = lambda df: rows(df.groupBy("date", "test_group").agg(F.sum("sessions")))
    batch = sessions.groupBy(F.col("session_date").alias("date"), "test_group").agg(F.count("*").alias("sessions"))
    assert days(spark.read.parquet(out)) == days(batch.filter(F.col("date") <= last))
    want = group_balance(sessions.filter(F.col("session_date") <= last), "user_id", "test_group", "A", "B")
    assert rows(M.balance(spark, out, "user_id", "test_group")) == rows(want)


def test_a_restart_adds_nothing_twice(spark, tmp_path):
    sessions, path = arrivals(spark, tmp_path)
    for _ in range(2):
        stream = M.read_arrivals(spark, path, sessions.schema, per_trigger=1)
        out = run(M.daily_sessions(stream, "session_start_ts", "test_group", lateness="1 day"), tmp_path, "again")
    table = spark.read.parquet(out)
    assert table.count() == table.select("date", "test_group").distinct().count()


def test_late_rows_are_counted(spark, tmp_path):
    sessions, _ = arrivals(spark, tmp_path)
    path = str(tmp_path / "late")
    for low, high in ((21, 31), (21, 31), (1, 3)):
        part = sessions.filter(F.dayofmonth("session_date").between(low, high))
        part.coalesce(1).write.mode("append").parquet(path)
    stream = M.read_arrivals(spark, path, sessions.schema, per_trigger=1)
    query = M.append_to(M.daily_sessions(stream, "session_start_ts", "test_group", lateness="1 day"), str(tmp_path / "out"), str(tmp_path / "c"))
    query.awaitTermination()
    assert M.late_rows(query) > 0
    assert spark.read.parquet(str(tmp_path / "out")).filter("dayofmonth(date) < 4").count() == 0


def test_first_seen_survives_restarts_and_counts_units_once(spark, tmp_path):
    from tidemark.streaming import units as U

    rows = [(u, f"2024-01-{d:02d} 10:00:00", "AB"[u % 2]) for d in range(1, 30) for u in range(d % 5, 40, 3)]
    rows += [(7, "2024-01-15 12:00:00", "A"), (None, "2024-01-15 12:00:00", "A"), (8, "2024-01-15 12:00:00", None)]
    df = spark.createDataFrame(rows, "user long, t string, g string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    seen = U.replayed(df, "t", "user", "g", ((1, 10), (11, 20), (21, 31)), "2 days")
    assert seen.count() < len(rows) * 0.9
    got = U.contamination(seen, "user", "g").first()
    assert (got.units, got.mixed_units) == (len({r[0] for r in rows if r[0] is not None}), 1)
    times = {}
    for r in seen.collect():
        times.setdefault(r.user, []).append(str(r.seen_at))
    assert all(min(ts) in {t for v, t, _ in rows if v == u and t < "2024-01-11"} for u, ts in times.items())


def test_state_expires_and_repeats_do_not_count_twice(spark):
    from tidemark.streaming import units as U

    rows = [(1, f"2024-01-{d:02d} 00:00:00", "A") for d in (1, 2, 12, 13, 25)] + [(2, f"2024-01-{d:02d} 00:00:00", "B") for d in range(1, 29)]
    df = spark.createDataFrame(rows, "user long, t string, g string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    seen = U.replayed(df, "t", "user", "g", ((1, 5), (6, 15), (16, 31)), "1 day")
    times = sorted(str(r.seen_at)[8:10] for r in seen.filter("user = 1").collect())
    assert times[0] == "01" and len(times) == 3  # state was gone before the 12th and the 25th
    assert U.balance_so_far(seen, "user", "g").first().units_a == 1


@pytest.mark.parametrize("name", ["stream_contamination", "stream_balance"])
def test_registered_streams_match_sql(spark, name):
    from oracle import compare, connect

    from tidemark.streaming import units as U

    con = connect("/root/testdata/sf0.01")
    got = U.QUERIES[name](spark, "/root/testdata/sf0.01").toArrow()
    assert compare(got, con.sql(U.ORACLE[name]).to_arrow_table()) == []
