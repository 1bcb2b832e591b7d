"""Daily figures of a running test as a stream; the checks on them stay batch queries.

The stream keeps one state row per day, group (and, for distinct units, unit) until the watermark
passes the day, then appends the day's row to a table. Balance, success share and running totals
read that table, so they can be repeated at any time and survive a restart of the stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.experiment import group_balance
from ..operators.trend import running_total


def read_arrivals(spark: SparkSession, folder: str, schema: StructType | str, fmt: str = "parquet", per_trigger: int = 1000) -> DataFrame:
    """Files of a folder as a stream, a bounded number per trigger."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", per_trigger).load(folder)


def _timed(sessions: DataFrame, ts: str, lateness: str) -> DataFrame:
    """Event time under a watermark. The zone-free wall clock is read as UTC, whatever the session's
    zone, because streaming windows are cut at midnight UTC."""
    t = F.col(ts)
    seconds = F.extract(F.lit("SECOND"), t)
    clock = F.make_timestamp(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.minute(t), seconds, F.lit("UTC"))
    return sessions.withColumn("_ts", clock).withWatermark("_ts", lateness)


def _date_of(window: str) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(f"{window}.start") / 86400).cast("int")).alias("date")


def daily_sessions(sessions: DataFrame, ts: str, group: str, flags: Sequence[str] = (), *, lateness: str) -> DataFrame:
    """Sessions and flagged sessions per day and group. Rows later than ``lateness`` are dropped; :func:`late_rows` counts them."""
    return (
        _timed(sessions, ts, lateness)
        .groupBy(F.window("_ts", "1 day").alias("_day"), group)
        .agg(F.count("*").alias("sessions"), *[F.sum(f).alias(f) for f in flags])
        .select(_date_of("_day"), group, "sessions", *flags)
    )


def daily_units(sessions: DataFrame, ts: str, unit: str, group: str, *, lateness: str) -> DataFrame:
    """One row per day, group and unit, the input of the balance and contamination checks; late rows as there."""
    return (
        _timed(sessions, ts, lateness)
        .groupBy(F.window("_ts", "1 day").alias("_day"), group, unit)
        .agg(F.count("*").alias("sessions"))
        .select(_date_of("_day"), group, unit, "sessions")
    )


def append_to(daily: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived and append finished days to a parquet table, exactly once.

    ``checkpoint`` must lie in storage that all executors share.
    """
    return (
        daily.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def late_rows(query: StreamingQuery) -> int:
    """Partial counts that a query's recent triggers dropped because they came later than the watermark allows."""
    return sum(op["numRowsDroppedByWatermark"] for trigger in query.recentProgress for op in trigger["stateOperators"])


def cumulative_sessions(spark: SparkSession, path: str, group: str) -> DataFrame:
    """Finished days with the running total per group."""
    return running_total(spark.read.parquet(path), "date", "sessions", [group], "cumulative")


def balance(spark: SparkSession, path: str, unit: str, group: str, a: str = "A", b: str = "B") -> DataFrame:
    """Group sizes and their gap over the finished days."""
    return group_balance(spark.read.parquet(path), unit, group, a, b)
