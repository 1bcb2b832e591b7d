"""Distinct units and contamination of a running test, kept by a stream.

The stream holds one state row per unit and group until the watermark has passed the time it was first seen by
the allowed lateness, and appends a row the first time it sees them. A unit that comes back after its state has
gone is appended again, so the table holds a few rows per unit, not one per session; the figures on it count
units once whatever is repeated. Both the state and the table survive a restart of the stream.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dates import day
from ..operators.experiment import group_balance
from ..sources.tables import load
from .monitor import _timed, append_to, read_arrivals


def first_seen(sessions: DataFrame, ts: str, unit: str, group: str, *, lateness: str) -> DataFrame:
    """Each unit and group once within the watermark, when they are first seen; rows without a unit are left out.

    ``seen_at`` is the time of one of their sessions in the trigger that saw them first.
    """
    known = sessions.filter(F.col(unit).isNotNull())
    once = _timed(known, ts, lateness).dropDuplicatesWithinWatermark([unit, group])
    return once.select(unit, group, F.col(ts).alias("seen_at"))


def unit_groups(seen: DataFrame, unit: str, group: str) -> DataFrame:
    """One row per unit with the extremes of its groups."""
    return seen.groupBy(unit).agg(F.min(group).alias("first_group"), F.max(group).alias("last_group"))


def contamination(seen: DataFrame, unit: str, group: str) -> DataFrame:
    """Units of the test so far, and those seen in more than one group."""
    mixed = F.col("first_group") != F.col("last_group")
    return unit_groups(seen, unit, group).agg(F.count("*").alias("units"), F.count_if(mixed).alias("mixed_units"))


def balance_so_far(seen: DataFrame, unit: str, group: str, a: str = "A", b: str = "B") -> DataFrame:
    """Distinct units of both groups and their gap."""
    return group_balance(seen.select(unit, group).distinct(), unit, group, a, b)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, else the warehouse, or a temporary one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return tempfile.mkdtemp(prefix="stream-")
    return f"{(named or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/stream-{uuid.uuid4().hex}"


def replayed(sessions: DataFrame, ts: str, unit: str, group: str, parts: Sequence[tuple[int, int]], lateness: str) -> DataFrame:
    """Rows of :func:`first_seen` after the sessions have arrived in parts (ranges of days of the month).

    The stream is stopped after each part and started again on the same checkpoint, as after a failure.
    """
    spark, folder = sessions.sparkSession, shared_folder(sessions.sparkSession)
    for first, last in parts:
        part = sessions.filter(F.dayofmonth(day(ts)).between(first, last))
        part.write.mode("append").parquet(f"{folder}/in")
        stream = read_arrivals(spark, f"{folder}/in", sessions.schema)
        query = append_to(first_seen(stream, ts, unit, group, lateness=lateness), f"{folder}/seen", f"{folder}/state")
        query.awaitTermination()
    return spark.read.parquet(f"{folder}/seen")


def _sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Every third user's purchases are logged under the other arm."""
    events = load(spark, folder, "events")
    other = (F.col("event_type") == "purchase") & (F.col("user_id") % 3 == 0)
    group = F.when((F.col("user_id") % 2 == 0) != other, "A").otherwise("B")
    return events.select("user_id", "ts", group.alias("test_group"))


PARTS = ((1, 9), (10, 21), (22, 31))

QUERIES = {
    "stream_contamination": lambda s, d: contamination(
        replayed(_sessions(s, d), "ts", "user_id", "test_group", PARTS, "2 days"), "user_id", "test_group"
    ),
    "stream_balance": lambda s, d: balance_so_far(
        replayed(_sessions(s, d), "ts", "user_id", "test_group", PARTS, "2 days"), "user_id", "test_group"
    ),
}

_GROUPS = """
  WITH g AS (SELECT user_id, CASE WHEN (user_id % 2 = 0) <> (event_type = 'purchase' AND user_id % 3 = 0) THEN 'A' ELSE 'B' END AS test_group FROM events)"""

ORACLE = {
    "stream_contamination": _GROUPS + """
  SELECT count(*) AS units, count(*) FILTER (WHERE n > 1) AS mixed_units
  FROM (SELECT user_id, count(DISTINCT test_group) AS n FROM g GROUP BY 1)""",
    "stream_balance": _GROUPS + """,
  w AS (SELECT count(DISTINCT user_id) FILTER (WHERE test_group = 'A') AS units_a, count(DISTINCT user_id) FILTER (WHERE test_group = 'B') AS units_b FROM g)
  SELECT *, round_even(abs(units_a - units_b) * 100 / CAST(units_a AS DOUBLE), 2) AS gap_percent FROM w""",
}
