"""Calendar grouping and running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import dates as D
from ..functions.numeric import half_even, ratio
from ..sources.tables import small_table

_UNITS = {
    "date": D.day,
    "month": lambda c: F.month(c),
    "year": lambda c: F.year(c),
    "hour": lambda c: F.hour(c),
    "weekday": D.weekday_name,
    "month_start": D.month_start,
}


def by_calendar(df: DataFrame, ts: str, unit: str, *aggs: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Aggregate by a calendar unit: date, month, year, hour, weekday or month_start."""
    return df.groupBy(*keys, _UNITS[unit](F.col(ts)).alias(unit)).agg(*aggs)


def label_order(spark: SparkSession, labels: Sequence[str], name: str) -> DataFrame:
    """A fixed list of labels with their ordinal."""
    return small_table(spark, [(x, i) for i, x in enumerate(labels, 1)], f"`{name}` string, ord int")


def in_label_order(df: DataFrame, name: str, labels: Sequence[str]) -> DataFrame:
    """Put aggregated rows in the order of a label list; labels without rows appear with NULLs."""
    order = label_order(df.sparkSession, labels, name)
    return order.join(df, name, "left").orderBy("ord")


def running_total(df: DataFrame, order_by: str, value: str, by: Sequence[str] = (), name: str = "running") -> DataFrame:
    """Running total over an already aggregated result (one row per date and group)."""
    frame = W.partitionBy(*by).orderBy(order_by).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(name, F.sum(value).over(frame))


def cumulative_daily(df: DataFrame, ts: str, group: str, agg: Column, value: str = "n", name: str = "cumulative") -> DataFrame:
    """Daily metric per group and its running total; the window sees days, not events."""
    daily = by_calendar(df, ts, "date", agg.alias(value), keys=[group])
    return running_total(daily, "date", value, [group], name)


def cumulative_units(df: DataFrame, ts: str, unit: str, group: str) -> DataFrame:
    """New units per day and their running total, also right when a unit shows up repeatedly."""
    first = df.groupBy(group, unit).agg(F.min(D.day(ts)).alias("date"))
    daily = first.groupBy(group, "date").agg(F.count("*").alias("n"))
    return running_total(daily, "date", "n", [group], "cumulative")


def daily_ratio(df: DataFrame, ts: str, num: Column, den: Column, digits: int, names: tuple[str, str, str]) -> DataFrame:
    """Per day a numerator, a denominator and their ratio (half-even rounding)."""
    daily = by_calendar(df, ts, "date", num.alias(names[0]), den.alias(names[1]))
    return daily.withColumn(names[2], half_even(ratio(names[0], names[1]), digits))


def rank_rows(df: DataFrame, by: str, tie: str, name: str = "rank") -> DataFrame:
    """Row number over an aggregated result of known small size (months, weekdays, hours)."""
    return df.withColumn(name, F.row_number().over(W.orderBy(F.col(by).desc(), F.col(tie).asc())))
