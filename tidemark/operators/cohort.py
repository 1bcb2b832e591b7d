"""Repeat-activity cohorts, plan completion and revenue by customer and month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates as D
from ..functions.numeric import exact_avg, percent
from .joins import lookup_join, match_flag


def activity_spans(df: DataFrame, unit: str, date: str, as_of: Column) -> DataFrame:
    """Per unit with at least two events: count, span, whole-day gap, first year and tenure."""
    first, last = F.col("first_date"), F.col("last_date")
    return (
        df.groupBy(unit)
        .agg(F.count("*").alias("events"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))
        .filter("events > 1")
        .withColumn("span_days", D.days_between(last, first))
        .withColumn("gap_days", F.expr("span_days div (events - 1)"))
        .withColumn("first_year", F.year(first))
        .withColumn("tenure_years", D.years_between(as_of, first))
    )


def cohort_table(spans: DataFrame, unit: str, keys: Sequence[str]) -> DataFrame:
    """Means of the activity figures per cohort."""
    return spans.groupBy(*keys).agg(
        F.count(unit).alias("units"),
        exact_avg("events", 0).alias("avg_events"),
        exact_avg("span_days").alias("avg_span_days"),
        exact_avg("gap_days").alias("avg_gap_days"),
        exact_avg("tenure_years").alias("avg_tenure_years"),
    )


def completion_rate(plan: DataFrame, actual: DataFrame, on: Sequence[str], kind: str) -> DataFrame:
    """Distinct planned items per kind, how many happened, and the rate in percent.

    Both sides are distinct before they meet, so no key has more rows than there are kinds.
    """
    planned = plan.select(*on, kind).distinct()
    return (
        match_flag(planned, actual, on, "done")
        .groupBy(kind)
        .agg(F.count("*").alias("planned"), F.sum("done").alias("completed"))
        .withColumn("rate_percent", percent("completed", "planned"))
    )


def monthly_usage(rides: DataFrame, unit: str, date: str, distance: str, duration: str) -> DataFrame:
    """Distance, minutes and rides per unit and month; all-missing sums count as zero."""
    return rides.groupBy(unit, F.month(date).alias("month")).agg(
        F.coalesce(F.sum(distance), F.lit(0)).alias("total_distance"),
        F.coalesce(F.sum(duration), F.lit(0)).alias("total_duration"),
        F.count(duration).alias("rides"),
    )


def tariff_revenue(
    users: DataFrame, rides: DataFrame, tariffs: DataFrame, unit: str = "user_id", plan: str = "subscription_type"
) -> DataFrame:
    """Monthly revenue per user: start fees, minutes and the subscription fee.

    ``rides`` has user, date, distance and duration. It is summed per user and month before it meets
    the user table, so a user with very many rides costs one row there. Users without rides have no
    month and therefore no row.
    """
    usage = monthly_usage(rides, unit, "date", "distance", "duration")
    priced = lookup_join(lookup_join(usage, users, unit), tariffs, plan)
    revenue = (
        F.col("start_ride_price") * F.col("rides")
        + F.col("minute_price") * F.col("total_duration")
        + F.col("subscription_fee")
    )
    return priced.withColumn("monthly_revenue", revenue)


def best_unit(df: DataFrame, unit: str, value: str) -> DataFrame:
    """The rows of the unit with the largest total (ties: smallest key)."""
    top = (
        df.groupBy(unit)
        .agg(F.sum(value).alias("_total"))
        .orderBy(F.col("_total").desc_nulls_last(), F.col(unit).asc())
        .limit(1)
    )
    return df.join(F.broadcast(top.select(unit)), unit, "left_semi")


def missing_child_share(
    parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, attribute: str, group: str
) -> DataFrame:
    """Per group of parents: distinct parents, joined rows lacking the attribute, and their percent.

    Children are counted per parent first; the joined row counts follow from those figures, so the
    fan-out of a left join is reproduced without building it. ``parent_key`` identifies a parent.
    """
    per_parent = children.groupBy(F.col(child_key).alias(parent_key)).agg(
        F.count_if(F.col(attribute).isNull()).alias("_lacking")
    )
    joined = lookup_join(parents.select(parent_key, group), per_parent, parent_key, "left", grouped=True)
    return (
        joined.filter(F.col(group).isNotNull())
        .groupBy(group)
        .agg(
            F.countDistinct(parent_key).alias("parents"),
            F.sum(F.coalesce("_lacking", F.lit(1))).alias("lacking"),
        )
        .withColumn("lacking_percent", F.try_divide(F.col("lacking") * 100.0, F.col("parents").cast("double")))
    )


