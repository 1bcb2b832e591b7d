"""Rounding, division and exact-average helpers (all native Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str, scale: int = 2) -> Column:
    """Exact decimal view of a value; sums of it do not depend on row order."""
    return as_col(c).cast(f"decimal(18,{scale})")


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` as double; NULL instead of an error when ``den`` is zero."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def _wide(c: Column | str) -> Column:
    return as_col(c).cast("decimal(20,0)")


def percent(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    """Share of two counts in percent, rounded half away from zero (SQL ``ROUND``)."""
    return F.round(F.try_divide(_wide(part) * 100, _wide(whole)), digits).cast("double")


def exact_avg(c: Column | str, digits: int = 2) -> Column:
    """Aggregate: average rounded half away from zero, once (SQL ``ROUND(AVG(..), n)``).

    The sum is a decimal of ten places, so it does not depend on the order of rows; values beyond what
    such a sum holds are averaged as doubles.
    """
    value = as_col(c)
    exact = value.try_cast("decimal(38,10)")
    size = F.max(F.abs(value.cast("double")))
    mean = F.try_divide(F.try_sum(exact), F.count(value).cast("decimal(20,0)"))
    rounded = F.round(mean, digits).cast("double")
    return F.when(size < 1e15, rounded).otherwise(F.round(F.avg(value.cast("double")), digits))


def mean(c: Column | str, digits: int = 6) -> Column:
    """Aggregate: floating average, rounded so that the summation order does not show."""
    return half_even(F.avg(as_col(c).cast("double")), digits)


def half_even(c: Column | str, digits: int = 0) -> Column:
    """Round a floating value half to even, on the scaled value as pandas does."""
    scale = F.lit(10.0**digits)
    value = as_col(c).cast("double")
    return F.rint(value * scale) / scale if digits else F.rint(value)


def flag(condition: Column) -> Column:
    """0/1 indicator in which an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def at_least(c: Column | str, threshold: float) -> Column:
    """1 when the value reaches the threshold, else 0 (missing counts as 0)."""
    return flag(as_col(c) >= F.lit(threshold))
