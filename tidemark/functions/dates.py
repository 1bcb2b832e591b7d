"""Calendar helpers. Every expression is independent of the session time zone for NTZ input."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from .numeric import as_col, half_even

# Names the published tables use, in calendar order.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTHS_RU = (
    "Январь", "Февраль", "Март", "Апрель", "Май", "Июнь",
    "Июль", "Август", "Сентябрь", "Октябрь", "Ноябрь", "Декабрь",
)


def day(c: Column | str) -> Column:
    return F.to_date(as_col(c))


def month_start(c: Column | str) -> Column:
    """First day of the month, kept as a DATE."""
    return F.trunc(day(c), "MM")


def in_days(c: Column | str, start: dt.date, end: dt.date) -> Column:
    """Whether a date or timestamp falls on one of the days from ``start`` to ``end``.

    The half-open range leaves the column bare, so the filter reaches the file scan, and keeps the
    whole last day of a timestamp.
    """
    return (as_col(c) >= F.lit(start)) & (as_col(c) < F.lit(end + dt.timedelta(days=1)))


def in_years(c: Column | str, first: int, last: int) -> Column:
    return in_days(c, dt.date(first, 1, 1), dt.date(last, 12, 31))


def weekday_name(c: Column | str) -> Column:
    return F.date_format(day(c), "EEEE")


def month_name(month: Column | str, names: tuple[str, ...] = MONTHS_RU) -> Column:
    """Month number to its name."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), as_col(month).cast("int"))


def add_days(start: Column | str, days: Column | str) -> Column:
    """Date plus a possibly fractional number of days (rounded, not truncated)."""
    return F.date_add(day(start), F.rint(as_col(days).cast("double")).cast("int"))


def days_between(end: Column | str, start: Column | str) -> Column:
    return F.date_diff(day(end), day(start))


def years_between(as_of: Column | str, start: Column | str) -> Column:
    """Whole calendar years: the difference of years, less one before the anniversary."""
    a, s = day(as_of), day(start)
    reached = (F.month(a) * 100 + F.dayofmonth(a)) >= (F.month(s) * 100 + F.dayofmonth(s))
    return F.year(a) - F.year(s) - F.when(reached, 0).otherwise(1)


def _second_of_day(c: Column) -> Column:
    return (F.hour(c) * 3600 + F.minute(c) * 60).cast("decimal(20,6)") + F.extract(F.lit("SECOND"), c)


def seconds_between(end: Column | str, start: Column | str) -> Column:
    """Exact elapsed seconds (decimal with microseconds) between two timestamps."""
    e, s = as_col(end), as_col(start)
    whole_days = F.date_diff(F.to_date(e), F.to_date(s)) * 86400
    return whole_days.cast("decimal(20,6)") + _second_of_day(e) - _second_of_day(s)


def minutes_between(end: Column | str, start: Column | str) -> Column:
    """Elapsed minutes, rounded half to even to a whole number."""
    return half_even(seconds_between(end, start) / F.lit(60), 0).cast("int")
