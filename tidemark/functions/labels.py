"""Conditional labels and binning as native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .numeric import as_col


def segment(
    c: Column | str,
    bands: Sequence[tuple[float | None, float | None, str]],
    other: str | None = None,
) -> Column:
    """Label of the first closed band ``[lo, hi]`` holding the value.

    An open end is ``None``. Missing values and values in the gaps between bands get ``other``.
    """
    value = as_col(c)
    out = None
    for lo, hi, label in bands:
        test = F.lit(True)
        if lo is not None:
            test = test & (value >= F.lit(lo))
        if hi is not None:
            test = test & (value <= F.lit(hi))
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(F.lit(other).cast("string"))


def upper_bands(
    c: Column | str,
    bands: Sequence[tuple[float, str]],
    last: str,
    null_label: str | None = None,
) -> Column:
    """Ordered upper limits. Missing values take ``last`` unless ``null_label`` is given."""
    value = as_col(c)
    out = F.when(value.isNull(), F.lit(last if null_label is None else null_label))
    for upper, label in bands:
        out = out.when(value <= F.lit(upper), label)
    return out.otherwise(last)


def first_true(choices: Sequence[tuple[Column | str, str]], other: str) -> Column:
    """Label of the first condition that is true; NULL conditions are passed over."""
    out = None
    for cond, label in choices:
        out = F.when(as_col(cond), label) if out is None else out.when(as_col(cond), label)
    return out.otherwise(other)


def two_way(condition: Column, yes: str, no: str) -> Column:
    return F.when(condition, yes).otherwise(no)


def interval_labels(edges: Sequence[float]) -> list[str]:
    return [f"({lo}, {hi}]" for lo, hi in zip(edges, edges[1:])]


def cut(c: Column | str, edges: Sequence[float], include_lowest: bool = False) -> Column:
    """Right-closed bins ``(lo, hi]``; values outside all bins give NULL."""
    value = as_col(c)
    out = None
    for i, label in enumerate(interval_labels(edges)):
        low = value >= F.lit(edges[i]) if include_lowest and i == 0 else value > F.lit(edges[i])
        test = low & (value <= F.lit(edges[i + 1]))
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def matches_any(c: Column | str, terms: Sequence[str]) -> Column:
    """Case-sensitive substring match of any term, over the whole text."""
    out = F.lit(False)
    for term in terms:
        out = out | as_col(c).contains(term)
    return out
