"""Named end-to-end analyses.

Each module holds functions over DataFrames with domain columns, plus ``QUERIES`` (the same
functions on the stand-in tables of :mod:`tidemark.plans.standins`) and ``ORACLE`` (independently
written SQL on those tables).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    return {name: query for module in _modules() for name, query in module.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.ORACLE.items()}


def _modules():
    from . import accidents, donors, feed, realty, rides, shop, startups, tariffs, vacancies

    return (donors, realty, vacancies, shop, feed, rides, tariffs, startups, accidents)
