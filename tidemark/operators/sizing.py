"""Size estimates behind the choice between plans with equal results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Beyond these limits percentiles take other plans with the same results. The session can set another
# limit under SMALL_SOURCE_KEY.
SMALL_SOURCE_BYTES = 128 * 1024 * 1024
SMALL_SOURCE_KEY = "tidemark.smallSourceBytes"


def small_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(SMALL_SOURCE_KEY, str(SMALL_SOURCE_BYTES)))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate of the result, the one automatic broadcasts go by."""
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()


def source_bytes(df: DataFrame) -> int:
    """Summed size of the tables a DataFrame reads: bounds how many distinct values it can hold."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(leaves.apply(i).stats().sizeInBytes() for i in range(leaves.size()))


def distinct_bytes(df: DataFrame) -> list[int | None]:
    """For each column a bound of its distinct values: the size of the one table that they come from.

    A join multiplies rows, and Catalyst's estimate multiplies sizes, but a value that is computed row by row
    from one table's columns takes no more values than that table has rows; a value of an aggregate no more than
    there are groups. None where a value is computed from several tables, or its origin is not known.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if not plan.deterministic():  # such as row numbers and random values
        return [None] * len(df.columns)
    found = []
    for attribute in _ids(plan.output().mkString(" ")):
        leaves = _origins(plan, {attribute})
        found.append(None if leaves is None or len(leaves) > 1 else sum(leaves))
    return found


def _ids(text: str) -> list[int]:
    """Numbers of the attributes in the text form of expressions. Too many can only make an origin unknown."""
    return list(dict.fromkeys(map(int, re.findall(r"#(\d+)", text))))


def _origins(plan, wanted: set[int]) -> list[int] | None:
    """Sizes of the leaves of a logical plan that the wanted attributes are computed from; None if not known."""
    if not wanted:
        return []
    children = plan.children()
    if children.size() == 0:
        return [plan.stats().sizeInBytes()]
    kind = plan.nodeName()
    if kind in ("Project", "Aggregate"):
        named = (plan.projectList() if kind == "Project" else plan.aggregateExpressions()).mkString("\x01")
        if "more fields" in named:
            return None
        below: set[int] = set()
        for text in named.split("\x01"):
            own = _ids(text)
            number = int(re.search(r"#(\d+)\w*$", text)[1]) if re.search(r"#(\d+)\w*$", text) else None
            if number not in wanted:
                continue
            if kind == "Project" or own == [number]:
                below |= {i for i in own if i != number} or ({number} if own == [number] and " AS " not in text else set())
            else:
                below |= set(_ids(plan.groupingExpressions().mkString("\x01")))
        wanted = below
    elif kind in ("Union", "Expand", "Generate", "Window"):
        return None
    known: set[int] = set()
    leaves: list[int] = []
    for k in range(children.size()):
        child = children.apply(k)
        given = set(_ids(child.output().mkString(" "))) & wanted
        known |= given
        more = _origins(child, given)
        if more is None:
            return None
        leaves += more
    return leaves if known == wanted else None
