"""Shared helpers: tables in the shared folder, running sums over a total order, word counts."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Characters that end a word, as a regular expression class (fixed values).
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, one of our own.

    Our own is a temporary folder in local mode (one process), else a folder in the warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            _own_folder[app] = tempfile.mkdtemp(prefix="shared-")
        else:
            _own_folder[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + f"/shared-{app}"
    return _own_folder[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows that a Python worker gets at a time while a table is stored.
BATCH_ROWS = 500


def stored(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """df, written once as a table in the shared folder and read from there: it survives lost executors.

    Python functions in df get batches of `batch_rows` rows, so that workers stay small with long texts (Spark
    bounds a batch's bytes besides). The session's own setting is back afterwards.
    """
    spark = df.sparkSession
    path, key = new_folder(spark, name), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(batch_rows, int(before)) if int(before) > 0 else batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def crc_remainder(value: Column, divisor: int) -> Column:
    """crc32 of the value as text, modulo divisor; null for null."""
    return F.pmod(F.crc32(value.cast("string")), F.lit(divisor))


def python_crc_remainder(value: object, divisor: int) -> int:
    """The same for one Python value."""
    return zlib.crc32(str(value).encode()) % divisor


def word_count(text: Column) -> Column:
    """Number of words of each text (0 for null)."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        # bytes.split() splits at exactly the six characters of BLANK
        return pd.Series([0 if t is None else len(t.encode().split()) for t in texts], dtype="int64")

    return count(text)


def running_total(
    df: DataFrame, order: Sequence[str], amount: str, total: str, *, within: str | None = None, name: str = "running"
) -> DataFrame:
    """Adds `total`, the sum of `amount` over all rows up to this one in the given order (of its `within`).

    The rows are range-partitioned by the order, stored, and summed part by part; only one row per part (and
    `within`) is then summed in order, so no group of rows meets in a task. `within` must lead the order.
    Rows that agree in all of `order` share their part; they are counted one after another.
    """
    if within is not None and order[0] != within:
        raise ValueError("the order must begin with `within`")
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c).asc_nulls_last() for c in order]
    ranged = df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id())
    ranged = stored(ranged, name)
    group = ["_part"] if within is None else ["_part", within]
    sums = ranged.groupBy(*group).agg(F.sum(amount).alias("_sum"))
    ahead = Window.orderBy("_part") if within is None else Window.partitionBy(within).orderBy("_part")
    before = sums.select(
        *[F.col(c).alias(f"_at{i}") for i, c in enumerate(group)],
        F.coalesce(F.sum("_sum").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    same = F.col("_part") == F.col("_at0")
    if within is not None:
        same = same & F.col(within).eqNullSafe(F.col("_at1"))
    inside = Window.partitionBy(*group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("_inside", F.sum(amount).over(inside))
    return summed.join(before, same, "left").select(*df.columns, (F.col("_inside") + F.col("_before")).alias(total))
