"""Table access with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .schemas import GIVEN

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: StructType | str | None = None,
    tolerant: bool = False,
    **options: str,
) -> DataFrame:
    """Read CSV (with header), JSON, ORC or parquet.

    Text formats need a declared schema: inference would read the input twice. Broken records stop
    the read; with ``tolerant`` they become NULLs instead.
    """
    if fmt in ("csv", "json"):
        if schema is None:
            raise ValueError(f"{fmt} needs a declared schema")
        options.setdefault("mode", "PERMISSIVE" if tolerant else "FAILFAST")
        if fmt == "csv":
            options.setdefault("header", "true")
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(fmt).load(path)


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder; a declared schema spares the look into a file footer."""
    reader = spark.read.schema(GIVEN[name]) if name in GIVEN else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A parameter table (price list, population series) from literal rows.

    It goes through Arrow, so Catalyst knows its size and can broadcast it.
    """
    fields = StructType.fromDDL(schema)
    columns = zip(*rows) if rows else [()] * len(fields)
    data = pa.table({f.name: list(values) for f, values in zip(fields, columns)})
    return spark.createDataFrame(data).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields])


def parse_lines(lines: DataFrame, column: str, schema: StructType | str, sep: str = ",", header: str | None = None, **options: str) -> DataFrame:
    """CSV lines as typed columns, with the line (``_line``) and why it is broken (``_reason``, NULL for sound ones).

    Reasons: ``open quote``, ``too few fields``, ``too many fields``, ``bad value: <columns>``. What can be read of
    a broken line stays in its columns. Blank lines and lines equal to ``header`` are left out. Fields hold no line
    breaks; a quote inside quotes is doubled. Everything is an expression on the line, so accepted and broken rows come from the same parse, and no
    column is skipped that a query doesn't read.
    """
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = [f.name for f in fields]
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    text = ", ".join(f"`{n}` string" for n in names)
    settings = {"sep": sep, "mode": "PERMISSIVE", "escape": '"', **options}
    line = F.col(column)
    kept = lines.filter(F.trim(line) != "") if header is None else lines.filter((F.trim(line) != "") & (F.rtrim(line) != header))
    parsed = kept.select(line.alias("_line"), F.from_csv(line, typed, settings).alias("_typed"), F.from_csv(line, F.lit(text), settings).alias("_text"))
    unquoted = F.regexp_replace("_line", r'"([^"]|"")*"', "")
    found = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(sep), F.lit("")))
    found = F.try_divide(found, F.lit(len(sep))).cast("int") + 1
    bad = F.array_compact(
        F.array(*[F.when(F.col("_text")[n].isNotNull() & F.col("_typed")[n].isNull(), F.lit(n)) for n in names])
    )
    reason = (
        F.when(F.contains(unquoted, F.lit('"')), "open quote")
        .when(found < len(names), "too few fields")
        .when(found > len(names), "too many fields")
        .when(F.size(bad) > 0, F.concat(F.lit("bad value: "), F.array_join(bad, ", ")))
    )
    return parsed.select(*[F.col("_typed")[n].alias(n) for n in names], "_line", reason.alias("_reason"))


def read_lines(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",", header: str | None = None, **options: str) -> DataFrame:
    """The files of a folder through :func:`parse_lines`; ``header`` is the files' first line, by default the column names."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    first = sep.join(f.name for f in fields) if header is None else header
    return parse_lines(spark.read.text(path), "value", fields, sep, first, **options)


def accepted(parsed: DataFrame) -> DataFrame:
    """The sound rows of :func:`parse_lines`, without its own columns."""
    return parsed.filter("_reason IS NULL").drop("_line", "_reason")


def rejected(parsed: DataFrame) -> DataFrame:
    """The broken lines with their reason, to be written beside the accepted rows."""
    return parsed.filter("_reason IS NOT NULL").select("_line", "_reason")


def reject_summary(parsed: DataFrame) -> DataFrame:
    """Rows per reason; ``accepted`` counts the sound ones."""
    return parsed.groupBy(F.coalesce("_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("rows"))


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, mode: str = "errorifexists") -> DataFrame:
    """Write a table of the catalog in sorted buckets of the keys; returns it.

    Joins and aggregates on the keys then need no exchange, as often as they are repeated. Rows are dealt to the
    buckets before they are written, so there is one file per bucket instead of one per bucket and task. Choose
    the number so that a bucket is one task's work; both sides of a join need the same one.
    """
    dealt = df.repartition(buckets, *keys)
    dealt.write.format("parquet").mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return df.sparkSession.table(table)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Write by partitions; those that the rows belong to are replaced, all others stay (a day can be run again)."""
    df.write.format("parquet").mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).save(path)


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists"
) -> None:
    """Write a result; the default refuses to replace what is there."""
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def cast_columns(df: DataFrame, types: dict[str, str], tolerant: bool = False) -> DataFrame:
    """Cast columns to declared types; a bad value raises, or becomes NULL with ``tolerant``."""
    changed = {c: F.col(c).try_cast(t) if tolerant else F.col(c).cast(t) for c, t in types.items()}
    return df.withColumns(changed)


def parse_times(df: DataFrame, formats: dict[str, str | None], to: str = "timestamp", tolerant: bool = False) -> DataFrame:
    """Parse text columns into zone-free timestamps or dates."""
    out = {}
    for name, pattern in formats.items():
        args = (F.col(name),) if pattern is None else (F.col(name), F.lit(pattern))
        if tolerant:
            parsed = F.try_to_timestamp(*args).cast("timestamp_ntz")
        else:
            parsed = F.to_timestamp_ntz(*args)
        out[name] = F.to_date(parsed) if to == "date" else parsed
    return df.withColumns(out)


def reject_counts(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Per column, how many present values a tolerant cast would lose; one pass."""
    return df.agg(
        *[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(c) for c, t in types.items()]
    )
