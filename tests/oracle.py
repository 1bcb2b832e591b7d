"""Compare a query with its SQL counterpart, value by value and type by type."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb
import pyarrow as pa

from tidemark.sources.tables import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _family(kind: pa.DataType) -> str:
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return "text"
    return str(kind)


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.12g}") + 0.0
    if isinstance(value, decimal.Decimal):
        return value.normalize()
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def table(arrow: pa.Table):
    names = sorted(arrow.column_names)
    rows = list(zip(*[[_plain(v) for v in arrow.column(n).to_pylist()] for n in names])) if names else []
    types = [(n, _family(arrow.schema.field(n).type)) for n in names]
    return types, sorted(rows, key=lambda r: [(v is None, str(type(v)), str(v)) for v in r])


def compare(got: pa.Table, want: pa.Table) -> list[str]:
    (gt, gr), (wt, wr) = table(got), table(want)
    problems = []
    if gt != wt:
        problems.append(f"schema {gt} != {wt}")
    if len(gr) != len(wr):
        problems.append(f"rows {len(gr)} != {len(wr)}")
    if gr != wr:
        bad = [(a, b) for a, b in zip(gr, wr) if a != b][:3]
        problems.append("values " + "; ".join(f"{a} != {b}" for a, b in bad))
    return problems
