"""Runs a registered query on Spark and its SQL on DuckDB and compares them exactly."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if hasattr(value, "is_integer") or hasattr(value, "to_integral_value"):
        return float(value)
    return value


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(row[i]) for i in order) for row in rows], key=repr)


def differences(spark_df, con, sql: str, limit: int = 5) -> list[str]:
    """Empty when both sides have the same columns and the same multiset of rows."""
    ours = [tuple(row) for row in spark_df.collect()]
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    theirs = found.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    a, b = table_of(spark_df.columns, ours), table_of(names, theirs)
    out = []
    if len(a) != len(b):
        out.append(f"rows {len(a)} != {len(b)}")
    different = [(x, y) for x, y in zip(a, b) if x != y]
    if different:
        out.append(f"{len(different)} rows differ")
        out += [f"  spark {x}\n  sql   {y}" for x, y in different[:limit]]
    kinds = {n: t for n, t in spark_df.dtypes}
    sql_kinds = {d[0]: str(d[1]) for d in con.execute(sql).description}
    wanted = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    for n, t in kinds.items():
        if t in wanted and wanted[t] != sql_kinds[n]:
            out.append(f"type of {n}: {t} / {sql_kinds[n]}")
    return out
