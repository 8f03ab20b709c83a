"""Spark results against DuckDB's."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


KINDS = {"bigint": "int64", "int": "int32", "double": "double", "string": "string", "boolean": "bool", "float": "float"}


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


def differences(df, con, sql: str) -> list[str]:
    """What differs: columns, kinds, row counts, values; empty if nothing does."""
    got = con.execute(sql).to_arrow_table()
    out = []
    if sorted(df.columns) != sorted(got.column_names):
        return [f"columns {sorted(df.columns)} and {sorted(got.column_names)}"]
    for name, kind in df.dtypes:
        own = str(got.schema.field(name).type).replace("large_string", "string")
        if KINDS.get(kind, kind) != own and not kind.startswith("timestamp"):
            out.append(f"{name} is {kind} and {own}")
    ours, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(got.column_names, [tuple(r.values()) for r in got.to_pylist()])
    if len(ours) != len(theirs):
        out.append(f"{len(ours)} and {len(theirs)} rows")
    out += [f"{a} and {b}" for a, b in zip(ours, theirs, strict=False) if a != b][:3]
    return out
