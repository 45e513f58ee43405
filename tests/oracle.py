"""Compares a query's rows with DuckDB's for its SQL: columns, types, rows as a multiset."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


def differences(df, sql: str, c: duckdb.DuckDBPyConnection) -> list[str]:
    rel = c.sql(sql)
    names = sorted(df.columns)
    out = []
    if names != sorted(rel.columns):
        return [f"columns {names} and {sorted(rel.columns)}"]
    kinds = dict(df.dtypes)
    for n, t in zip(rel.columns, rel.types, strict=True):
        if TYPES.get(kinds[n], kinds[n]) != str(t) and not kinds[n].startswith(("array", "struct")):
            out.append(f"{n}: {kinds[n]} and {t}")
    order = [rel.columns.index(n) for n in names]
    ours = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    theirs = sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    if len(ours) != len(theirs):
        out.append(f"{len(ours)} and {len(theirs)} rows")
    if ours != theirs:
        a, b = [x for x in ours if x not in set(theirs)][:3], [x for x in theirs if x not in set(ours)][:3]
        out.append(f"rows: {a} and {b}")
    if not ours:
        out.append("no rows")
    return out
