"""Comparison of a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb

from gneiss.session import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        files = glob.glob(f"{path}/*.parquet") if os.path.isdir(path) else [path]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet({files})")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, query, sql: str, sf_dir: str, con=None) -> str | None:
    got = query(spark, sf_dir)
    ours = rows_of(got.columns, got.collect())
    rel = (con or connect(sf_dir)).sql(sql)
    theirs = rows_of(rel.columns, rel.fetchall())
    if sorted(got.columns) != sorted(rel.columns):
        return f"columns {sorted(got.columns)} and {sorted(rel.columns)}"
    if ours != theirs:
        a, b = [r for r in ours if r not in set(theirs)][:3], [r for r in theirs if r not in set(ours)][:3]
        return f"{len(ours)} and {len(theirs)} rows; only ours {a}, only theirs {b}"
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    for name, kind in got.dtypes:
        if kind == "int" and kinds[name] in ("BIGINT", "HUGEINT") or kind == "bigint" and kinds[name] in ("INTEGER", "HUGEINT", "DOUBLE"):
            return f"{name} is {kind} and {kinds[name]}"
    return None
