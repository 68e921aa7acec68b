"""Spark queries against their SQL on DuckDB over the same Parquet files."""

from __future__ import annotations

import glob
import os

import duckdb


def oracle_connection(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{src}')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of_spark(df) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_duck(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(norm(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def compare(spark, folder: str, query, sql: str) -> None:
    df = query(spark, folder)
    names, want = rows_of_duck(oracle_connection(folder), sql)
    assert sorted(df.columns) == names, (sorted(df.columns), names)
    got = rows_of_spark(df)
    assert len(got) == len(want), (len(got), len(want))
    off = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not off, (len(off), off[:2])
