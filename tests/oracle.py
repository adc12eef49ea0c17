"""Comparison of a Spark query with its SQL on DuckDB, as sets of rows."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{source}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(names: list[str], rows) -> tuple[list[str], list[str]]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def assert_same(frame, con, sql: str) -> None:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert rows_of(frame.columns, frame.collect()) == rows_of(names, result.fetchall())
