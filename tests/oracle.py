"""Rows of a query and of its SQL in DuckDB, made comparable."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, bool):
        return x
    return float(x) if isinstance(x, int) else x


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    mine, theirs = bag(df.columns, df.collect()), bag(names, found.fetchall())
    assert mine == theirs, f"only here: {list((mine - theirs).items())[:3]}; only in SQL: {list((theirs - mine).items())[:3]}"
