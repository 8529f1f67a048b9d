"""Comparison of a Spark result with that of SQL in DuckDB."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both have the same columns and rows, else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    at = [names.index(n) for n in order]
    want = Counter(tuple(row[i] for i in at) for row in cursor.fetchall())
    got = Counter(tuple(row) for row in df.select(*order).collect())
    if want == got:
        return None
    extra, missing = got - want, want - got
    return (
        f"{sum(got.values())} rows, {sum(want.values())} expected; "
        f"extra {list(extra)[:2]}, missing {list(missing)[:2]}"
    )
