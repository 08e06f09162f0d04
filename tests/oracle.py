"""Runs a registered query and its SQL side by side."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if hasattr(x, "as_integer_ratio") and not isinstance(x, (int, bool)):
        return float(f"{float(x):.9g}")
    return x


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir: str, query, sql: str) -> int:
    got = query(spark, sf_dir)
    con = connect(sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(names), (sorted(got.columns), sorted(names))
    a, b = rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(names, cur.fetchall())
    assert len(a) == len(b), (len(a), len(b))
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not bad, (len(bad), bad[:3])
    return len(a)
