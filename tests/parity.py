"""Compare a query with its DuckDB SQL."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(frame) -> list[tuple]:
    cols = sorted(frame.columns)
    plain = frame[cols].astype({c: "Int64" for c in cols if frame[c].dtype == "float64" and frame[c].hasnans and (frame[c].dropna() % 1 == 0).all()})  # longs with nulls
    return sorted(map(tuple, plain.astype(str).to_numpy()))


def assert_same(spark, sf: str, query, sql: str) -> None:
    a, b = query(spark, sf).toPandas(), duck(sf).execute(sql).fetchdf()
    assert sorted(a.columns) == sorted(b.columns)
    assert len(a) == len(b)
    assert rows(a) == rows(b)
