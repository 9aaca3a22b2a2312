"""Reported cases: zeros and copies in the events."""

from __future__ import annotations

import os

import duckdb
import pytest
from parity import TABLES, duck, rows

import __spark_entry__  # noqa: F401  (registers the queries)
from tidewell.plans import registry


@pytest.fixture(scope="module")
def odd(sf, tmp_path_factory):
    """The tables with seven copies of every subject, their rows in other orders, and values of zero and beyond 500 in all classes."""
    to = str(tmp_path_factory.mktemp("odd"))
    for t in TABLES:
        if t != "events":
            os.symlink(f"{sf}/{t}.parquet", f"{to}/{t}.parquet")
    copy = "SELECT * REPLACE (event_id + 1000000 * i AS event_id, user_id + 1000 * i AS user_id) FROM '{}/events.parquet', range(7) t(i)"
    odd = "SELECT * REPLACE (CASE event_id % 400 WHEN 0 THEN 0 WHEN 1 THEN 501.25 ELSE value END AS value) FROM"
    duckdb.sql(f"COPY ({odd} ({copy.format(sf)}) ORDER BY user_id // 1000, hash(event_id)) TO '{to}/events.parquet' (FORMAT parquet)")
    return to


def same(spark, sf, name):
    con = duck(sf)
    con.execute("SET threads = 1")  # sums in one order, so that copies tie
    a, b = registry.QUERIES[name](spark, sf).toPandas(), con.execute(registry.SQL[name]).fetchdf()
    assert rows(a) == rows(b[a.columns])


@pytest.mark.parametrize("name", ["metrics_brier_log_loss", "scalar_math"])
def test_logarithms_of_zero(spark, odd, name):
    same(spark, odd, name)


def test_equal_separabilities_tie(spark, odd):
    """Whatever the order of the rows that they come from: copies of a subject have one rank."""
    out = registry.QUERIES["responder_scores"](spark, odd).selectExpr("subject % 1000 AS s", "sep_rank").distinct()
    assert out.count() == out.select("s").distinct().count()


def test_scalars_of_odd_values(spark, sf, tmp_path):
    """At and below -1, at infinity, NaN and null, as its SQL has them."""
    odd = "[-1, -2.5, 'nan'::DOUBLE, 'inf'::DOUBLE, -0.0, NULL, 0.5, 300]"
    duckdb.sql(f"COPY (SELECT * REPLACE ({odd}[event_id % 8 + 1] AS value) FROM '{sf}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = registry.QUERIES["scalar_math"](spark, str(tmp_path)).collect()
    want = con.execute(f"SELECT {', '.join(got[0].asDict())} FROM ({registry.SQL['scalar_math']})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
