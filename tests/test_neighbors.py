"""Nearest neighbours against all pairs."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import neighbors
from tidewell.operators.neighbors import Pivots


def data(seed, n, dims, spread=0.2):
    g = np.random.default_rng(seed)
    c = g.normal(size=(6, dims))
    rows = [(i, [float(x) for x in c[i % 6] + spread * g.normal(size=dims)], i % 9) for i in range(n)]
    return rows + [(1000 + i, rows[0][1], 7) for i in range(60)]  # copies


def plain(queries, rows, k, same=lambda a, b: a[0] == b[0]):
    out = Counter()
    for q in queries:
        d = sorted((sum((a - b) ** 2 for a, b in zip(q[1], r[1], strict=True)), r[0]) for r in rows if not same(q, r))
        out.update((q[0], n, i, round(x**0.5, 7)) for n, (x, i) in enumerate(d[:k], 1))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)


@pytest.mark.parametrize(("dims", "k", "s"), [(2, 5, Pivots()), (8, 3, Pivots(most=7, groups=3, block_rows=40, block_queries=19, tile=8)), (16, 1, Pivots(most=1)), (3, 80, Pivots())])
def test_neighbours_of_all_rows(spark, dims, k, s):
    rows = data(1, 240, dims)
    df = frame(spark, rows)
    got = neighbors.neighbour_rows(neighbors.nearest(df, df, k, s=s)).collect()
    assert Counter((r.query_id, r["rank"], r.id, round(r.distance, 7)) for r in got) == plain(rows, rows, k)


def test_far_cells_are_not_searched(spark, monkeypatch):
    """In well parted data a query asks few cells."""
    rows = data(2, 400, 2, 0.01)[:400]
    asked = []
    other = neighbors._others
    monkeypatch.setattr(neighbors, "_others", lambda *a: asked.append(other(*a)) or asked[-1])
    df = frame(spark, rows)
    neighbors.nearest(df, df, 2).count()
    assert asked[0].agg(F.sum(F.size("cells"))).first()[0] < 0.25 * 400 * 20


def test_own_groups_and_tags(spark):
    rows = data(3, 90, 4)
    df = frame(spark, rows)
    got = neighbors.nearest(df, df, 4, own=F.col("label"), tag=F.col("label")).collect()
    assert Counter((r.query_id, n, t.id, round(t.distance, 7)) for r in got for n, t in enumerate(r.neighbours, 1)) == plain(rows, rows, 4, lambda a, b: a[2] == b[2])
    label = {r[0]: r[2] for r in rows}
    assert all(t.tag == label[t.id] for r in got for t in r.neighbours)


def test_a_cell_is_not_all_pairs(monkeypatch):
    """In few dimensions a query meets few rows of its cell; the lists are those of all pairs."""
    n, g, pairs, far = 8000, np.random.default_rng(5), [], neighbors._far
    monkeypatch.setattr(neighbors, "_far", lambda a, b: pairs.append(len(a) * len(b)) or far(a, b))
    x, own = g.integers(0, 90, size=(n, 3)).astype(float), np.arange(n) % 50
    block = neighbors._Block(np.arange(n), own, np.full(n, np.inf), x, 4, 64)
    for part in np.split(np.arange(n), [7000]):
        block.add(np.arange(n), part, own[part], own[part].astype(float), x[part])
    assert sum(pairs) < 0.3 * n**2
    for i in range(0, n, 40):
        d = ((x - x[i]) ** 2).sum(1)
        want = sorted((d[j], j) for j in range(n) if own[j] != own[i])[:4]
        assert list(zip(block.d[i], block.id[i], strict=True)) == want


def test_copies_that_no_list_can_hold_are_not_searched(spark, monkeypatch):
    """Of many equal vectors k of an own and 2k in all take part, and lists stay those of all pairs."""
    rows = [(i, [float(i % 3), 1.0], i % 70 % 4 if i % 2 else 9) for i in range(600)]
    searched, other = [], neighbors._search
    monkeypatch.setattr(neighbors, "_search", lambda asked, rows, *a: searched.append(rows.count()) or other(asked, rows, *a))
    df = frame(spark, rows)
    got = neighbors.neighbour_rows(neighbors.nearest(df, df, 4, own=F.col("label"))).collect()
    assert Counter((r.query_id, r["rank"], r.id, round(r.distance, 7)) for r in got) == plain(rows, rows, 4, lambda a, b: a[2] == b[2])
    assert searched and max(searched) <= 3 * 2 * 4


def test_odd_rows(spark):
    rows = data(4, 20, 3)[:20]
    odd = [(100, None, 1), (101, [1.0], 1), (102, [1.0, None, 2.0], 1), (103, [1.0, float("nan"), 0.0], 1), (None, [1.0, 2.0, 3.0], 1)]
    df = frame(spark, [*rows, *odd])
    got = neighbors.neighbour_rows(neighbors.nearest(df, df, 3)).collect()
    assert Counter((r.query_id, r["rank"], r.id, round(r.distance, 7)) for r in got) == plain(rows, rows, 3)
    assert neighbors.nearest(df.filter("vec_id < 0"), df, 3).count() == 0
    alone = neighbors.nearest(df.filter("vec_id = 1"), df.filter("vec_id = 1"), 3).collect()
    assert [r.neighbours for r in alone] == [[]]
    assert [r.neighbours for r in neighbors.nearest(df.filter("vec_id = 1"), df.filter("vec_id < 0"), 3).collect()] == [[]]
