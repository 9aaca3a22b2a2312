"""Exact-count decoding by class prices against the dynamic programme, and of groups that no task holds."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import decode
from tidewell.operators.decode import Decoding


def total(x, labels):
    return x[np.arange(len(x)), labels].sum()


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_flow_has_the_programmes_total(k):
    rng = np.random.default_rng(k)
    for n in (1, 2, 7, 25):
        for _ in range(12):
            x = rng.normal(size=(n, k)) + rng.normal(size=k) * 3
            if n % 2:
                x = np.round(x, 1)  # ties
            counts = np.bincount(rng.integers(0, k, n), minlength=k)
            labels, price = decode.count_flow(x, counts)
            assert (np.bincount(labels, minlength=k) == counts).all()
            assert total(x, labels) == pytest.approx(total(x, decode.exact_count_labels(x, counts.tolist())))
            assert ((x - price).max(1) <= x[np.arange(n), labels] - price[labels] + 1e-9).all()
    with pytest.raises(ValueError, match="counts sum to"):
        decode.count_flow(np.zeros((3, 2)), [1, 1])


def test_flow_of_equal_rows():
    labels, _ = decode.count_flow(np.zeros((9, 3)), [2, 3, 4])
    assert np.bincount(labels).tolist() == [2, 3, 4]
    labels, _ = decode.count_flow(np.tile([5.0, 1.0, 0.0], (9, 1)), [0, 4, 5])
    assert np.bincount(labels, minlength=3).tolist() == [0, 4, 5]


def frame(spark, groups, seed=1, digits=None):
    rng = np.random.default_rng(seed)
    rows, counts = [], []
    for g, n in groups:
        x = rng.normal(size=(n, 3)) + rng.normal(size=3)
        x = x if digits is None else np.round(x, digits)
        rows += [(g, 10_000 * g + i, *map(float, v)) for i, v in enumerate(x)]
        counts.append((g, *np.bincount(rng.choice(3, n, p=[0.5, 0.2, 0.3]), minlength=3).tolist()))
    df = spark.createDataFrame(rows, "subject int, segment_id long, s0 double, s1 double, s2 double").repartition(4)
    return rows, df, counts, spark.createDataFrame(counts, "subject int, n0 int, n1 int, n2 int")


@pytest.mark.parametrize("digits", [None, 1])
def test_large_groups_have_the_programmes_total(spark, digits):
    """The same rows with tasks of 60 rows, and prices from 40."""
    rows, df, counts, table = frame(spark, [(1, 400), (2, 150), (3, 30)], digits=digits)
    got = {(r.subject, r.segment_id): r.pred for r in decode.exact_count_decode(df, ["s0", "s1", "s2"], table, s=Decoding(in_task=60, sample=40, near=0.3)).collect()}
    assert len(got) == len(rows)
    for g, *n in counts:
        part = [r for r in rows if r[0] == g]
        x, labels = np.array([r[2:] for r in part]), np.array([got[g, r[1]] for r in part])
        assert np.bincount(labels, minlength=3).tolist() == n
        assert total(x, labels) == pytest.approx(total(x, decode.exact_count_labels(x, n)))


def test_a_million_rows_in_one_group(spark):
    """Optimal by the prices of the labels themselves: no row would gain more elsewhere than a row of that class loses by leaving."""
    u = lambda i: (F.xxhash64(F.lit(i), "id") / F.lit(2.0**63)).alias(f"s{i}")
    df = spark.range(1_000_000).select(F.lit(1).alias("subject"), F.col("id").alias("segment_id"), u(0), u(1), u(2))
    counts = spark.createDataFrame([(1, 600_000, 100_000, 300_000)], "subject int, n0 int, n1 int, n2 int")
    out = df.join(decode.exact_count_decode(df, ["s0", "s1", "s2"], counts), ["subject", "segment_id"]).persist()
    assert {r.pred: r["count"] for r in out.groupBy("pred").count().collect()} == {0: 600_000, 1: 100_000, 2: 300_000}
    best = out.groupBy("pred").agg(*[F.max(F.col(f"s{b}") - F.get(F.array("s0", "s1", "s2"), F.col("pred"))).alias(f"g{b}") for b in range(3)]).collect()
    g = {(r.pred, b): r[f"g{b}"] for r in best for b in range(3)}
    out.unpersist()
    for a, b in ((0, 1), (0, 2), (1, 2)):
        assert g[a, b] + g[b, a] <= 1e-9
    for c in ((0, 1, 2), (0, 2, 1)):
        assert g[c[0], c[1]] + g[c[1], c[2]] + g[c[2], c[0]] <= 1e-9


def test_wrong_counts_are_an_error(spark):
    _, df, _, _ = frame(spark, [(1, 5)])
    with pytest.raises(Exception, match="counts sum to 4, rows are 5"):
        decode.exact_count_decode(df, ["s0", "s1", "s2"], spark.createDataFrame([(1, 1, 1, 2)], "subject int, n0 int, n1 int, n2 int")).collect()
