"""Forms that spread one group over tasks, against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import aggregate, inventory, metrics, stats

SHARES = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]


def frame(spark, groups):
    return spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("z", None)], "g string, x double").repartition(5)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    groups = {"one": [4.0], "two": [1.0, 3.0], "few": rng.normal(size=64), "ties": rng.integers(0, 5, 3000), "many": rng.normal(size=60_000), "long": rng.pareto(1.0, 5001)}
    got = {r.g: r.q for r in aggregate.exact_quantiles(frame(spark, groups), ["g"], "x", SHARES).collect()}
    assert got.keys() == groups.keys()
    for k, x in groups.items():
        assert np.allclose(got[k], np.quantile(x, SHARES), rtol=1e-12), k
    whole = aggregate.exact_quantiles(frame(spark, groups), [], "x", SHARES).first().q
    assert np.allclose(whole, np.quantile(np.concatenate(list(groups.values())), SHARES))
    assert aggregate.exact_quantiles(frame(spark, {}), ["g"], "x", SHARES).count() == 0


def test_running_totals(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=4000), 2)
    df = spark.createDataFrame([(float(v), int(v > 0.3), int(v <= 0.3)) for v in x], "x double, p int, q int")
    for r in aggregate.running_totals(df.groupBy("x").agg(F.sum("p").alias("p"), F.sum("q").alias("q")), "x", ["p", "q"]).collect():
        assert (r.run_p, r.all_p) == (((x >= r.x) & (x > 0.3)).sum(), (x > 0.3).sum()) and r.run_q == ((x >= r.x) & (x <= 0.3)).sum()
    assert metrics.roc_points(df.filter("x > 9"), "p", "x").count() == 0


def test_ranks_from_counts(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 30, 500)
    df = spark.createDataFrame([("f", "ab"[i % 2], float(v)) for i, v in enumerate(x)] + [("f", "a", None)], "feature string, class string, value double")
    order = np.sort(x)
    mean_rank = {v: (np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2 for v in x}
    rows = stats.ranked_counts(df, ["feature"], "value", ["class"]).collect()
    assert sum(r.n for r in rows) == 500 and all(r.r == mean_rank[r.value] and r.t == (x == r.value).sum() for r in rows)
    a, b = x[::2], x[1::2]
    want = ((a[:, None] > b).sum() - (a[:, None] < b).sum()) / (len(a) * len(b))
    assert stats.cliffs_delta(df, "a", "b").first().delta == pytest.approx(want)


def test_infinite_samples_are_counted(spark):
    rows = [(1, "a", [1.0, float("inf"), 2.0]), (2, "a", [float("nan"), 1.0, None]), (3, "b", [1.0, 2.0, float("-inf")]), (4, "b", [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "segment_id int, class string, samples array<double>")
    got = {r["class"]: r for r in inventory.gaps(df, ["class"], "samples", 2).collect()}
    assert [got["a"][c] for c in ("with_nan", "with_inf", "with_nan_head", "with_inf_head", "nan_samples", "inf_samples", "n_total")] == [1, 1, 1, 1, 2, 1, 2]
    assert [got["b"][c] for c in ("with_nan", "with_inf", "with_inf_head", "inf_samples")] == [0, 1, 0, 1]
    spread = {r["class"]: r for r in inventory.ranges(df, ["class"], "samples").collect()}
    assert (spread["a"].min, spread["a"].max, spread["a"].n_finite) == (1, 2, 3)


def test_subjects_in_both_splits(spark):
    df = spark.createDataFrame([(1, "train"), (1, "validation"), (2, "train"), (3, "validation"), (3, "validation")], "subject int, split string")
    assert {r.subject: r.n_splits for r in inventory.split_membership(df).collect()} == {1: 2, 2: 1, 3: 1}


def test_ranks_of_many_means(spark):
    """Beyond 10,000 values a group's quantiles are approximate, and need not come out the same where a plan computes them twice."""
    rows = spark.range(0, 60_000, 1, 4).select(F.expr("id div 3").alias("subject"), F.expr("array('A', 'B', 'C')[id % 3]").alias("class"), F.xxhash64("id").alias("h"))
    means = rows.groupBy("subject", "class").agg(F.avg(F.col("h") % 100_003).alias("a"), F.avg(F.col("h") % 7919).alias("b")).unpivot(["subject", "class"], ["a", "b"], "feature", "value")
    got = {r.feature: r for r in stats.battery(means, ("A", "B", "C")).collect()}
    for feature, g in means.toPandas().groupby("feature"):
        of = {k: np.sort(v.to_numpy()) for k, v in g.groupby("class")["value"]}
        for x, y in ("AB", "AC", "BC"):
            u = (np.searchsorted(of[y], of[x], "left") + np.searchsorted(of[y], of[x], "right")).sum() / 2
            assert got[feature][f"u_{x}_{y}"] == u
        assert got[feature].kruskal_h >= 0
