"""Tree sums, blocked products, shared-pass selection and resumable sweeps."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators import aggregate, blocks, metrics, models, select, sweep


@pytest.mark.parametrize(("parts", "fan_in"), [(1, 8), (7, 8), (23, 2), (40, 8)])
def test_tree_sum(spark, parts, fan_in):
    df = spark.range(0, 1000, 1, parts)
    got = blocks.tree_sum(df, lambda batches: sum((np.array([len(b), b["id"].sum()], float) for b in batches), np.zeros(2)), fan_in)
    assert got.tolist() == [1000, 499500]


def test_five_hundred_columns_in_one_pass(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 500)) @ rng.normal(size=(500, 500)) * 0.1 + 1e4 * rng.normal(size=500)
    x[rng.random(x.shape) < 0.02] = np.nan
    x[:, 7] = 3.0
    cols = [f"c{i}" for i in range(500)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols)).repartition(9)
    frame = pd.DataFrame(x)
    assert np.allclose(blocks.covariances(df, cols), frame.cov().to_numpy(), atol=1e-6, equal_nan=True)
    r = blocks.correlation_matrix(df, cols)
    want = frame.corr().to_numpy()
    assert np.isnan(r[7]).all() and np.allclose(np.delete(np.delete(r, 7, 0), 7, 1), np.delete(np.delete(want, 7, 0), 7, 1), atol=1e-9)
    rows = aggregate.correlations(df, cols[:4]).collect()
    assert [(q.a, q.b) for q in rows] == [("c0", "c1"), ("c0", "c2"), ("c0", "c3"), ("c1", "c2"), ("c1", "c3"), ("c2", "c3")]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(300):
        x = rng.normal(size=5)
        y = int(x[1] + 0.6 * x[3] + rng.normal() > 0)
        rows.append((i, i % 8, *map(float, x), y, i % 8 != 7))
    return spark.createDataFrame(rows, "segment_id long, subject int, a double, b double, c double, d double, e double, y int, train boolean").repartition(4).persist()


NAMES = list("abcde")


def test_sets_are_fitted_as_alone(table, monkeypatch):
    sets = [["a"], ["b", "d"], ["e", "a", "c"], NAMES]
    for cells in (models.MANY_CELLS, 200):
        monkeypatch.setattr(models, "MANY_CELLS", cells)
        got = {(r["set"], r.segment_id): (r.fold, r.proba) for r in models.loso_many(table, sets, "y", F.col("train")).collect()}
        for i, s in enumerate(sets):
            for r in models.loso(table, s, "y", F.col("train")).collect():
                assert got[i, r.segment_id] == (r.fold, pytest.approx(r.proba, abs=1e-6))


def by_callback(table, names):
    p = models.loso(table, names, "y", F.col("train")).filter("fold <> -1").join(table.select("segment_id", "y"), "segment_id")
    return metrics.roc_auc(p, "y", "proba").first().auc


def test_shared_selection_chooses_alike(table, monkeypatch):
    want = select.greedy_forward(NAMES, lambda names: by_callback(table, names), most=3)
    passes = []
    one = models._many_sums
    monkeypatch.setattr(models, "_many_sums", lambda *a: passes.append(len(a[2])) or one(*a))
    got = select.greedy_shared(table, NAMES, "y", F.col("train"), most=3)
    assert got[0] == want[0] and got[1] == pytest.approx(want[1])
    assert set(passes) == {5, 4, 3} and passes.count(5) < 15  # every pass has all candidates of its step
    sweep_ = select.top_k_shared(table, ["b", "d", "a"], [1, 2, 3, 9], "y", F.col("train"))
    assert [k for k, *_ in sweep_] == [1, 2, 3]
    assert [a for _, a, _ in sweep_] == pytest.approx([by_callback(table, ["b", "d", "a"][:k]) for k in (1, 2, 3)])
    assert all(0.5 < v <= 1 for _, _, v in sweep_)


def test_killed_sweeps_go_on(spark, tmp_path):
    calls = []

    def first(config, before):
        calls.append(("first", config["a"]))
        return spark.range(3).select((F.col("id") * config["a"]).alias("x"))

    def second(config, before):
        calls.append(("second", config["a"], config["b"]))
        if dies and (config["a"], config["b"]) == (2, 10):
            raise KeyboardInterrupt
        return before[0].agg((F.sum("x") + config["b"]).alias("total"))

    stages = [sweep.Stage("first", ("a",), first), sweep.Stage("second", ("b",), second)]
    configs = sweep.grid(a=[1, 2], b=[10, 20])
    dies = True
    with pytest.raises(KeyboardInterrupt):
        sweep.Sweep(spark, f"{tmp_path}/s", stages).run(configs)
    assert calls == [("first", 1), ("second", 1, 10), ("second", 1, 20), ("first", 2), ("second", 2, 10)]
    dies, calls[:] = False, []
    again = sweep.Sweep(spark, f"{tmp_path}/s", stages)
    assert again.pending(configs) == [{"a": 2, "b": 10}, {"a": 2, "b": 20}] and again.results(configs).count() == 2
    out = again.run(configs)
    assert calls == [("second", 2, 10), ("second", 2, 20)]  # the first stage of a = 2 had been committed
    assert {(r.a, r.b): r.total for r in out.collect()} == {(a, b): 3 * a + b for a in (1, 2) for b in (10, 20)}
    calls.clear()
    sweep.Sweep(spark, f"{tmp_path}/s", stages).run(configs)
    assert not calls
    newer = [stages[0], sweep.Stage("second", ("b",), second, "2")]
    sweep.Sweep(spark, f"{tmp_path}/s", newer).run(configs[:1])
    assert calls == [("second", 1, 10)]
    with pytest.raises(ValueError, match="no configuration"):
        sweep.Sweep(spark, f"{tmp_path}/t", stages).results(configs)
