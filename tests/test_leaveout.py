"""Folds fitted from the expanded loss against folds fitted on all rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import kernel, models


@pytest.fixture(scope="module")
def many(spark):
    """300 subjects of ten rows, one of 400, one of one class only; weights and rows not learned from."""
    rng = np.random.default_rng(7)
    data = []
    for s in range(302):  # 299 is the large one
        for _ in range(400 if s == 299 else 10):
            a, b = rng.normal(), rng.exponential()
            data.append((len(data), s, float(a), float(100 * b), int(s == 301 or rng.random() < 1 / (1 + np.exp(-a + b))), float(rng.random() + 0.5), bool(rng.random() < 0.9)))
    return spark.createDataFrame(data, "segment_id long, subject long, a double, b double, y int, v double, known boolean").repartition(3).persist()


@pytest.mark.parametrize("options", [{}, {"balanced": False, "weight": "v"}, {"learn": True, "c": 0.1}])
def test_expansion_equals_fits_on_rows(many, monkeypatch, options):
    if options.get("learn"):
        options = options | {"learn": F.col("known")}
    monkeypatch.setattr(models, "MANY_FOLDS", 100)
    fitted = []
    plain = models._fit_folds
    monkeypatch.setattr(models, "_fit_folds", lambda rows, q, at, *a, **k: (fitted.append(len(at)), plain(rows, q, at, *a, **k))[1])
    run = lambda: {r.segment_id: (r.fold, r.proba) for r in models.loso(many, ["a", "b"], "y", F.col("subject") % 5 != 0, **options).collect()}
    got = run()
    assert sum(fitted) < 70  # the fits on rows do not grow with the folds
    monkeypatch.setattr(models, "MANY_FOLDS", 10**9)
    want = run()
    assert got.keys() == want.keys()
    worst = max((abs(got[k][1] - p), f) for k, (f, p) in want.items())
    assert all(got[k][0] == f for k, (f, _) in want.items()) and worst[0] < 1e-9, worst


def test_svm_of_many_folds_equals_fits_on_rows(many, monkeypatch):
    """With a band that holds some rows only; the folds beyond its reach go back to the rows."""
    df = many.filter("subject >= 270").withColumn("y", (F.col("a") + F.col("b") / 100 + F.rand(3) > 1).cast("int")).localCheckpoint()
    monkeypatch.setattr(models, "MANY_FOLDS", 20)
    monkeypatch.setattr(kernel, "BAND", 200)
    monkeypatch.setattr(kernel, "fit_svm", None)
    run = lambda: {r.segment_id: (r.fold, r.decision, r.proba) for r in kernel.loso_svm(df, ["a", "b"], "y", F.col("subject") % 5 != 0, kernel.Svm(landmarks=0)).collect()}
    got = run()
    monkeypatch.undo()
    want = run()
    assert got.keys() == want.keys()
    worst = max((abs(got[k][1] - v[1]) + abs(got[k][2] - v[2]), v[0]) for k, v in want.items())
    assert worst[0] < 1e-6, worst


def test_pools_need_no_folds(spark, sf, monkeypatch):
    import __spark_entry__

    monkeypatch.setattr(models, "loso", None)
    assert {r.pool for r in __spark_entry__.queries()["feature_set_auc"](spark, sf).collect()} >= {"all", "bvp", "eda", "resp"}
