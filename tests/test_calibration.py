"""Calibrators of exact probabilities against brute force, with all probabilities in one hundredth of the range."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import models


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    p = np.round(rng.random(400) * 0.01, 5)
    y = (rng.random(400) < p * 80).astype(int)
    return p, y, spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, y int").repartition(5)


def applied(df, c):
    return np.array([tuple(r) for r in df.select("p", c.apply(F.col("p")).alias("q")).orderBy("p").collect()])


def test_isotonic(data):
    p, y, df = data
    xs = np.unique(p)
    m = [np.array([y[p == x].mean() for x in xs]), np.array([(p == x).sum() for x in xs])]
    s, n = np.append(0, np.cumsum(m[0] * m[1])), np.append(0, np.cumsum(m[1]))
    with np.errstate(divide="ignore", invalid="ignore"):
        table = (s[None, 1:] - s[:-1, None]) / (n[None, 1:] - n[:-1, None])
    want = {x: max(table[i, k:].min() for i in range(k + 1)) for k, x in enumerate(xs)}  # the max-min formula
    got = applied(df, models.fit_calibrator(df, "p", "y", "isotonic"))
    assert np.allclose(got[:, 1], np.clip([want[x] for x in got[:, 0]], 1e-6, 1 - 1e-6))
    assert len(np.unique(got[:, 1])) > 5


def test_platt(data):
    p, y, df = data
    c = models.fit_calibrator(df, "p", "y", "platt")
    want = models.fit_logistic(np.clip(p, 1e-6, 1 - 1e-6)[:, None], y, np.ones(len(p)))
    assert np.allclose([c.a, c.b], want, atol=1e-6)
