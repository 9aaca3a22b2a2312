"""Distance correlation against its definition."""

from __future__ import annotations

import numpy as np
import pytest

from tidewell.operators import dependence


def by_matrices(x, y):
    a, b = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    a, b = (m - m.mean(0) - m.mean(1)[:, None] + m.mean() for m in (a, b))
    return np.sqrt(max((a * b).mean(), 0) / np.sqrt((a * a).mean() * (b * b).mean()))


@pytest.mark.parametrize("n", [2, 3, 17, 64, 301])
def test_pair_products(n):
    rng = np.random.default_rng(n)
    for x, y in ((rng.normal(size=n), rng.normal(size=n)), (rng.integers(0, 4, n) * 1.0, rng.integers(0, 5, n) * 1.0)):
        w = rng.integers(1, 4, n) * 1.0
        want = (w[:, None] * w * np.abs(x[:, None] - x) * np.abs(y[:, None] - y)).sum() / 2
        assert dependence.pair_products(x, y, w) == pytest.approx(want)


@pytest.mark.parametrize("kind", ["plain", "ties", "hot", "none"])
def test_of_columns(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.normal(size=700) + 50
    y = (x - 50) ** 2 + 0.3 * rng.normal(size=700)
    if kind == "ties":
        x, y = np.round(x, 0), np.round(y, 0)
    if kind == "hot":
        x[:300], y[200:450] = 50.0, 1.0
    if kind == "none":
        y = rng.normal(size=700)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (float("nan"), 2.0)], "x double, y double").repartition(5)
    assert dependence.distance_correlation(df, "x", "y", 8) == pytest.approx(by_matrices(x, y), abs=1e-9)


def test_undefined(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert dependence.distance_correlation(df, "x", "y") is None
    assert dependence.distance_correlation(df.limit(1), "x", "y") is None
