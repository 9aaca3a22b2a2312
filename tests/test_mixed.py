"""The random intercept model against dense restricted likelihoods, and its odd inputs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tidewell.operators.mixed import random_intercept

SCHEMA = "feature string, subject string, effect double, value double"


def dense(rows):
    """The same model with whole covariance matrices and a fine search for the ratio."""
    names = sorted({g for g, _, _ in rows})
    z = np.array([[g == n for n in names] for g, _, _ in rows], float)
    x = np.array([[1.0, e] for _, e, _ in rows])
    y = np.array([v for _, _, v in rows])

    def fit(log_ratio):
        v = np.eye(len(y)) + math.exp(log_ratio) * z @ z.T
        inv = np.linalg.inv(v)
        a = x.T @ inv @ x
        b = np.linalg.solve(a, x.T @ inv @ y)
        r = y - x @ b
        rss = r @ inv @ r
        crit = (len(y) - 2) * math.log(rss) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1]
        return crit, b[1], math.sqrt(rss / (len(y) - 2) * np.linalg.inv(a)[1, 1])

    lo, hi = -16.0, 16.0
    for _ in range(8):
        grid = np.linspace(lo, hi, 41)
        at = grid[np.argmin([fit(g)[0] for g in grid])]
        lo, hi = at - (hi - lo) / 40, at + (hi - lo) / 40
    return (*fit(at)[1:], math.exp(at))


def planted(seed, spread, effect, n_groups=9, shift=0.0):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(n_groups):
        own = rng.normal(0, spread)
        out += [(f"s{g}", float(e), float(shift + own + effect * e + rng.normal())) for e in rng.integers(0, 2, rng.integers(2, 14))]
    return out


def test_against_dense_likelihood(spark):
    sets = {"wide": planted(1, 3.0, 0.7), "narrow": planted(2, 0.4, 0.2), "none": planted(3, 0.0, 1.5), "far": planted(4, 1.0, 0.5, shift=1e6)}
    df = spark.createDataFrame([(f, *r) for f, rows in sets.items() for r in rows], SCHEMA).repartition(5)
    out = {r.feature: r for r in random_intercept(df).collect()}
    assert out.keys() == sets.keys()
    for f, rows in sets.items():
        shifted = [(g, e, v - (1e6 if f == "far" else 0)) for g, e, v in rows]
        estimate, se, ratio = dense(shifted)
        r = out[f]
        assert (r.n, r.groups) == (len(rows), 9)
        assert r.estimate == pytest.approx(estimate, rel=1e-4) and r.se == pytest.approx(se, rel=1e-4)
        assert r.ratio == pytest.approx(ratio, rel=1e-3, abs=1e-6)
        assert r.p == pytest.approx(math.erfc(abs(estimate / se) / math.sqrt(2)), abs=1e-4)


def test_an_effect_of_many_values(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{i % 7}", float(e), 2 * float(e) + i % 7 + float(v)) for i, (e, v) in enumerate(rng.normal(size=(80, 2)))]
    (r,) = random_intercept(spark.createDataFrame([("a", *r) for r in rows], SCHEMA)).collect()
    estimate, se, _ = dense(rows)
    assert (r.estimate, r.se) == (pytest.approx(estimate, rel=1e-4), pytest.approx(se, rel=1e-4))


def test_odd_inputs(spark):
    good = planted(6, 1.0, 0.5)
    rows = [("good", *r) for r in good] + [("good", "s0", None, 3.0), ("good", "s0", 1.0, None), ("good", "s1", 0.0, math.nan), ("good", None, 1.0, 4.0)]
    rows += [("few", f"s{i % 4}", float(i % 2), float(i * i % 7)) for i in range(40)]
    rows += [("flat", f"s{i % 6}", float(i % 2), 5.0) for i in range(40)] + [("one effect", f"s{i % 6}", 1.0, float(i)) for i in range(40)]
    rows += [(None, *r) for r in good] + [("empty", "s0", 1.0, None)]
    out = {r.feature: r for r in random_intercept(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out.keys() == {"good", "few", "flat", "one effect", None}
    assert out["good"].n == len(good) and out["good"].p is not None and out["good"][3:] == pytest.approx(out[None][3:])
    for f in ("few", "flat", "one effect"):
        assert out[f].n == 40 and all(v is None for v in out[f][3:])
    assert random_intercept(spark.createDataFrame([], SCHEMA)).count() == 0
