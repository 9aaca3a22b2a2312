"""Support vector machines against dense kernel fits, one against the rest, and stacking without leaks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import families, kernel, models
from tidewell.operators.kernel import Svm
from tidewell.operators.models import ModelSpec

COLS = ["a", "b"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(200):
        a, b = (float(v) for v in rng.normal(size=2) * [2, 0.5] + [5, 1])
        y = int(((a - 5) / 2) ** 2 + ((b - 1) / 0.5) ** 2 + 0.4 * rng.normal() > 1.3)
        kind = int(np.digitize(a + rng.normal(), [4, 6]))
        rows.append((i, i % 8, a, b, y, kind, float(1 + i % 2), i % 8 != 7))
    return rows, spark.createDataFrame(rows, "segment_id long, subject int, a double, b double, y int, kind int, w double, train boolean").repartition(4)


def dense_svm(x, y, w, others, c, gamma):
    """Decision values at others of the fit over all kernel functions, by Newton steps on their weights."""
    k = (kernel.kernel(x, x, gamma) if gamma else x @ x.T) + 1
    sign, alpha = 2.0 * y - 1, np.zeros(len(x))
    value = lambda v: 0.5 * v @ k @ v + c * (w * np.maximum(0, 1 - sign * (k @ v)) ** 2).sum()
    for _ in range(100):
        on = 1 - sign * (k @ alpha) > 0
        # on the active rows alpha = 2 c w (sign - f), elsewhere 0
        new = np.zeros(len(x))
        d = 1 / (2 * c * w[on])
        new[on] = np.linalg.solve(k[np.ix_(on, on)] + np.diag(d), sign[on])
        step = new - alpha
        t = 1.0
        while value(alpha + t * step) > value(alpha) + 1e-12 and t > 1e-6:
            t /= 2
        alpha = alpha + t * step
        if np.abs(t * step).max() < 1e-11:
            break
    return ((kernel.kernel(others, x, gamma) if gamma else others @ x.T) + 1) @ alpha


def dense_folds(rows, s, gamma):
    x, y, w = np.array([r[2:4] for r in rows]), np.array([r[4] for r in rows]), np.array([r[6] for r in rows])
    fold = np.array([r[1] if r[7] else -1 for r in rows])
    centre, scale = x[fold >= 0].mean(0), x[fold >= 0].std(0)
    z, out = (x - centre) / scale, {}
    for f in np.unique(fold):
        fit = (fold >= 0) & (fold != f)
        v = w[fit].copy()
        for cls in (0, 1) if s.balanced else ():
            v[y[fit] == cls] *= w[fit].sum() / (2 * w[fit][y[fit] == cls].sum())
        out |= dict(zip(np.flatnonzero(fold == f).tolist(), dense_svm(z[fit], y[fit], v, z[fold == f], s.c, gamma), strict=True))
    return out


@pytest.mark.parametrize(("s", "gamma"), [(Svm(landmarks=500), 0.5), (Svm(landmarks=500, gamma=2.0, c=0.3, balanced=False), 2.0), (Svm(landmarks=0), 0.0)])
def test_exact_fits(table, monkeypatch, s, gamma):
    """Every row a landmark, or no kernel: the dense solution."""
    rows, df = table
    monkeypatch.setattr(models, "FOLD_CELLS", 100_000)
    got = {r.segment_id: r for r in kernel.loso_svm(df, COLS, "y", F.col("train"), s, weight="w").collect()}
    assert {i: r.decision for i, r in got.items()} == pytest.approx(dense_folds(rows, s, gamma), abs=2e-4 if gamma else 1e-6)
    left = [r for r in got.values() if r.fold != -1]
    y = {r[0]: r[4] for r in rows}
    b = models.fit_logistic(np.array([[r.decision] for r in left]), np.array([y[r.segment_id] for r in left], float), np.ones(len(left)))
    assert {i: r.proba for i, r in got.items()} == pytest.approx({i: 1 / (1 + np.exp(-(b[0] * r.decision + b[1]))) for i, r in got.items()}, abs=1e-6)


@pytest.mark.parametrize("m", [8, 20, 60])
def test_landmarks_keep_their_bound(table, m):
    rows, df = table
    s = Svm(landmarks=m, gamma=0.5, c=0.5)
    x = df.select(F.col("a").alias("x_0"), F.col("b").alias("x_1"), "y", "w", F.when(F.col("train"), F.col("subject")).otherwise(-1).cast("long").alias("f"), F.xxhash64("segment_id").alias("id"))
    fits = kernel.fit_svm(x, 2, s)
    got = {r.segment_id: (r.fold, r.decision) for r in kernel.loso_svm(df, COLS, "y", F.col("train"), s, weight="w").collect()}
    off = {}
    for i, f in dense_folds(rows, s, 0.5).items():
        off[got[i][0]] = max(off.get(got[i][0], 0), abs(got[i][1] - f))
    assert all(d <= fits.gap(f) + 1e-6 for f, d in off.items())
    if m == 60:
        assert max(off.values()) < 0.1


def test_svm_needs_both_classes(table):
    assert kernel.loso_svm(table[1].filter("y = 1"), COLS, "y", F.col("train")).count() == 0


def test_families_and_one_against_the_rest(table):
    rows, df = table
    for name, params in (("logreg", {}), ("xgb", {"rounds": 4, "depth": 2, "bins": 8}), ("svm_linear", {}), ("svm_rbf", {"landmarks": 30})):
        spec = ModelSpec(name, params)
        one = families.left_out(df, spec, COLS, "y", F.col("train"))
        assert one.columns == ["segment_id", "subject", "fold", "proba"] and one.count() == len(rows)
    three = families.one_vs_rest(df, ModelSpec("logreg"), COLS, "kind", 3, F.col("train")).collect()
    each = [{r.segment_id: r.proba for r in models.loso(df.withColumn("k", (F.col("kind") == c).cast("int")), COLS, "k", F.col("train")).collect()} for c in range(3)]
    for r in three:
        total = sum(e[r.segment_id] for e in each)
        assert [r.proba_0, r.proba_1, r.proba_2] == pytest.approx([e[r.segment_id] / total for e in each])
    soft = families.one_vs_rest(df, ModelSpec("xgb", {"rounds": 3, "depth": 2, "bins": 8}), COLS, "kind", 3, F.col("train")).collect()
    assert len(soft) == len(rows) and all(r.proba_0 + r.proba_1 + r.proba_2 == pytest.approx(1) for r in soft)


STACK = [ModelSpec("logreg"), ModelSpec("logreg", {"c": 0.01})]


def groups_of(spark, rows, groups):
    g = spark.createDataFrame([(s,) for s in range(8)], "subject int").select("subject", F.pmod(F.xxhash64(F.lit(42), "subject"), F.lit(groups)).alias("g"))
    return {r.subject: r.g for r in g.collect()}


def test_stack_equals_plain_nested_folds(spark, table):
    rows, df = table
    of = groups_of(spark, rows, 3)
    x, y = np.array([r[2:4] for r in rows]), np.array([r[4] for r in rows], float)
    group = np.array([of[r[1]] if r[7] else -1 for r in rows])

    def fit(part, x, c):
        w = np.ones(part.sum())
        for v in (0, 1):
            w[y[part] == v] *= part.sum() / (2 * (y[part] == v).sum())
        centre, scale = x[part].mean(0), x[part].std(0)
        b = models.fit_logistic((x[part] - centre) / scale, y[part], w, c)
        return lambda z: (z - centre) / scale @ b[:-1] + b[-1]

    want = {}
    for g in np.unique(group):
        learns = (group >= 0) & (group != g)
        z = np.zeros((len(rows), 2))
        for j, spec in enumerate(STACK):
            for v in np.unique(group):
                without = learns & (group != v)
                z[group == v, j] = fit(without, x, spec.params.get("c", 1.0))(x[group == v])
        second = fit(learns, np.clip(z, -np.log(1e6 - 1), np.log(1e6 - 1)), 1.0)
        want |= {rows[i][0]: 1 / (1 + np.exp(-second(z[i : i + 1])[0])) for i in np.flatnonzero(group == g)}
    got = {r.segment_id: r.proba for r in families.stack(df, STACK, COLS, "y", F.col("train"), groups=3).collect()}
    assert got == pytest.approx(want, abs=1e-5)


def test_stack_does_not_leak(spark, table):
    """Other labels in a group change no score of that group, whatever the models."""
    rows, df = table
    of = groups_of(spark, rows, 3)
    some = [s for s in range(7) if of[s] == of[0]]
    specs = [ModelSpec("logreg"), ModelSpec("xgb", {"rounds": 3, "depth": 2, "bins": 8})]
    turned = df.withColumn("y", F.when(F.col("subject").isin(some), 1 - F.col("y")).otherwise(F.col("y")))
    a, b = ({r.segment_id: (r.stack_group, r.proba) for r in families.stack(d, specs, COLS, "y", F.col("train"), groups=3).collect()} for d in (df, turned))
    own = [i for i in a if a[i][0] == of[0]]
    assert own and all(a[i][1] == pytest.approx(b[i][1], abs=1e-9) for i in own)
    assert any(abs(a[i][1] - b[i][1]) > 1e-3 for i in a if a[i][0] not in (of[0],))


def test_knn(table):
    rows, df = table
    x, y = np.array([r[2:4] for r in rows]), np.array([r[4] for r in rows])
    fold = np.array([r[1] if r[7] else -1 for r in rows])
    z = (x - x[fold >= 0].mean(0)) / x[fold >= 0].std(0)
    got = {r.segment_id: (r.fold, r.proba) for r in families.left_out(df, ModelSpec("knn", {"k": 7}), COLS, "y", F.col("train")).collect()}
    for i in range(len(rows)):
        d = np.where((fold >= 0) & (fold != fold[i]), ((z - z[i]) ** 2).sum(1), np.inf)
        assert got[i] == (fold[i], pytest.approx(y[np.argsort(d)[:7]].mean()))
