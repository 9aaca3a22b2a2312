"""Fits over folds, stored models, experts and augmentations against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import decode, metrics, models, normalize, stats
from tidewell.operators.decode import exact_count_labels


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        subject = i % 12
        x = rng.normal(size=2) * [3, 0.1] + [100, subject % 3]
        y = int(x[0] - 100 + 20 * (x[1] - subject % 3) + rng.normal() * 2 > 0)
        rows.append((i, subject, float(x[0]), float(x[1]), y, float(1 + i % 3), subject % 4 != 3))
    return rows, spark.createDataFrame(rows, "segment_id long, subject int, a double, b double, y int, w double, train boolean").repartition(5)


def plain_loso(rows, robust, weighted, learn=lambda r: True, subjects=None):
    out = {}
    for fold in sorted({r[1] for r in rows if r[6]}) + [-1]:
        fit = [r for r in rows if r[6] and r[1] != fold and learn(r) and (subjects is None or r[1] in subjects)]
        held = [r for r in rows if (r[6] and r[1] == fold if fold != -1 else not r[6])]
        x, y = np.array([r[2:4] for r in fit]), np.array([r[4] for r in fit], float)
        w = np.array([r[5] if weighted else 1.0 for r in fit])
        for v in (0, 1):
            w[y == v] *= len(y) / (2 * (y == v).sum())
        centre = np.median(x, 0) if robust else x.mean(0)
        scale = np.subtract(*np.percentile(x, [75, 25], axis=0)) if robust else x.std(0)
        b = models.fit_logistic((x - centre) / scale, y, w)
        for r in held:
            out[r[0]] = fold, 1 / (1 + np.exp(-((np.array(r[2:4]) - centre) / scale @ b[:2] + b[2])))
    return out


@pytest.mark.parametrize(("robust", "weighted", "cells"), [(False, False, 250_000), (True, True, 250_000), (False, True, 20)])
def test_loso_is_a_fit_a_fold(table, monkeypatch, robust, weighted, cells):
    monkeypatch.setattr(models, "FOLD_CELLS", cells)
    rows, df = table
    got = {r.segment_id: (r.fold, r.proba) for r in models.loso(df, ["a", "b"], "y", F.col("train"), robust=robust, weight="w" if weighted else None).collect()}
    want = plain_loso(rows, robust, weighted)
    assert got.keys() == want.keys()
    assert all(got[i][0] == f and got[i][1] == pytest.approx(p, abs=1e-6) for i, (f, p) in want.items())


def test_loso_learns_from_some_and_scores_all(table):
    rows, df = table
    got = {r.segment_id: r.proba for r in models.loso(df, ["a", "b"], "y", F.col("train"), learn=F.col("segment_id") % 2 == 0).collect()}
    want = plain_loso(rows, False, False, lambda r: r[0] % 2 == 0)
    assert got == pytest.approx({i: p for i, (_, p) in want.items()}, abs=1e-6)
    assert models.loso(df.filter("y = 1"), ["a", "b"], "y", F.col("train")).count() == 0


def test_models_are_kept(spark, table, tmp_path):
    rows, df = table
    model = models.fit_model(df.filter("train"), ["a", "b"], "y")
    models.save_model(spark, f"{tmp_path}/m.json", model, norm="subject_z", w0=0.8)
    again, settings = models.load_model(spark, f"{tmp_path}/m.json")
    assert again == model and settings == {"norm": "subject_z", "w0": 0.8}
    want = plain_loso(rows, False, False)
    got = {r.segment_id: r.p for r in df.filter("not train").select("segment_id", again.proba().alias("p")).collect()}
    assert got == pytest.approx({i: p for i, (f, p) in want.items() if f == -1}, abs=1e-6)


def test_experts(table):
    """Strata of six and three training subjects: the first has its own experts, the second falls back to all."""
    rows, df = table
    df = df.withColumn("strength", F.when(F.col("subject") % 4 == 0, 50.0).otherwise(F.when(F.col("subject") == 11, 60.0).otherwise(1.0 + F.col("subject") / 100)))
    got = {r.segment_id: (r.stratum, r.proba) for r in models.experts(df, ["a", "b"], "y", F.col("train"), "strength", 2, least=5).collect()}
    low = {s for s in range(12) if s % 4 not in (0, 3)}
    strata = np.log1p([1 + s / 100 for s in sorted(low)] + [50.0] * 3)
    edge = np.quantile(strata, 0.5)
    first = {s for s in low if np.log1p(1 + s / 100) <= edge}
    assert len(first) == 5  # not more than five, so both strata fall back
    every = plain_loso(rows, False, False)
    assert {i: p for i, (_, p) in got.items()} == pytest.approx({i: p for i, (_, p) in every.items()}, abs=1e-6)
    got = {r.segment_id: (r.stratum, r.proba) for r in models.experts(df, ["a", "b"], "y", F.col("train"), "strength", 2, least=4).collect()}
    own = plain_loso([r for r in rows if r[1] in first], False, False) if False else {}
    for s in first:
        fit = plain_loso([r for r in rows if r[1] in first or not r[6]], False, False)
        own |= {i: p for i, (f, p) in fit.items() if f == s}
    assert {i: got[i] for i in own} == {i: (0, pytest.approx(p, abs=1e-6)) for i, p in own.items()}


def test_grid_search_runs_a_stage_once():
    calls = []
    stages = [(("a",), lambda c, got: calls.append(("one", c["a"])) or c["a"] * 10), (("b",), lambda c, got: calls.append(("two", c["a"], c["b"])) or got[0] + c["b"])]
    configs = [{"a": a, "b": b, "w": w} for a in (1, 2) for b in (3, 4) for w in (0, 1)]
    out = models.grid_search(configs, stages, lambda c, got: got[1] + 100 * c["w"])
    assert [o["score"] for o in out] == [10 * c["a"] + c["b"] + 100 * c["w"] for c in configs]
    assert len(calls) == 2 + 4


def test_weight_sweep(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i // 9, float(rng.random()), float(rng.random()), i % 3) for i in range(27)]
    df = spark.createDataFrame(rows, "segment_id long, subject int, p0 double, p1 double, y int")
    counts = spark.createDataFrame([(s, 3, 3, 3) for s in range(3)], "subject int, n0 int, n1 int, n2 int")
    weights = [(1.0, 1.0, 1.0), (0.4, 1.2, 1.6)]
    got = {(r.w0, r.w1, r.w2): r.accuracy for r in decode.sweep_weights(df, "p0", "p1", "y", weights, counts).collect()}
    for w in weights:
        right = 0
        for s in range(3):
            part = [r for r in rows if r[1] == s]
            scores = np.array([[w[0] * np.log(p0), w[1] * (np.log(1 - p0) + np.log(p1)), w[2] * (np.log(1 - p0) + np.log(1 - p1))] for _, _, p0, p1, _ in part])
            right += (exact_count_labels(scores, (3, 3, 3)) == [r[4] for r in part]).sum()
        assert got[w] == pytest.approx(right / 27)


def test_weight_sweep_gives_a_task_counts_only(spark, monkeypatch):
    """No row for each subject and triple; the same with subjects that no task holds."""
    rng = np.random.default_rng(9)
    rows = [(i, i % 7, float(rng.random()), float(rng.random()), int(rng.integers(3))) for i in range(210)]
    df = spark.createDataFrame(rows, "segment_id long, subject int, p0 double, p1 double, y int").repartition(3)
    counts = spark.createDataFrame([(s, 9, 0, 21) if s == 3 else (s, 8, 10, 12) for s in range(7)], "subject int, n0 int, n1 int, n2 int")
    weights = [(1.0, 1.0, 1.0), (0.4, 1.2, 1.6), (1.4, 0.6, 0.6)]
    large = decode.sweep_weights(df, "p0", "p1", "y", weights, counts, s=decode.Decoding(in_task=20, sample=10, near=0.4)).collect()
    monkeypatch.setattr(decode, "exact_count_decode", None)
    got = decode.sweep_weights(df, "p0", "p1", "y", weights, counts)
    assert np.array(sorted(map(tuple, got.collect()))) == pytest.approx(np.array(sorted(map(tuple, large))))
    monkeypatch.undo()
    for w in weights:
        scores = decode.joint_scores(df, "p0", "p1", w)
        one = metrics.summary(df.join(decode.exact_count_decode(scores, ["s0", "s1", "s2"], counts), ["subject", "segment_id"]), "y", "pred").first()
        assert next(tuple(r)[3:] for r in got.collect() if tuple(r)[:3] == w) == pytest.approx(tuple(one))


def test_augmentation_depends_on_keys_alone(spark):
    df = spark.range(4000).select(F.col("id").alias("segment_id"), (F.col("id") % 2).alias("subject"), F.lit("c").alias("class"), F.col("id").cast("double").alias("x"))
    runs = [{r.segment_id: r.x for r in models.jitter(d, ["x"], 2.0, 3).filter("augmented").collect()} for d in (df, df.repartition(7, "class"))]
    assert runs[0] == runs[1]
    noise = np.array([(x - i) / 2 for i, x in runs[0].items()])
    assert abs(noise.mean()) < 0.06 and abs(noise.std() - 1) < 0.05 and abs((np.abs(noise) < 1).mean() - 0.6827) < 0.03
    ends = df.withColumn("x", F.when(F.col("segment_id") % 4 < 2, 0.0).otherwise(1.0)).withColumn("subject", F.lit(0))
    for alpha in (0.4, 2.0):
        mixed = [{r.segment_id: r.x for r in models.mixup(d, ["x"], alpha, 5).collect()} for d in (ends, ends.repartition(6, "x"))]
        assert mixed[0] == mixed[1]
        lam = np.array([v for v in mixed[0].values() if 0 < v < 1])  # Beta(alpha, alpha) has mean 1/2 and this variance
        assert abs(lam.mean() - 0.5) < 0.03 and abs(lam.var() - 1 / (4 * (2 * alpha + 1))) < 0.012


def test_linear_maps_against_numpy(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 3))
    z = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 3))
    names = ["a", "b", "c"]
    frame = lambda m: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], "segment_id long, a double, b double, c double")
    out = np.array([list(r)[1:] for r in models.coral(frame(x), frame(z), names).orderBy("segment_id").collect()])
    power = lambda m, e: (lambda v, q: q @ np.diag(v**e) @ q.T)(*np.linalg.eigh(np.cov(m.T) + 1e-3 * np.eye(3)))
    assert np.allclose(out, x @ power(x, -0.5) @ power(z, 0.5))
    got = np.array([[r.pc_1, r.pc_2] for r in models.pca(frame(x), names, 2).orderBy("segment_id").collect()])
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs((u * s)[:, :2])) and np.allclose(np.cov(got.T)[0, 1], 0, atol=1e-9)


def test_sample_weight_modes(spark):
    rows = [(i, i % 4, float([1, 4, 9, 16][i % 4])) for i in range(40)]
    df = spark.createDataFrame(rows, "segment_id long, subject int, s double")
    s = np.array([r[2] for r in rows])
    rank = 0.5 + np.array([r[1] / 3 for r in rows])
    for mode, raw in {"uniform": np.ones(40), "linear": s, "sqrt": np.sqrt(s), "inverse": 1 / (s + 1e-6), "rank": rank}.items():
        got = {r.segment_id: r.weight for r in models.sample_weights(df, mode, "s").collect()}
        assert np.allclose([got[i] for i in range(40)], raw / raw.mean()), mode


def test_every_normaliser_by_name(spark):
    df = spark.createDataFrame([(i, i % 3, float(i * i % 17)) for i in range(60)], "segment_id long, subject int, x double")
    for name, f in normalize.NORMALISERS.items():
        a = {r.segment_id: r.x for r in normalize.normalise(df, ["x"], name).collect()}
        assert a == pytest.approx({r.segment_id: r.x for r in f(df, ["x"]).collect()}) and len(a) == 60
    assert normalize.normalise(df, ["x"], "global") is df


def test_exact_p_values_are_used(spark):
    """Few rows without ties: the exact law, as counted by hand; with a tie, the approximation."""
    long = spark.createDataFrame([("f", "a", 1.0), ("f", "a", 2.0), ("f", "b", 3.0), ("f", "b", 4.0), ("f", "b", 5.0), ("g", "a", 1.0), ("g", "b", 1.0), ("g", "b", 2.0)], "feature string, class string, value double")
    p = {r.feature: r.p for r in stats.mann_whitney(long, "a", "b").collect()}
    assert p["f"] == pytest.approx(2 / 10) and p["g"] != pytest.approx(2 / 3)
    pairs = spark.createDataFrame([("f", float(k), 0.0) for k in (1, 2, 3, 4, -5)] + [("g", 1.0, 1.0), ("g", 2.0, 1.0)], "feature string, a double, b double")
    p = {r.feature: r.p for r in stats.wilcoxon(pairs).collect()}
    assert p["f"] == pytest.approx(2 * 10 / 32) and p["g"] == pytest.approx(0.3173, abs=1e-3)


def test_every_family_learns(spark):
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 2))
    rows = [(float(a), float(b), float(a + 0.3 * b > 0), i % 5 == 0) for i, (a, b) in enumerate(x)]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(rows, "a double, b double, label double, held boolean"))
    specs = {"logreg": {}, "elastic_net": {}, "naive_bayes": {}, "rf": {"numTrees": 10}, "gbt": {"maxIter": 8}, "svm_linear": {}}
    for name, params in specs.items():
        made = models.classifier(models.ModelSpec(name, params), validation="held")
        out = made.fit(df if name == "gbt" else df.filter("not held")).transform(df.filter("held"))
        assert out.filter("prediction = label").count() / 80 > 0.85, name
        assert name != "gbt" or made.getValidationIndicatorCol() == "held"
    three = df.withColumn("label", F.when(F.col("a") > 0.5, 2.0).when(F.col("a") > -0.5, 1.0).otherwise(0.0))
    out = models.classifier(models.ModelSpec("svm_linear"), multiclass=True).fit(three).transform(three)
    assert out.select("prediction").distinct().count() >= 2


def test_learning_curve_and_importances(table):
    rows, df = table
    got = models.learning_curve(df, ["a", "b"], "y", F.col("train"), [3, 9]).collect()
    assert [r.n_subjects for r in got] == [3, 9] and all(0.5 < r.auc <= 1 and r.n_pos + r.n_neg == 60 for r in got)
    model = models.fit_model(df.filter("train"), ["a", "b"], "y")
    held = [r for r in rows if not r[6]]
    p = np.array([model.weights[0] * r[2] + model.weights[1] * r[3] for r in held])
    y = np.array([r[4] for r in held])
    diff = p[y == 1][:, None] - p[y == 0]
    assert got[1].auc == pytest.approx(((diff > 0) + 0.5 * (diff == 0)).mean())
    found = {r.feature: r.importance for r in models.importances(model, df).collect()}
    assert found["a"] == pytest.approx(abs(model.weights[0]) * np.std([r[2] for r in rows]))


def test_top_k_sweep_and_seeded_subset(spark):
    from tidewell.operators import relational, select

    assert select.top_k_sweep(["a", "b", "c"], [1, 2, 5], lambda names: len(names) / 10) == [(1, 0.1), (2, 0.2)]
    df = spark.createDataFrame([(i, i % 20) for i in range(200)], "segment_id int, subject int")
    few, more = ({r.subject for r in relational.seeded_subset(d, "subject", n, 42).collect()} for d, n in ((df, 5), (df.repartition(7, "segment_id"), 8)))
    assert len(few) == 5 and few < more and len(more) == 8
    assert relational.seeded_subset(df, "subject", 5, 42).count() == 50
    assert {r.subject for r in relational.seeded_subset(df, "subject", 5, 43).collect()} != few
