"""Histogram boosting against a plain booster of one fold at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.operators import boost
from tidewell.operators.boost import Boosting


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(360):
        a, b, c = (float(v) for v in rng.normal(size=3))
        y = int(a * b + 0.3 * c + 0.5 * rng.normal() > 0)
        kind = int(np.digitize(a + 0.5 * b + 0.3 * rng.normal(), [-0.4, 0.5]))
        rows.append((i, i % 6, None if i % 17 == 0 else a, float("nan") if i % 23 == 0 else b, round(c, 1), y, kind, float(1 + i % 3), i % 6 != 5))
    return rows, spark.createDataFrame(rows, "segment_id long, subject int, a double, b double, c double, y int, kind int, w double, train boolean").repartition(5)


COLS = ["a", "b", "c"]


def plain_tree(bins, g, h, s, level, features):
    """Nested tuples (feature, cut, null_left, left, right) or a leaf's value."""
    if level < s.depth:
        best, hit = boost.LEAST_GAIN, None
        for f in features:
            for null_left in (False, True):
                for cut in range(1, s.bins):
                    left = np.where(bins[:, f] == 0, null_left, bins[:, f] <= cut)
                    hl, hr = h[left].sum(), h[~left].sum()
                    if hl >= s.least_weight and hr >= s.least_weight:
                        gain = g[left].sum() ** 2 / (hl + s.ridge) + g[~left].sum() ** 2 / (hr + s.ridge) - g.sum() ** 2 / (h.sum() + s.ridge)
                        if gain > best + 1e-9:
                            best, hit = gain, (f, cut, null_left, left)
        if hit:
            f, cut, null_left, left = hit
            return f, cut, null_left, plain_tree(bins[left], g[left], h[left], s, level + 1, features), plain_tree(bins[~left], g[~left], h[~left], s, level + 1, features)
    return -s.rate * g.sum() / (h.sum() + s.ridge) if len(g) else 0.0


def plain_value(tree, row):
    while isinstance(tree, tuple):
        f, cut, null_left, a, b = tree
        tree = a if (null_left if row[f] == 0 else row[f] <= cut) else b
    return tree


def plain_boost(bins, y, w, s, classes, ids=None, held=None):
    """Margins of all rows after every round; rows of weight 0 are scored only."""
    fit = (w > 0) & (~held if held is not None else True)
    mass = np.array([w[w > 0][y[w > 0] == c].sum() for c in range(classes)])
    weight = w * (mass.sum() / (classes * mass))[y] if s.balanced else w
    share = np.array([weight[w > 0][y[w > 0] == c].sum() for c in range(classes)])
    share = share / share.sum()
    k = 1 if classes == 2 else classes
    m = np.tile(np.log(share[1] / share[0]) if k == 1 else np.log(share), (len(y), 1)).astype(float)
    out = [m]
    for r in range(s.rounds):
        p = 1 / (1 + np.exp(-m)) if k == 1 else np.exp(m) / np.exp(m).sum(1, keepdims=True)
        use = fit & (boost.unit(ids, s.seed + 7919 * (r + 1)) < s.subsample if s.subsample < 1 else True)
        rng = np.random.default_rng((s.seed, r))
        features = np.sort(rng.choice(bins.shape[1], max(1, round(bins.shape[1] * s.column_share)), replace=False)) if s.column_share < 1 else range(bins.shape[1])
        new = m.copy()
        for c in range(k):
            g = weight * (p[:, c] - ((y == 1) if k == 1 else (y == c)))
            h = weight * p[:, c] * (1 - p[:, c]) * (1 if k == 1 else 2)
            tree = plain_tree(bins[use], g[use], h[use], s, 0, features)
            new[:, c] += [plain_value(tree, b) for b in bins]
        m = new
        out.append(m)
    return out


def prob(m):
    return 1 / (1 + np.exp(-m[:, 0])) if m.shape[1] == 1 else np.exp(m) / np.exp(m).sum(1, keepdims=True)


def matrix(rows, edges):
    return boost.to_bins(np.array([[np.nan if v is None else v for v in r[2:5]] for r in rows], float), edges)


def ids_of(spark, rows):
    return np.array([r[0] for r in spark.createDataFrame([(r[0],) for r in rows], "i long").select(F.xxhash64("i")).collect()], np.int64)


@pytest.mark.parametrize(
    ("s", "classes", "label", "cells"),
    [
        (Boosting(rounds=6, depth=3, rate=0.3, bins=16), 2, "y", boost.CELLS),
        (Boosting(rounds=4, depth=2, rate=0.5, bins=8, balanced=True, subsample=0.7, column_share=0.6), 2, "y", 600),
        (Boosting(rounds=3, depth=2, rate=0.5, bins=12), 3, "kind", boost.CELLS),
    ],
)
def test_folds_equal_a_plain_booster(spark, table, monkeypatch, s, classes, label, cells):
    rows, df = table
    monkeypatch.setattr(boost, "CELLS", cells)
    monkeypatch.setattr(boost, "STRIDE", 2)
    got = {r.segment_id: r for r in boost.loso_boosting(df, COLS, label, F.col("train"), s, classes, weight="w").collect()}
    assert got.keys() == {r[0] for r in rows}
    edges = boost.quantile_edges(df.filter("train"), COLS, s.bins)
    bins, y, w = matrix(rows, edges), np.array([r[5 if label == "y" else 6] for r in rows]), np.array([r[7] for r in rows])
    fold = np.array([r[1] if r[8] else -1 for r in rows])
    for f in np.unique(fold):
        last = prob(plain_boost(bins, y, np.where((fold >= 0) & (fold != f), w, 0), s, classes, ids_of(spark, rows))[-1])
        for i in np.flatnonzero(fold == f):
            r = got[rows[i][0]]
            assert r.fold == f
            assert ([r.proba] if classes == 2 else [r.proba_0, r.proba_1, r.proba_2]) == pytest.approx(np.atleast_1d(last[i]), abs=1e-6)


def test_curve_stopping_and_importances(spark, table):
    rows, df = table
    s = Boosting(rounds=30, depth=3, rate=0.8, bins=16, patience=3, held_share=0.3)
    m = boost.fit_boosting(df, COLS, "y", F.col("train"), s, leave_out=False)
    bins, y, train = matrix(rows, m.edges), np.array([r[5] for r in rows]), np.array([r[8] for r in rows])
    held = train & (boost.unit(ids_of(spark, rows), s.seed) < s.held_share)
    margins = plain_boost(bins, y, np.where(train, 1.0, 0.0), s, 2, held=held)
    loss = lambda at, part: float(np.mean(np.logaddexp(0, at[part, 0]) - y[part] * at[part, 0]))
    curve = sorted(m.curve(spark).collect(), key=lambda r: r.round)
    for r in curve:
        assert (r.fit_loss, r.held_loss, r.left_out_loss) == pytest.approx((loss(margins[r.round], train & ~held), loss(margins[r.round], held), loss(margins[r.round], ~train)), abs=1e-6)
    low = min(range(len(curve)), key=lambda i: curve[i].held_loss)
    assert m.best == [low] and len(curve) == low + 4 < s.rounds and len(m.rounds) == low
    got = {r.segment_id: r.proba for r in m.score(df.filter("not train"), ["segment_id"]).collect()}
    want = prob(margins[low])
    assert got == pytest.approx({r[0]: want[i] for i, r in enumerate(rows) if not r[8]}, abs=1e-6)
    imp = m.importances(spark).collect()
    assert {r.feature for r in imp} == set(COLS) and sum(r.share for r in imp) == pytest.approx(1) and imp[0].gain >= imp[-1].gain


def test_models_are_kept(spark, table, tmp_path):
    rows, df = table
    m = boost.fit_boosting(df, COLS, "y", F.col("train"), Boosting(rounds=3, depth=2, bins=8))
    boost.save_boosted(spark, f"{tmp_path}/b.json", m, norm="subject_z")
    again, settings = boost.load_boosted(spark, f"{tmp_path}/b.json")
    assert settings == {"norm": "subject_z"}
    a, b = ({(r.segment_id, r.fold): r.proba for r in x.score(df, ["segment_id"], F.when(F.col("train"), F.col("subject")).otherwise(-1)).collect()} for x in (m, again))
    assert a == b and len(a) == len(rows)


def test_no_models_without_both_classes(table):
    rows, df = table
    assert boost.loso_boosting(df.filter("y = 1"), COLS, "y", F.col("train"), Boosting(rounds=2)).count() == 0
    one = df.filter("subject = 0 or not train")  # nothing is left to learn from without subject 0
    assert {r.fold for r in boost.loso_boosting(one, COLS, "y", F.col("train"), Boosting(rounds=2, depth=2)).collect()} == {-1}


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(i, i % 3, 1.0, None, float(i % 2), i % 2) for i in range(60)], "segment_id long, subject int, a double, b double, c double, y int")
    out = boost.loso_boosting(df, COLS, "y", F.lit(True), Boosting(rounds=5, depth=2, rate=0.5)).collect()
    assert all((r.proba > 0.5) == (r.segment_id % 2 == 1) for r in out) and len(out) == 60


@pytest.mark.parametrize("options", [{}, {"weight": "w"}, {"label": "kind", "classes": 3}, {"learn": True}])
@pytest.mark.parametrize("distinct", [boost.DISTINCT, 0])
def test_many_folds_equal_few(table, monkeypatch, options, distinct):
    """On distinct rows, or some folds at a time on the blocks."""
    options = {"label": "y"} | options
    if options.get("learn"):
        options["learn"] = (F.col("segment_id") % 7 > 0) & (F.col("subject") != 2)
    s = Boosting(rounds=4, depth=3, rate=0.4, bins=12, balanced="weight" in options, column_share=0.7 if "weight" in options else 1.0)
    run = lambda: {r.segment_id: tuple(r)[2:] for r in boost.loso_boosting(table[1], COLS, train=F.col("train"), s=s, **options).collect()}
    want = run()
    fitted = []
    plain = boost._fit
    monkeypatch.setattr(boost, "_fit", lambda blocks, columns, edges, folds, *a: (fitted.append(len(folds)), plain(blocks, columns, edges, folds, *a))[1])
    monkeypatch.setattr(boost.models, "MANY_FOLDS", 3)
    monkeypatch.setattr(boost, "DISTINCT", distinct)
    got = run()
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())
    assert max(fitted, default=0) <= 3 and bool(fitted) == (not distinct)


@pytest.mark.parametrize("at_once", [boost.AT_ONCE, 2000])
@pytest.mark.parametrize(("balanced", "unit", "share"), [(False, 1.0, 1.0), (True, 1.7, 0.7)])
def test_folds_share_passes_while_cut_alike(monkeypatch, at_once, balanced, unit, share):
    """Fits without some rows each equal those of one fold at a time; folds without the same rows, or without any, take one's passes."""
    rng = np.random.default_rng(1)
    bins = np.unique(rng.integers(0, 13, (400, 3)).astype(np.uint8), axis=0)
    total = rng.integers(0, 4, (len(bins), 2)) * unit
    own = [(a, np.minimum(total[a], rng.integers(0, 4, (12, 2)) * unit)) for a in (np.sort(rng.choice(len(bins), 12, replace=False)) for _ in range(9))]
    own.append((np.arange(50), np.zeros((50, 2))))
    left = np.repeat(total[None], len(own), 0)
    for j, (a, w) in enumerate(own):
        left[j, a] -= w
    s = Boosting(rounds=4, depth=3, rate=0.4, bins=12, balanced=balanced, column_share=share)
    want = [m[a] for m, (a, _) in zip(boost._probabilities(bins, left, left.sum(1), s, 2), own, strict=True)]
    passes, plain = [], boost.best_cuts
    monkeypatch.setattr(boost, "AT_ONCE", at_once)
    monkeypatch.setattr(boost, "best_cuts", lambda *a: passes.append(1) or plain(*a))
    got = boost._own_probabilities(bins, total, own * 20, s)
    assert len(got) == 200 and all(g == pytest.approx(want[i % 10], abs=1e-12) for i, g in enumerate(got))
    assert at_once < boost.TOGETHER or len(passes) <= 10 * s.rounds * s.depth


def test_batches_of_blocks_stay_small(spark):
    """A task gets its blocks in batches of bounded size, not all of its rows in one."""
    rows = spark.range(0, 800_000, 1, 1).select(F.rand(1).alias("x0"), (F.col("id") % 2).cast("double").alias("y"), F.lit(1.0).alias("w"), F.lit(0).cast("long").alias("fold"), "id").coalesce(1)
    blocks = boost._blocks(rows, ["x0"], [np.linspace(0, 1, 9)]).coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(r["y"].__len__() // 8 for r in b.to_pylist())]), pa.array([b.nbytes])], ["n", "bytes"])

    got = blocks.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in got) == 800_000 and max(r.bytes for r in got) < 24 << 20
