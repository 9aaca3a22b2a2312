"""Classifiers: pyspark.ml factories, a grouped logistic regression for validation loops, calibrators, weights and alignment."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.sources.io import read_json, write_json

from . import leaveout, stats
from .blocks import covariances, tree_sum
from .metrics import roc_auc
from .normalize import _scaled
from .relational import seeded_subset


@dataclass(frozen=True)
class ModelSpec:
    name: str
    params: dict = field(default_factory=dict)


def classifier(spec: ModelSpec, features: str = "features", label: str = "label", weight: str | None = None, multiclass: bool = False, validation: str | None = None):
    """logreg, elastic_net, naive_bayes, rf, gbt or svm_linear of pyspark.ml; gbt and svm one against the rest for several classes.

    validation: for gbt, a boolean column of the rows on which boosting stops early, once they no longer gain.
    """
    from pyspark.ml import classification as m

    kind, usual = {
        "logreg": (m.LogisticRegression, {}), "elastic_net": (m.LogisticRegression, {"elasticNetParam": 0.5, "regParam": 0.01}), "naive_bayes": (m.NaiveBayes, {"modelType": "gaussian"}),
        "rf": (m.RandomForestClassifier, {"seed": 42}), "gbt": (m.GBTClassifier, {"seed": 42}), "svm_linear": (m.LinearSVC, {}),
    }[spec.name]
    more = {"validationIndicatorCol": validation} if validation and spec.name == "gbt" else {}
    out = kind(featuresCol=features, labelCol=label, **({"weightCol": weight} if weight else {}), **(usual | spec.params | more))
    return m.OneVsRest(classifier=out, featuresCol=features, labelCol=label) if multiclass and spec.name in ("gbt", "svm_linear") else out


def balanced_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """n / (classes * rows of the class)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    everything = Window.partitionBy()
    c = c.withColumn(out, F.sum("__n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("__n"))).drop("__n")
    return df.join(F.broadcast(c), label)  # a row for each class


def sample_weights(df: DataFrame, mode: str, strength: str, by: str = "subject") -> DataFrame:
    """weight from a subject's strength: uniform, linear, sqrt, inverse or rank; mean 1 over the rows."""
    s = F.col(strength)
    if mode == "rank":
        each = df.select(by, strength).distinct()
        r = stats.ranked_counts(each, [], strength).select(F.col(strength).alias("__s"), (F.col("r") - (F.col("t") - 1) / 2.0).alias("__r"), "t")
        n = r.agg(F.sum("t").alias("__n"))
        first = F.when(F.col("__n") > 1, (F.col("__r") - 1) / (F.col("__n") - 1)).otherwise(0.0)
        raw = df.join(r.crossJoin(F.broadcast(n)).select("__s", (0.5 + first).alias("__w")), F.col(strength) == F.col("__s")).drop("__s")  # one row
    else:
        raw = df.withColumn("__w", {"uniform": F.lit(1.0), "linear": s, "sqrt": F.sqrt(s), "inverse": 1 / (s + 1e-6)}[mode])
    mean = raw.agg(F.avg("__w").alias("__mean"))
    return raw.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("__w") / F.col("__mean")).drop("__w", "__mean")  # one row


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, c: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights and intercept that minimise |b|^2 / 2 + c * the weighted log loss, by Newton's method with step halving."""
    a = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.append(np.ones(x.shape[1]), 0.0)
    b = np.zeros(a.shape[1])

    def loss(b: np.ndarray) -> float:
        z = a @ b
        return 0.5 * float((ridge * b * b).sum()) + c * float((w * (np.logaddexp(0, z) - y * z)).sum())

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -500, 500)))
        grad = ridge * b + c * a.T @ (w * (p - y))
        hess = np.diag(ridge + 1e-12) + c * (a * (w * p * (1 - p))[:, None]).T @ a
        step, size, now = np.linalg.solve(hess, grad), 1.0, loss(b)
        while loss(b - size * step) > now and size > 1e-8:
            size /= 2
        b = b - size * step
        if np.abs(size * step).max() < 1e-10:
            break
    return b


def scale_fit(x: np.ndarray, robust: bool) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scale of each column; a zero scale is 1."""
    centre = np.median(x, 0) if robust else x.mean(0)
    scale = np.subtract(*np.percentile(x, [75, 25], axis=0)) if robust else x.std(0)
    return centre, np.where(scale > 0, scale, 1.0)


#: Numbers that a task sums up for the folds it fits at once.
FOLD_CELLS = 250_000


def _fold_sums(rows: DataFrame, q: int, at: np.ndarray, weight: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Loss, gradient and upper Hessian sums of every fold at its raw coefficients b, by one pass over rows.

    rows: x_0 .. x_{q-2}, y, w, f. Row i counts for fold at[k] unless f is it, weighted by w and weight[k, y].
    Partial sums are added up in a tree, so the driver gets a few rows of q * q numbers a fold.
    """
    names = [f"x_{j}" for j in range(q - 1)]
    step = max(1, 2_000_000 // len(at))

    def part(batches) -> np.ndarray:
        out = np.zeros((len(at), 1 + q + q * q))
        for g in batches:
            for i in range(0, len(g), step):
                rows = g.iloc[i : i + step]
                x = np.hstack([rows[names].to_numpy(float), np.ones((len(rows), 1))])
                y, f = rows["y"].to_numpy(float), rows["f"].to_numpy(np.int64)
                z = np.clip(x @ b.T, -500, 500)
                w = rows["w"].to_numpy(float)[:, None] * weight[:, y.astype(int)].T * (f[:, None] != at)
                p = 1 / (1 + np.exp(-z))
                out[:, 0] += (w * (np.logaddexp(0, z) - y[:, None] * z)).sum(0)
                out[:, 1 : 1 + q] += (w * (p - y[:, None])).T @ x
                out[:, 1 + q :] += (w * p * (1 - p)).T @ (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
        return out

    return tree_sum(rows, part).reshape(len(at), -1)


def _fit_folds(rows: DataFrame, q: int, at: np.ndarray, centre: np.ndarray, scale: np.ndarray, weight: np.ndarray, c: float, steps: int = 50) -> np.ndarray:
    """Raw coefficients of every fold, intercept last: fit_logistic of the scaled columns, Newton steps for all folds at once."""
    k = len(at)
    t = np.zeros((k, q, q))  # scaled = t @ raw
    t[:, range(q - 1), range(q - 1)] = 1 / scale
    t[:, :-1, -1] = -centre / scale
    t[:, -1, -1] = 1
    ridge = np.append(np.ones(q - 1), 0.0)

    def at_point(b: np.ndarray):
        s = _fold_sums(rows, q, at, weight, np.einsum("kij,ki->kj", t, b))
        grad = ridge * b + c * np.einsum("kij,kj->ki", t, s[:, 1 : 1 + q])
        hess = np.diag(ridge + 1e-12) + c * t @ s[:, 1 + q :].reshape(k, q, q) @ t.transpose(0, 2, 1)
        return 0.5 * (ridge * b * b).sum(1) + c * s[:, 0], grad, hess

    b = np.zeros((k, q))
    loss, grad, hess = at_point(b)
    for _ in range(steps):
        step = np.linalg.solve(hess, grad[:, :, None])[:, :, 0]
        new = at_point(b - step)
        while (worse := (new[0] > loss + 1e-9 * np.abs(loss)) & (np.abs(step).max(1) > 1e-8)).any():
            step[worse] /= 2
            new = at_point(b - step)
        b, (loss, grad, hess) = b - step, new
        if np.abs(step).max() < 1e-8:
            break
    return np.einsum("kij,ki->kj", t, b)


def loso(
    df: DataFrame, columns: list[str], label: str, train: Column, c: float = 1.0, balanced: bool = True, robust: bool = False, key: str = "segment_id", by: str = "subject", weight: str | None = None, learn: Column | None = None
) -> DataFrame:
    """(key, by, fold, proba): leave-one-subject-out probabilities of the training subjects, and (fold -1) of all other rows by a fit on all training rows.

    learn restricts the training rows that are learned from; all are scored. A fold without both classes scores no row.
    Some folds are fitted together: each Newton step is one pass over the rows, which stay where they are and send sums
    of the folds' gradients and curvatures. Many are fitted by what their subjects take from the expanded loss of all rows (leaveout), so
    that the work grows with the rows only. Scales leave the fold's subject out: by sums or, if robust, by percentiles.
    """
    rows = df.select(
        F.col(key), F.col(by), *[F.col(x).cast("double").alias(f"x_{j}") for j, x in enumerate(columns)], F.col(label).cast("double").alias("y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), F.when(train, F.col(by).cast("long")).otherwise(-1).alias("fold"), (learn if learn is not None else F.lit(True)).alias("__learn"),
    )
    rows = rows.persist()
    try:
        many = not robust and rows.filter("fold <> -1").select("fold").distinct().count() > MANY_FOLDS
        fits = _many_folds(rows, len(columns), c, balanced) if many else df.sparkSession.createDataFrame(_loso_coefficients(rows, len(columns), c, balanced, robust), "fold long, b array<double>")
        n_fits = fits.count()
    finally:
        rows.unpersist()
    if n_fits * (len(columns) + 1) < 4_000_000:  # 32 MB
        fits = F.broadcast(fits)
    z = sum((F.get("b", F.lit(j)) * F.col(f"x_{j}") for j in range(len(columns))), F.get("b", F.lit(len(columns))))
    return rows.join(fits, "fold").select(key, by, "fold", (1 / (1 + F.exp(-z))).alias("proba"))


def loso_many(
    df: DataFrame, sets: list[list[str]], label: str, train: Column, c: float = 1.0, balanced: bool = True, key: str = "segment_id", by: str = "subject", weight: str | None = None, learn: Column | None = None
) -> DataFrame:
    """(key, by, fold, set, proba): what loso() gives for each set of columns, set being its number. A Newton step of all sets and folds is one pass over the rows."""
    columns = list(dict.fromkeys(x for s in sets for x in s))
    place = {x: j for j, x in enumerate(columns)}
    at_sets = [[place[x] for x in s] for s in sets]
    xs = [f"x_{j}" for j in range(len(columns))]
    rows = df.select(
        F.col(key), F.col(by), *[F.col(x).cast("double").alias(n) for x, n in zip(columns, xs, strict=True)], F.col(label).cast("double").alias("y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), F.when(train, F.col(by).cast("long")).otherwise(-1).alias("fold"), (learn if learn is not None else F.lit(True)).alias("__learn"),
    ).persist()
    try:
        folds, fits = _many_coefficients(rows, xs, at_sets, c, balanced)
    finally:
        rows.unpersist()
    number = {f: j for j, f in enumerate(folds.tolist())}
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches):
        for g in batches:
            j = g["fold"].map(number)
            g, j = g[j.notna()], j[j.notna()].astype(int).to_numpy()
            x = g[xs].to_numpy(float)
            for s, (cols, b) in enumerate(zip(at_sets, fits, strict=True)):
                z = (x[:, cols] * b[j, :-1]).sum(1) + b[j, -1] if len(g) else np.zeros(0)
                yield g[[key, by, "fold"]].assign(set=s, proba=1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return rows.mapInPandas(run, f"`{key}` {kinds[key]}, `{by}` {kinds[by]}, fold long, set int, proba double")


def _many_coefficients(rows: DataFrame, xs: list[str], sets: list[list[int]], c: float, balanced: bool, steps: int = 50) -> tuple[np.ndarray, list[np.ndarray]]:
    """Folds, and for each set their raw coefficients, intercept last."""
    used = rows.filter("fold <> -1 and __learn").select(*xs, "y", "w", F.col("fold").alias("f"))
    there = sorted(r.fold for r in rows.filter("fold <> -1").select("fold").distinct().collect())
    sums = used.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"), *[F.sum(x) for x in xs], *[F.sum(F.col(x) * F.col(x)) for x in xs]).collect()
    own = {r.f: np.array(r[1:], float) for r in sums}
    folds = np.array([-1, *there], np.int64)
    if not own:
        return folds[:0], [np.zeros((0, len(s) + 1)) for s in sets]
    everything, p = sum(own.values()), len(xs)
    left = np.array([everything - own.get(f, 0.0) for f in folds.tolist()])
    ok = (left[:, 1] > 0.5) & (left[:, 0] - left[:, 1] > 0.5)
    folds, left = folds[ok], left[ok]
    n, ones = left[:, 0], left[:, 1]
    centre, square = left[:, 2 : 2 + p] / n[:, None], left[:, 2 + p :] / n[:, None]
    var = square - centre**2
    scale = np.sqrt(np.where(var > 1e-12 * np.maximum(square, 1e-300), var, 0.0))
    scale = np.where(scale > 0, scale, 1.0)
    weight = np.stack([n / (2 * (n - ones)), n / (2 * ones)], 1) if balanced else np.ones((len(n), 2))
    cells = [len(folds) * (1 + (q := len(s) + 1) + q * q) for s in sets]
    out: list[np.ndarray] = []
    first = 0
    while first < len(sets):  # as many sets at once as a pass may sum up
        last, held = first, 0
        while last < len(sets) and (last == first or held + cells[last] <= MANY_CELLS):
            held += cells[last]
            last += 1
        out += _fit_many(used, xs, sets[first:last], folds, centre, scale, weight, c, steps)
        first = last
    return folds, out


#: Numbers that a pass sums up for all sets and folds that it fits (32 MB).
MANY_CELLS = 4_000_000


def _many_sums(rows: DataFrame, xs: list[str], sets: list[list[int]], at: np.ndarray, weight: np.ndarray, bs: list[np.ndarray]) -> list[np.ndarray]:
    """For each set, of every fold at its raw coefficients: loss, gradient and Hessian sums, by one pass."""
    k, sizes = len(at), [len(s) + 1 for s in sets]
    ends = np.cumsum([0, *[k * (1 + q + q * q) for q in sizes]])

    def part(batches) -> np.ndarray:
        out = [np.zeros((k, 1 + q + q * q)) for q in sizes]
        for g in (b.iloc[i : i + 2048] for b in batches for i in range(0, len(b), 2048)):
            every, y, f = g[xs].to_numpy(float), g["y"].to_numpy(float), g["f"].to_numpy(np.int64)
            w = g["w"].to_numpy(float)[:, None] * weight[:, y.astype(int)].T * (f[:, None] != at)
            for s, b, o, q in zip(sets, bs, out, sizes, strict=True):
                x = np.hstack([every[:, s], np.ones((len(g), 1))])
                z = np.clip(x @ b.T, -500, 500)
                p = 1 / (1 + np.exp(-z))
                o[:, 0] += (w * (np.logaddexp(0, z) - y[:, None] * z)).sum(0)
                o[:, 1 : 1 + q] += (w * (p - y[:, None])).T @ x
                o[:, 1 + q :] += (w * p * (1 - p)).T @ (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
        return np.concatenate([o.ravel() for o in out])

    flat = tree_sum(rows, part)
    return [flat[a:b].reshape(k, -1) for a, b in zip(ends, ends[1:], strict=False)]


def _fit_many(rows: DataFrame, xs: list[str], sets: list[list[int]], at: np.ndarray, centre: np.ndarray, scale: np.ndarray, weight: np.ndarray, c: float, steps: int) -> list[np.ndarray]:
    k = len(at)
    maps, ridges = [], []
    for s in sets:  # scaled = t @ raw
        q = len(s) + 1
        t = np.zeros((k, q, q))
        t[:, range(q - 1), range(q - 1)] = 1 / scale[:, s]
        t[:, :-1, -1] = -centre[:, s] / scale[:, s]
        t[:, -1, -1] = 1
        maps.append(t)
        ridges.append(np.append(np.ones(q - 1), 0.0))
    raw = lambda bs: [np.einsum("kij,ki->kj", t, b) for t, b in zip(maps, bs, strict=True)]

    def at_point(bs: list[np.ndarray]):
        out = []
        for s, b, t, ridge in zip(_many_sums(rows, xs, sets, at, weight, raw(bs)), bs, maps, ridges, strict=True):
            q = len(ridge)
            grad = ridge * b + c * np.einsum("kij,kj->ki", t, s[:, 1 : 1 + q])
            hess = np.diag(ridge + 1e-12) + c * t @ s[:, 1 + q :].reshape(k, q, q) @ t.transpose(0, 2, 1)
            out.append((0.5 * (ridge * b * b).sum(1) + c * s[:, 0], grad, hess))
        return out

    bs = [np.zeros((k, len(s) + 1)) for s in sets]
    now = at_point(bs)
    for _ in range(steps):
        moves = [np.linalg.solve(h, g[:, :, None])[:, :, 0] for _, g, h in now]
        new = at_point([b - m for b, m in zip(bs, moves, strict=True)])
        while any((worse := [(n[0] > o[0] + 1e-9 * np.abs(o[0])) & (np.abs(m).max(1) > 1e-8) for n, o, m in zip(new, now, moves, strict=True)])[i].any() for i in range(len(sets))):
            for m, bad in zip(moves, worse, strict=True):
                m[bad] /= 2
            new = at_point([b - m for b, m in zip(bs, moves, strict=True)])
        bs, now = [b - m for b, m in zip(bs, moves, strict=True)], new
        if max(np.abs(m).max() for m in moves) < 1e-8:
            break
    return raw(bs)


#: Folds beyond which they are not fitted on all rows each.
MANY_FOLDS = 256


def _many_folds(rows: DataFrame, p: int, c: float, balanced: bool) -> DataFrame:
    """(fold, b) of _loso_coefficients, without passes over all rows for each fold but for the few with a large share of the rows or beyond the expansion's reach."""
    xs = [f"x_{j}" for j in range(p)]
    spark, empty = rows.sparkSession, "fold long, b array<double>"
    used = rows.filter("fold <> -1 and __learn")
    each = [F.sum, lambda x: F.sum(F.col(x) * F.col(x)), F.min, F.max]
    row = used.agg(F.count(F.lit(1)), F.sum("y"), *[f(x) for f in each for x in xs]).first()
    n, ones = float(row[0]), float(row[1] or 0)
    if ones < 0.5 or n - ones < 0.5:
        return spark.createDataFrame([], empty)
    total, square, least, most = np.array(row[2:], float).reshape(4, p)
    centre, var = total / n, square / n - (total / n) ** 2
    scale = np.sqrt(np.where(var > 1e-12 * np.maximum(square / n, 1e-300), var, 0.0))
    scale = np.where(scale > 0, scale, 1.0)
    weight = np.array([[n / (2 * (n - ones)), n / (2 * ones)]]) if balanced else np.ones((1, 2))
    everything = np.array([-1], np.int64)
    raw = _fit_folds(used.select(*xs, "y", "w", F.col("fold").alias("f")), p + 1, everything, centre[None], scale[None], weight, c)[0]
    every = {"n": n, "ones": ones, "centre": centre, "scale": scale, "reach": np.maximum(most - centre, centre - least), "sum": np.zeros(p), "square": n * var / scale**2}
    large = [r.fold for r in used.groupBy("fold").count().filter(F.col("count") > leaveout.LARGE * n).collect()]  # fewer than 1 / LARGE
    fits = leaveout.fold_fits(rows.filter("fold <> -1"), p, every, raw, c, balanced, large)
    again = sorted({*large, *(r.fold for r in fits.filter("not fine").select("fold").collect())})
    some = _loso_coefficients(rows, p, c, balanced, False, again) if again else []
    own = [(-1, [float(v) for v in raw]), *[(f, b) for f, b in some if f != -1]]
    return fits.filter("fine").select("fold", "b").unionByName(spark.createDataFrame(own, empty))


def _loso_coefficients(rows: DataFrame, p: int, c: float, balanced: bool, robust: bool, only: list[int] | None = None) -> list[tuple[int, list[float]]]:
    """Raw coefficients of every fold (or only of some) and of fold -1."""
    used = rows.filter("fold <> -1 and __learn").select(*[f"x_{j}" for j in range(p)], "y", "w", F.col("fold").alias("f"))
    xs = [f"x_{j}" for j in range(p)]
    there = only if only is not None else sorted(r.fold for r in rows.filter("fold <> -1").select("fold").distinct().collect())
    folds = np.array([-1, *there], np.int64)
    key = F.col("f") if only is None else F.when(F.col("f").isin(only), F.col("f")).otherwise(-2).alias("f")
    sums = used.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"), *[F.sum(x).alias(f"s_{x}") for x in xs], *[F.sum(F.col(x) * F.col(x)).alias(f"q_{x}") for x in xs]).collect()
    own = {r.f: np.array(r[1:], float) for r in sums}
    if not own:
        return []
    everything = sum(own.values())
    left = np.array([everything - own.get(f, 0.0) for f in folds.tolist()])
    n, ones = left[:, 0], left[:, 1]
    ok = (ones > 0.5) & (n - ones > 0.5)
    folds, left, n, ones = folds[ok], left[ok], n[ok], ones[ok]
    if robust:
        q = F.percentile(F.col("x"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        spread = used.select("f", F.posexplode(F.array(*xs)).alias("j", "x"), F.explode(F.array(*[F.lit(int(f)) for f in folds])).alias("fold")).filter("f <> fold")
        quartiles = {(r.fold, r.j): r.q for r in spread.groupBy("fold", "j").agg(q.alias("q")).collect()}
        got = np.array([[quartiles[f, j] for j in range(p)] for f in folds.tolist()])
        centre, scale = got[:, :, 1], got[:, :, 2] - got[:, :, 0]
    else:
        centre = left[:, 2 : 2 + p] / n[:, None]
        var = left[:, 2 + p :] / n[:, None] - centre**2
        scale = np.sqrt(np.where(var > 1e-12 * np.maximum(left[:, 2 + p :] / n[:, None], 1e-300), var, 0.0))
    scale = np.where(scale > 0, scale, 1.0)
    weight = np.stack([n / (2 * (n - ones)), n / (2 * ones)], 1) if balanced else np.ones((len(n), 2))
    out, size = [], max(1, FOLD_CELLS // (p + 1) ** 2)
    for i in range(0, len(folds), size):
        s = slice(i, i + size)
        b = _fit_folds(used, p + 1, folds[s], centre[s], scale[s], weight[s], c)
        out += [(int(f), [float(v) for v in row]) for f, row in zip(folds[s], b, strict=True)]
    return out


@dataclass(frozen=True)
class LinearModel:
    """A fitted logistic regression on raw columns; plain values, so that it is stored as JSON."""

    columns: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    def proba(self) -> Column:
        return 1 / (1 + F.exp(-sum((F.col(c) * w for c, w in zip(self.columns, self.weights, strict=True)), F.lit(self.intercept))))


def fit_model(df: DataFrame, columns: list[str], label: str, c: float = 1.0, balanced: bool = True, robust: bool = False, weight: str | None = None) -> LinearModel:
    """The fit of loso() on all rows, to be kept."""
    rows = df.select(*[F.col(x).cast("double").alias(f"x_{j}") for j, x in enumerate(columns)], F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), F.lit(0).cast("long").alias("fold"), F.lit(True).alias("__learn"))
    fits = dict(_loso_coefficients(rows, len(columns), c, balanced, robust))
    if -1 not in fits:
        raise ValueError("both classes are needed")
    return LinearModel(tuple(columns), tuple(fits[-1][:-1]), fits[-1][-1])


def save_model(spark, path: str, model: LinearModel, **settings) -> None:
    """The model and the settings it was fitted with, as one JSON file."""
    write_json(spark, path, {"model": asdict(model), "settings": settings})


def load_model(spark, path: str) -> tuple[LinearModel, dict]:
    got = read_json(spark, path)
    m = got["model"]
    return LinearModel(tuple(m["columns"]), tuple(m["weights"]), m["intercept"]), got["settings"]


def experts(df: DataFrame, columns: list[str], label: str, train: Column, strength: str, k: int, least: int = 5, by: str = "subject", key: str = "segment_id", **options) -> DataFrame:
    """(key, by, stratum, proba): mixture of experts. Subjects fall into k strata by the training subjects' quantiles of log1p(strength).

    A row is scored by a fit on the training subjects of its stratum, its own subject left out; by one on all training
    subjects where the stratum has fewer than least others.
    """
    known = df.filter(train).select(by, strength).distinct()
    edges = known.agg(F.percentile(F.log1p(strength), F.array(*[F.lit(i / k) for i in range(1, k)])).alias("e")).first().e or []
    stratum = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>"), lambda e: e < F.log1p(F.col(strength))))
    df = df.withColumn("stratum", stratum)
    members = {r.stratum: r["count"] for r in df.filter(train).select(by, "stratum").distinct().groupBy("stratum").count().collect()}
    out = None
    for s in range(k):
        here = df.filter(F.col("stratum") == s)
        enough = members.get(s, 0) > least
        scored = loso(here if enough else df, columns, label, train, by=by, key=key, **options).select(key, by, "proba")
        scored = (scored if enough else scored.join(here.select(key), key, "left_semi")).withColumn("stratum", F.lit(s))
        out = scored if out is None else out.unionByName(scored)
    return out.select(key, by, "stratum", "proba")


def importances(model: LinearModel, df: DataFrame) -> DataFrame:
    """(feature, importance): each column's absolute weight by its deviation over df, the greatest first."""
    row = df.agg(*[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(model.columns)])
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), F.abs(F.lit(w) * F.col(f"s_{i}")).alias("importance")) for i, (c, w) in enumerate(zip(model.columns, model.weights, strict=True))])
    return row.select(F.inline(parts)).orderBy(F.desc("importance"), "feature")


def learning_curve(df: DataFrame, columns: list[str], label: str, train: Column, sizes: list[int], seed: int = 42, by: str = "subject", **options) -> DataFrame:
    """(n_subjects, auc, n_pos, n_neg): fits on a seeded choice of so many training subjects, each choice within the next, on all other rows."""
    out = None
    for n in sizes:
        model = fit_model(seeded_subset(df.filter(train), by, n, seed), columns, label, **options)
        auc = roc_auc(df.filter(~train).select(label, model.proba().alias("p")), label, "p").select(F.lit(n).alias("n_subjects"), "auc", "n_pos", "n_neg")
        out = auc if out is None else out.unionByName(auc)
    return out


def grid_search(configs: list[dict], stages: list[tuple[tuple[str, ...], Callable]], score: Callable) -> list[dict]:
    """Each config with its score. stages: (the config's keys it depends on, f(config, results before)); a stage runs once for each value of its and its predecessors' keys."""
    memo: dict[tuple, object] = {}
    out = []
    for config in configs:
        got, path = [], ()
        for names, run in stages:
            path = (*path, *[(n, config[n]) for n in names])
            if path not in memo:
                memo[path] = run(config, got)
            got = [*got, memo[path]]
        out.append({**config, "score": score(config, got)})
    return out


@dataclass(frozen=True)
class Calibrator:
    """kind none, platt (a, b on the probability) or isotonic (x, y knots); plain values, so that it can be stored as JSON."""

    kind: str
    a: float = 1.0
    b: float = 0.0
    x: tuple[float, ...] = ()
    y: tuple[float, ...] = ()

    def apply(self, p: Column, eps: float = 1e-6) -> Column:
        if self.kind == "platt":
            out = 1 / (1 + F.exp(-(self.a * F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p)) + self.b)))
        elif self.kind == "isotonic":
            x, y = np.array(self.x), np.array(self.y)
            between = F.pandas_udf(lambda v: pd.Series(np.interp(v.to_numpy(float), x, y)), "double")
            out = F.when(p.isNotNull(), between(p))
        else:
            out = p
        return F.greatest(F.lit(eps), F.least(F.lit(1 - eps), out))


def isotonic(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over distinct p: the knots' p and value."""
    order = np.argsort(p, kind="stable")
    xs, first = np.unique(p[order], return_index=True)
    n = np.diff(np.append(first, len(p)))
    s = np.add.reduceat(y[order].astype(float), first)
    blocks: list[list[float]] = []  # sum, weight, distinct values
    for a, w in zip(s, n, strict=True):
        blocks.append([a, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a2, w2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a2, blocks[-1][1] + w2, blocks[-1][2] + k2]
    return xs, np.concatenate([np.full(int(k), a / w) for a, w, k in blocks])


def _pool(lo: np.ndarray, hi: np.ndarray, s: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """Pool adjacent violators over blocks in the order of p. Pooling parts of the range first gives the same."""
    out: list[list[float]] = []
    for row in zip(lo.tolist(), hi.tolist(), s.tolist(), n.tolist(), strict=True):
        out.append(list(row))
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, h, a, w = out.pop()
            out[-1][1:] = [h, out[-1][2] + a, out[-1][3] + w]
    return pd.DataFrame(out, columns=["lo", "hi", "s", "n"], dtype=float)


def _platt(g: DataFrame, steps: int = 50) -> tuple[float, float]:
    """fit_logistic of the one column p, with the sums of each step by an aggregate."""

    def at(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = F.lit(float(b[0])) * F.col("p") + F.lit(float(b[1]))
        q = 1 / (1 + F.exp(-z))
        e, v = F.col("n") * q - F.col("s"), F.col("n") * q * (1 - q)
        loss = F.col("n") * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))) - F.col("s") * z
        r = g.agg(*[F.sum(c) for c in (loss, e * F.col("p"), e, v * F.col("p") * F.col("p"), v * F.col("p"), v)]).first()
        return 0.5 * b[0] ** 2 + r[0], np.array([b[0] + r[1], r[2]]), np.array([[1 + r[3], r[4]], [r[4], r[5]]]) + 1e-12 * np.eye(2)

    b = np.zeros(2)
    loss, grad, hess = at(b)
    for _ in range(steps):
        step = np.linalg.solve(hess, grad)
        new = at(b - step)
        while new[0] > loss and np.abs(step).max() > 1e-10:
            step = step / 2
            new = at(b - step)
        b, (loss, grad, hess) = b - step, new
        if np.abs(step).max() < 1e-10:
            break
    return float(b[0]), float(b[1])


def fit_calibrator(df: DataFrame, p: str, y: str, kind: str, eps: float = 1e-6) -> Calibrator:
    """From the exact probabilities, clipped to eps and 1 - eps. Rows with a null are left out.

    Isotonic blocks are pooled on ranges of p before they reach the driver; Platt's sums are aggregates.
    """
    if kind == "none":
        return Calibrator("none")
    rows = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).select(F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(p))).alias("p"), F.col(y).cast("double").alias("y"))
    g = rows.groupBy("p").agg(F.sum("y").alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    if kind == "platt":
        g = g.persist()
        a, b = _platt(g)
        g.unpersist()
        return Calibrator("platt", a, b)
    pool = lambda batches: (_pool(t["p"].to_numpy(), t["p"].to_numpy(), t["s"].to_numpy(), t["n"].to_numpy()) for t in batches)
    t = g.repartitionByRange("p").sortWithinPartitions("p").mapInPandas(pool, "lo double, hi double, s double, n double").toPandas().sort_values("lo")
    t = _pool(*(t[c].to_numpy() for c in ("lo", "hi", "s", "n")))
    knots = [(x, s / n) for lo, hi, s, n in t.itertuples(index=False) for x in dict.fromkeys((lo, hi))]
    return Calibrator("isotonic", x=tuple(x for x, _ in knots), y=tuple(v for _, v in knots))


def standard_scale(df: DataFrame, columns: list[str], train: Column, robust: bool = False) -> DataFrame:
    """Fit on training rows, apply to all, with exact aggregates: mean and population deviation, or median and quartiles."""
    fit = df.filter(train)
    if robust:
        s = fit.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"__q_{i}") for i, c in enumerate(columns)])
        pick = lambda i: (F.col(f"__q_{i}")[1], F.col(f"__q_{i}")[2] - F.col(f"__q_{i}")[0])
    else:
        s = fit.agg(*[x for i, c in enumerate(columns) for x in (F.avg(c).alias(f"__m_{i}"), F.stddev_pop(c).alias(f"__s_{i}"))])
        pick = lambda i: (F.col(f"__m_{i}"), F.col(f"__s_{i}"))
    out = df.crossJoin(F.broadcast(s))  # one row
    return out.withColumns({c: _scaled(F.col(c), *pick(i)) for i, c in enumerate(columns)}).drop(*s.columns)


def mixup(df: DataFrame, columns: list[str], alpha: float, seed: int, by: tuple[str, ...] = ("subject", "class"), key: str = "segment_id") -> DataFrame:
    """Each row blended with the next of its group in a seeded order, by a weight of the law Beta(alpha, alpha) that depends on the seed and the row's key alone."""
    w = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)

    @F.pandas_udf("double")
    def beta(h: pd.Series) -> pd.Series:
        return pd.Series([np.random.Generator(np.random.Philox(key=int(v) & (1 << 64) - 1)).beta(alpha, alpha) for v in h])

    first = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(first))
    out = df.withColumn("__l", beta(F.xxhash64(F.lit(seed + 1), F.col(key))))
    return out.withColumns({c: F.col("__l") * F.col(c) + (1 - F.col("__l")) * other(c) for c in columns}).drop("__l")


def jitter(df: DataFrame, columns: list[str], scale: float, seed: int, key: str = "segment_id") -> DataFrame:
    """df and a copy with Gaussian noise, which depends on the seed, the column and the row's key alone."""
    unit = lambda *x: (F.shiftrightunsigned(F.xxhash64(*[F.lit(v) for v in x], F.col(key)), 11) + 1) / float(2**53 + 1)
    normal = lambda i: F.sqrt(-2 * F.log(unit(seed, i, 0))) * F.cos(2 * math.pi * unit(seed, i, 1))
    noisy = df.withColumns({c: F.col(c) + scale * normal(i) for i, c in enumerate(columns)})
    return df.withColumn("augmented", F.lit(False)).unionByName(noisy.withColumn("augmented", F.lit(True)))


def sign_flip(df: DataFrame, columns: list[str], flagged: Column) -> DataFrame:
    return df.withColumns({c: F.when(flagged, -F.col(c)).otherwise(F.col(c)) for c in columns})


def linear_map(df: DataFrame, columns: list[str], m: np.ndarray) -> DataFrame:
    """Rows times m, as column expressions."""
    return df.withColumns({c: sum((F.col(b) * float(m[i, j]) for i, b in enumerate(columns)), F.lit(0.0)) for j, c in enumerate(columns)})


def coral(source: DataFrame, target: DataFrame, columns: list[str], ridge: float = 1e-3) -> DataFrame:
    """Source rows whitened by their covariance and recoloured by the target's."""

    def power(c: np.ndarray, e: float) -> np.ndarray:
        v, q = np.linalg.eigh(c + ridge * np.eye(len(c)))
        return q @ np.diag(np.maximum(v, 1e-12) ** e) @ q.T

    return linear_map(source, columns, power(covariances(source, columns), -0.5) @ power(covariances(target, columns), 0.5))


def pca(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """pc_1 .. pc_k of the centred columns; a component's sign makes its greatest loading positive."""
    v, q = np.linalg.eigh(covariances(df, columns))
    q = q[:, np.argsort(-v, kind="stable")[:k]]
    q = q * np.sign(q[np.abs(q).argmax(0), np.arange(q.shape[1])])
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return df.withColumns({f"pc_{j + 1}": sum(((F.col(c) - means[c]) * float(q[i, j]) for i, c in enumerate(columns)), F.lit(0.0)) for j in range(q.shape[1])})


def stratum(df: DataFrame, value: str, n: int, out: str = "stratum") -> DataFrame:
    """0 to n - 1 by quantiles of log1p(value)."""
    x = F.log1p(F.col(value))
    q = df.agg(F.percentile(x, F.array(*[F.lit(k / n) for k in range(1, n)])).alias("__q"))
    return df.crossJoin(F.broadcast(q)).withColumn(out, F.size(F.filter("__q", lambda e: e < x))).drop("__q")  # one row


def blend(a: DataFrame, b: DataFrame, key: str, p: str, alpha: float) -> DataFrame:
    """(key, p): alpha of a's probability and the rest of b's."""
    return a.select(key, F.col(p).alias("__a")).join(b.select(key, F.col(p).alias("__b")), key).select(key, (alpha * F.col("__a") + (1 - alpha) * F.col("__b")).alias(p))


def average_views(views: list[DataFrame], key: str, p: str) -> DataFrame:
    out = views[0].select(key, p)
    for v in views[1:]:
        out = out.unionByName(v.select(key, p))
    return out.groupBy(key).agg(F.avg(p).alias(p))


def logit(p: float) -> float:
    return math.log(p / (1 - p))
