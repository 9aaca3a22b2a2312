"""Support vector machines with squared hinge loss: linear, or with a radial basis kernel over landmarks, for all folds at once.

The kernel is exp(-gamma |x - z|^2) + 1, so the intercept is part of it and shrinks with the rest. Its functions are kept to the span
of m landmark rows: k(x) = K^(-1/2) (k(x, landmark_1), ...) turns a row into at most m numbers, and the fit into a linear one of
these, solved by Newton steps on sums over all rows. How far that is from the fit without landmarks is known afterwards: if
a_i = 2 C w_i max(0, 1 - y_i f(x_i)) and r_i^2 is what the landmarks leave of k(x_i, x_i), then the exact fit's decision values are
within sqrt(2) * sum a_i r_i of these everywhere (the duality gap of f is half that sum's square at most, and the loss is
strongly convex). gap() gives the figure; with every row a landmark it is zero.

Columns are scaled by all training rows, for all folds, without their labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.sources.shared import stored

from . import models
from .blocks import tree_sum


@dataclass(frozen=True)
class Svm:
    c: float = 1.0
    gamma: float | None = None  #: None: 1 / columns, which is "scale" for scaled columns; unused if linear
    landmarks: int = 256  #: most rows for the kernel's span, by a hash of their keys; 0: linear
    balanced: bool = True
    seed: int = 42


@dataclass(frozen=True)
class Map:
    """From raw columns to the numbers that the fit is linear in; the last is 1."""

    centre: np.ndarray
    scale: np.ndarray
    gamma: float
    points: np.ndarray | None  #: scaled landmarks; None: linear
    root: np.ndarray | None  #: m x rank

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        if self.points is not None:
            z = kernel(z, self.points, self.gamma) @ self.root
        return np.hstack([z, np.ones((len(z), 1))])

    def left_over(self, phi: np.ndarray) -> np.ndarray:
        """r: the distance of a row's kernel function from the span."""
        return np.sqrt(np.maximum(1 - (phi[:, :-1] ** 2).sum(1), 0)) if self.points is not None else np.zeros(len(phi))


def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    d = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(d, 0))


def _map(fit: DataFrame, xs: list[str], s: Svm) -> Map:
    row = fit.agg(*[a for x in xs for a in (F.avg(x), F.stddev_pop(x))]).first()
    centre, scale = np.array(row[0::2], float), np.array(row[1::2], float)
    scale = np.where(scale > 0, scale, 1.0)
    gamma = s.gamma if s.gamma is not None else 1 / len(xs)
    if not s.landmarks:
        return Map(centre, scale, gamma, None, None)
    picked = fit.select(*xs).orderBy(F.xxhash64(F.lit(s.seed), "id"), "id").limit(s.landmarks).toPandas().to_numpy(float)  # at most s.landmarks rows
    points = np.unique((picked - centre) / scale, axis=0)
    v, q = np.linalg.eigh(kernel(points, points, gamma))
    keep = v > 1e-10 * v[-1]
    return Map(centre, scale, gamma, points, q[:, keep] / np.sqrt(v[keep]))


def _sums(rows: DataFrame, xs: list[str], to: Map, at: np.ndarray, weight: np.ndarray, b: np.ndarray, curved: bool) -> np.ndarray:
    """Of every fold at its coefficients b: sum of w h^2, of w y h phi, of w a r, and (curved) of w phi phi' over rows with h = max(0, 1 - y f) > 0."""
    q = b.shape[1]

    def part(batches: Iterator[pd.DataFrame]) -> np.ndarray:
        out = np.zeros((len(at), 2 + q + (q * q if curved else 0)))
        for g in batches:
            phi, y, f = to(g[xs].to_numpy(float)), g["y"].to_numpy(int), g["f"].to_numpy(np.int64)
            sign, left = 2.0 * y - 1, to.left_over(phi)
            w = g["w"].to_numpy(float)[:, None] * weight[:, y].T * (f[:, None] != at)
            h = np.maximum(0, 1 - sign[:, None] * (phi @ b.T))
            out[:, 0] += (w * h * h).sum(0)
            out[:, 1] += (w * h * left[:, None]).sum(0)
            out[:, 2 : 2 + q] += (w * h * sign[:, None]).T @ phi
            for j in range(len(at)) if curved else ():
                on = np.flatnonzero(w[:, j] * h[:, j] > 0)
                out[j, 2 + q :] += ((phi[on] * w[on, j, None]).T @ phi[on]).ravel()
        return out

    return tree_sum(rows, part).reshape(len(at), -1)


def _fit(rows: DataFrame, xs: list[str], to: Map, at: np.ndarray, weight: np.ndarray, c: float, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and gaps of some folds."""
    q = (to.root.shape[1] if to.root is not None else len(xs)) + 1
    b = np.zeros((len(at), q))

    def at_point(b: np.ndarray):
        s = _sums(rows, xs, to, at, weight, b, True)
        return 0.5 * (b * b).sum(1) + c * s[:, 0], b - 2 * c * s[:, 2 : 2 + q], np.eye(q) + 2 * c * s[:, 2 + q :].reshape(-1, q, q), 2 * c * s[:, 1]

    loss, grad, hess, gap = at_point(b)
    for _ in range(steps):
        step = np.linalg.solve(hess, grad[:, :, None])[:, :, 0]
        new = at_point(b - step)
        while (worse := (new[0] > loss + 1e-12 * np.abs(loss)) & (np.abs(step).max(1) > 1e-10)).any():
            step[worse] /= 2
            new = at_point(b - step)
        b, (loss, grad, hess, gap) = b - step, new
        if np.abs(step).max() < 1e-9:
            break
    return b, np.sqrt(2) * gap


@dataclass(frozen=True)
class Machines:
    """The fits of all folds: one map, and coefficients and gap of each."""

    to: Map
    folds: list[int]
    b: np.ndarray
    gaps: np.ndarray

    def gap(self, fold: int) -> float:
        return float(self.gaps[self.folds.index(fold)])


def fit_svm(rows: DataFrame, p: int, s: Svm) -> Machines | None:
    """rows: x_0 .., y (0 or 1), w, f (fold, -1 for rows outside training), id. None if no fold has both classes."""
    xs = [f"x_{j}" for j in range(p)]
    fit = rows.filter("f <> -1")
    count = {(r.f, int(r.y)): r.n for r in fit.groupBy("f", "y").agg(F.sum("w").alias("n")).collect()}
    folds = np.array([-1, *sorted({f for f, _ in count})], np.int64)
    mass = np.array([[sum(n for (f, c), n in count.items() if f != j and c == y) for y in (0, 1)] for j in folds.tolist()])
    ok = (mass > 0).all(1)
    folds, mass = folds[ok], mass[ok]
    if not len(folds):
        return None
    weight = mass.sum(1, keepdims=True) / (2 * mass) if s.balanced else np.ones_like(mass)
    to = _map(fit, xs, s)
    q = (to.root.shape[1] if to.root is not None else p) + 1
    size = max(1, models.FOLD_CELLS // q**2)
    parts = [_fit(fit, xs, to, folds[i : i + size], weight[i : i + size], s.c) for i in range(0, len(folds), size)]
    return Machines(to, folds.tolist(), np.concatenate([b for b, _ in parts]), np.concatenate([g for _, g in parts]))


#: Rows nearest to the margin of the fit of all rows that every left-out fold decides anew.
BAND = 4096
FOLD = "fold long, b array<double>, fine boolean"


def _many_folds(rows: DataFrame, p: int, s: Svm) -> tuple[Map, DataFrame] | None:
    """The map, and (fold, b) of every fold, in work that grows with the rows and not with rows times folds.

    Rows on one side of the margin add a quadratic form to the loss, or nothing. The form of all rows is summed up once, about the fit of all of them, and a subject's own
    is taken off. Only rows that change sides between the two fits spoil this, so the BAND rows nearest to the margin are held one by one; if no
    other row can have changed sides (|phi| |b - b_all| < the band's width for the greatest |phi|), the fold's fit is exact. The folds for which that fails are fitted on all rows.
    """
    xs = [f"x_{j}" for j in range(p)]
    spark = rows.sparkSession
    fit = rows.filter("f <> -1")
    mass_all = np.zeros(2)
    for r in fit.groupBy("y").agg(F.sum("w").alias("n")).collect():
        mass_all[int(r.y)] = r.n
    if not (mass_all > 0).all():
        return None
    weigh = lambda mass: mass.sum() / (2 * mass) if s.balanced else np.ones(2)
    to = _map(fit, xs, s)
    q, c = (to.root.shape[1] if to.root is not None else p) + 1, s.c
    b_all = _fit(fit, xs, to, np.array([-1], np.int64), weigh(mass_all)[None], c)[0][0]

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            phi = to(g[xs].to_numpy(float))
            yield g.assign(far=np.abs(1 - (2.0 * g["y"].to_numpy(int) - 1) * (phi @ b_all)), size=np.sqrt((phi**2).sum(1)))

    kinds = ", ".join(f"{x} double" for x in xs) + ", y double, w double, f long, id long, far double, size double"
    placed = stored(fit.select(*xs, "y", "w", "f", "id").mapInPandas(near, kinds), "margins")
    most = placed.agg(F.max("size")).first()[0]
    band = placed.orderBy("far", "id").limit(BAND + 1).toPandas()  # at most BAND + 1 rows
    width = float(band["far"].iloc[-1]) if len(band) > BAND else np.inf
    band = band[band["far"] < width]
    held = to(band[xs].to_numpy(float)), 2.0 * band["y"].to_numpy(int) - 1, band["y"].to_numpy(int), band["w"].to_numpy(float), band["f"].to_numpy(np.int64)

    def forms(phi: np.ndarray, y: np.ndarray, w: np.ndarray, far: np.ndarray) -> np.ndarray:
        """By class: w phi phi' and w sign phi over active rows outside the band; and the class's w."""
        sign, out = 2.0 * y - 1, np.zeros((2, q * q + q + 1))
        on = (1 - sign * (phi @ b_all) > 0) & (far >= width)
        for k in (0, 1):
            at = on & (y == k)
            out[k, : q * q] = ((phi[at] * w[at, None]).T @ phi[at]).ravel()
            out[k, q * q : -1] = (w[at] * sign[at]) @ phi[at]
            out[k, -1] = w[y == k].sum()
        return out

    def of(g: pd.DataFrame) -> tuple[np.ndarray, ...]:
        return to(g[xs].to_numpy(float)), g["y"].to_numpy(int), g["w"].to_numpy(float), g["far"].to_numpy(float)

    total = tree_sum(placed, lambda batches: sum((forms(*of(g)) for g in batches), np.zeros((2, q * q + q + 1))).ravel()).reshape(2, -1)
    phi_band, sign_band, y_band, w_band, f_band = held

    def solve(fold: int, own: np.ndarray) -> tuple[np.ndarray, bool] | None:
        left = total - own
        mass = left[:, -1]
        if not (mass > 1e-9 * mass_all).all():
            return None
        class_weight = weigh(mass)
        hess = np.eye(q) + 2 * c * np.einsum("k,kij->ij", class_weight, left[:, : q * q].reshape(2, q, q))
        grad = 2 * c * class_weight @ left[:, q * q : -1]
        w = w_band * class_weight[y_band] * (f_band != fold)
        b, on = b_all, None
        for _ in range(60):  # Newton: exact once the band's sides stay as they are
            now = (1 - sign_band * (phi_band @ b) > 0) & (w > 0)
            if on is not None and (now == on).all():
                return b, bool(most * np.linalg.norm(b - b_all) < width)
            on, x = now, phi_band[now]
            b = np.linalg.solve(hess + 2 * c * (x * w[now, None]).T @ x, grad + 2 * c * (w[now] * sign_band[now]) @ x)
        return b, False

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by fold; one fold's sums at a time."""
        at, own, out = None, None, []

        def done() -> None:
            if at is not None and (r := solve(at, own)) is not None:
                out.append((at, r[0].tolist(), r[1]))

        for g in batches:
            f, parts = g["f"].to_numpy(np.int64), of(g)
            cuts = [0, *(np.flatnonzero(f[1:] != f[:-1]) + 1).tolist(), len(f)]
            for i, j in zip(cuts, cuts[1:], strict=False) if len(f) else ():
                if at != int(f[i]):
                    done()
                    at, own = int(f[i]), np.zeros_like(total)
                own += forms(*(v[i:j] for v in parts))
            if out:
                yield pd.DataFrame(out, columns=["fold", "b", "fine"])
                out.clear()
        done()
        yield pd.DataFrame(out, columns=["fold", "b", "fine"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fits = stored(placed.repartition(tasks, "f").sortWithinPartitions("f").mapInPandas(run, FOLD), "fits")
    own = [(-1, b_all.tolist())]
    again = [r.fold for r in fits.filter("not fine").select("fold").collect()]
    size = max(1, models.FOLD_CELLS // q**2)
    for i in range(0, len(again), size):
        some = np.array(again[i : i + size], np.int64)
        mass = {f: mass_all.copy() for f in some.tolist()}
        for r in fit.filter(F.col("f").isin(some.tolist())).groupBy("f", "y").agg(F.sum("w").alias("n")).collect():
            mass[r.f][int(r.y)] -= r.n
        b = _fit(fit, xs, to, some, np.stack([weigh(mass[f]) for f in some.tolist()]), c)[0]
        own += [(int(f), v.tolist()) for f, v in zip(some, b, strict=True)]
    return to, fits.filter("fine").select("fold", "b").unionByName(spark.createDataFrame(own, "fold long, b array<double>"))


def _decisions(rows: DataFrame, to: Map, fits: DataFrame, xs: list[str], schema: str, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            f = (to(g[xs].to_numpy(float)) * np.stack(g["b"].to_list())).sum(1) if len(g) else np.zeros(0)
            yield g[keep].assign(decision=f)

    return rows.join(fits, "fold").mapInPandas(run, schema)


def loso_svm(df: DataFrame, columns: list[str], label: str, train: Column, s: Svm = Svm(), key: str = "segment_id", by: str = "subject", weight: str | None = None, learn: Column | None = None) -> DataFrame:
    """(key, by, fold, decision, proba): training subjects by the fit that left them out, other rows by that of all training rows (fold -1).

    proba: Platt's sigmoid of the decision values, fitted on those of left-out training rows. Rows of folds without both classes aren't scored.
    """
    known = F.coalesce(learn, F.lit(False)) if learn is not None else F.lit(True)
    own = F.when(train, F.col(by).cast("long")).otherwise(-1)
    rows = df.select(
        F.col(key), F.col(by), own.alias("fold"), known.alias("known"), *[F.col(f"`{c}`").cast("double").alias(f"x_{j}") for j, c in enumerate(columns)],
        F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), F.xxhash64(key).alias("id"),
    ).persist()
    p = len(columns)
    xs = [f"x_{j}" for j in range(p)]
    try:
        used = rows.filter("known and y is not null").withColumnRenamed("fold", "f")
        many = used.filter("f <> -1").select("f").distinct().count() > models.MANY_FOLDS
        fits = _many_folds(used, p, s) if many else fit_svm(used, p, s)
        kinds = {f.name: f.dataType.simpleString() for f in df.schema}
        schema = f"`{key}` {kinds[key]}, `{by}` {kinds[by]}, fold long, y double, known boolean, decision double"
        if fits is None:
            return df.sparkSession.createDataFrame([], f"`{key}` {kinds[key]}, `{by}` {kinds[by]}, fold long, decision double, proba double")
        number = {} if many else {f: j for j, f in enumerate(fits.folds)}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for g in batches:
                j = g["fold"].map(number)
                g, j = g[j.notna()], j[j.notna()].astype(int).to_numpy()
                f = (fits.to(g[xs].to_numpy(float)) * fits.b[j]).sum(1) if len(g) else np.zeros(0)
                yield g[[key, by, "fold", "y", "known"]].assign(decision=f)

        scored = stored(_decisions(rows, *fits, xs, schema, [key, by, "fold", "y", "known"]), "decisions") if many else rows.mapInPandas(run, schema)
        out = scored.filter("fold <> -1 and known and y is not null").groupBy(F.col("decision").alias("p")).agg(F.sum("y").alias("s"), F.count(F.lit(1)).cast("double").alias("n")).persist()
        a, b = models._platt(out) if not out.isEmpty() else (1.0, 0.0)
        out.unpersist()
    finally:
        rows.unpersist()
    return scored.select(key, by, "fold", "decision", (1 / (1 + F.exp(-(F.lit(a) * F.col("decision") + F.lit(b))))).alias("proba"))
