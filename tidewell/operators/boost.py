"""Gradient boosting on histograms of quantile bins, for all validation folds at once.

Rows become blocks of bin numbers, written once. A level of a round's trees is one pass over the blocks: every task sums
gradients and curvatures by (model, node, feature, bin), the sums of a (model, node, feature) meet in one task, which finds
its best cut, and the driver gets one candidate each. Models are a fold and, for several classes, a class; they share the
passes. Margins are written every few rounds, so a pass meets few trees, and a lost executor costs no round.

Bins are cut at quantiles of all training rows, without their labels, for all folds; nulls and NaN have a bin of their own, and a
cut sends them to the better side. The loss is logistic, or softmax over several classes.

Beyond models.MANY_FOLDS folds, rows with the same bins become one, with their weights by class. Where these distinct rows fit a task, folds are dealt
over tasks, and a task fits its folds on them, less what their own subjects weigh; nothing of a fold passes the driver. With two classes, folds whose trees are
cut alike share the pass over these rows, and each takes its regions only. Otherwise the folds are fitted on the blocks, some at a time, which is rows times folds, in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.sources.io import read_json, write_json
from tidewell.sources.shared import stored

from . import models

#: Numbers in the histograms of one pass (32 MB); more models take more passes.
CELLS = 4_000_000
#: Rounds between two writings of the margins.
STRIDE = 10
#: Rows of a block as it is written, and blocks that a pass works on at once. Spark reads and hands over thousands of blocks in one batch, so they are small.
BLOCK_ROWS, JOINED = 64, 64
#: Most relative error of a bin edge's rank.
ACCURACY = 10_000
LEAST_GAIN = 1e-6
#: Bytes of distinct rows of bins, with their weights, that a task may hold; and distinct rows (or regions, or sums of a histogram) times models that it works on at once.
DISTINCT, AT_ONCE = 32 << 20, 1 << 19
#: Folds of two classes that are fitted together at most.
TOGETHER = 4096


@dataclass(frozen=True)
class Boosting:
    rounds: int = 200
    depth: int = 4
    rate: float = 0.08
    bins: int = 128
    ridge: float = 1.0
    least_weight: float = 1.0  #: curvature that a child must have
    subsample: float = 1.0  #: share of rows of a round, by a hash of key and round
    column_share: float = 1.0  #: share of features of a round
    patience: int | None = None  #: rounds without a better loss on held rows after which a fold stops
    held_share: float = 0.15  #: of the training rows, by a hash of the key, if patience is set
    balanced: bool = False
    seed: int = 42


@dataclass
class Trees:
    """One round of m models: cut nodes by level, then the leaves' values. feature -1: not cut, all go left."""

    feature: np.ndarray  # m x (2**depth - 1)
    cut: np.ndarray  # last bin that goes left
    null_left: np.ndarray
    value: np.ndarray  # m x 2**depth

    def leaves(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """Node of every row and model at that depth."""
        rows, models = np.arange(len(bins))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(bins), len(self.feature)), np.int64)
        for level in range(depth):
            at = 2**level - 1 + node
            f = self.feature[models, at]
            b = bins[rows, f]
            node = 2 * node + ((f >= 0) & np.where(b == 0, ~self.null_left[models, at], b > self.cut[models, at]))
        return node

    def margin(self, bins: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.value.shape[1]))
        return self.value[np.arange(len(self.value))[None, :], self.leaves(bins, depth)]

    def only(self, models: np.ndarray) -> Trees:
        return Trees(self.feature[models], self.cut[models], self.null_left[models], self.value[models])


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers from 1: values up to the first edge, and so on; 0 for NaN."""
    return np.stack([np.where(np.isnan(c), 0, np.searchsorted(e, c, "left") + 1) for c, e in zip(x.T, edges, strict=True)], 1).astype(np.uint8)


def unit(ids: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit hashes and a salt."""
    with np.errstate(over="ignore"):
        z = ids.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(salt + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) / 2.0**64


def slopes(margin: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients and curvatures of every model, and losses of every fold. margin: rows x (folds * k), k classes of a fold adjacent, 1 for two classes."""
    if classes == 2:
        p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        return p - y[:, None], np.maximum(p * (1 - p), 1e-16), np.logaddexp(0, margin) - y[:, None] * margin
    m = margin.reshape(len(margin), -1, classes)
    m = m - m.max(axis=2, keepdims=True)
    total = np.log(np.exp(m).sum(axis=2, keepdims=True))
    p, hit = np.exp(m - total), np.eye(classes)[y.astype(int)][:, None, :]
    flat = lambda a: a.reshape(margin.shape)
    return flat(p - hit), flat(np.maximum(2 * p * (1 - p), 1e-16)), (total - m)[np.arange(len(m)), :, y.astype(int)]


def best_cuts(g: np.ndarray, h: np.ndarray, s: Boosting) -> tuple[np.ndarray, ...]:
    """For histograms (one a row, bin 0 null): gain, cut, null_left, and the sums left of it and in all."""
    total_g, total_h = g.sum(1), h.sum(1)
    gl, hl = g[:, 1:].cumsum(1)[:, :-1], h[:, 1:].cumsum(1)[:, :-1]
    gl, hl = (np.stack((a, a + b[:, :1]), 1) for a, b in ((gl, g), (hl, h)))  # nulls right, nulls left
    gr, hr = total_g[:, None, None] - gl, total_h[:, None, None] - hl
    gain = gl**2 / (hl + s.ridge) + gr**2 / (hr + s.ridge) - (total_g**2 / (total_h + s.ridge))[:, None, None]
    gain = np.where((hl >= s.least_weight) & (hr >= s.least_weight), gain, -np.inf).reshape(len(g), -1)
    at, rows = gain.argmax(1), np.arange(len(g))
    pick = lambda a: a.reshape(len(g), -1)[rows, at]
    width = gl.shape[2]
    return gain[rows, at], at % width + 1, at >= width, pick(gl), pick(hl), total_g, total_h


@dataclass
class Boosted:
    """Fitted trees of every fold; plain values in store(), so that they are kept as JSON."""

    columns: list[str]
    edges: list[np.ndarray]
    folds: list[int]
    classes: int
    base: np.ndarray  # m
    rounds: list[Trees]
    best: list[int]  #: rounds that count, of each fold
    losses: list[tuple[int, int, float, float | None, float | None]] = field(default_factory=list)
    gains: np.ndarray | None = None  #: folds x features

    @property
    def k(self) -> int:
        return 1 if self.classes == 2 else self.classes

    def margins(self, bins: np.ndarray, fold: int) -> np.ndarray:
        """rows x k of one fold's model."""
        j = self.folds.index(fold)
        own = np.arange(j * self.k, (j + 1) * self.k)
        return sum((t.only(own).margin(bins) for t in self.rounds[: self.best[j]]), np.broadcast_to(self.base[own], (len(bins), self.k)))

    def score(self, df: DataFrame, keep: list[str], fold: Column | None = None) -> DataFrame:
        """keep, fold and proba (of class 1), or proba_0 .. of several classes. fold: whose model scores a row, -1 unless given; rows of unknown folds are left out."""
        kinds = {f.name: f.dataType.simpleString() for f in df.schema}
        names = ["proba"] if self.classes == 2 else [f"proba_{c}" for c in range(self.classes)]
        xs = [f"__x{i}" for i in range(len(self.columns))]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                bins, of = to_bins(b[xs].to_numpy(float), self.edges), b["fold"].to_numpy()
                p = np.full((len(b), len(names)), np.nan)
                for f in np.unique(of):
                    if int(f) in self.folds:
                        m = self.margins(bins[of == f], int(f))
                        e = np.exp(m - m.max(1, keepdims=True))
                        p[of == f] = 1 / (1 + np.exp(-np.clip(m, -500, 500))) if self.classes == 2 else e / e.sum(1, keepdims=True)
                known = ~np.isnan(p[:, 0])
                yield pd.concat([b[[*keep, "fold"]].reset_index(drop=True), pd.DataFrame(p, columns=names)], axis=1)[known]

        rows = df.select(*keep, (fold if fold is not None else F.lit(-1)).cast("long").alias("fold"), *[F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(self.columns, xs, strict=True)])
        return rows.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", fold long, " + ", ".join(f"{n} double" for n in names))

    def curve(self, spark) -> DataFrame:
        """(fold, round, fit_loss, held_loss, left_out_loss): mean losses after so many rounds; null where there are no such rows."""
        return spark.createDataFrame(self.losses, "fold long, round int, fit_loss double, held_loss double, left_out_loss double")

    def importances(self, spark, fold: int = -1) -> DataFrame:
        """(feature, gain, share) of one fold's cuts, the greatest first."""
        g = self.gains[self.folds.index(fold)]
        rows = [(c, float(v), float(v / g.sum()) if g.sum() > 0 else 0.0) for c, v in zip(self.columns, g, strict=True)]
        return spark.createDataFrame(rows, "feature string, gain double, share double").orderBy(F.desc("gain"), "feature")

    def store(self) -> dict:
        trees = [{k: v.tolist() for k, v in vars(t).items()} for t in self.rounds]
        return {"columns": self.columns, "edges": [e.tolist() for e in self.edges], "folds": self.folds, "classes": self.classes, "base": self.base.tolist(), "best": self.best, "losses": self.losses, "gains": self.gains.tolist(), "trees": trees}

    @classmethod
    def restore(cls, d: dict) -> Boosted:
        trees = [Trees(*(np.array(t[k], kind) for k, kind in (("feature", int), ("cut", int), ("null_left", bool), ("value", float)))) for t in d["trees"]]
        return cls(d["columns"], [np.array(e) for e in d["edges"]], d["folds"], d["classes"], np.array(d["base"]), trees, d["best"], [tuple(x) for x in d["losses"]], np.array(d["gains"]))


def save_boosted(spark, path: str, model: Boosted, **settings) -> None:
    write_json(spark, path, {"model": model.store(), "settings": settings})


def load_boosted(spark, path: str) -> tuple[Boosted, dict]:
    d = read_json(spark, path)
    return Boosted.restore(d["model"]), d["settings"]


def quantile_edges(df: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """Upper edges of all bins but the last, by one aggregate; equal edges are one."""
    q = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    row = df.agg(*[F.percentile_approx(known(c), q, ACCURACY).alias(f"e{i}") for i, c in enumerate(columns)], *[F.max(known(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return [np.unique([v for v in row[f"e{i}"] or [] if v < row[f"m{i}"]]) for i in range(len(columns))]


def _blocks(rows: DataFrame, xs: list[str], edges: list[np.ndarray]) -> DataFrame:
    """Blocks of bin numbers, labels, weights, folds and hashes, with no margins yet; small inputs are dealt to all cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores, "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g in (b.iloc[i : i + 4096] for i in range(0, len(b), 4096)):
                cols = {"y": g["y"].to_numpy(np.float64), "w": g["w"].to_numpy(np.float64), "fold": g["fold"].to_numpy(np.int64), "id": g["id"].to_numpy(np.int64)}
                cols = {"bins": to_bins(g[xs].to_numpy(float), edges), **cols}
                starts = range(0, len(g), BLOCK_ROWS)
                yield pd.DataFrame({**{c: [v[i : i + BLOCK_ROWS].tobytes() for i in starts] for c, v in cols.items()}, "margin": [b""] * len(starts)})

    return stored(rows.mapInPandas(run, "bins binary, y binary, w binary, fold binary, id binary, margin binary"), "blocks")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Blocks of a task, neighbouring ones as one."""
    for b in batches:
        for i in range(0, b.num_rows, JOINED):
            yield {c: b"".join(v) for c, v in b.slice(i, JOINED).to_pydict().items()}


class _Pass:
    """What a task needs for a pass: the models of this pass and the trees since the margins were written."""

    def __init__(self, s: Boosting, folds: np.ndarray, classes: int, width: int, base: np.ndarray, weight: np.ndarray, since: list[Trees], done: int):
        self.s, self.folds, self.classes, self.width, self.base, self.weight, self.since, self.done = s, folds, classes, width, base, weight, since, done
        self.k = 1 if classes == 2 else classes

    def read(self, r: dict) -> tuple[np.ndarray, ...]:
        bins = np.frombuffer(r["bins"], np.uint8).reshape(-1, self.width)
        y, w = (np.frombuffer(r[c], np.float64) for c in ("y", "w"))
        fold, ids = (np.frombuffer(r[c], np.int64) for c in ("fold", "id"))
        start = np.frombuffer(r["margin"], np.float64).reshape(len(y), -1) if r["margin"] else np.broadcast_to(self.base, (len(y), len(self.base)))
        return bins, y, w, fold, ids, sum((t.margin(bins) for t in self.since), start)

    def roles(self, w: np.ndarray, y: np.ndarray, fold: np.ndarray, ids: np.ndarray, some: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights of rows to fit, held and left out, rows x folds."""
        folds = self.folds[some]
        own = fold[:, None] == folds
        part = w[:, None] * self.weight[some][:, y.astype(int)].T
        learns = (fold[:, None] >= 0) & ~own
        held = learns & ((unit(ids, self.s.seed) < self.s.held_share)[:, None] if self.s.patience else False)
        return part * (learns & ~held), part * held, part * (own | ((fold[:, None] == -1) & (folds == -1)))

    def sums(self, blocks: DataFrame, level: int, tree: Trees | None, features: np.ndarray, some: slice) -> DataFrame:
        """(key, data): histograms of the models of the folds `some` by key ((model * nodes + node) * features + feature); key -1 at level 0: losses."""
        s, k, nb = self.s, self.k, self.s.bins + 1
        models = slice(some.start * k, some.stop * k)
        m, nodes, p = models.stop - models.start, 2**level, len(features)
        now = None if tree is None else tree.only(np.arange(models.start, models.stop))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hist, losses = np.zeros((2, p, m * nodes * nb)), np.zeros((6, some.stop - some.start))
            for r in _joined(batches):
                bins, y, w, fold, ids, margin = self.read(r)
                fit, held, out = self.roles(w, y, fold, ids, some)
                g, h, loss = slopes(margin[:, models], y, self.classes)
                if level == 0:
                    losses += np.stack([x for part in (fit, held, out) for x in ((part * loss).sum(0), part.sum(0))])
                if s.subsample < 1:
                    fit = fit * (unit(ids, s.seed + 7919 * (self.done + 1)) < s.subsample)[:, None]
                part = np.repeat(fit, k, axis=1)
                node = now.leaves(bins, level) if now is not None and level else np.zeros(part.shape, np.int64)
                slot = (np.arange(m)[None, :] * nodes + node) * nb
                use = part > 0
                slot, g, h = slot[use], (part * g)[use], (part * h)[use]
                row = np.nonzero(use)[0]
                for i, f in enumerate(features):
                    at = slot + bins[row, f]
                    hist[0, i] += np.bincount(at, g, m * nodes * nb)
                    hist[1, i] += np.bincount(at, h, m * nodes * nb)
            both = hist.reshape(2, p, m * nodes, nb).transpose(2, 1, 0, 3).reshape(-1, 2 * nb)
            there = np.flatnonzero(both[:, nb:].any(axis=1))
            base = models.start * nodes * p
            keys, data = [*(base + there).tolist()], [both[i].tobytes() for i in there]
            if level == 0:
                keys, data = [*keys, -1 - some.start], [*data, losses.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(data, pa.binary())], ["key", "data"])

        return blocks.mapInArrow(run, "key long, data binary")


CANDIDATE = "key long, gain double, cut int, null_left boolean, gl double, hl double, g double, h double, extra binary"


def _candidates(parts: DataFrame, s: Boosting) -> DataFrame:
    """The best cut of every key, from the sums of all tasks; negative keys have their sums only. Keys are sorted, so a task holds one sum at a time."""
    nb = s.bins + 1

    def give(keys: list[int], sums: list[np.ndarray]) -> pa.RecordBatch:
        out = {n: [] for n in ("key", "gain", "cut", "null_left", "gl", "hl", "g", "h", "extra")}
        at = [i for i, k in enumerate(keys) if k >= 0]
        if at:
            both = np.stack([sums[i] for i in at])
            for n, v in zip(("gain", "cut", "null_left", "gl", "hl", "g", "h"), best_cuts(both[:, :nb], both[:, nb:], s), strict=True):
                out[n] = v.tolist()
            out["key"], out["extra"] = [keys[i] for i in at], [None] * len(at)
        for i, k in enumerate(keys):
            if k < 0:
                for n in out:
                    out[n].append(k if n == "key" else sums[i].tobytes() if n == "extra" else None)
        kinds = [pa.int64(), pa.float64(), pa.int32(), pa.bool_(), *[pa.float64()] * 4, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = [], []
        for b in batches:
            for key, data in zip(b.column("key").to_pylist(), b.column("data").to_pylist(), strict=True):
                v = np.frombuffer(data)
                if keys and keys[-1] == key:
                    sums[-1] = sums[-1] + v
                    continue
                if len(keys) >= 4096:
                    yield give(keys, sums)
                    keys, sums = [], []
                keys.append(key)
                sums.append(v)
        if keys:
            yield give(keys, sums)

    return parts.repartition("key").sortWithinPartitions("key").mapInArrow(run, CANDIDATE)


def fit_boosting(
    df: DataFrame, columns: list[str], label: str, train: Column, s: Boosting = Boosting(), classes: int = 2, leave_out: bool = True, key: str = "segment_id", by: str = "subject", weight: str | None = None, learn: Column | None = None
) -> Boosted:
    """Models of every left-out training subject (leave_out) and of all training rows (fold -1). Labels are 0 .. classes - 1.

    learn restricts the rows that are learned from. Rows outside train are watched by fold -1: their loss is in the curve.
    """
    rows, xs, edges = _learned(df, columns, label, train, s, leave_out, key, by, weight, learn)
    count = {(r.fold, int(r.y)): r.n for r in rows.filter("fold >= 0").groupBy("fold", "y").agg(F.sum("w").alias("n")).collect()}
    folds = np.array([-1, *(sorted({f for f, _ in count}) if leave_out else [])], np.int64)
    mass = np.array([[sum(n for (f, c), n in count.items() if f != j and c == y) for y in range(classes)] for j in folds])
    return _fit(_blocks(rows, xs, edges), list(columns), edges, folds, mass, s, classes)


def _learned(df, columns, label, train, s: Boosting, leave_out: bool, key, by, weight, learn) -> tuple[DataFrame, list[str], list[np.ndarray]]:
    """Rows with x0 .., y, w, fold and id, their columns and the edges of their bins."""
    xs = [f"x{i}" for i in range(len(columns))]
    known = F.coalesce(learn, F.lit(False)) if learn is not None else F.lit(True)
    fold = F.when(~train, -1).when(known, F.col(by).cast("long") if leave_out else F.lit(0)).otherwise(-2)
    rows = df.select(
        *[F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(columns, xs, strict=True)], F.col(label).cast("double").alias("y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), fold.cast("long").alias("fold"), F.xxhash64(key).alias("id"),
    ).filter("y is not null and fold <> -2")
    if s.bins > 250:
        raise ValueError("at most 250 bins")
    return rows, xs, quantile_edges(rows.filter("fold >= 0"), xs, s.bins)


def _starts(mass: np.ndarray, s: Boosting, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Class weights and first margins of folds, from what the classes weigh in them."""
    weight_of = mass.sum(1, keepdims=True) / (classes * mass) if s.balanced else np.ones_like(mass)
    share = mass * weight_of / (mass * weight_of).sum(1, keepdims=True)
    return weight_of, np.log(share[:, 1] / share[:, 0]) if classes == 2 else np.log(share).ravel()


def _fit(blocks: DataFrame, columns: list[str], edges: list[np.ndarray], folds: np.ndarray, mass: np.ndarray, s: Boosting, classes: int) -> Boosted:
    ok = (mass > 0).all(axis=1)  # a fold without all classes has no model
    folds, mass = folds[ok], mass[ok]
    weight_of, base = _starts(mass, s, classes)
    k = 1 if classes == 2 else classes

    n_folds, p = len(folds), len(columns)
    out = Boosted(columns, edges, folds.tolist(), classes, base, [], [0] * n_folds, [], np.zeros((n_folds, p)))
    if not n_folds:
        return out
    since: list[Trees] = []
    low = np.full(n_folds, np.inf)
    for done in range(s.rounds + 1):
        state = _Pass(s, folds, classes, p, base, weight_of, since, done)
        last = done == s.rounds
        tree, losses = _grow(state, blocks, n_folds, k, p, out.gains, only_losses=last)
        mean = losses[:, 0::2] / np.where(losses[:, 1::2] > 0, losses[:, 1::2], np.nan)
        out.losses += [(int(f), done, *(None if np.isnan(v) else float(v) for v in row)) for f, row in zip(folds, mean, strict=True)]
        if s.patience:
            better = mean[:, 1] < low
            low = np.where(better, mean[:, 1], low)
            out.best = [done if b else was for b, was in zip(better, out.best, strict=True)]
            if all(done - b >= s.patience for b in out.best):
                break
        else:
            out.best = [done] * n_folds
        if last:
            break
        out.rounds.append(tree)
        since = [*since, tree]
        if len(since) == STRIDE:
            blocks, since = _written(_Pass(s, folds, classes, p, base, weight_of, since, done), blocks), []
    out.rounds = out.rounds[: max(out.best)]
    return out


def _written(state: _Pass, blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(margin=[state.read(r)[-1].tobytes() for r in b.to_dict("records")])

    return stored(blocks.mapInPandas(run, blocks.schema), "blocks")


def _grow(state: _Pass, blocks: DataFrame, n_folds: int, k: int, p: int, gains: np.ndarray, only_losses: bool) -> tuple[Trees | None, np.ndarray]:
    """The next round's trees of all models, level by level, and the losses before it (folds x 6). gains: what each feature's cuts gain, added up."""
    s = state.s
    m, inner = n_folds * k, 2**s.depth - 1
    rng = np.random.default_rng((s.seed, state.done))
    features = np.sort(rng.choice(p, max(1, round(p * s.column_share)), replace=False)) if s.column_share < 1 else np.arange(p)
    tree = Trees(np.full((m, inner), -1), np.zeros((m, inner), int), np.zeros((m, inner), bool), np.zeros((m, inner + 1)))
    sums = np.zeros((m, 2 * inner + 1, 2))  # gradient and curvature of every node
    losses = np.zeros((n_folds, 6))
    for level in range(1 if only_losses else s.depth):
        nodes, first = 2**level, 2**level - 1
        used = features[:1] if only_losses else features
        step = max(1, CELLS // (2 * k * nodes * len(used) * (s.bins + 1)))
        parts = [_candidates(state.sums(blocks, level, tree, used, slice(i, min(i + step, n_folds))), s) for i in range(0, n_folds, step)]
        found = sorted((r for part in parts for r in part.collect()), key=lambda r: r.key)
        for r in (r for r in found if r.key < 0):
            part = np.frombuffer(r.extra).reshape(6, -1).T
            losses[-1 - r.key : -1 - r.key + len(part)] = part
        if only_losses:
            return None, losses
        best: dict[tuple[int, int], tuple] = {}
        for r in (r for r in found if r.key >= 0):
            (j, node), i = divmod(r.key // len(used), nodes), r.key % len(used)
            if level == 0:
                sums[j, 0] = r.g, r.h
            if r.gain > LEAST_GAIN and (node == 0 and level == 0 or tree.feature[j, (first + node - 1) // 2] >= 0) and ((j, node) not in best or r.gain > best[j, node][0].gain):
                best[j, node] = r, int(used[i])
        for j in range(m):
            for node in range(nodes):
                at = first + node
                if (j, node) in best:
                    r, f = best[j, node]
                    tree.feature[j, at], tree.cut[j, at], tree.null_left[j, at] = f, r.cut, r.null_left
                    gains[j // k, f] += r.gain
                    left = np.array((r.gl, r.hl))
                    sums[j, 2 * at + 1], sums[j, 2 * at + 2] = left, np.array((r.g, r.h)) - left
                else:
                    sums[j, 2 * at + 1] = sums[j, at]
    ends = sums[:, inner:]
    tree.value[:] = np.where(ends[:, :, 1] > 0, -s.rate * ends[:, :, 0] / (ends[:, :, 1] + s.ridge), 0.0)
    return tree, losses


def loso_boosting(df: DataFrame, columns: list[str], label: str, train: Column, s: Boosting = Boosting(), classes: int = 2, key: str = "segment_id", by: str = "subject", weight: str | None = None, learn: Column | None = None) -> DataFrame:
    """(key, by, fold, proba), or proba_0 .. of several classes: training subjects by the model that left them out, other rows by that of all training rows (fold -1)."""
    own = F.when(train, F.col(by).cast("long")).otherwise(-1)
    rows, xs, edges = _learned(df, columns, label, train, s, True, key, by, weight, learn)
    learns = rows.filter("fold >= 0")
    if learns.select("fold").distinct().count() <= models.MANY_FOLDS:
        return fit_boosting(df, columns, label, train, s, classes, True, key, by, weight, learn).score(df, [key, by], own)
    if s.subsample == 1 and s.patience is None and (found := _on_distinct(df, columns, label, own, edges, s, classes, key, by, weight, learn)) is not None:
        return found
    blocks, out = _blocks(rows, xs, edges), None
    total = np.zeros(classes)
    for r in learns.groupBy("y").agg(F.sum("w").alias("n")).collect():
        total[int(r.y)] = r.n
    folds = [-1, *sorted(r.fold for r in learns.select("fold").distinct().collect())]
    for i in range(0, len(folds), models.MANY_FOLDS):
        some = folds[i : i + models.MANY_FOLDS]
        mass = {f: total.copy() for f in some}
        for r in learns.filter(F.col("fold").isin(some)).groupBy("fold", "y").agg(F.sum("w").alias("n")).collect():
            mass[r.fold][int(r.y)] -= r.n
        left = np.stack([mass[f] for f in some])
        model = _fit(blocks, list(columns), edges, np.array(some, np.int64), np.where(left > 1e-9 * total, left, 0.0), s, classes)
        scored = stored(model.score(df.filter(own.isin(some)), [key, by], own), "scores")
        out = scored if out is None else out.unionByName(scored)
    return out


def _on_distinct(df, columns, label, own: Column, edges, s: Boosting, classes: int, key, by, weight, learn) -> DataFrame | None:
    """loso_boosting with folds dealt over tasks, which hold the distinct rows of bins; None if these take more than DISTINCT bytes."""
    spark, p, names = df.sparkSession, len(columns), ["proba"] if classes == 2 else [f"proba_{c}" for c in range(classes)]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    xs, ws = [f"__x{i}" for i in range(p)], [f"w{c}" for c in range(classes)]
    known = F.coalesce(learn, F.lit(False)) if learn is not None else F.lit(True)
    rows = df.select(
        key, by, own.alias("fold"), *[F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(columns, xs, strict=True)], F.col(label).cast("double").alias("__y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"), (known & F.col(label).isNotNull()).alias("__learns"),
    ).filter("fold is not null")

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bins = to_bins(b[xs].to_numpy(float), edges).tobytes()
            yield b.drop(columns=xs).assign(bins=[bins[i : i + p] for i in range(0, len(bins), p)])

    coded = stored(rows.mapInPandas(code, f"`{key}` {kinds[key]}, `{by}` {kinds[by]}, fold long, __y double, __w double, __learns boolean, bins binary"), "coded")
    weighs = [F.sum(F.when(F.col("__learns") & (F.col("fold") >= 0) & (F.col("__y") == c), F.col("__w")).otherwise(0.0)).alias(w) for c, w in enumerate(ws)]
    parts = stored(coded.groupBy("fold", "bins").agg(*weighs, F.max(F.col("__learns") & (F.col("fold") >= 0)).alias("learns")), "parts")
    cells = stored(parts.groupBy("bins").agg(*[F.sum(w).alias(w) for w in ws]), "cells")
    if cells.count() * (p + 8 * classes) > DISTINCT:
        return None
    got = cells.toArrow()  # DISTINCT bytes at most
    cell = np.frombuffer(b"".join(got.column("bins").to_pylist()), f"S{p}")
    order = np.argsort(cell)
    held = spark.sparkContext.broadcast((cell[order], np.stack([got.column(w).to_numpy()[order] for w in ws], 1)))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by fold; some folds at a time."""
        cell, total = held.value
        bins = np.frombuffer(cell.tobytes(), np.uint8).reshape(-1, p)
        size = TOGETHER if classes == 2 else max(1, AT_ONCE // (len(cell) * len(names)))
        ids: list[int] = []
        own: list[list[pa.RecordBatch]] = []

        def done() -> pa.RecordBatch:
            groups = [pa.Table.from_batches(g) for g in own]
            at = [np.searchsorted(cell, np.frombuffer(b"".join(g.column("bins").to_pylist()), f"S{p}")) for g in groups]
            takes = [np.stack([g.column(w).to_numpy() for w in ws], 1) for g in groups]
            mass, least = total.sum(0) - np.stack([t.sum(0) for t in takes]), 1e-9 * total.sum(0)
            ok = np.flatnonzero((mass > least).all(1) & [f == -1 or any(g.column("learns").to_pylist()) for f, g in zip(ids, groups, strict=True)])
            if classes == 2:
                found = _own_probabilities(bins, total, [(at[j], takes[j]) for j in ok], s)
            else:
                left = np.repeat(total[None], len(ok), 0)
                for i, j in enumerate(ok):
                    left[i, at[j]] = np.maximum(left[i, at[j]] - takes[j], 0.0)
                found = [m[at[j]] for j, m in zip(ok, _probabilities(bins, left, left.sum(1), s, classes), strict=True)] if len(ok) else []
            fold = np.repeat([ids[j] for j in ok], [len(at[j]) for j in ok]).astype(np.int64)
            code = [b for j in ok for b in groups[j].column("bins").to_pylist()]
            v = np.concatenate(found) if len(ok) else np.zeros((0, len(names)))
            return pa.RecordBatch.from_arrays([pa.array(fold), pa.array(code, pa.binary()), *map(pa.array, v.T)], ["fold", "bins", *names])

        rows = 0
        for b in batches:
            f = b.column("fold").to_numpy()
            cuts = [0, *(np.flatnonzero(f[1:] != f[:-1]) + 1).tolist(), len(f)]
            for i, j in zip(cuts, cuts[1:], strict=False) if len(f) else ():
                if not ids or ids[-1] != f[i]:
                    if len(ids) >= size or rows >= AT_ONCE:
                        yield done()
                        ids, own, rows = [], [], 0
                    ids.append(int(f[i]))
                    own.append([])
                own[-1].append(b.slice(i, j - i))
                rows += j - i
        if ids:
            yield done()

    tasks = 4 * spark.sparkContext.defaultParallelism  # no more, since folds of one task share their passes
    if classes != 2:
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tasks)
    fitted = stored(parts.repartition(tasks, "fold").sortWithinPartitions("fold").mapInArrow(fit, "fold long, bins binary, " + ", ".join(f"{n} double" for n in names)), "fitted")
    return coded.select(key, by, "fold", "bins").join(fitted, ["fold", "bins"]).select(key, by, "fold", *names)


@dataclass
class _Alike:
    """Folds whose trees are cut alike so far, and the distinct rows' regions (by the rounds before) and nodes (in this round)."""

    folds: np.ndarray
    done: int
    level: int
    region: np.ndarray
    node: np.ndarray
    margin: np.ndarray  # folds x regions
    slope: np.ndarray | None = None  # gradient's part and curvature for one of weight, 2 x folds x regions
    sums: np.ndarray | None = None  # folds x nodes of all levels x 2
    cuts: np.ndarray | None = None  # nodes of the last level x (feature or -1, cut, null_left): not yet in node
    cut: np.ndarray | None = None  # which nodes of the level before were cut


def _numbered(code: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, all below most, and each one's place among them."""
    there = np.zeros(most, bool)
    there[code] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[code]


def _own_probabilities(bins: np.ndarray, total: np.ndarray, own: list[tuple[np.ndarray, np.ndarray]], s: Boosting) -> list[np.ndarray]:
    """rows x 1 of each fold: probabilities of two classes at its own rows, by a fit on all others. own: places of its rows in bins, and what they weigh by class; total: what all weigh.

    While trees are cut alike, a fold's margins are a number for each region, and its histograms are products of slopes by region and of what a region
    weighs by bin, less what its own rows have in them. Where cuts differ, folds part: at worst each is alone, with its pass over the distinct rows.
    """
    if not own:
        return []
    p, nb, inner, leaves = bins.shape[1], s.bins + 1, 2**s.depth - 1, 2**s.depth
    size = np.array([len(a) for a, _ in own])
    begin, at, takes = np.cumsum(size) - size, np.concatenate([a for a, _ in own]), np.concatenate([w for _, w in own])
    weight_of, base = _starts(total.sum(0) - np.stack([w.sum(0) for _, w in own]), s, 2)
    codes, first_of, whole = bins.T.astype(np.int64), np.arange(len(bins)) * p, total.sum(1)
    flat, out, nothing = bins.ravel(), [np.zeros((n, 1)) for n in size], np.zeros(len(bins), np.int64)

    def histograms(x: _Alike, features: np.ndarray, rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        """2 x folds x nodes x features x bins. rows: of own rows of the folds, and whose (of)."""
        n, nodes, scale = len(x.folds), 2**x.level, weight_of[x.folds]
        hist = np.zeros((2, n, nodes, len(features), nb))
        here, node = x.region[at[rows]], x.node[at[rows]]
        mine = takes[rows] * scale[of]
        slope = mine.sum(1) * x.slope[:, of, here]
        slope[0] -= mine[:, 1]
        for v in range(nodes):
            cells = np.flatnonzero(x.node == v)
            regions, place = _numbered(x.region[cells], x.margin.shape[1])
            slopes_of = x.slope[:, :, regions].reshape(2 * n, -1)
            for i, f in enumerate(features):
                code = codes[f, cells]
                for c in range(2) if s.balanced else (None,):
                    weighs = np.bincount(place * nb + code, (whole if c is None else total[:, c])[cells], len(regions) * nb).reshape(-1, nb)
                    hist[:, :, v, i] += (slopes_of @ weighs).reshape(2, n, nb) * (1.0 if c is None else scale[:, c, None])
                hist[0, :, v, i] -= scale[:, 1, None] * np.bincount(code, total[cells, 1], nb)
        for i, f in enumerate(features):
            code = codes[f, at[rows]]
            slot, shape = (of * nodes + node) * nb + code, (n, nodes, nb)
            for k in range(2):
                hist[k, :, :, i] -= np.bincount(slot, slope[k], n * nodes * nb).reshape(shape)
            all_of = np.bincount(x.node * nb + codes[f], whole, nodes * nb).reshape(nodes, nb)
            left = all_of - np.bincount(slot, takes[rows].sum(1), n * nodes * nb).reshape(shape)
            hist[:, :, :, i][:, left <= 1e-12 * all_of] = 0.0  # no rows but its own: nothing, not what differences leave
        return hist

    def parted(x: _Alike) -> list[_Alike]:
        """The folds by how they cut the nodes of x's level, most folds first."""
        nodes, first = 2**x.level, 2**x.level - 1
        rng = np.random.default_rng((s.seed, x.done))
        features = np.sort(rng.choice(p, max(1, round(p * s.column_share)), replace=False)) if s.column_share < 1 else np.arange(p)
        n = size[x.folds]
        of = np.repeat(np.arange(len(n)), n)
        rows = np.repeat(begin[x.folds] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        gain, cut, null_left, gl, hl, all_g, all_h = (v.reshape(len(n), nodes, -1) for v in best_cuts(*histograms(x, features, rows, of).reshape(2, -1, nb), s))
        if x.level == 0:
            x.sums[:, 0] = np.stack((all_g[:, 0, -1], all_h[:, 0, -1]), 1)
        gain = np.where((all_h > 0) & (gain > LEAST_GAIN), gain, -np.inf)
        pick = gain.argmax(2)[:, :, None]
        best = lambda a: np.take_along_axis(a, pick, 2)[:, :, 0]
        is_cut = (best(gain) > -np.inf) & (np.repeat(x.cut, 2) if x.level else True)
        mine, left, both = x.sums[:, first : first + nodes], np.stack((best(gl), best(hl)), 2), np.stack((best(all_g), best(all_h)), 2)
        x.sums[:, 2 * first + 1 : 2 * first + 1 + 2 * nodes : 2] = np.where(is_cut[:, :, None], left, mine)
        x.sums[:, 2 * first + 2 : 2 * first + 2 + 2 * nodes : 2] = np.where(is_cut[:, :, None], both - left, 0.0)
        cuts = np.stack((np.where(is_cut, features[pick[:, :, 0]], -1), np.where(is_cut, best(cut), 0), is_cut & best(null_left)), 2)
        kinds, which, many = np.unique(cuts.reshape(len(n), -1), axis=0, return_inverse=True, return_counts=True)
        groups = [(kinds[k].reshape(nodes, 3), slice(None) if len(kinds) == 1 else np.flatnonzero(which.ravel() == k)) for k in np.argsort(-many)]
        return [_Alike(x.folds[g], x.done, x.level, x.region, x.node, x.margin[g], x.slope[:, g], x.sums[g], k) for k, g in groups]

    waiting = [_Alike(np.arange(len(own)), 0, 0, nothing, nothing, base[:, None])]
    while waiting:
        x = waiting.pop()  # few folds before many, so that not many states wait
        if x.cuts is not None:
            number, (feature, cut, null_left) = np.arange(nb), x.cuts.T
            right = np.where(number == 0, null_left[:, None] == 0, number > cut[:, None]) & (feature >= 0)[:, None]
            x.node = 2 * x.node + right[x.node, flat[first_of + np.maximum(feature, 0)[x.node]]]
            x.level, x.cut, x.cuts = x.level + 1, feature >= 0, None
        if x.level == s.depth:
            ends = x.sums[:, inner:]
            with np.errstate(divide="ignore", invalid="ignore"):
                value = np.where(ends[:, :, 1] > 0, -s.rate * ends[:, :, 0] / (ends[:, :, 1] + s.ridge), 0.0)
            known, x.region = _numbered(x.region * leaves + x.node, x.margin.shape[1] * leaves)
            x.margin = x.margin[:, known // leaves] + value[:, known % leaves]
            x.done, x.level, x.node = x.done + 1, 0, nothing
        if x.level == 0:
            if x.done == s.rounds:
                for j, m in zip(x.folds, x.margin, strict=True):
                    out[j][:, 0] = 1 / (1 + np.exp(-np.clip(m[x.region[at[begin[j] : begin[j] + size[j]]]], -500, 500)))
                continue
            half = len(x.folds) // 2
            if half and len(x.folds) * max(x.margin.shape[1], leaves // 2 * p * nb) > AT_ONCE:
                waiting += [_Alike(x.folds[g], x.done, 0, x.region, nothing, x.margin[g].copy()) for g in (slice(half, None), slice(half))]
                continue
            q = 1 / (1 + np.exp(-np.clip(x.margin, -500, 500)))
            x.slope, x.sums = np.stack((q, np.maximum(q * (1 - q), 1e-16))), np.zeros((len(x.folds), 2 * inner + 1, 2))
        waiting += parted(x)
    return out


def _probabilities(bins: np.ndarray, weights: np.ndarray, mass: np.ndarray, s: Boosting, classes: int) -> np.ndarray:
    """folds x rows x probabilities: models of some folds at the distinct rows that they are fitted on. weights: folds x rows x classes."""
    weight_of, base = _starts(mass, s, classes)
    k, nb, (n, p) = 1 if classes == 2 else classes, s.bins + 1, bins.shape
    m, inner = len(weights) * k, 2**s.depth - 1
    weights = weights * weight_of[:, None, :]
    whole = weights.sum(2)
    codes, flat, first_of = bins.T.astype(np.int64), bins.ravel(), np.arange(n) * p
    margin = np.repeat(base[:, None], n, 1)
    for done in range(s.rounds):
        if k == 1:
            q = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            g, h = whole * q - weights[:, :, 1], whole * np.maximum(q * (1 - q), 1e-16)
        else:
            q = _softmax(margin, k)
            g, h = whole[:, None] * q - weights.transpose(0, 2, 1), whole[:, None] * np.maximum(2 * q * (1 - q), 1e-16)
            g, h = g.reshape(m, n), h.reshape(m, n)
        rng = np.random.default_rng((s.seed, done))
        features = np.sort(rng.choice(p, max(1, round(p * s.column_share)), replace=False)) if s.column_share < 1 else np.arange(p)
        feature, sums, node = np.full((m, inner), -1), np.zeros((m, 2 * inner + 1, 2)), np.zeros((m, n), np.int64)
        for level in range(s.depth):
            nodes, first = 2**level, 2**level - 1
            hist = np.empty((2, m, nodes, len(features), nb))
            for j in range(m):
                for i, f in enumerate(features):
                    at = node[j] * nb + codes[f] if level else codes[f]
                    hist[0, j, :, i] = np.bincount(at, g[j], nodes * nb).reshape(nodes, nb)
                    hist[1, j, :, i] = np.bincount(at, h[j], nodes * nb).reshape(nodes, nb)
            gain, cut, null_left, gl, hl, all_g, all_h = (v.reshape(m, nodes, -1) for v in best_cuts(*hist.reshape(2, -1, nb), s))
            if level == 0:
                sums[:, 0] = np.stack((all_g[:, 0, -1], all_h[:, 0, -1]), 1)
            gain = np.where((all_h > 0) & (gain > LEAST_GAIN), gain, -np.inf)
            pick = gain.argmax(2)[:, :, None]
            of = lambda a: np.take_along_axis(a, pick, 2)[:, :, 0]  # noqa: B023, E731
            is_cut = (of(gain) > -np.inf) & (feature[:, (first - 1 + np.arange(nodes)) // 2] >= 0 if level else True)
            feature[:, first : first + nodes] = np.where(is_cut, features[pick[:, :, 0]], -1)
            own, left = sums[:, first : first + nodes], np.stack((of(gl), of(hl)), 2)
            both = np.stack((of(all_g), of(all_h)), 2)
            sums[:, 2 * first + 1 : 2 * first + 1 + 2 * nodes : 2] = np.where(is_cut[:, :, None], left, own)
            sums[:, 2 * first + 2 : 2 * first + 2 + 2 * nodes : 2] = np.where(is_cut[:, :, None], both - left, 0.0)
            number = np.arange(nb)
            right = np.where(number == 0, ~of(null_left)[:, :, None], number > of(cut)[:, :, None]) & is_cut[:, :, None]
            for j in range(m):
                f = np.maximum(feature[j, first : first + nodes], 0)
                b = codes[f[0]] if nodes == 1 else flat[first_of + f[node[j]]]
                node[j] = 2 * node[j] + right[j].ravel()[node[j] * nb + b]
        ends = sums[:, inner:]
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(ends[:, :, 1] > 0, -s.rate * ends[:, :, 0] / (ends[:, :, 1] + s.ridge), 0.0)
        margin += np.take_along_axis(value, node, 1)
    return (1 / (1 + np.exp(-np.clip(margin, -500, 500))))[:, :, None] if k == 1 else _softmax(margin, k).transpose(0, 2, 1)


def _softmax(margin: np.ndarray, k: int) -> np.ndarray:
    """folds x k x rows, from (folds * k) x rows."""
    x = margin.reshape(-1, k, margin.shape[1])
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)
