"""Centroid clustering in exact integers, by kd-tree filtering.

Vectors are floor(scale * x). Each partition's vectors are cut into blocks, each block becomes a kd-tree whose nodes hold the
count, the integer sums and squares, and the box of their vectors; the trees are written once. In a round every node is
met with the centroids that can still be nearest to one of its vectors: a centroid is pruned where another is strictly
nearer in the whole box. A node with one centroid left is assigned whole from its sums, leaves with more are resolved
vector by vector. Only sums of each centroid and task leave a round.

Kept are vectors of exactly `size` components, none null or non-finite; the others are not in the result. Every kept row counts,
repeated ones too; a null id is hashed as the empty string. With fewer vectors than k there are as many centroids as
vectors. Ties go to the smaller centroid. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import exact_products, largest, matrix, points

BLOCK, LEAF = 4096, 16  #: vectors of a tree, most vectors of a leaf that can be cut
TREE = "ids array<long>, points binary, start array<int>, stop array<int>, child array<int>, low binary, high binary, sums binary, squares array<long>"


class Tree:
    """A kd-tree over the rows of q, which it puts in the order of its leaves. child: the first of two children, or -1 at leaves."""

    def __init__(self, q: np.ndarray):
        order, spans, child = np.arange(len(q)), [(0, len(q))], []
        low, high = [], []
        for a, b in spans:  # grows: children come after their parents
            rows = q[order[a:b]]
            low.append(rows.min(axis=0)), high.append(rows.max(axis=0))
            width = high[-1].astype(np.int64) - low[-1]
            if b - a <= LEAF or not width.any():
                child.append(-1)
                continue
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(rows[:, width.argmax()], mid)]
            child.append(len(spans))
            spans += [(a, a + mid), (a + mid, b)]
        self.order, self.q = order, q[order]
        self.start, self.stop = np.array(spans, np.int32).T
        self.child, self.low, self.high = np.array(child, np.int32), np.array(low, np.int32), np.array(high, np.int32)
        run = np.vstack((np.zeros((1, q.shape[1]), np.int64), self.q.cumsum(axis=0, dtype=np.int64)))
        squares = np.concatenate(([0], (self.q.astype(np.int64) ** 2).sum(axis=1).cumsum()))
        self.sums, self.squares = run[self.stop] - run[self.start], squares[self.stop] - squares[self.start]

    @classmethod
    def read(cls, row: dict, dims: int) -> Tree:
        t = cls.__new__(cls)
        t.q, t.low, t.high = (np.frombuffer(row[c], np.int32).reshape(-1, dims) for c in ("points", "low", "high"))
        t.sums = np.frombuffer(row["sums"], np.int64).reshape(-1, dims)
        t.start, t.stop, t.child, t.squares = (np.array(row[c]) for c in ("start", "stop", "child", "squares"))
        return t

    def row(self, ids: list) -> dict:
        return {
            "ids": [ids[i] for i in self.order], "points": self.q.tobytes(), "start": self.start, "stop": self.stop, "child": self.child,
            "low": self.low.tobytes(), "high": self.high.tobytes(), "sums": self.sums.tobytes(), "squares": self.squares,
        }

    def filter(self, c: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """("nodes", nodes, their centroids) assigned whole and ("rows", places, their centroids) resolved one by one; together all rows once."""
        most = max(largest(self.low), largest(self.high), largest(c))
        if 4 * most * most * c.shape[1] >= 1 << 62:
            raise ValueError("squared distances exceed 64 bits")
        low, high = 2 * self.low.astype(np.int64), 2 * self.high.astype(np.int64)
        nodes, alive = np.zeros(1, int), np.ones((1, len(c)), bool)
        while len(nodes):
            middle = (low[nodes] + high[nodes]) // 2
            far = ((middle[:, None, :] - 2 * c[None]) ** 2).sum(axis=2)
            best = c[np.where(alive, far, np.iinfo(np.int64).max).argmin(axis=1)][:, None, :]
            # |v-z|^2 - |v-best|^2 is linear in v: its least value over the box, by component
            gap, both = best - c[None], best + c[None]
            least = np.minimum(gap * (low[nodes][:, None, :] - both), gap * (high[nodes][:, None, :] - both)).sum(axis=2)
            alive &= least <= 0
            whole = alive.sum(axis=1) == 1
            yield "nodes", nodes[whole], alive[whole].argmax(axis=1)
            leaf = ~whole & (self.child[nodes] < 0)
            if leaf.any():
                rows = np.concatenate([np.arange(a, b) for a, b in zip(self.start[nodes[leaf]], self.stop[nodes[leaf]], strict=True)])
                yield "rows", rows, distances(self.q[rows], c).argmin(axis=1)
            inner = ~whole & ~leaf
            first = self.child[nodes[inner]]
            nodes, alive = np.concatenate((first, first + 1)), np.concatenate((alive[inner], alive[inner]))


def distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of q and c, exact."""
    bound = max(largest(q), largest(c)) ** 2 * c.shape[1]
    square = lambda x: (x.astype(np.int64) ** 2).sum(axis=1)
    return square(q)[:, None] - 2 * exact_products(q, c, bound) + square(c)[None, :]


def trees(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, size: int = 64, block: int = BLOCK) -> DataFrame:
    """The kept vectors as a stored table of kd-trees, one for each block of a partition."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []
        for batch in batches:
            for part in (batch.slice(a, block) for a in range(0, batch.num_rows, block)):
                if held and len(ids) + part.num_rows > block:
                    yield packed(ids, held)
                    ids, held = [], []
                ids += part.column("id").to_pylist()
                held.append(matrix(part.column("q")))
        if ids:
            yield packed(ids, held)

    def packed(ids: list, held: list) -> pa.RecordBatch:
        row = Tree(np.concatenate(held)).row(ids)
        kinds = {"ids": pa.int64(), "start": pa.int32(), "stop": pa.int32(), "child": pa.int32(), "squares": pa.int64()}
        cols = {c: pa.array([x], pa.list_(kinds[c]) if c in kinds else pa.binary()) for c, x in row.items()}
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return materialize(points(df, id_col, vec_col, scale, size).mapInArrow(build, TREE), "trees")


def start(df: DataFrame, k: int = 16, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, size: int = 64) -> np.ndarray:
    """The k kept vectors with the least sha256(seed:id), in that order; k rows come to the driver."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = points(df, id_col, vec_col, scale, size).select(h.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([r.q for r in first], np.int64).reshape(len(first), size)


def summaries(table: DataFrame, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and inertias of the vectors nearest to each centroid; a row for each centroid and component comes to the driver."""
    k, dims = c.shape

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, inertia = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        own = (c**2).sum(axis=1)
        for t in (Tree.read(r, dims) for batch in batches for r in batch.to_pylist()):
            for kind, at, to in t.filter(c):
                count, total, square = (t.stop[at] - t.start[at], t.sums[at], t.squares[at]) if kind == "nodes" else (np.ones(len(at), np.int64), t.q[at].astype(np.int64), (t.q[at].astype(np.int64) ** 2).sum(axis=1))
                np.add.at(n, to, count)
                np.add.at(sums, to, total)
                np.add.at(inertia, to, square - 2 * (total * c[to]).sum(axis=1) + count * own[to])
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(n[there]), pa.array(list(sums[there]), pa.list_(pa.int64())), pa.array(inertia[there])], ["cluster", "n", "sums", "inertia"])

    parts = table.mapInArrow(totals, "cluster int, n long, sums array<long>, inertia long")
    rows = parts.select("cluster", "n", "inertia", F.posexplode("sums").alias("j", "x")).groupBy("cluster", "j").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.sum("x").alias("x")).collect()
    n, sums, inertia = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
    for r in rows:
        n[r.cluster], inertia[r.cluster], sums[r.cluster, r.j] = r.n, r.inertia, r.x
    return n, sums, inertia


def assign(table: DataFrame, c: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector of the trees."""
    dims = c.shape[1]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            t = Tree.read(row, dims)
            to = np.zeros(len(t.q), np.int32)
            for kind, at, found in t.filter(c):
                if kind == "rows":
                    to[at] = found
                else:
                    for a, b, x in zip(t.start[at], t.stop[at], found, strict=True):
                        to[a:b] = x
            away = ((t.q.astype(np.int64) - c[to]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(to), pa.array(away)], ["vec_id", "cluster", "distance"])

    return table.mapInArrow(label, "vec_id long, cluster int, distance long")


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, size: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector after so many rounds."""
    table, c = trees(df, id_col, vec_col, scale, size), start(df, k, seed, id_col, vec_col, scale, size)
    for _ in range(rounds):
        n, sums, _ = summaries(table, c)
        c = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], c)  # // rounds down
    inertia = [int(x) for x in summaries(table, c)[2]]
    sha = [hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in c]
    each = [(j, inertia[j], sum(inertia), sha[j]) for j in range(len(c))]
    per = df.sparkSession.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assign(table, c).join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
