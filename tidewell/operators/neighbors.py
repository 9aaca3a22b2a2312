"""Exact nearest neighbours by pivots.

Rows are dealt to the cells of their nearest pivots (a bounded, seeded choice of rows); a cell knows its count and radius. A query is
first answered in its own cell. Its k-th distance there then rules out every other cell that lies farther, by the cell's
radius or by the plane between the two pivots; what is left is searched in a second pass, and the lists are merged. Cells are
dealt to groups. A query goes once to each group in which it asks cells, with their numbers, so where little can be ruled out, as
in many dimensions, it is copied to groups, not to cells. A group's rows are streamed past its queries in one task, in blocks of
bounded size, so neither a large cell nor a cell that many ask for makes a large task. There, a cell's rows and the queries that
ask it are parted into boxes of some dozens, and a box of queries meets boxes of rows, nearest first, until the next lies beyond
what its queries hold, so a cell's work grows with its queries, not with its queries times its rows, where dimensions are few.

Of equal vectors only those rows are searched that can be in a list: k with the same own, 2k in all, those with the smallest ids.
Whatever own a query has, k with another are among them, or all there are.

Ties go to the smaller id. Rows whose vectors are null, of another length than the first, or hold null or non-finite components take no part,
nor do rows without an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.sources.shared import stored


@dataclass(frozen=True)
class Pivots:
    most: int = 512  #: cells; else the square root of the number of rows
    groups: int | None = None  #: of cells; unless given, two for each task that can run, or one for each block_queries
    block_rows: int = 1 << 19  #: rows of a group in one task
    block_queries: int = 1 << 16  #: queries of a group in one task
    tile: int = 64  #: queries or rows in a box
    held_values: int = 1 << 20  #: components of a cell's rows that a task holds at once
    seed: int = 42


LIST = "array<struct<d:double,id:long,tag:double>>"
SLACK = 1e-9  #: share of a distance by which bounds are widened against rounding


def _points(df: DataFrame, id_col: str, vec_col: str, own: Column | None, tag: Column | None) -> DataFrame:
    v = F.col(f"`{vec_col}`").cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    out = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), (own if own is not None else F.col(f"`{id_col}`")).cast("long").alias("own"), (tag if tag is not None else F.lit(None)).cast("double").alias("tag"), v.alias("v"))
    return out.filter(fine & F.col("id").isNotNull())


def _of_copies(points: DataFrame, k: int) -> DataFrame:
    """points without the rows that k others with an equal vector and a smaller id keep out of every list. Spark drops most of them before the shuffles."""
    hashed = points.withColumn("__h", F.xxhash64("v"))  # sorts faster than vectors
    for keys, most in ((["__h", "v", "own"], k), (["__h", "v"], 2 * k)):
        hashed = hashed.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).filter(F.col("__n") <= most)
    return hashed.drop("__h", "__n")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows, to a rounding error of SLACK of the squared lengths."""
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0)


def _dealt(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """points with cell, the nearest pivot, and r, the distance to it. Vectors of another length are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"))
            cell = np.empty(len(x), np.int32)
            for i in range(0, len(x), 1024):
                cell[i : i + 1024] = _far(x[i : i + 1024], pivots).argmin(1)
            r = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(r)], [*b.schema.names, "cell", "r"])

    return points.filter(F.size("v") == pivots.shape[1]).mapInArrow(run, "id long, own long, tag double, v array<double>, cell int, r double")


def _boxes(x: np.ndarray, size: int) -> list[np.ndarray]:
    """The row numbers of x in parts of at most size: halves at the median of the widest dimension, again and again."""
    todo, out = [np.arange(len(x))], []
    while todo:
        i = todo.pop()
        if len(i) <= size:
            out.append(i)
            continue
        part, half = x[i], len(i) // 2
        order = np.argpartition(part[:, np.ptp(part, axis=0).argmax()], half)
        todo += [i[order[half:]], i[order[:half]]]
    return out


class _Block:
    """Running lists of the queries of one block. bound: squared distances beyond which a query needs no row."""

    def __init__(self, keys: np.ndarray, own: np.ndarray, bound: np.ndarray, q: np.ndarray, k: int, tile: int):
        self.keys, self.own, self.bound, self.q, self.k, self.tile = keys, own, bound, q, k, tile
        self.d, self.id, self.tag = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64), np.full((len(q), k), np.nan)

    def add(self, which: np.ndarray, ids: np.ndarray, own: np.ndarray, tag: np.ndarray, x: np.ndarray) -> None:
        """Rows of one cell, for the queries that ask it."""
        boxes = _boxes(x, self.tile)
        order, ends = np.concatenate(boxes), np.cumsum([len(b) for b in boxes])
        ids, own, tag, x = ids[order], own[order], tag[order], x[order]
        starts = np.append(0, ends[:-1])
        low, high, norm = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts), np.maximum.reduceat((x**2).sum(1), starts)
        for t in _boxes(self.q[which], self.tile):
            t = which[t]
            q = self.q[t]
            gap = np.maximum(np.maximum(low - q.max(0), q.min(0) - high), 0)
            least = (gap**2).sum(1) - SLACK * ((q**2).sum(1).max() + norm)
            near, at, n = np.argsort(least, kind="stable"), 0, 1
            while at < len(near) and least[near[at]] <= np.minimum(self.d[t].max(1), self.bound[t]).max():
                some = near[at : at + n]
                rows = np.concatenate([np.arange(starts[b], ends[b]) for b in some])
                for i in range(0, len(rows), 1024):
                    r = rows[i : i + 1024]
                    self._tile(t, ids[r], own[r], tag[r], x[r])
                at, n = at + n, min(2 * n, 16)

    def _tile(self, t: np.ndarray, ids: np.ndarray, own: np.ndarray, tag: np.ndarray, x: np.ndarray) -> None:
        q, most = self.q[t], np.minimum(self.d[t].max(1), self.bound[t])
        near = _far(q, x)
        near[self.own[t, None] == own[None, :]] = np.inf
        slack = SLACK * ((q**2).sum(1)[:, None] + (x**2).sum(1)[None, :])
        worst = most
        if near.shape[1] > self.k:  # the k-th best of this tile can't be beaten by what is farther
            worst = np.minimum(worst, np.partition(near + slack, self.k - 1, axis=1)[:, self.k - 1])
        a, b = np.nonzero((near - slack <= worst[:, None]) & (near < np.inf))
        if not len(a):
            return
        d = ((q[a] - x[b]) ** 2).sum(1)
        held = self.d[t] < np.inf
        rows = np.concatenate((a, np.nonzero(held)[0]))
        d, i, g = np.concatenate((d, self.d[t][held])), np.concatenate((ids[b], self.id[t][held])), np.concatenate((tag[b], self.tag[t][held]))
        order = np.lexsort((i, d, rows))
        rows, d, i, g = rows[order], d[order], i[order], g[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
        keep = place < self.k
        new = np.full((len(q), self.k), np.inf), np.zeros((len(q), self.k), np.int64), np.full((len(q), self.k), np.nan)
        for to, v in zip(new, (d, i, g), strict=True):
            to[rows[keep], place[keep]] = v[keep]
        self.d[t], self.id[t], self.tag[t] = new

    def lists(self) -> pa.RecordBatch:
        there = self.d < np.inf
        tag = self.tag[there]
        tops = pa.StructArray.from_arrays([pa.array(self.d[there]), pa.array(self.id[there]), pa.array(tag, mask=np.isnan(tag))], ["d", "id", "tag"])
        offsets = pa.array(np.concatenate(([0], there.sum(1).cumsum())).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(self.keys), pa.ListArray.from_arrays(offsets, tops)], ["key", "top"])


def _search(asked: DataFrame, rows: DataFrame, k: int, n_groups: int, s: Pivots) -> DataFrame:
    """(key, top) for every query and block of rows of a group that it asks. asked: key, own, theta, v, grp, cells; rows: id, own, tag, v, cell."""
    rows = rows.withColumn("grp", F.col("cell") % n_groups)
    counts = asked.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / s.block_queries).cast("int").alias("nq"))
    counts = counts.join(rows.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / s.block_rows).cast("int").alias("nr")), "grp")  # a row for each group
    blocks, deal = F.broadcast(counts), lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = asked.join(blocks, "grp").select("grp", deal("key", "nq").alias("bq"), every("nr").alias("br"), F.lit(-1).alias("cell"), "key", "own", F.col("theta").alias("tag"), "v", "cells")
    b = rows.join(blocks, "grp").select("grp", every("nq").alias("bq"), deal("id", "nr").alias("br"), "cell", F.col("id").alias("key"), "own", "tag", "v", F.lit(None).cast("array<int>").alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, queries, asks, block, of, held = None, [], [], None, {}, []

        def put() -> None:
            """The rows held, all of one cell, meet the queries that ask it."""
            if held:
                block.add(held[0][0], *map(np.concatenate, zip(*[h[1:] for h in held], strict=True)))
                held.clear()

        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in ("grp", "bq", "br", "cell")])
            cuts = np.flatnonzero((np.diff(place, axis=1) != 0).any(0)) + 1
            for i, j in zip([0, *cuts], [*cuts, batch.num_rows], strict=True) if batch.num_rows else ():
                if (now := tuple(place[:3, i])) != here:
                    put()
                    if block is not None:
                        yield block.lists()
                    here, queries, asks, block = now, [], [], None
                part = batch.slice(i, j - i)
                key, own, x = part.column("key").to_numpy(), part.column("own").fill_null(np.iinfo(np.int64).min).to_numpy(), _matrix(part.column("v"))
                tag = part.column("tag").to_numpy(zero_copy_only=False).astype(float)
                if place[3, i] < 0:
                    queries.append((key, own, tag**2 * (1 + SLACK), x))
                    asks.append((part.column("cells").value_lengths().to_numpy(), part.column("cells").flatten().to_numpy()))
                    continue
                if queries and block is None:
                    block = _Block(*map(np.concatenate, zip(*queries, strict=True)), k, s.tile)
                    sizes, cells = map(np.concatenate, zip(*asks, strict=True))
                    by = np.argsort(cells, kind="stable")
                    asker = np.repeat(np.arange(len(sizes)), sizes)[by]
                    names, first = np.unique(cells[by], return_index=True)
                    of = dict(zip(names.tolist(), np.split(asker, first[1:]), strict=True))
                if block is not None and (which := of.get(int(place[3, i]))) is not None:
                    if held and (held[0][0] is not which or sum(h[-1].size for h in held) + x.size > s.held_values):
                        put()
                    held.append((which, key, own, tag, x))
        put()
        if block is not None:
            yield block.lists()

    meet = a.unionByName(b).repartition("grp", "bq", "br").sortWithinPartitions("grp", "bq", "br", "cell")
    return meet.mapInArrow(run, f"key long, top {LIST}")


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """One list a query; of at most as many lists as there are blocks of cells that it asked."""
    return lists.groupBy("key").agg(F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top"))


def _others(asked: DataFrame, pivots: np.ndarray, radius: np.ndarray, n_groups: int) -> DataFrame:
    """asked (key, own, v, cell, r, theta) with a row for every group, and in it the other cells that may hold a nearer row."""
    gaps, group = np.sqrt(_far(pivots, pivots)), np.arange(len(pivots)) % n_groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, cell, theta = _matrix(b.column("v")), b.column("cell").to_numpy(), b.column("theta").to_numpy(zero_copy_only=False)
            for i in range(0, len(x), 256):
                part, own, most = x[i : i + 256], cell[i : i + 256], theta[i : i + 256, None]
                d2 = _far(part, pivots)
                slack = SLACK * ((part**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :])
                least = np.sqrt(d2) - radius[None, :]
                home = d2[np.arange(len(part)), own][:, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = np.where(gaps[own] > 0, (d2 - home) / (2 * gaps[own]), 0.0)
                wide = np.sqrt(slack) + SLACK * np.where(np.isfinite(most), most, 0)
                ask = (np.maximum(least, plane) - wide <= most) & (radius[None, :] >= 0)
                ask[np.arange(len(part)), own] = False
                row, to = np.nonzero(ask)
                order = np.lexsort((to, group[to], row))
                row, to = row[order], to[order]
                first = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(group[to]) != 0)))) if len(row) else np.zeros(0, int)
                keep = b.slice(i, len(part)).select(["key", "own", "theta", "v"]).take(pa.array(row[first]))
                cells = pa.ListArray.from_arrays(pa.array(np.append(first, len(to)).astype(np.int32)), pa.array(to.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(group[to[first]].astype(np.int32)), cells], ["key", "own", "theta", "v", "grp", "cells"])

    return asked.mapInArrow(run, "key long, own long, theta double, v array<double>, grp int, cells array<int>")


def nearest(
    queries: DataFrame, rows: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", own: Column | None = None, query_own: Column | None = None, tag: Column | None = None, s: Pivots = Pivots()
) -> DataFrame:
    """(query_id, neighbours): every query's k nearest rows by Euclidean distance, as structs (distance, id, tag), nearest first.

    own, query_own: a row is no neighbour of queries with the same value; their ids unless given. A query without any neighbour has an empty list.
    """
    table = stored(_of_copies(_points(rows, id_col, vec_col, own, tag), k), "points")
    ask = _points(queries, id_col, vec_col, query_own if query_own is not None else own, None)
    first = table.orderBy("id").limit(1).collect()
    if not first:
        return ask.select(F.col("id").alias("query_id"), F.array().cast("array<struct<distance:double,id:long,tag:double>>").alias("neighbours"))
    dims = len(first[0].v)
    n = table.filter(F.size("v") == dims).count()
    chosen = table.filter(F.size("v") == dims).orderBy(F.xxhash64(F.lit(s.seed), "id"), "id").limit(max(1, min(s.most, isqrt(n)))).select("v").collect()  # s.most rows at most
    pivots = np.unique(np.array([r.v for r in chosen]), axis=0)
    table, ask = stored(_dealt(table, pivots), "rows"), stored(_dealt(ask, pivots).withColumn("key", F.monotonically_increasing_id()), "queries")
    radius = np.full(len(pivots), -1.0)
    for r in table.groupBy("cell").agg(F.max("r").alias("r")).collect():
        radius[r.cell] = r.r
    # More groups for more rows, so that a group's rows need not be copied to many blocks of its queries.
    n_groups = min(len(pivots), s.groups or max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-ask.count() // s.block_queries)))
    at_home = ask.withColumns({"grp": F.col("cell") % n_groups, "cells": F.array("cell"), "theta": F.lit(float("inf"))})
    home = stored(_merged(_search(at_home, table, k, n_groups, s), k), "home")
    theta = F.when(F.size("top") >= k, F.sqrt(F.element_at("top", -1)["d"])).otherwise(F.lit(float("inf")))
    known = ask.join(home.select("key", theta.alias("theta")), "key", "left").withColumn("theta", F.coalesce("theta", F.lit(float("inf"))))
    away = _search(stored(_others(known, pivots, radius, n_groups), "asked"), table, k, n_groups, s)
    best = _merged(home.unionByName(away), k)
    out = F.transform(F.coalesce("top", F.array().cast(LIST)), lambda t: F.struct(F.sqrt(t["d"]).alias("distance"), t["id"].alias("id"), t["tag"].alias("tag")))
    return ask.select("key", F.col("id").alias("query_id")).join(best, "key", "left").select("query_id", out.alias("neighbours"))


def neighbour_rows(found: DataFrame) -> DataFrame:
    """(query_id, rank from 1, id, distance)."""
    return found.select("query_id", F.posexplode("neighbours").alias("p", "n")).select("query_id", (F.col("p") + 1).alias("rank"), "n.id", "n.distance")
