"""Exact top-k search by tiled matrix products.

Vectors are integers: floor(scale * x). Queries and rows meet in a grid of cells: rows are dealt to column groups and
copied to the row groups of queries, queries are dealt to row groups and copied to the column groups. The grid is
sized so that a cell holds a bounded number of queries, and queries a bounded number of lists. In a cell, blocks of
rows stream past the cell's queries: the product of every tile of queries and block of rows gives its k best, merged at
once into the running lists. The lists of a query from all cells are merged in a tree of bounded fan-in.

Null vectors, and those with null or non-finite components, take no part; vectors of different lengths have no product and don't
meet. A row isn't a candidate of queries with its own id; rows with a null id are candidates, last among ties, and never queries.
Every query row has its own list, also if ids or whole rows are repeated. Fewer candidates than k give all of them; an
empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import exact_products, largest, matrix, points


@dataclass(frozen=True)
class Grid:
    cell_queries: int = 1 << 17  #: most queries of a cell; 32 MB of vectors and 45 MB of lists at 64 components and k = 20
    cell_rows: int = 1 << 18  #: rows of a cell, unless there are few
    tile: int = 256  #: queries of one product
    block: int = 4096  #: rows of one product
    fan_in: int = 16  #: lists merged at once

    def shape(self, n_queries: int, n_rows: int, tasks: int) -> tuple[int, int]:
        """(groups of queries, groups of rows); at least so many cells as tasks can run, if there are rows for them."""
        down = max(1, ceil(n_queries / self.cell_queries))
        return down, max(1, min(ceil(tasks / down), ceil(n_rows / self.block)), ceil(n_rows / self.cell_rows))


LIST = "array<struct<neg:long,noid:boolean,id:long>>"  #: in ascending order: best score first, ties by id, null ids last
NONE = np.iinfo(np.int64).min


class _Lists:
    """Running top lists of one cell's queries of one vector length."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, grid: Grid):
        self.keys, self.ids, self.q, self.k, self.grid, self.most = keys, ids, q, k, grid, largest(q)
        shape = (len(q), k)
        self.score, self.noid, self.id = np.full(shape, NONE), np.zeros(shape, bool), np.zeros(shape, np.int64)

    def add(self, ids: np.ndarray, noid: np.ndarray, rows: np.ndarray) -> None:
        for at in range(0, len(rows), self.grid.block):
            part = slice(at, at + self.grid.block)
            order = np.lexsort((ids[part], noid[part]))  # places now break ties as ids do
            self._block(ids[part][order], noid[part][order], rows[part][order])

    def _block(self, ids: np.ndarray, noid: np.ndarray, rows: np.ndarray) -> None:
        bound, n = self.most * largest(rows) * rows.shape[1], len(rows)
        for at in range(0, len(self.q), self.grid.tile):
            t = slice(at, at + self.grid.tile)
            scores = exact_products(self.q[t], rows, bound)
            own = (self.ids[t, None] == ids[None, :]) & ~noid[None, :]
            if bound < (1 << 62) // self.grid.block:  # score and place fit one integer
                packed = scores * self.grid.block + np.arange(self.grid.block - 1, self.grid.block - 1 - n, -1)
                packed[own] = NONE
                best = np.argpartition(packed, n - self.k, axis=1)[:, n - self.k :] if n > self.k else np.broadcast_to(np.arange(n), scores.shape)
            else:
                best = np.argsort(-scores, axis=1, kind="stable")[:, : self.k + int(own.sum(axis=1).max(initial=0))]
            found = np.where(np.take_along_axis(own, best, 1), NONE, np.take_along_axis(scores, best, 1))
            both = [np.concatenate(x, axis=1) for x in ((self.score[t], found), (self.noid[t], noid[best]), (self.id[t], ids[best]))]
            order = np.lexsort((both[2], both[1], -np.maximum(both[0], NONE + 1)), axis=1)[:, : self.k]
            self.score[t], self.noid[t], self.id[t] = (np.take_along_axis(x, order, 1) for x in both)

    def lists(self, cell_group: int) -> pa.RecordBatch:
        there = self.score != NONE
        tops = pa.StructArray.from_arrays(
            [pa.array(-self.score[there]), pa.array(self.noid[there]), pa.array(self.id[there], mask=self.noid[there])], ["neg", "noid", "id"]
        )
        offsets = pa.array(np.concatenate(([0], there.sum(axis=1).cumsum())).astype(np.int32))
        group = pa.array(np.full(len(self.keys), cell_group, np.int32))
        return pa.RecordBatch.from_arrays([pa.array(self.keys), pa.array(self.ids), group, pa.ListArray.from_arrays(offsets, tops)], ["key", "query_id", "g", "top"])


def _search(batches: Iterator[pa.RecordBatch], k: int, grid: Grid) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, vector length and kind (0 query, 1 row)."""
    here, queries, lists = None, [], None

    def over() -> Iterator[pa.RecordBatch]:
        if lists is not None:
            yield lists.lists(here[0])

    for batch in batches:
        g, r, dim, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "r", "dim", "kind"))
        cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(r) != 0) | (np.diff(dim) != 0) | (np.diff(kind) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(g)], strict=True) if len(g) else ():
            if (now := (int(g[a]), int(r[a]), int(dim[a]))) != here:
                yield from over()
                here, queries, lists = now, [], None
            part = batch.slice(a, b - a)
            noid = part.column("id").is_null().to_numpy(zero_copy_only=False)
            ids, q = part.column("id").fill_null(0).to_numpy(), matrix(part.column("q"))
            if kind[a] == 0:
                queries.append((part.column("key").to_numpy(), ids, q))
            elif queries and lists is None:
                lists = _Lists(*map(np.concatenate, zip(*queries, strict=True)), k, grid)
            if kind[a] == 1 and lists is not None:
                lists.add(ids, noid, q)
    yield from over()


def merge(lists: DataFrame, k: int, groups: int, fan_in: int) -> DataFrame:
    """(key, query_id, top) from (key, query_id, g, top): fan_in neighbours at a time, until one list is left."""
    while True:
        groups = ceil(groups / fan_in)
        top = F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top")
        lists = lists.withColumn("g", F.floor(F.col("g") / fan_in).cast("int")).groupBy("key", "query_id", "g").agg(top)
        if groups == 1:
            return lists.select("key", "query_id", "top")


def top_k(
    queries: DataFrame, rows: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", query_id_col: str | None = None, query_vec_col: str | None = None, scale: int = 64, grid: Grid = Grid()
) -> DataFrame:
    """query_id, rank from 1, vec_id, score (integer inner product): the k best rows for every row of queries."""
    spark = rows.sparkSession
    asked = points(queries, query_id_col or id_col, query_vec_col or vec_col, scale).filter("id is not null")
    # written, so that rows keep their places, and with them their keys and groups, whatever is computed again
    asked, rows = materialize(asked, "queries"), materialize(points(rows, id_col, vec_col, scale), "rows")
    down, across = grid.shape(asked.count(), rows.count(), 2 * spark.sparkContext.defaultParallelism)
    at, by = F.monotonically_increasing_id(), lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.withColumn("key", at).select(every(across).alias("g"), by(down).alias("r"), F.lit(0).alias("kind"), "key", "id", "q")
    rows = rows.withColumn("key", at).select(by(across).alias("g"), every(down).alias("r"), F.lit(1).alias("kind"), "key", "id", "q")
    cells = asked.union(rows).withColumn("dim", F.size("q"))
    cells = cells.repartitionById(down * across, F.col("r") * across + F.col("g")).sortWithinPartitions("r", "g", "dim", "kind")
    lists = cells.mapInArrow(lambda b: _search(b, k, grid), f"key long, query_id long, g int, top {LIST}")
    best = merge(lists, k, across, grid.fan_in).select("query_id", F.posexplode("top").alias("place", "t"))
    return best.select("query_id", (F.col("place") + 1).alias("rank"), F.col("t.id").alias("vec_id"), (-F.col("t.neg")).alias("score"))
