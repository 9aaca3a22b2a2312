"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths.

Only the histogram of encoded lengths, which has at most as many rows as the largest capacity,
reaches the driver. There best-fit decreasing runs over it exactly, but in bulk: bins that look
alike are one range of bin numbers, and all items of one length that best-fit would put into
such a range are placed at once. An item that fits no open bin opens the allowed size of least
cost for each token that it can hold. Which sizes may be opened is settled for all jointly: the
plan is made for every subset of the permitted lengths (with the largest in it), each bin is
then downsized to the least permitted length that holds its contents, and the cheapest plan is
kept. Documents get their rank among those of equal length and look their bin up in the plan.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import add_length

SIZES = (512, 1024, 2048, 4096, 8192)
RANK_BUCKETS, BUCKET_ROWS = 256, 100_000


def attention_cost(size: int) -> float:
    """Cost of a sequence: linear in its length, and as much again in the quadratic term at 16,384 tokens."""
    return size * (1 + size / 16_384)


@dataclass
class Plan:
    cost: float
    bins: int
    placed: np.ndarray  # (length, first rank, items a bin, first bin, offset in the bin), sorted
    final: np.ndarray  # (first bin, capacity, used), sorted
    allowed: tuple[int, ...]


def best_fit(hist: dict[int, int], sizes: tuple[int, ...], allowed: tuple[int, ...], cost: Callable[[int], float]) -> Plan:
    """Best-fit decreasing of hist (length -> count, lengths up to the largest size), opening allowed sizes only."""
    open_bins: dict[int, list[tuple[int, int, int]]] = {}  # what is left -> ranges (first bin, bins, size)
    lefts: list[int] = []
    placed, bins = [], 0

    def put(left: int, entry: tuple[int, int, int]) -> None:
        if left not in open_bins:
            open_bins[left] = []
            insort(lefts, left)
        open_bins[left].append(entry)

    for length in sorted(hist, reverse=True):
        n, rank = hist[length], 0
        while n:
            at = bisect_left(lefts, length)
            if at == len(lefts):
                size = min((s for s in allowed if s >= length), key=lambda s: (cost(s) / s, s))
                need = -(-n // (size // length))
                put(size, (bins, need, size))
                bins += need
                continue
            left = lefts[at]
            first, m, size = open_bins[left].pop()
            if not open_bins[left]:
                del open_bins[left]
                lefts.pop(at)
            k = left // length
            full = min(m, n // k)
            if full:
                placed.append((length, rank, k, first, size - left))
                put(left - k * length, (first, full, size))
                n, rank = n - full * k, rank + full * k
            if full < m and n:
                placed.append((length, rank, n, first + full, size - left))
                put(left - n * length, (first + full, 1, size))
                full, n, rank = full + 1, 0, rank + n
            if full < m:
                put(left, (first + full, m - full, size))
    total, final = 0.0, []
    for left, entries in open_bins.items():
        for first, m, size in entries:
            used = size - left
            small = min(s for s in sizes if s >= used)
            total += m * cost(small)
            final.append((first, small, used))
    return Plan(total, bins, np.array(sorted(placed), np.int64).reshape(-1, 5), np.array(sorted(final), np.int64).reshape(-1, 3), allowed)


def make_plan(hist: dict[int, int], sizes: tuple[int, ...] = SIZES, cost: Callable[[int], float] = attention_cost) -> Plan:
    """The cheapest of the plans for all subsets of sizes that hold the largest; of equal ones, that of the fewest bins."""
    sizes = tuple(sorted(set(sizes)))
    subsets = [(*s, sizes[-1]) for r in range(len(sizes)) for s in combinations(sizes[:-1], r)]
    return min((best_fit(hist, sizes, s, cost) for s in subsets), key=lambda p: (p.cost, p.bins, p.allowed))


def _assign(plan):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = plan.value
        codes = p.placed[:, 0] << 40 | p.placed[:, 1]
        for b in batches:
            length, rank = b["n_tokens"].to_numpy(np.int64), b["rank"].to_numpy(np.int64)
            row = p.placed[np.searchsorted(codes, length << 40 | rank, "right") - 1]
            within = rank - row[:, 1]
            bin_id = row[:, 3] + within // row[:, 2]
            last = p.final[np.searchsorted(p.final[:, 0], bin_id, "right") - 1]
            out = b.drop(columns="rank")
            yield out.assign(bin_id=bin_id, bin_offset=row[:, 4] + within % row[:, 2] * length, bin_capacity=last[:, 1], bin_used=last[:, 2])

    return run


def pack(
    docs: DataFrame,
    sizes: tuple[int, ...] = SIZES,
    cost: Callable[[int], float] = attention_cost,
    separators: int = 1,
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, piece_start, n_tokens, bin_id, bin_offset, bin_capacity, bin_used), a row for each piece.

    A document takes its encoded length plus the separators that end it; a null or empty text takes the separators
    alone. A document longer than the largest size is cut into pieces of that size and a rest. Null ids are kept, and
    repeated rows are packed as often as they occur. The bins of a size hold at most that many tokens; together the
    pieces of a bin fill it from 0 without gaps. Which of several pieces of one length takes which of their places is
    not fixed.
    """
    most = max(sizes)
    id_type = docs.schema[id_col].dataType.simpleString()
    lengths = add_length(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), vocabulary, as_col="total").drop("text")
    lengths = lengths.withColumn("total", F.col("total") + separators).filter("total > 0")
    lengths = materialize(lengths.withColumn("row", F.monotonically_increasing_id()), "lengths")  # written, so the numbers stay
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(most).cast("long")))
    pieces = lengths.withColumn("piece_start", start)
    pieces = pieces.select(
        "doc_id", "row", (F.col("piece_start") / most).cast("int").alias("piece"), "piece_start", F.least(F.col("total") - F.col("piece_start"), F.lit(most)).cast("long").alias("n_tokens")
    )
    # Ranks among equal lengths without gathering a length in one task: by bucket, after the rows of earlier buckets.
    # By row, not id: null and repeated ids are dealt over all buckets.
    bucket = F.pmod(F.xxhash64("row", "piece"), F.lit(max(RANK_BUCKETS, lengths.count() // BUCKET_ROWS)))
    pieces = pieces.withColumn("bucket", bucket)
    counts = materialize(pieces.groupBy("n_tokens", "bucket").agg(F.count(F.lit(1)).alias("n")), "length-counts")
    hist = {r.n_tokens: r.n for r in counts.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}  # at most max(sizes) rows
    earlier = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("n_tokens", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    own = Window.partitionBy("n_tokens", "bucket").orderBy("row", "piece")
    # Never broadcast: Spark sizes pieces as one for each document.
    ranked = pieces.hint("merge").join(first, ["n_tokens", "bucket"]).withColumn("rank", F.col("first") + F.row_number().over(own) - 1)
    plan = docs.sparkSession.sparkContext.broadcast(make_plan(hist, sizes, cost))
    schema = f"doc_id {id_type}, piece int, piece_start long, n_tokens long, bin_id long, bin_offset long, bin_capacity long, bin_used long"
    return ranked.select("doc_id", "piece", "piece_start", "n_tokens", "rank").mapInPandas(_assign(plan), schema)
