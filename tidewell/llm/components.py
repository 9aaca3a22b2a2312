"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    far = both.filter("v > u").join(least, F.col("u") == F.col("k"))
    return far.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    joined = down.join(least, F.col("u") == F.col("k"))
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: u, v (long). Gives (node, root) for every node with an edge but the roots; root is the component's least node.

    Each round is written to the shared storage; rounds end when the edges, then stars, no longer change. Paths of n
    nodes take O(log^2 n) rounds.
    """
    now = materialize(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        now = materialize(_small_star(_large_star(now)), "stars")
        row = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if row == mark or row[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = row
    raise RuntimeError("components did not settle")
