"""Distance correlation of two columns of any length, without their distance matrices.

With a(i, j) = |x_i - x_j| and b alike, distance covariance needs sum a(i, j) b(i, j), the row sums a(i), b(i), and their products. Row sums
are running totals of sorted values. For the sum over pairs both columns are cut into ranges: pairs that lie in different ranges of
both follow from counts and sums of the cells of ranges, since their order in either column is known; pairs that share a
range of x, or of y, are summed up range by range, by merging sorted halves, and those that share both are taken off once. A value
that many rows share is a range of its own, in which all distances are zero.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.sources.shared import stored

from .aggregate import running_totals


def pair_products(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Sum over pairs i < j of w_i w_j |x_i - x_j| |y_i - y_j|, in the order of m log^2 m.

    Rows in the order of x are merged bottom-up: at each level a row of a right half meets all rows of its left half, whose x are no greater; in
    the order of y it knows how many of them, and of what sums, lie below it.
    """
    order = np.lexsort((y, x))
    x, y, w = x[order], y[order], w[order]
    at, total, width = np.arange(len(x)), 0.0, 1
    terms = np.stack((w, w * x, w * y, w * x * y))
    while width < len(x):
        group, right = at // (2 * width), (at // width) % 2 == 1
        by = np.lexsort((y, group))
        left = np.where(right[by], 0.0, terms[:, by]).cumsum(axis=1)
        start = np.searchsorted(group[by], group[by], "left")
        before = np.where(start > 0, left[:, start - 1], 0.0)
        whole = left[:, np.searchsorted(group[by], group[by], "right") - 1] - before
        n, sx, sy, sxy = 2 * (left - before) - whole  # below, less above
        r = right[by]
        xr, yr = x[by][r], y[by][r]
        total += float((w[by][r] * (xr * yr * n[r] - yr * sx[r] - xr * sy[r] + sxy[r])).sum())
        width *= 2
    return total


def _cells(t: np.ndarray) -> float:
    """Sum over pairs of cells that differ in both ranges. t: 4 x ranges of x x ranges of y, counts and sums of x, y and xy."""
    n, sx, sy, sxy = t
    total = 0.0
    for sign, flip in ((1, False), (-1, True)):
        v = np.stack([a[:, ::-1] if flip else a for a in (n, sx, sy, sxy)])
        low = np.zeros_like(v)
        low[:, 1:, 1:] = v.cumsum(1).cumsum(2)[:, :-1, :-1]  # cells lower in x and (flipped: higher) in y
        m, lx, ly, lxy = low
        a, ax, ay, axy = v
        total += sign * float((axy * m - ax * ly - ay * lx + a * lxy).sum())
    return total


def _range(c: str, edges: str) -> Column:
    """Ranges between edges have even numbers, the edges' own values odd ones."""
    e = F.col(edges)
    return F.aggregate(e, F.lit(0), lambda k, v: k + F.when(v < F.col(c), 2).when(v == F.col(c), 1).otherwise(0))


def _row_sums(rows: DataFrame, c: str) -> DataFrame:
    """(c, a_c): for each value the sum of its distances to all rows."""
    t = rows.groupBy(c).agg(F.sum("w").alias("n")).withColumn("s", F.col("n") * F.col(c))
    t = running_totals(t, c, ["n", "s"])
    low_n, low_s = F.col("all_n") - F.col("run_n"), F.col("all_s") - F.col("run_s")
    return t.select(c, (F.col(c) * low_n - low_s + F.col("run_s") - F.col(c) * F.col("run_n")).alias(f"a_{c}"))


def distance_correlation(df: DataFrame, x: str, y: str, ranges: int | None = None) -> float | None:
    """Of all rows with both values; None for fewer than two rows or a constant column. Quantiles that cut the ranges need not be exact.

    ranges: of either column; unless given, for some 250,000 rows in each, 64 at least and 2,048 at most.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    ranges = ranges or min(2048, max(64, rows.count() // 250_000))
    at = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    row = rows.agg(F.count(F.lit(1)), F.avg("x"), F.avg("y"), F.percentile_approx("x", at, 2000), F.percentile_approx("y", at, 2000)).first()
    n = row[0]
    if n < 2:
        return None
    mx, my = row[1], row[2]
    cut = {"x": sorted({float(v) - mx for v in row[3]}), "y": sorted({float(v) - my for v in row[4]})}
    rows = rows.select((F.col("x") - mx).alias("x"), (F.col("y") - my).alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))
    rows = rows.withColumns({f"e{c}": F.array(*[F.lit(v) for v in cut[c]]) for c in "xy"}).withColumns({f"r{c}": _range(c, f"e{c}") for c in "xy"})
    rows = stored(rows.select("x", "y", "w", "rx", "ry"), "pairs")

    size = [2 * len(cut[c]) + 1 for c in "xy"]
    t = np.zeros((4, *size))
    for r in rows.groupBy("rx", "ry").agg(*[F.sum(v).alias(f"s{i}") for i, v in enumerate((F.col("w"), F.col("w") * F.col("x"), F.col("w") * F.col("y"), F.col("w") * F.col("x") * F.col("y")))]).collect():
        t[:, r.rx, r.ry] = r.s0, r.s1, r.s2, r.s3

    def near(keys: list[str]) -> float:
        """Pairs that share these ranges."""
        varies = rows.select("*", *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).filter(" and ".join(f"k{i} % 2 = 0" for i in range(len(keys))))  # an edge's own range holds one value

        def part(g: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"v": [pair_products(*(g[c].to_numpy(float) for c in ("x", "y", "w")))]})

        return varies.groupBy(*[f"k{i}" for i in range(len(keys))]).applyInPandas(part, "v double").agg(F.coalesce(F.sum("v"), F.lit(0.0))).first()[0]

    both = 2 * (_cells(t) + near(["rx"]) + near(["ry"]) - near(["rx", "ry"]))
    joined = rows.join(_row_sums(rows, "x"), "x").join(_row_sums(rows, "y"), "y")
    p = F.col("w")
    a, b, aa, bb, ab, xx, yy = joined.agg(
        F.sum(p * F.col("a_x")), F.sum(p * F.col("a_y")), F.sum(p * F.col("a_x") ** 2), F.sum(p * F.col("a_y") ** 2), F.sum(p * F.col("a_x") * F.col("a_y")), F.sum(p * F.col("x") ** 2), F.sum(p * F.col("y") ** 2)
    ).first()
    cov = both / n**2 + a * b / n**4 - 2 * ab / n**3
    var_x, var_y = (2 * q / n + s * s / n**4 - 2 * ss / n**3 for q, s, ss in ((xx, a, aa), (yy, b, bb)))
    if min(var_x, var_y) <= 0:
        return None
    return float(np.sqrt(max(cov, 0.0) / np.sqrt(var_x * var_y)))
