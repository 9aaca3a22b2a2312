"""Sums of vectors over all tasks in a tree, and matrices of column products in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 8


def partitions(rows: DataFrame) -> int:
    """How many tasks rows takes; found out once for each DataFrame. Best for stored or persisted ones."""
    if not hasattr(rows, "_tidewell_partitions"):
        rows._tidewell_partitions = rows.rdd.getNumPartitions()
    return rows._tidewell_partitions


def tree_sum(rows: DataFrame, part: Callable[[Iterator[pd.DataFrame]], np.ndarray], fan_in: int = FAN_IN) -> np.ndarray | None:
    """The sum over tasks of part(the task's batches), vectors of one length; None without tasks.

    Neighbouring tasks' vectors are added fan_in at a time, level by level, so that no task and not the driver holds more than so many.
    """

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"v": [np.ascontiguousarray(part(batches), np.float64).tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by k; one running sum."""
        key, total = None, None
        for b in batches:
            for k, v in zip(b.column("k").to_pylist(), b.column("v"), strict=True):
                x = np.frombuffer(v.as_buffer())
                if k != key and total is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([total.tobytes()], pa.binary())], ["k", "v"])
                key, total = k, x.copy() if k != key else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([total.tobytes()], pa.binary())], ["k", "v"])

    n = partitions(rows)
    sums = rows.mapInPandas(first, "v binary").select(F.spark_partition_id().cast("long").alias("k"), "v")
    while n > fan_in:
        n = -(-n // fan_in)
        sums = sums.withColumn("k", F.floor(F.col("k") / fan_in)).repartition(n, "k").sortWithinPartitions("k").mapInArrow(add, "k long, v binary")
    got = sums.collect()
    return sum((np.frombuffer(r.v) for r in got), 0.0) if got else None


def pair_sums(df: DataFrame, columns: list[str], block: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all pairs of columns over the rows that have both: counts n[i, j], sums x[i, j] of column i and q[i, j] of its squares, and products p[i, j].

    Columns are shifted by their means first, so that little is lost to cancellation: one pass for these, one for the products. A task holds
    four matrices of columns by columns.
    """
    k = len(columns)
    xs = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    rows = df.select(*xs)
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    mean = np.array([v or 0.0 for v in rows.agg(*[F.avg(known(c)) for c in rows.columns]).first()])

    def part(batches: Iterator[pd.DataFrame]) -> np.ndarray:
        out = np.zeros((4, k, k))
        for b in batches:
            for i in range(0, len(b), block):
                x = b.iloc[i : i + block].to_numpy(float) - mean
                there = ~np.isnan(x)
                x, m = np.where(there, x, 0.0), there.astype(float)
                out += np.stack((m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x))
        return out.ravel()

    got = tree_sum(rows, part)
    n, x, q, p = (np.zeros((4, k, k)) if got is None else got.reshape(4, k, k))
    return n, x, q, p


def covariances(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Sample covariances over the rows that have both columns; NaN for fewer than two."""
    n, x, _, p = pair_sums(df, columns)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 1, (p - x * x.T / n) / (n - 1), np.nan)


def correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Correlations over the rows that have both columns; NaN where one does not vary."""
    n, x, q, p = pair_sums(df, columns)
    with np.errstate(divide="ignore", invalid="ignore"):
        cov, var = p - x * x.T / n, q - x * x / n
        var = np.where(var > 1e-12 * q, var, 0.0)
        return np.where((var > 0) & (var.T > 0), cov / np.sqrt(var * var.T), np.nan)
