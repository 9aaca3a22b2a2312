"""Vectors of integers from arrays of floats, and exact products of blocks of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column, size: int | None = None) -> Column:
    """True for arrays without null or non-finite components, of that many components if size is given; never null."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & (F.lit(True) if size is None else F.size(vec) == size), F.lit(False))


def points(df: DataFrame, id_col: str, vec_col: str, scale: int = 64, size: int | None = None) -> DataFrame:
    """(id long, q array<int>): floor(scale * x) of every component of the usable vectors. A component beyond 32 bits is an error."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("v")).filter(usable(F.col("v"), size))
    return rows.select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("int")).alias("q"))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def exact_products(a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """a @ b.T in integers. bound: no sum of absolute products is larger. Up to 2**53 doubles are exact, and fast."""
    if bound >= 1 << 62:
        raise ValueError("inner products exceed 64 bits")
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def largest(a: np.ndarray) -> int:
    return int(np.abs(a.astype(np.int64)).max(initial=0))
