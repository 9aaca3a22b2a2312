"""Normalisers within a subject, over all rows of the subject unless they say otherwise.

Statistics of a subject come from one aggregate that is joined back (a hash aggregate and, for a
bounded number of subjects, a broadcast), or from a whole-partition window; values stay double.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.columns import clip

BY = "subject"


def _scaled(x: Column, centre: Column, scale: Column) -> Column:
    """(x - centre) / scale, a scale of 0 or null counting as 1, and a null result as 0."""
    return F.coalesce((x - centre) / F.when(scale != 0, scale).otherwise(F.lit(1.0)), F.lit(0.0))


def _apply(df: DataFrame, columns: list[str], f: Callable[[str], Column]) -> DataFrame:
    return df.withColumns({c: f(c) for c in columns})


def subject_z(df: DataFrame, columns: list[str], by: str = BY) -> DataFrame:
    w = Window.partitionBy(by)
    return _apply(df, columns, lambda c: _scaled(F.col(c), F.avg(c).over(w), F.stddev_pop(c).over(w)))


def subject_robust(df: DataFrame, columns: list[str], by: str = BY) -> DataFrame:
    """Median and interquartile range, exact; one aggregate joined back."""
    q = df.groupBy(by).agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"__q_{i}") for i, c in enumerate(columns)])
    out = df.join(q, by)
    out = _apply(out, columns, lambda c: (lambda v: _scaled(F.col(c), v[1], v[2] - v[0]))(F.col(f"__q_{columns.index(c)}")))
    return out.drop(*q.columns[1:])


def global_z(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """By the mean and deviation of the training rows."""
    s = df.filter(train).agg(*[x for i, c in enumerate(columns) for x in (F.avg(c).alias(f"__m_{i}"), F.stddev_pop(c).alias(f"__s_{i}"))])
    out = df.crossJoin(F.broadcast(s))  # one row
    out = _apply(out, columns, lambda c: _scaled(F.col(c), F.col(f"__m_{columns.index(c)}"), F.col(f"__s_{columns.index(c)}")))
    return out.drop(*s.columns)


def anchored(df: DataFrame, columns: list[str], anchor: Column, mode: str = "z", by: str = BY) -> DataFrame:
    """Centre (mode center), standardise (z) or robustly scale (robust) by the subject's anchor rows."""
    w = Window.partitionBy(by)

    def of(c: str) -> Column:
        x = F.when(anchor, F.col(c))
        if mode == "center":
            return F.coalesce(F.col(c) - F.avg(x).over(w), F.lit(0.0))
        if mode == "z":
            return _scaled(F.col(c), F.avg(x).over(w), F.stddev_pop(x).over(w))
        q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(w)
        return _scaled(F.col(c), q[1], q[2] - q[0])

    return _apply(df, columns, of)


def percentile_rank(df: DataFrame, columns: list[str], by: str = BY) -> DataFrame:
    """Average rank divided by the number of rows."""

    def of(c: str) -> Column:
        ties = F.count(F.lit(1)).over(Window.partitionBy(by, c))
        return (F.rank().over(Window.partitionBy(by).orderBy(c)) + (ties - 1) / 2.0) / F.count(F.lit(1)).over(Window.partitionBy(by))

    return _apply(df, columns, of)


def trimmed_z(df: DataFrame, columns: list[str], lo: float = 0.10, hi: float = 0.90, by: str = BY) -> DataFrame:
    """z by the mean and deviation of the values between two quantiles, both included."""
    q = df.groupBy(by).agg(*[F.percentile(c, F.array(F.lit(lo), F.lit(hi))).alias(f"__q_{i}") for i, c in enumerate(columns)])
    out = df.join(q, by)
    w = Window.partitionBy(by)

    def of(c: str) -> Column:
        v = F.col(f"__q_{columns.index(c)}")
        x = F.when((F.col(c) >= v[0]) & (F.col(c) <= v[1]), F.col(c))
        return _scaled(F.col(c), F.avg(x).over(w), F.stddev_pop(x).over(w))

    return _apply(out, columns, of).drop(*q.columns[1:])


def clipped_z(df: DataFrame, columns: list[str], limit: float = 3.0, by: str = BY) -> DataFrame:
    return _apply(subject_z(df, columns, by), columns, lambda c: clip(F.col(c), -limit, limit))


def quantile_bucket(df: DataFrame, columns: list[str], n: int = 4, by: str = BY) -> DataFrame:
    """0 to n - 1 by the subject's quantile edges, equal edges counting once; intervals are open below, the first closed."""
    shares = F.array(*[F.lit(k / n) for k in range(n + 1)])
    q = df.groupBy(by).agg(*[F.array_distinct(F.percentile(c, shares)).alias(f"__q_{i}") for i, c in enumerate(columns)])
    out = df.join(q, by)

    def of(c: str) -> Column:
        inner = F.slice(F.col(f"__q_{columns.index(c)}"), 2, F.greatest(F.size(F.col(f"__q_{columns.index(c)}")) - 2, F.lit(0)))
        return F.size(F.filter(inner, lambda e: e < F.col(c))).cast("double")

    return _apply(out, columns, of).drop(*q.columns[1:])


def subject_residual(df: DataFrame, columns: list[str], alpha: float = 1.0, by: str = BY) -> DataFrame:
    """What a ridge regression on the subject's indicator leaves of the globally centred values, in closed form."""
    w = Window.partitionBy(by)
    mean = df.agg(*[F.avg(c).alias(f"__m_{i}") for i, c in enumerate(columns)])
    out = df.crossJoin(F.broadcast(mean))  # one row

    def of(c: str) -> Column:
        d = F.col(c) - F.col(f"__m_{columns.index(c)}")
        return d - F.sum(d).over(w) / (F.count(c).over(w) + F.lit(alpha))

    return _apply(out, columns, of).drop(*mean.columns)


def winsorize(df: DataFrame, columns: list[str], train: Column, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Clip at quantiles of the training rows."""
    q = df.filter(train).agg(*[F.percentile(c, F.array(F.lit(lo), F.lit(hi))).alias(f"__q_{i}") for i, c in enumerate(columns)])
    out = df.crossJoin(F.broadcast(q))  # one row
    out = _apply(out, columns, lambda c: F.greatest(F.least(F.col(c), F.col(f"__q_{columns.index(c)}")[1]), F.col(f"__q_{columns.index(c)}")[0]))
    return out.drop(*q.columns)


def array_z(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Samples of an array column by the mean and deviation of all samples of the group."""
    s = df.select(*by, F.explode(column).alias("__x")).groupBy(*by).agg(F.avg("__x").alias("__m"), F.stddev_pop("__x").alias("__s"))
    out = df.join(s, by)
    scale = F.when(F.col("__s") != 0, F.col("__s")).otherwise(F.lit(1.0))
    return out.withColumn(column, F.transform(column, lambda x: (x - F.col("__m")) / scale)).drop("__m", "__s")


NORMALISERS: dict[str, Callable[..., DataFrame]] = {
    "subject_z": subject_z,
    "subject_robust": subject_robust,
    "rank": percentile_rank,
    "trimmed_z": trimmed_z,
    "clipped_z": clipped_z,
    "bucket": quantile_bucket,
    "residual": subject_residual,
}


def normalise(df: DataFrame, columns: list[str], strategy: str) -> DataFrame:
    return df if strategy == "global" else NORMALISERS[strategy](df, columns)


def norm_map(df: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """The three normal forms, lazily: what is not used costs nothing."""
    return {k: normalise(df, columns, k) for k in ("global", "subject_z", "subject_robust")}
