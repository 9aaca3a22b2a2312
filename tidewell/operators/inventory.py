"""Integrity tables of segments: lengths, gaps, ranges, constants, duplicates, split membership. samples is an array column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .aggregate import exact_quantiles


def lengths(df: DataFrame, by: list[str], samples: str, usual: int) -> DataFrame:
    n = F.size(samples)
    return df.groupBy(*by).agg(
        F.min(n).alias("len_min"), F.median(n).alias("len_median"), F.max(n).alias("len_max"), F.stddev_pop(n).alias("len_std"),
        F.count_if(n < usual).alias("n_shorter"), F.count_if(n > usual).alias("n_longer"), F.count_if(n == usual).alias("n_equal"), F.count(F.lit(1)).alias("n_total"),
    )


def gaps(df: DataFrame, by: list[str], samples: str, head: int) -> DataFrame:
    """Segments with NaN (or null) and infinite samples, in the whole and in the first head samples, and the samples themselves."""
    missing = lambda x: x.isNull() | F.isnan(x)
    inf = lambda x: F.abs(x) == float("inf")
    c = F.col(samples)
    count = lambda a, f: F.size(F.filter(a, f))
    return df.groupBy(*by).agg(
        F.count_if(count(c, missing) > 0).alias("with_nan"), F.count_if(count(c, inf) > 0).alias("with_inf"),
        F.count_if(count(F.slice(c, 1, head), missing) > 0).alias("with_nan_head"), F.count_if(count(F.slice(c, 1, head), inf) > 0).alias("with_inf_head"),
        F.sum(count(c, missing)).alias("nan_samples"), F.sum(count(c, inf)).alias("inf_samples"), F.count(F.lit(1)).alias("n_total"),
    )


def ranges(df: DataFrame, by: list[str], samples: str) -> DataFrame:
    x = df.select(*by, F.explode(F.col(samples).cast("array<double>")).alias("x")).filter(~F.isnan("x") & (F.abs("x") != float("inf")))
    out = x.groupBy(*by).agg(F.min("x").alias("min"), F.max("x").alias("max"), F.count("x").alias("n_finite"))
    out = out.join(exact_quantiles(x, by, "x", [0.01, 0.5, 0.99]), by)
    return out.withColumns({"p1": F.col("q")[0], "median": F.col("q")[1], "p99": F.col("q")[2]}).drop("q")


def constants(df: DataFrame, key: str, samples: str, least_std: float = 1e-8) -> DataFrame:
    """Segments of two samples or more that hardly vary."""
    x = df.select(key, F.explode(F.col(samples).cast("array<double>")).alias("x")).groupBy(key).agg(F.stddev_pop("x").alias("std"), F.count("x").alias("n"))
    return x.filter((F.col("n") >= 2) & (F.col("std") < least_std))


def duplicates(df: DataFrame, by: list[str], content: str) -> DataFrame:
    """Rows whose content is shared within the group, with the group's size."""
    w = Window.partitionBy(*by, "hash")
    return df.withColumn("hash", F.sha1(F.col(content).cast("string").cast("binary"))).withColumn("group_size", F.count(F.lit(1)).over(w)).filter("group_size > 1")


def split_membership(df: DataFrame, subject: str = "subject", split: str = "split") -> DataFrame:
    out = df.groupBy(subject).agg(F.bool_or(F.col(split) == "train").alias("in_train"), F.bool_or(F.col(split) == "validation").alias("in_validation"))
    return out.withColumn("n_splits", F.col("in_train").cast("int") + F.col("in_validation").cast("int"))
