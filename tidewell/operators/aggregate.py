"""Aggregates of feature tables, and top-k and exact-count selections."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.sources.shared import stored

from . import blocks


def subject_means(df: DataFrame, columns: list[str], by: tuple[str, ...] = ("subject", "class")) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])


def class_means(df: DataFrame, columns: list[str], by: tuple[str, ...] = ("class",)) -> DataFrame:
    """Mean, sample deviation, count and standard error."""
    out = df.groupBy(*by).agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.count(c).alias(f"{c}_n"))])
    return out.withColumns({f"{c}_sem": F.col(f"{c}_std") / F.sqrt(F.when(F.col(f"{c}_n") > 0, F.col(f"{c}_n"))) for c in columns})


def long_summary(df: DataFrame, columns: list[str], by: tuple[str, ...]) -> DataFrame:
    """(by, feature, mean, std, n) with the population deviation, over non-null values."""
    long = df.unpivot(list(by), columns, "feature", "value")
    return long.groupBy(*by, "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))


def class_counts(df: DataFrame, by: list[str], cls: str, classes: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_segments"), *[F.count_if(F.col(cls) == c).alias(f"n_{c}") for c in classes])


def describe(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*(by or [])).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), q.alias("q"), F.max(value).alias("max")
    )
    return out.withColumns({"p25": F.col("q")[0], "p50": F.col("q")[1], "p75": F.col("q")[2]}).drop("q")


def spread_of_scores(df: DataFrame, score: str, by: list[str], low: float = 0.5) -> DataFrame:
    """Mean, deviation, least, median, greatest, and how many are below low."""
    return df.groupBy(*by).agg(
        F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("min"), F.median(score).alias("median"), F.max(score).alias("max"), F.count_if(F.col(score) < low).alias("n_low")
    )


def config_summary(df: DataFrame, by: list[str], scores: list[str], elapsed: str) -> DataFrame:
    """(by, n, <score>_mean, <score>_std, elapsed): results of runs by configuration, with the time they took together."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[x for c in scores for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))], F.sum(elapsed).alias("elapsed"))


def running_totals(df: DataFrame, order: str, sums: list[str], buckets: int = 64) -> DataFrame:
    """df with run_<c>, the sum of c over rows of this value of order or a greater one, and all_<c>, over all rows.

    Rows are cut into ranges by approximate quantiles, which need not be right, only much the same size: totals run over
    the ranges, then within each, so no task sorts all rows.
    """
    cuts = stored(df.agg(F.percentile_approx(order, F.array(*[F.lit(k / buckets) for k in range(1, buckets)]), 1000).alias("__cuts")), "cuts")  # the same for both branches below
    rows = df.crossJoin(F.broadcast(cuts)).withColumn("__b", F.size(F.filter(F.coalesce("__cuts", F.array().cast(cuts.schema["__cuts"].dataType)), lambda c: c < F.col(order)))).drop("__cuts")  # one row
    every, above = Window.partitionBy(), Window.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("__b").agg(*[F.sum(c).alias(c) for c in sums])
    ranges = ranges.select("__b", *[F.sum(c).over(every).alias(f"all_{c}") for c in sums], *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"__above_{c}") for c in sums])
    here = Window.partitionBy("__b").orderBy(F.desc(order))
    out = rows.join(F.broadcast(ranges), "__b")  # a row for each range
    return out.withColumns({f"run_{c}": F.col(f"__above_{c}") + F.sum(c).over(here) for c in sums}).drop("__b", *[f"__above_{c}" for c in sums])


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], error: float = 1e-4) -> DataFrame:
    """(by, q): the quantiles at these shares, interpolated linearly, of any number of values in a group.

    A sketch of known error gives a bracket about each quantile; the second pass counts what lies below the bracket and
    ranks what lies in it, some thousandth of the values. In small groups the quantile's neighbours may be the values next
    to the bracket, which are kept too. Nulls do not count.
    """
    x = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__x"))
    at = lambda d: F.percentile_approx("__x", F.array(*[F.lit(min(1.0, max(0.0, q + d))) for q in shares]), round(1 / error))
    sketch = x.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), at(-5 * error).alias("__lo"), at(5 * error).alias("__hi"))
    rows = x.join(sketch, by) if by else x.crossJoin(F.broadcast(sketch))  # one row
    lo, hi = (lambda k: F.get("__lo", F.lit(k))), (lambda k: F.get("__hi", F.lit(k)))
    parts = range(len(shares))
    outside = rows.groupBy(*by).agg(
        F.first("__n").alias("__n"), F.array(*[F.count_if(F.col("__x") < lo(k)) for k in parts]).alias("__below"), F.array(*[F.min(F.when(F.col("__x") > hi(k), F.col("__x"))) for k in parts]).alias("__next"), F.array(*[F.max(F.when(F.col("__x") < lo(k), F.col("__x"))) for k in parts]).alias("__last")
    )
    inside = F.filter(F.array(*[F.when((F.col("__x") >= lo(k)) & (F.col("__x") <= hi(k)), F.lit(k)) for k in parts]), lambda k: k.isNotNull())
    counts = rows.select(*by, "__x", F.explode(inside).alias("__k")).groupBy(*by, "__k", "__x").agg(F.count(F.lit(1)).alias("__c"))
    counts = counts.withColumn("__run", F.sum("__c").over(Window.partitionBy(*by, "__k").orderBy("__x")))
    ranked = counts.join(outside, by) if by else counts.crossJoin(F.broadcast(outside))  # one row
    place = F.get(F.array(*[F.lit(float(q)) for q in shares]), F.col("__k")) * (F.col("__n") - 1)
    first = F.floor(place) - F.get("__below", F.col("__k"))
    of = lambda i: F.min(F.when(F.col("__run") > i, F.col("__x")))
    found = ranked.groupBy(*by, "__k").agg(F.when(F.first(first) < 0, F.first(F.get("__last", F.col("__k")))).otherwise(of(first)).alias("__a"), F.coalesce(of(first + 1), F.first(F.get("__next", F.col("__k")))).alias("__b"), F.first(place - F.floor(place)).alias("__f"))
    q = F.when(F.col("__f") > 0, F.col("__a") + F.col("__f") * (F.col("__b") - F.col("__a"))).otherwise(F.col("__a"))
    return found.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("__k", q.alias("q")))), lambda r: r["q"]).alias("q"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of all pairs a < b in the order of columns, over the rows that have both; null where one does not vary."""
    r = blocks.correlation_matrix(df, columns)
    rows = [(a, b, None if np.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def target_correlations(df: DataFrame, columns: list[str], target: str, least: int = 5) -> DataFrame:
    """(feature, r, n): correlation with the target where at least so many rows have both."""
    long = df.unpivot([target], columns, "feature", "value").filter(F.col("value").isNotNull() & F.col(target).isNotNull())
    return long.groupBy("feature").agg(F.corr("value", F.col(target).cast("double")).alias("r"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def top_variance(df: DataFrame, columns: list[str], k: int) -> list[str]:
    row = df.agg(*[F.var_samp(c).alias(c) for c in columns]).first()
    return sorted(columns, key=lambda c: (-(row[c] or 0.0), c))[:k]


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; order should end with a unique key."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def exact_top(df: DataFrame, by: str, score: str, key: str, k: int | Column, label: str = "pred", descending: bool = True) -> DataFrame:
    """label 1 for exactly the k best of each group (k may be a column), ties by key, and 0 for the rest."""
    best = F.desc(score) if descending else F.asc(score)
    place = F.row_number().over(Window.partitionBy(by).orderBy(best, key))
    return df.withColumn(label, (place <= k).cast("int"))


def argmax(names: list[str]) -> Column:
    """The name of the greatest of these columns, the first of equals."""
    values = F.array(*[F.col(n) for n in names])
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(values, F.array_max(values)).cast("int"))
