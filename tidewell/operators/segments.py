"""Array columns of samples: cleaning, cutting, statistics by higher-order functions, and the numpy extractors over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import features as fx
from tidewell.functions import signal as sg


def bind(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def var_pop(a: Column) -> Column:
    return bind(mean(a), lambda m: mean(F.transform(a, lambda x: (x - m) * (x - m))))


def diff(a: Column) -> Column:
    return F.filter(F.transform(a, lambda x, i: F.get(a, i + 1) - x), lambda d: d.isNotNull())


def quantile(sorted_a: Column, q: float) -> Column:
    """Linear interpolation in a sorted array."""
    at = F.lit(q) * (F.size(sorted_a) - 1)
    lo = F.floor(at).cast("int")
    return F.get(sorted_a, lo) + (at - lo) * (F.coalesce(F.get(sorted_a, lo + 1), F.get(sorted_a, lo)) - F.get(sorted_a, lo))


def strip_trailing(a: Column) -> Column:
    good = F.filter(F.transform(a, lambda x, i: F.when(x.isNotNull() & ~F.isnan(x), i + 1)), lambda i: i.isNotNull())
    return F.slice(a, 1, F.coalesce(F.array_max(good), F.lit(0)))


def fit_length(a: Column, n: int) -> Column:
    """Cut, or filled up with nulls, to n samples."""
    return F.concat(F.slice(a, 1, n), F.array_repeat(F.lit(None).cast("double"), F.greatest(F.lit(n) - F.size(a), F.lit(0))))


def resample_linear(a: Column, n: int) -> Column:
    def at(i: Column) -> Column:
        t = i * (F.size(a) - 1) / F.lit(float(max(n - 1, 1)))
        lo = F.floor(t).cast("int")
        return F.get(a, lo) + (t - lo) * (F.coalesce(F.get(a, lo + 1), F.get(a, lo)) - F.get(a, lo))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def is_flat(a: Column, least_std: float = 1e-8) -> Column:
    return (F.size(a) >= 2) & (F.sqrt(var_pop(a)) < least_std)


def subwindows(df: DataFrame, samples: str, n: int) -> DataFrame:
    """n windows of equal length, the rest dropped: window (from 0) and the samples."""
    size = F.floor(F.size(samples) / n).cast("int")
    out = df.withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.withColumn(samples, F.slice(samples, F.col("window") * size + 1, size))


def hjorth(a: Column) -> Column:
    """struct(activity, mobility, complexity); the latter two null without movement."""

    def of(d1: Column, d2: Column) -> Column:
        v0, v1, v2 = var_pop(a), var_pop(d1), var_pop(d2)
        ok = (v0 > 0) & (v1 > 0)
        mob = F.sqrt(v1 / F.when(ok, v0))
        return F.struct(v0.alias("activity"), mob.alias("mobility"), (F.sqrt(v2 / F.when(ok, v1)) / mob).alias("complexity"))

    return bind(diff(a), lambda d1: bind(diff(d1), lambda d2: of(d1, d2)))


def change_rate(flags: Column) -> Column:
    """Share of neighbours in a boolean array that differ."""
    return mean(F.filter(F.transform(flags, lambda x, i: (F.get(flags, i + 1) != x).cast("double")), lambda v: v.isNotNull()))


def zero_cross_rate(a: Column) -> Column:
    """Changes of sign about the mean."""
    return bind(mean(a), lambda m: bind(F.transform(a, lambda x: x - m < 0), change_rate))


def mean_cross_rate(a: Column) -> Column:
    """Changes between above the mean and not above it."""
    return bind(mean(a), lambda m: bind(F.transform(a, lambda x: x > m), change_rate))


def petrosian(a: Column) -> Column:
    turns = bind(F.transform(diff(a), lambda x: x < 0), lambda d: F.size(F.filter(F.transform(d, lambda x, i: F.get(d, i + 1) != x), lambda v: v)))
    n = F.size(a).cast("double")
    return F.when(n >= 3, F.log10(n) / (F.log10(n) + F.log10(n / (n + 0.4 * turns))))


def permutation_entropy3(a: Column) -> Column:
    """Of order 3, normalised, ties by position."""

    def code(i: Column) -> Column:
        x, y, z = F.get(a, i), F.get(a, i + 1), F.get(a, i + 2)
        return (x > y).cast("int") * 4 + (x > z).cast("int") * 2 + (y > z).cast("int")

    codes = F.transform(F.sequence(F.lit(0), F.size(a) - 3), code)

    def entropy(c: Column) -> Column:
        shares = F.transform(F.array_distinct(c), lambda k: F.size(F.filter(c, lambda v: v == k)) / F.size(c))
        return F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p)) / F.lit(float(np.log2(6)))

    return F.when(F.size(a) >= 3, bind(codes, entropy))


def raw_stats(a: Column) -> dict[str, Column]:
    """Descriptive statistics as expressions, skew and kurtosis bias-corrected."""
    n = F.size(a).cast("double")
    s = F.sort_array(a)
    m, v = mean(a), var_pop(a)
    central = lambda k: bind(mean(a), lambda mm: mean(F.transform(a, lambda x: F.pow(x - mm, F.lit(float(k))))))
    g1, g2 = central(3) / F.pow(F.when(v > 0, v), F.lit(1.5)), central(4) / F.pow(F.when(v > 0, v), F.lit(2.0)) - 3
    med = bind(s, lambda t: quantile(t, 0.5))
    return {
        "mean": m, "std": F.sqrt(v), "min": F.array_min(a), "max": F.array_max(a), "range": F.array_max(a) - F.array_min(a), "median": med,
        "iqr": bind(s, lambda t: quantile(t, 0.75) - quantile(t, 0.25)),
        "skew": g1 * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2), "kurtosis": (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6),
        "mad": bind(med, lambda mm: bind(F.sort_array(F.transform(a, lambda x: F.abs(x - mm))), lambda t: quantile(t, 0.5))),
        "rms": F.sqrt(mean(F.transform(a, lambda x: x * x))), "cv": F.sqrt(v) / F.when(F.abs(m) > 1e-12, m), "diff_std": F.sqrt(bind(diff(a), var_pop)),
    }


def dft_power(a: Column, n: int) -> Column:
    """One-sided power |X_k|^2 of the first n samples, k = 0 .. n / 2, from its definition; for short arrays."""
    at = F.sequence(F.lit(0), F.lit(n - 1))

    def power(k: Column) -> Column:
        term = lambda f: F.aggregate(at, F.lit(0.0), lambda s, i: s + F.get(a, i) * f(i * k * F.lit(2 * np.pi / n)))
        re, im = term(F.cos), term(F.sin)
        return re * re + im * im

    return F.transform(F.sequence(F.lit(0), F.lit(n // 2)), power)


def spread(df: DataFrame, key: list[str]) -> DataFrame:
    """df over all cores: segments are short to read and long to work on, so one input split may hold very many."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, *key) if df.rdd.getNumPartitions() < n else df


def _arrays(column: pd.Series) -> list[np.ndarray]:
    return [np.asarray(a if a is not None else [], float) for a in column]


def extract(df: DataFrame, key: list[str], signals: dict[str, str], fs: float) -> DataFrame:
    """(key, feature, value) and status rows (value null, feature "status:<family>=<state>") of every segment, over Arrow batches.

    signals: name (bvp, eda, resp, spo2) -> array column. A long table, so that names need no agreement beforehand.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values, states = fx.segment_features({n: _arrays(b[c]) for n, c in signals.items()}, fs)
            parts = [(f, at[np.isfinite(v)], v[np.isfinite(v)]) for f, at, v in values] + [(f"status:{s}", at, np.full(len(at), np.nan)) for s, at in states]
            at = np.concatenate([p[1] for p in parts])
            out = b[key].iloc[at].reset_index(drop=True)
            value = pd.Series(np.concatenate([p[2] for p in parts]), dtype="Float64")
            yield out.assign(feature=np.repeat([p[0] for p in parts], [len(p[1]) for p in parts]), value=value.where(value.notna(), None))

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", feature string, value double"
    return spread(df.select(*key, *dict.fromkeys(signals.values())), key).mapInPandas(run, schema)


def features(df: DataFrame, key: list[str], samples: str, f, names: list[str]) -> DataFrame:
    """key and the named features of f (a matrix of equally long rows -> name -> values) as columns; NaN becomes null."""
    kinds = {c.name: c.dataType.simpleString() for c in df.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.full((len(b), len(names)), np.nan)
            for at, got in fx.by_length(_arrays(b[samples]), f):
                for k, name in enumerate(names):
                    if got and name in got:
                        out[at, k] = got[name]
            yield pd.concat([b[key].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key) + "".join(f", `{n}` double" for n in names)
    out = spread(df.select(*key, samples), key).mapInPandas(run, schema)
    return out.select(*key, *[F.nanvl(n, F.lit(None).cast("double")).alias(n) for n in names])


def map_matrix(c: Column, f) -> Column:
    """A numpy function of matrices, over arrays of equal length at once, by Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        out = np.empty(len(s), object)
        for at, got in fx.by_length(_arrays(s), f):
            for i, row in zip(at, got if got is not None else [None] * len(at), strict=True):
                out[i] = row
        return pd.Series(out, index=s.index).where(s.notna(), None)

    return run(c)


def map_array(c: Column, f) -> Column:
    """A numpy function of one array column, by Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda a: None if a is None else [float(v) for v in f(np.asarray(a, float))])

    return run(c)


def map_pair(a: Column, b: Column, f) -> Column:
    """A numpy function of two array columns, by Arrow batches; NaN becomes null."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if u is None or v is None else [float(r) for r in f(np.asarray(u, float), np.asarray(v, float))] for u, v in zip(x, y, strict=True)])

    return F.transform(run(a, b), lambda v: F.nanvl(v, F.lit(None).cast("double")))


def psd(c: Column, fs: float, size: int = 256, overlap: int = 128) -> Column:
    """struct(f, p): Welch's power spectral density."""

    @F.pandas_udf("f array<double>, p array<double>")
    def run(s: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"f": np.empty(len(s), object), "p": np.empty(len(s), object)})
        for at, (f, p) in fx.by_length(_arrays(s), lambda x: sg.welch(x, fs, size, overlap)):
            for i, row in zip(at, p, strict=True):
                out.at[i, "f"], out.at[i, "p"] = f, row
        return out

    return run(c)


def position_means(df: DataFrame, by: list[str], samples: str) -> DataFrame:
    """(by, pos, mean, sem, n): mean waveform of each class, position by position."""
    x = df.select(*by, F.posexplode(samples).alias("pos", "x"))
    out = x.groupBy(*by, "pos").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.count("x").alias("n"))
    return out.withColumn("sem", F.col("sd") / F.sqrt(F.when(F.col("n") > 0, F.col("n")))).drop("sd")


def baseline_normalised(df: DataFrame, baseline: Column, samples: str = "samples", by: str = "subject", floor: float | None = None) -> DataFrame:
    """df with samples as deviations from all of the group's baseline samples; null where these are fewer than ten or flat.

    floor: samples at or below it do not count for the baseline, and segments that hold one below it, or hardly move, become null.
    """
    x = df.filter(baseline).select(by, F.explode(samples).alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.lit(True) if floor is None else F.col("x") > floor))
    stats = x.groupBy(by).agg(F.avg("x").alias("__m"), F.stddev_pop("x").alias("__s"), F.count("x").alias("__n"))
    out = df.join(stats, by, "left")
    ok = (F.col("__n") >= 10) & (F.col("__s") >= 1e-6)
    if floor is not None:
        ok = ok & ~F.exists(samples, lambda v: v < floor) & (F.sqrt(var_pop(F.col(samples))) >= 1e-6)
    return out.withColumn(samples, F.when(ok, F.transform(samples, lambda v: (v - F.col("__m")) / F.col("__s")))).drop("__m", "__s", "__n")
