"""Joins with checks, reshaping, sets and table clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.columns import META


def join_features(tables: list[DataFrame], prefixes: list[str], key: str = "segment_id", meta: tuple[str, ...] = META) -> DataFrame:
    """Inner join of feature tables by key. Of columns whose names meet, in any case, all but the first get their table's prefix."""
    out, taken = tables[0], {c.lower() for c in tables[0].columns}
    for table, prefix in zip(tables[1:], prefixes[1:], strict=True):
        table = table.drop(*[c for c in meta if c != key and c in table.columns])
        names = {c: f"{prefix}_{c}" for c in table.columns if c != key and c.lower() in taken}
        table = table.withColumnsRenamed(names)
        taken |= {c.lower() for c in table.columns}
        out = out.join(table, key)
    return out


def align(ref: DataFrame, values: DataFrame, key: str, columns: list[str], default: float | None = None, strict: bool = False) -> DataFrame:
    """Left join; missing values become the default, or raise if strict."""
    out = ref.join(values.select(key, *columns), key, "left")
    for c in columns:
        missing = F.raise_error(F.concat(F.lit(f"no {c} for "), F.col(key).cast("string"))) if strict else F.lit(default)
        out = out.withColumn(c, F.coalesce(c, missing.cast(values.schema[c].dataType)))
    return out


def paired(df: DataFrame, subject: str, cls: str, value: str, a: str, b: str) -> DataFrame:
    """(subject, a, b): a subject's means in two classes, side by side, where it has both. One shuffle."""
    of = lambda k: F.avg(F.when(F.col(cls) == k, F.col(value)))
    return df.groupBy(subject).agg(of(a).alias("a"), of(b).alias("b")).filter("a is not null and b is not null")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def pending(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The configurations that are not done yet."""
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def parameter_grid(spark: SparkSession, **values: list) -> DataFrame:
    """The product of short literal lists."""
    out = spark.range(1).select()
    for name, options in values.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in options])))
    return out


def melt(df: DataFrame, keys: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.unpivot(keys, columns, name, value)


def widen(df: DataFrame, keys: list[str], name: str, values: list[str], value: str, suffix: str = "") -> DataFrame:
    """Long to wide over fixed values, absent ones null."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(name) == v, F.col(value))).alias(f"{v}{suffix}") for v in values])


def crosstab(df: DataFrame, row: str, col: str, rows: list, cols: list) -> DataFrame:
    """Counts on a fixed grid, 0 where there are none."""
    counts = df.groupBy(row).agg(*[F.count_if(F.col(col) == c).alias(str(c)) for c in cols])
    grid = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(r) for r in rows])).alias(row))
    return grid.join(counts, row, "left").na.fill(0)


def features_of(df: DataFrame, meta: tuple[str, ...] = META) -> list[str]:
    return [c for c in df.columns if c not in meta]


def clean(df: DataFrame, columns: list[str], train: Column, max_missing: float = 0.10, min_variance: float = 1e-12) -> DataFrame:
    """Drop columns with too many nulls or, in training rows, too little variance; impute by training median, median, 0.

    Which columns stay depends on the data, so one aggregate is computed at once.
    """
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)],
        *[F.median(F.when(train, F.col(c))).alias(f"t_{i}") for i, c in enumerate(columns)],
        *[F.median(c).alias(f"m_{i}") for i, c in enumerate(columns)],
    ).first()
    fill = {c: next((x for x in (stats[f"t_{i}"], stats[f"m_{i}"]) if x is not None), 0.0) for i, c in enumerate(columns)}
    keep = [c for i, c in enumerate(columns) if stats["n"] and 1 - stats[f"n_{i}"] / stats["n"] <= max_missing]
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(fill[c]))) for c in keep})
    if keep:
        var = filled.agg(*[F.var_samp(F.when(train, F.col(c))).alias(c) for c in keep]).first()
        keep = [c for c in keep if var[c] is None or var[c] > min_variance]
    return filled.select(*[c for c in df.columns if c not in columns or c in keep])


def unique_names(df: DataFrame, name: str) -> DataFrame:
    """Rows of names, one for each canonical name: that without raw_ before the other, then by name."""
    canon = F.regexp_replace(name, "^raw_", "")
    w = Window.partitionBy("canonical").orderBy(F.startswith(F.col(name), F.lit("raw_")), name)
    return df.withColumn("canonical", canon).withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def seeded_subset(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The rows of n keys, drawn by a seeded hash: the same for the same seed whatever the partitions."""
    ids = df.select(key).distinct().orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)
    return df.join(F.broadcast(ids), key, "left_semi")
