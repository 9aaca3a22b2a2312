"""Sources and sinks: wide signal CSVs, feature tables, caches, small configuration files."""

from __future__ import annotations

import json
import re
from concurrent.futures import ThreadPoolExecutor
from io import BytesIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.columns import parse_key, segment_key

SIGNALS = ("Bvp", "Eda", "Resp", "SpO2")
#: Files that the driver gives their names at once.
RENAMES = 16


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def split_root(spark: SparkSession, root: str, split: str) -> str:
    """<root>/Dataset/<split> if it exists, else <root>/<split>."""
    first = f"{root}/Dataset/{split}"
    return first if exists(spark, first) else f"{root}/{split}"


def subjects(spark: SparkSession, root: str, split: str, signal: str = SIGNALS[0]) -> list[int]:
    """Sorted subject numbers from the file names of one signal."""
    fs, p = _fs(spark, f"{split_root(spark, root, split)}/{signal}")
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d+)\.csv", n)))


def read_columns(spark: SparkSession, root: str, split: str, signal: str) -> DataFrame:
    """(file_subject, key, x) of all subjects: a file's columns are segments and its rows samples; blanks and NaN are null.

    A file is one subject's recording of one signal, some thousands of rows, and is parsed whole in one task; files are dealt over tasks.
    """

    def parse(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                wide = pd.read_csv(BytesIO(content), dtype="float64", na_values=["", "nan", "NaN"], skip_blank_lines=False)
                subject = int(re.search(r"(\d+)\.csv$", path)[1])
                yield pd.DataFrame({"file_subject": subject, "key": [n.strip().strip('"') for n in wide.columns], "x": list(wide.to_numpy().T)})

    files = spark.read.format("binaryFile").load(f"{split_root(spark, root, split)}/{signal}").filter(F.col("path").rlike(r"/\d+\.csv$"))
    wide = files.select("path", "content").mapInPandas(parse, "file_subject int, key string, x array<double>")
    return wide.withColumn("x", F.transform("x", lambda v: F.when(~F.isnan(v), v)))


def read_signal(spark: SparkSession, root: str, split: str, signal: str) -> DataFrame:
    """(file_subject, key, t, x): read_columns by samples."""
    long = read_columns(spark, root, split, signal).select("file_subject", "key", F.posexplode("x").alias("t", "x"))
    return long.withColumn("t", F.col("t").cast("long"))


def to_segments(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, key, samples, raw_len): a segment's samples in the order of time, trailing nulls stripped."""
    by = by or []
    rows = samples.groupBy(*by, "key").agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("s"))
    return _stripped(rows.withColumn("samples", F.transform("s", lambda v: v["x"])), by)


def _stripped(rows: DataFrame, by: list[str]) -> DataFrame:
    filled = F.filter(F.transform("samples", lambda x, i: F.when(x.isNotNull(), i + 1)), lambda i: i.isNotNull())
    last = F.coalesce(F.array_max(filled), F.lit(0))
    return rows.select(*by, "key", F.slice("samples", 1, last).alias("samples"), last.alias("raw_len"))


def build_split(spark: SparkSession, root: str, split: str, signals: tuple[str, ...] = SIGNALS) -> DataFrame:
    """A row for each segment: split, subject, class, segment_idx, segment_id, and samples and raw_len of each signal.

    Raises if the files of a subject do not name the same segments.
    """
    out = None
    for signal in signals:
        seg = _stripped(read_columns(spark, root, split, signal).withColumnRenamed("x", "samples"), ["file_subject"]).withColumnsRenamed({"samples": f"samples_{signal}", "raw_len": f"raw_len_{signal}"})
        out = seg if out is None else out.join(seg, ["file_subject", "key"], "full")
    whole = F.lit(True)
    for signal in signals:
        whole = whole & F.col(f"raw_len_{signal}").isNotNull()
    out = out.withColumn("key", F.when(whole, F.col("key")).otherwise(F.raise_error(F.concat(F.lit("signals disagree on segment "), F.col("key")))))
    k = parse_key(F.col("key"))
    return out.select(F.lit(split).alias("split"), k["subject"].alias("subject"), k["class"].alias("class"), k["segment_idx"].alias("segment_idx"), segment_key(k["subject"], k["class"], k["segment_idx"]).alias("segment_id"), *[c for s in signals for c in (f"samples_{s}", f"raw_len_{s}")])


def write_split(df: DataFrame, root: str, split: str, signals: tuple[str, ...] = SIGNALS) -> None:
    """The recordings of a split as read_signal reads them: a CSV for each signal and subject, a column for each segment and a row for each sample.

    df: subject, key (the column's name) and samples_<signal>. Shorter segments end in blanks. A file is written by one task, and files are dealt over tasks.
    """
    spark = df.sparkSession
    long = df.select("subject", "key", F.inline(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(f"samples_{s}").cast("array<double>").alias("x")) for s in signals])))
    files = long.groupBy("signal", "subject").agg(F.map_from_entries(F.collect_list(F.struct("key", "x"))).alias("m")).withColumn("keys", F.sort_array(F.map_keys("m")))
    files = files.withColumn("columns", F.transform("keys", lambda k: F.coalesce(F.element_at("m", k), F.array().cast("array<double>"))))
    n = F.array_max(F.transform("columns", lambda x: F.size(x)))
    line = lambda t: F.array_join(F.transform("columns", lambda x: F.coalesce(F.get(x, t).cast("string"), F.lit(""))), ",")
    body = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), line)).otherwise(F.array().cast("array<string>"))
    lines = files.select("signal", "subject", F.array_join(F.concat(F.array(F.array_join("keys", ",")), body), "\n").alias("value"))
    part = f"{root}/.{split}-parts"
    # version 2: tasks move their own files when they end, and not the driver all of them
    lines.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("signal", "subject").text(part)
    fs, base = _fs(spark, part)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def name(subject) -> None:
        files = [f.getPath() for f in fs.listStatus(subject) if f.getPath().getName().startswith("part-")]
        if len(files) != 1:
            raise RuntimeError(f"{subject.getName()} is in {len(files)} files")
        signal = subject.getParent().getName().removeprefix("signal=")
        to = path(f"{root}/{split}/{signal}/{subject.getName().removeprefix('subject=')}.csv")
        fs.delete(to, False)
        if not fs.rename(files[0], to):
            raise RuntimeError(f"{to} could not be written")

    with ThreadPoolExecutor(RENAMES) as pool:
        for signal in (s.getPath() for s in fs.listStatus(base) if s.isDirectory()):
            fs.mkdirs(path(f"{root}/{split}/{signal.getName().removeprefix('signal=')}"))
            list(pool.map(name, (s.getPath() for s in fs.listStatus(signal))))
    fs.delete(base, True)


def cache_root(spark: SparkSession, default: str) -> str:
    """Where caches lie: the session's spark.tidewell.cache.dir, else the default."""
    return (spark.conf.get("spark.tidewell.cache.dir", None) or default).rstrip("/")


def load_split(spark: SparkSession, root: str, split: str, n_samples: int, cache: str | None = None, signals: tuple[str, ...] = SIGNALS) -> DataFrame:
    """build_split with every signal cut, or filled up with nulls, to n_samples; kept in a table for each split and n_samples."""

    def build() -> DataFrame:
        out = build_split(spark, root, split, signals)
        fit = lambda a: F.concat(F.slice(a, 1, n_samples), F.array_repeat(F.lit(None).cast("double"), F.greatest(F.lit(n_samples) - F.size(a), F.lit(0))))
        return out.withColumns({f"samples_{s}": fit(f"samples_{s}") for s in signals})

    return cached(spark, f"{cache_root(spark, cache or f'{root}/cache')}/{split}_{n_samples}", build)


def prime(spark: SparkSession, root: str, splits: list[str], n_samples: int, cache: str | None = None, signals: tuple[str, ...] = SIGNALS) -> DataFrame:
    """Build the splits' caches where they are missing. Gives (split, class, n)."""
    out = None
    for split in splits:
        counts = load_split(spark, root, split, n_samples, cache, signals).groupBy("split", "class").agg(F.count(F.lit(1)).alias("n"))
        out = counts if out is None else out.unionByName(counts)
    return out


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at path, built and written first if it is not there."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """A CSV folder with a header; for small results."""
    df.coalesce(1).write.mode("append" if append else "overwrite").csv(path, header=True)


def to_markdown(df: DataFrame, most: int = 1000) -> str:
    """A Markdown table of a small result; raises beyond most rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows]) + "\n"


def write_json(spark: SparkSession, path: str, value) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(value, sort_keys=True, indent=1).encode()))
    out.close()


def read_json(spark: SparkSession, path: str):
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
