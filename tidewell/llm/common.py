"""What the training-data operators share: word expressions, tables on shared storage, size checks."""

from __future__ import annotations

import gc
import sys
import tempfile
import time
import uuid
from collections.abc import Callable

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: ASCII white space, or all ASCII but digits and lower-case letters.
WS_GAP = r"[\x20\x09-\x0D]+"
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column, gap: str = WS_GAP) -> Column:
    """The words between the gaps of the whole text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(c.cast("string"), F.lit("")), gap), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns whose names, in any case, an operator is about to write."""
    clash = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in clash])


class WordHashes(dict):
    """Words to their XXH64, kept for as long as this dict lives."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it. A folder of our own only where it is unset and Spark is local."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        sc = spark.sparkContext
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = _local_folder()
    return conf.rstrip("/")


def worker_cache() -> dict:
    """A dict that lives as long as this Python process."""
    return sys.__dict__.setdefault("_tidewell_cache", {})


def _local_folder() -> str:
    cache = worker_cache()
    if "local_folder" not in cache:
        cache["local_folder"] = tempfile.mkdtemp(prefix="tidewell-")
    return cache["local_folder"]


def app_folder(spark: SparkSession) -> str:
    """The application's folder; it goes when the driver ends, or with cleanup()."""
    path = f"{_folder(spark)}/tidewell-{spark.sparkContext.applicationId}"
    if worker_cache().get("marked") != path:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
        worker_cache()["marked"] = path
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{app_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table on the shared storage and read it back: lineage ends here, and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once nothing reads it any more."""
    jvm, jsc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder: partitions, and the order within them, stay as they are."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def cleanup(spark: SparkSession) -> None:
    """Delete the tables that materialize() wrote in this application."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(app_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def collect_garbage(spark: SparkSession) -> None:
    """Collect the driver's heap now, so that it does not grow by finished queries and their broadcasts."""
    gc.collect()  # what Python still holds of them
    spark.sparkContext._jvm.System.gc()


def free_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of finished queries deleted now: Spark does so when the driver's heap is next collected, which may be long after."""
    for _ in range(2):  # what listeners still hold at first is free the second time
        collect_garbage(spark)
        time.sleep(0.5)


def broadcast_if(df: DataFrame, most_rows: int, most_bytes: int = 32 << 20) -> DataFrame:
    """df marked for broadcast if it has at most so many rows and bytes; else as it is, for a shuffled join. df should be cheap to compute."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    n, held = df.limit(most_rows + 1).agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    return F.broadcast(df) if n <= most_rows and held <= most_bytes else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
