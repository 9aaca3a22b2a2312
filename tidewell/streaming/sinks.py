"""A resumable sink for streams of results: each micro-batch upserts its keys once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewell.operators.relational import upsert
from tidewell.sources.io import exists, read_json, write_json


def upsert_batches(path: str, keys: list[str]):
    """For writeStream.foreachBatch: versions of the table under path, the current one named in path/current.json.

    A batch that is delivered again finds its number recorded and changes nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = read_json(spark, f"{path}/current.json") if exists(spark, f"{path}/current.json") else {"batch": -1, "version": None}
        if number <= state["batch"]:
            return
        out = upsert(spark.read.parquet(state["version"]), batch, keys) if state["version"] else batch
        out.write.mode("overwrite").parquet(f"{path}/v{number}")
        write_json(spark, f"{path}/current.json", {"batch": number, "version": f"{path}/v{number}"})

    return run


def current(spark, path: str) -> DataFrame:
    return spark.read.parquet(read_json(spark, f"{path}/current.json")["version"])
