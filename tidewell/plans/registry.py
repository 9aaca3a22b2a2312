"""Registration of queries with their DuckDB SQL, and the tables in their roles.

Roles: events are segments (subject = user_id, class by event_type, features bvp_value, eda_k and
resp_minute), a quarter of the subjects is the validation split; embeddings are signals of 64
samples; lineitem is four channels of a subject (supplier) in three classes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FEATURES = ["bvp_value", "eda_k", "resp_minute"]
EVENT_CLASS = {"view": "NoPain", "click": "PainArm", "purchase": "PainHand"}
DIGITS = 6
#: Added before rounding, so that values that end in 5 after the last digit do not depend on the order of sums.
NUDGE = "1.2345e-8"

#: The role tables for the SQL side.
SEG = """seg AS (
  SELECT event_id AS segment_id, user_id AS subject,
         CASE event_type WHEN 'view' THEN 'NoPain' WHEN 'click' THEN 'PainArm' ELSE 'PainHand' END AS class,
         CASE WHEN user_id % 4 = 0 THEN 'validation' ELSE 'train' END AS split,
         value AS bvp_value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS eda_k, CAST(extract(minute FROM ts) AS DOUBLE) AS resp_minute
  FROM events WHERE event_type IN ('view', 'click', 'purchase'))"""
SIG = "sig AS (SELECT vec_id AS segment_id, label AS class, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS samples FROM embeddings)"
LONG = SEG + """, long AS (
  SELECT segment_id, subject, class, split, 'bvp_value' AS feature, bvp_value AS value FROM seg
  UNION ALL SELECT segment_id, subject, class, split, 'eda_k', eda_k FROM seg
  UNION ALL SELECT segment_id, subject, class, split, 'resp_minute', resp_minute FROM seg),
means AS (SELECT subject, class, feature, avg(value) AS value FROM long GROUP BY ALL)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin(*EVENT_CLASS))
    cls = F.when(F.col("event_type") == "view", "NoPain").when(F.col("event_type") == "click", "PainArm").otherwise("PainHand")
    return e.select(
        F.col("event_id").alias("segment_id"), F.col("user_id").alias("subject"), cls.alias("class"), F.when(F.col("user_id") % 4 == 0, "validation").otherwise("train").alias("split"),
        F.col("value").alias("bvp_value"), F.get_json_object("props", "$.k").cast("double").alias("eda_k"), F.minute("ts").cast("double").alias("resp_minute"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("segment_id"), F.col("label").alias("class"), F.col("embedding").cast("array<double>").alias("samples"))


def recordings(spark: SparkSession, sf_dir: str, parts: int = 16) -> DataFrame:
    """(recording_id, class, samples): the signals of so many neighbouring segments one after the other, some ten seconds at 100 Hz; the last may be shorter. class: of the first."""
    s = signals(spark, sf_dir).groupBy(F.floor(F.col("segment_id") / parts).alias("recording_id")).agg(F.sort_array(F.collect_list(F.struct("segment_id", "class", "samples"))).alias("s"))
    return s.select("recording_id", F.get("s", F.lit(0))["class"].alias("class"), F.flatten(F.transform("s", lambda x: x["samples"])).alias("samples"))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{f.name}`") + float(NUDGE), DIGITS).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`") for f in df.schema])


def query(name: str, sql: str | None = None, doubles: str = "", others: str = ""):
    """Register f(spark, sf_dir); doubles and others name the columns of its result, doubles are rounded on both sides."""

    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            cols = [*others.split(), *[f"round({c} + {NUDGE}, {DIGITS}) + 0.0 AS {c}" for c in doubles.split()]]
            head, _, body = sql.strip().rpartition("\n--\n")
            SQL[name] = f"{'WITH ' + head if head else ''} SELECT {', '.join(cols)} FROM ({body})"
        return f

    return add
