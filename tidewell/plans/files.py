"""Queries that write files, read them back, and return what came through."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import aggregate as agg
from tidewell.sources import io
from tidewell.sources.shared import new_path

from .registry import SEG, SIG, query, segments, signals

#: Signals as recordings: 24 neighbours are a subject's, a third of them of each tag; the signals are the samples, backwards, doubled, and cut by segment.
WIDE = SIG + """, w AS (SELECT CAST(segment_id // 24 AS INTEGER) AS subject, CAST(segment_id % 24 // 3 + 1 AS INTEGER) AS idx, ['NoPain', 'PainArm', 'PainHand'][segment_id % 3 + 1] AS class, samples AS bvp, list_reverse(samples) AS eda, list_transform(samples, lambda x: 2 * x) AS resp, samples[1 : 64 - segment_id % 5] AS spo2 FROM sig)"""


def _moment(c: str) -> F.Column:
    return F.aggregate(F.zip_with(c, F.sequence(F.lit(1), F.size(c)), lambda x, k: F.coalesce(x, F.lit(0.0)) * k), F.lit(0.0), lambda a, x: a + x)


@query("recordings_round_trip", WIDE + """, d AS (SELECT subject, class, idx, len(spo2) AS n, [bvp, eda, resp, spo2] AS s FROM w)
--
SELECT subject, class, idx AS segment_idx, concat_ws('_', subject, class, idx) AS segment_id, CAST(64 AS INTEGER) AS raw_len_bvp, CAST(n AS INTEGER) AS raw_len_spo2, list_sum(list_transform(range(1, 61), lambda i: i * s[1][i])) AS bvp, list_sum(list_transform(range(1, 61), lambda i: i * s[2][i])) AS eda, list_sum(list_transform(range(1, 61), lambda i: i * s[3][i])) AS resp, list_sum(list_transform(range(1, 61), lambda i: i * coalesce(s[4][i], 0))) AS spo2 FROM d""", "bvp eda resp spo2", "subject class segment_idx segment_id raw_len_bvp raw_len_spo2")  # fmt: skip
def recordings_round_trip(spark, d):
    """Signals written as wide CSVs of each signal and subject, found, read, put together and checked, cached at 60 samples, and read from the cache."""
    s, root = signals(spark, d), new_path(spark, "recordings")
    i, x = F.col("segment_id"), F.col("samples")
    tag = F.get(F.array(*[F.lit(t) for t in ("Baseline", "ARM", "HAND")]), (i % 3).cast("int"))
    subject = F.floor(i / 24).cast("int")
    wide = s.select(subject.alias("subject"), F.concat_ws("_", subject, tag, F.floor(i % 24 / 3) + 1).alias("key"), x.alias("samples_Bvp"), F.reverse(x).alias("samples_Eda"), F.transform(x, lambda v: 2 * v).alias("samples_Resp"), F.slice(x, F.lit(1), F.lit(64) - i % 5).alias("samples_SpO2"))
    io.write_split(wide, root, "train")
    io.prime(spark, root, ["train"], 60)
    out = io.load_split(spark, root, "train", 60)
    if set(io.subjects(spark, root, "train")) != {r.subject for r in out.select("subject").distinct().collect()}:
        raise ValueError("subjects and files disagree")
    return out.select("subject", "class", "segment_idx", "segment_id", F.col("raw_len_Bvp").alias("raw_len_bvp"), F.col("raw_len_SpO2").alias("raw_len_spo2"), *[_moment(f"samples_{k}").alias(k.lower()) for k in io.SIGNALS])


@query("appended_summaries", SEG + "\n--\nSELECT split, class, avg(bvp_value) AS mean, count(*) AS n FROM seg GROUP BY split, class", "mean", "split class n")
def appended_summaries(spark, d):
    """Class means of each split, appended to one CSV folder with headers, and read back; the settings go through JSON."""
    path = new_path(spark, "summary")
    for split in ("train", "validation"):
        part = agg.class_means(segments(spark, d).filter(F.col("split") == split), ["bvp_value"])
        io.write_csv(part.select(F.lit(split).alias("split"), "class", F.col("bvp_value_mean").alias("mean"), F.col("bvp_value_n").alias("n")), path, append=True)
    io.write_json(spark, f"{path}.json", {"columns": ["split", "class", "mean", "n"], "types": "string string double long"})
    settings = io.read_json(spark, f"{path}.json")
    schema = ", ".join(f"{c} {t}" for c, t in zip(settings["columns"], settings["types"].split(), strict=True))
    return spark.read.csv(path, header=True, schema=schema)
