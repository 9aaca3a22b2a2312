"""Importance resampling toward a target distribution over hashed n-grams.

The n-gram arrays of every document are exploded, each n-gram goes to bucket crc32 modulo M, and grouped counts of
the documents' and the target's buckets give a table of at most M gains, which is broadcast. A document's weight is
the sum of its features' gains; Gumbel noise from a hash of its id makes the highest scores a draw without
replacement. One sort by range, with the offset of each partition, ranks all rows. Built-in functions only.

Null and empty texts have no features, weight 0, and aren't drawn. Every row is a document of its own, rows of equal
ids too; a null id is hashed as the empty string and comes last among ties. Rows of equal score and id take ranks in
any order. An empty table gives no rows, an empty target leaves its counts 0. Other columns of docs are ignored, whatever
their names; selected() gives the drawn rows with all their columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, without

#: All of ASCII but digits and letters separates words.
GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


@dataclass(frozen=True)
class Settings:
    buckets: int = 10_000
    longest: int = 3  #: words of the longest n-gram
    min_words: int = 20  #: documents with fewer can't be drawn
    percent: int = 5  #: of the documents that can
    seed: int = 42


def target_words(text: Column) -> Column:
    """Words of ASCII digits, lower-cased ASCII letters and all other characters; one translate and a split at single spaces."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER + GAPS, LOWER + " " * len(GAPS))
    return F.array_remove(F.split(plain, " "), "")


def feature_buckets(docs: DataFrame, s: Settings, text_col: str, *keys: str) -> DataFrame:
    """keys, n_words and bucket: one row for each place of a text and n-gram length, with a null bucket where the n-gram would end
    beyond the text; texts without words have rows with null buckets only."""
    w = docs.select(*keys, target_words(F.col(f"`{text_col}`")).alias("w"))
    n = F.size("w")
    shifted = [F.col("w").alias("g0"), *[F.slice("w", k + 1, F.greatest(n, F.lit(1))).alias(f"g{k}") for k in range(1, s.longest)]]
    at = w.select(*keys, n.cast("long").alias("n_words"), F.explode_outer(F.arrays_zip(*shifted)).alias("z"))
    parts = [F.col(f"z.g{k}") for k in range(s.longest)]
    spaced = [x for p in parts for x in (F.lit(" "), p)][1:]
    grams = [F.concat(*spaced[: 2 * k + 1]) for k in range(s.longest)]  # null where a later word is
    return at.select(*keys, "n_words", F.explode(F.array(*[(F.crc32(g.cast("binary")) % s.buckets).cast("int") for g in grams])).alias("bucket"))


def n_features(n_words: Column, s: Settings) -> Column:
    return sum((F.greatest(n_words - k, F.lit(0)) for k in range(s.longest)), F.lit(0)).cast("long")


def bucket_counts(docs: DataFrame, s: Settings, text_col: str = "text") -> DataFrame:
    """(bucket, n) of all features; at most s.buckets rows."""
    return feature_buckets(docs, s, text_col).filter("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gain_table(docs: DataFrame, target: DataFrame, s: Settings = Settings(), text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(bucket, gain) for every bucket of a document's feature; at most s.buckets rows. gain: floor(1000 ln of the ratio of smoothed shares)."""
    raw = materialize(bucket_counts(docs, s, text_col), "raw-buckets")
    aim = materialize(bucket_counts(target, s, target_text_col), "target-buckets")
    all_raw, all_aim = (x.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for x in (raw, aim))
    both = raw.withColumnRenamed("n", "s").join(F.broadcast(aim.withColumnRenamed("n", "t")), "bucket", "left")
    t, b = F.coalesce("t", F.lit(0)), s.buckets
    ratio = (t + 1).cast("double") * F.lit(float(all_raw + b)) / ((F.col("s") + 1).cast("double") * F.lit(float(all_aim + b)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256(seed:doc_id)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def score(docs: DataFrame, target: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", stable: bool = False) -> DataFrame:
    """doc_id, n_words, n_features, weight, score for every row of docs.

    stable: docs is a stored table, whose partitions hold the same rows whenever they are read. Else it is written first, since
    rows are numbered by their places and a lost partition may be computed again.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = (rows if stable else materialize(rows, "documents")).withColumn("row", F.monotonically_increasing_id())
    gains = F.broadcast(gain_table(rows, target, s, "text", target_text_col))  # at most s.buckets rows
    found = feature_buckets(rows, s, "text", "row", "doc_id").join(gains, "bucket", "left")
    sums = found.groupBy("row", "doc_id", "n_words").agg(F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    return sums.select("doc_id", "n_words", n_features(F.col("n_words"), s).alias("n_features"), "weight", (F.col("weight") + noise(F.col("doc_id"), s.seed)).alias("score"))


def draw(scored: DataFrame, s: Settings = Settings()) -> DataFrame:
    """scored with rank: 1 for the highest score, and so on, for s.percent of the rows with enough words; null for the others.

    Rows are sorted by range once and written with their places; a row's rank is its place and the offset of its partition.
    """
    can = F.col("n_words") >= s.min_words
    order = [F.when(can, 0).otherwise(1).asc(), F.desc("score"), F.asc_nulls_last("doc_id")]
    ordered = without(scored, "rank", "part", "place").repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    placed = materialize(ordered.select("*", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "placed")
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(can).alias("able"))  # a row for each partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    able = F.sum("able").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    offsets = parts.select("part", before.alias("before"), F.floor(able * s.percent / 100).alias("most"))
    rank = F.col("before") + F.col("place") + 1
    out = placed.join(F.broadcast(offsets), "part")
    return out.withColumn("rank", F.when(can & (rank <= F.col("most")), rank).cast("long")).drop("part", "place", "before", "most")


def resample(docs: DataFrame, target: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", stable: bool = False) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for every row of docs; rank is null for those not drawn."""
    return draw(materialize(score(docs, target, s, id_col, text_col, target_text_col, stable), "scores"), s)


def selected(docs: DataFrame, ranked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that were drawn. ids must be unique in docs."""
    kept = ranked.filter("rank is not null").select(F.col("doc_id").alias("__id"))
    return docs.join(kept, F.col(f"`{id_col}`") == F.col("__id"), "left_semi")
