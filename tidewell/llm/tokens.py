"""Token counts: an exact histogram of encoded lengths, and its suffix sums.

Documents are encoded whole with a public byte-level BPE vocabulary and counted by their
length, before anything is shuffled. The histogram is cut into blocks of lengths; suffix sums
run within each block and start from the totals of the longer blocks, so no task needs the
whole histogram. From them every context limit L has its exact answers: how many documents
are longer, their tokens, and the tokens left if each document is cut at L.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, worker_cache

#: The pre-tokenizer's pattern that goes with the vocabulary files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pieces, faster: a word, a number and a contraction can't start alike, so their order is free, and all that needs no look-ahead is one group.
FASTER = r"(?: ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]+)|\s+(?!\S)|\s+"
BLOCK = 1024
MOST_VOCABULARY = 32 << 20
#: White space as the pattern has it, in runs too long for its look-ahead.
LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def default_vocabulary() -> str:
    """The path of byte_bpe_50k.tiktoken among the installed public tokenizers."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, "byte_bpe_50k.tiktoken")


def vocabulary_bytes(spark: SparkSession, path: str) -> bytes:
    """The vocabulary file, from the driver's disk or else by a path that Spark reads. Its size is bounded by MOST_VOCABULARY."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            data = f.read(MOST_VOCABULARY + 1)
    else:
        data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    if len(data) > MOST_VOCABULARY:
        raise ValueError(f"{path} is larger than a vocabulary should be")
    return data


def encoder(path: str, data: bytes | None = None):
    """The encoding of this process. data: the file's content, where the file itself is not at hand."""
    cache = worker_cache()
    if ("bpe", path) not in cache:
        import tiktoken

        if data is None:
            with open(path, "rb") as f:
                data = f.read()
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}
        cache["bpe", path] = tiktoken.Encoding("vocabulary", pat_str=FASTER, mergeable_ranks=ranks, special_tokens={})
        cache["blank", path] = tiktoken.Encoding("blanks", pat_str=r"\s+", mergeable_ranks=ranks, special_tokens={})
    return cache["bpe", path]


def encoded_length(text: str | None, path: str, data: bytes | None = None) -> int:
    """Tokens of the whole text; of a null one 0.

    The pattern takes a run of white space up to its last character as one piece, and that character with what follows;
    at the end of the text it takes all of the run. Its engine fails on very long runs, so these are cut there.
    """
    encode = encoder(path, data).encode_ordinary
    n = at = 0
    for m in LONG_BLANK.finditer(text) if text and len(text) >= 10_000 else ():
        end = m.end() - (m.end() < len(text))
        n += len(encode(text[at : m.start()])) + len(worker_cache()["blank", path].encode_ordinary(text[m.start() : end]))
        at = end
    return n + len(encode(text[at:])) if text else 0


def add_length(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text", as_col: str = "n_tokens") -> DataFrame:
    """docs with the encoded length of the whole text; null and empty texts have 0. A column of that name is replaced.

    vocabulary: a path that the driver or Spark can read; executors get the file by broadcast.
    """
    path = vocabulary or default_vocabulary()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(docs.sparkSession, path))

    @F.pandas_udf("long")
    def length(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([encoded_length(t, path, shared.value) for t in texts], np.int64))

    return docs.withColumn(as_col, length(F.col(f"`{text_col}`").cast("string")))


def histogram(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """(length, n_docs) over all rows of docs, repeated ones too."""
    rows = add_length(docs.select(F.col(f"`{text_col}`").alias("text")), vocabulary)
    return rows.groupBy(F.col("n_tokens").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """hist with what documents of this length or more sum to, and with the answers for a context limit of this length.

    docs_from, tokens_from: documents of at least this length and their tokens. docs_total, tokens_total: of all.
    truncated_tokens: tokens left if every document is cut at this length. share_within: of documents not cut by it.
    An empty histogram gives no rows.
    """
    rows = materialize(hist.withColumn("block", F.floor(F.col("length") / BLOCK)), "histogram")
    tokens = F.col("length") * F.col("n_docs")
    longer = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("bn"), F.sum(tokens).alias("bt"))
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bn").over(longer), F.lit(0)).alias("n_after"),
        F.coalesce(F.sum("bt").over(longer), F.lit(0)).alias("t_after"),
        F.sum("bn").over(everything).alias("docs_total"),
        F.sum("bt").over(everything).alias("tokens_total"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(blocks, "block")
    out = out.withColumn("docs_from", F.col("n_after") + F.sum("n_docs").over(within)).withColumn("tokens_from", F.col("t_after") + F.sum(tokens).over(within))
    return out.select(
        "length", "n_docs", "docs_from", "tokens_from", "docs_total", "tokens_total",
        (F.col("tokens_total") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated_tokens"),
        ((F.col("docs_total") - F.col("docs_from") + F.col("n_docs")) / F.col("docs_total")).alias("share_within"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_longer, tokens_total, truncated_tokens) for any limits, those between two lengths too."""
    longer_than = lambda x: F.when(F.col("length") > F.lit(int(x)), F.col("length"))
    one = sums.agg(F.max("tokens_total").alias("tokens_total"), *[F.min_by(F.struct("docs_from", "tokens_from"), longer_than(x)).alias(f"s{i}") for i, x in enumerate(limits)])
    rows = F.array(*[F.struct(F.lit(int(x)).cast("long").alias("limit"), F.col(f"s{i}").alias("s")) for i, x in enumerate(limits)])
    first = one.select("tokens_total", F.inline(rows))
    longer, cut = F.coalesce("s.docs_from", F.lit(0)), F.coalesce("s.tokens_from", F.lit(0))
    return first.select("limit", longer.alias("docs_longer"), "tokens_total", (F.col("tokens_total") - cut + F.col("limit") * longer).alias("truncated_tokens"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that at least this share of the documents do not exceed."""
    up_to = F.col("docs_total") - F.col("docs_from") + F.col("n_docs")
    aggs = [F.min(F.when(up_to >= F.lit(float(q)) * F.col("docs_total"), F.col("length"))).alias(f"q{i}") for i, q in enumerate(shares)]
    one = sums.agg(*aggs)
    return one.select(F.inline(F.array(*[F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("length")) for i, q in enumerate(shares)])))
