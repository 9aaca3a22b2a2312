"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of a product of three binary Golay codes over the 64 bits (23 + 23 +
18, the last padded with zeros): each code is perfect, so every block is within the covering
radius 3 of exactly one code word, and a fingerprint has one home anchor. Fingerprints that
differ in t bits or fewer differ in t_i bits of block i with t_1 + t_2 + t_3 <= t, so one is
within 3 + t_i, block by block, of the other's home. Each distinct fingerprint is therefore
replicated to every anchor whose block distances exceed the radius by at most t in total (118
on average for t = 2) and compared there with the fingerprints that are at home. Exact copies
share a fingerprint and are never compared; links go to connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, worker_cache
from .components import components

#: Generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, and the blocks' (shift, bits).
GOLAY, RADIUS, LENGTH = 0xAE3, 3, 23
BLOCKS = ((0, 23), (23, 23), (46, 18))
SHINGLE_CHUNK = 200_000


def fingerprint(text: str | None, n: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the lower-cased (A-Z) text's word n-grams, repeats included; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = min(n, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - n + 1].tolist()
    ends = (ends[n - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    h64 = xxhash.xxh64_intdigest
    for k in range(0, len(starts), SHINGLE_CHUNK):
        h = np.fromiter((h64(joined[a:b], seed) for a, b in zip(starts[k : k + SHINGLE_CHUNK], ends[k : k + SHINGLE_CHUNK], strict=True)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def add_fingerprint(docs: DataFrame, n: int = 3, text_col: str = "text", as_col: str = "__tw_fp") -> DataFrame:
    """docs with the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, n) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(as_col, of(F.col(f"`{text_col}`").cast("string")))


def _syndromes() -> np.ndarray:
    """The remainder of x^i by the generator, for each bit i."""
    out, r = [], 1
    for _ in range(LENGTH):
        out.append(r)
        r <<= 1
        if r >> 11:
            r ^= GOLAY
    return np.array(out, np.int64)


def _cosets(extra: int):
    """For each excess e up to extra: (offsets by syndrome, error patterns of weight 3 + e; all weights up to 3 for e = 0)."""
    cache = worker_cache()
    if ("golay", extra) not in cache:
        syn = _syndromes()
        out = []
        for e in range(extra + 1):
            pats, keys = [], []
            for weight in range(RADIUS + 1) if e == 0 else [RADIUS + e]:
                if weight == 0:
                    pats.append(np.zeros(1, np.int64))
                    keys.append(np.zeros(1, np.int64))
                    continue
                at = np.array(list(combinations(range(LENGTH), weight)), np.int64)
                pats.append((1 << at).sum(1))
                keys.append(np.bitwise_xor.reduce(syn[at], axis=1))
            p, k = np.concatenate(pats), np.concatenate(keys)
            order = np.argsort(k, kind="stable")
            out.append((np.searchsorted(k[order], np.arange(2049)), p[order]))
        cache["golay", extra] = out
    return cache["golay", extra]


def _syndrome(v: np.ndarray) -> np.ndarray:
    out = np.zeros(len(v), np.int64)
    for i, s in enumerate(_syndromes().tolist()):
        out ^= np.where(v >> i & 1, s, 0)
    return out


def anchors(fps: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of fps, anchor) for every anchor whose block distances exceed the radius by t in total at most."""
    cosets = _cosets(t)
    blocks = [(fps.view(np.uint64) >> np.uint64(a) & np.uint64((1 << bits) - 1)).astype(np.int64) for a, bits in BLOCKS]
    syn = [_syndrome(b) for b in blocks]
    rows_out, out = [], []
    for e in [(i, j, k) for i in range(t + 1) for j in range(t + 1 - i) for k in range(t + 1 - i - j)]:
        rows, key = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        for b in range(3):
            first, pats = cosets[e[b]]
            lo, n = first[syn[b][rows]], first[syn[b][rows] + 1] - first[syn[b][rows]]
            at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            rows, key = np.repeat(rows, n), np.repeat(key, n)
            key = key << 12 | (blocks[b][rows] ^ pats[at]) >> 11  # systematic: the upper 12 bits name the code word
        rows_out.append(rows)
        out.append(key)
    return np.concatenate(rows_out), np.concatenate(out)


def links(fps: DataFrame, t: int = 2) -> DataFrame:
    """fps: distinct fp (long). Gives (u, v), u < v, once for every two that differ in 1 to t bits."""

    def replicate(extra: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                v = b["fp"].to_numpy(np.int64)
                for k in range(0, len(v), 2000):
                    rows, key = anchors(v[k : k + 2000], extra)
                    yield pd.DataFrame({"anchor": key, "fp": v[k : k + 2000][rows]})

        return run

    home = fps.mapInPandas(replicate(0), "anchor long, fp long").withColumnRenamed("fp", "u")
    near = fps.mapInPandas(replicate(t), "anchor long, fp long").withColumnRenamed("fp", "v")
    close = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= t)
    # Spark sizes near by its fingerprints, as if each were there once, and would broadcast it beside 10 MB of them.
    return home.join(near.hint("merge"), "anchor").filter(close).select("u", "v")


def group(rows: DataFrame, t: int = 2) -> DataFrame:
    """rows: doc_id, fp. Gives (fp, root, component_id): the least fingerprint, and the least doc_id, of the rows whose fingerprints are reachable by links."""
    own = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    parts = min(max(8, own.count() // 20_000), 4096)
    stars = components(links(own.select("fp").repartition(parts, "fp"), t))
    joined = own.join(stars, own["fp"] == stars["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, n: int = 3, t: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of docs.

    Texts without words, null ones too, have the fingerprint zero and are linked like any other. Null ids are not
    counted for component_id, which is null only where a whole component has none. Repeated rows stay.
    """
    rows = add_fingerprint(docs, n, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), F.col("__tw_fp").alias("fp"))
    rows = materialize(rows, "simhash")
    out = rows.join(materialize(group(rows, t), "components"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, n: int = 3, t: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the least (id, text hash), nulls first. Columns stay as they are."""
    th = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    rows = add_fingerprint(docs, n, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), th.alias("th"), F.col("__tw_fp").alias("fp"))
    rows = materialize(rows, "simhash")
    same = rows.groupBy("fp", "doc_id", "th").agg(F.count(F.lit(1)).alias("m"))
    best = same.groupBy("fp").agg(F.min(F.struct("doc_id", "th", "m")).alias("s"))
    keys = materialize(group(rows, t), "components").join(best, "fp")
    # By root, not component_id: that is null for every component without ids, and an id repeated with unlike texts may lead two.
    return keep_rows(docs, keys.groupBy("root").agg(F.min("s").alias("s")), th, id_col)


def keep_rows(docs: DataFrame, keep: DataFrame, th: F.Column, id_col: str) -> DataFrame:
    """One row of docs for each s (doc_id, th, m) of keep; m rows of docs have that id and text hash."""
    keep = keep.select(F.col("s.doc_id").alias("__tw_id"), F.col("s.th").alias("__tw_h"), F.col("s.m").alias("__tw_m"))
    keep = materialize(keep, "survivors")
    hit = F.col(f"`{id_col}`").eqNullSafe(F.col("__tw_id")) & (F.col("__tw_th") == F.col("__tw_h"))
    marked = docs.withColumn("__tw_th", th)
    once = marked.join(keep.filter("__tw_m = 1"), hit, "left_semi")
    more = marked.join(keep.filter("__tw_m > 1"), hit, "left_semi").dropDuplicates([id_col, "__tw_th"])
    return once.unionByName(more).drop("__tw_th")
