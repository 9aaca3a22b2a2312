"""Near-duplicates of a given Jaccard similarity of their sets of word shingles.

SimHash with anchors comes first: sets whose fingerprints differ in t bits or fewer meet at an anchor, are compared exactly, and
those that are similar become one component. Fingerprints of a few bits' difference can't find all pairs of a similarity
of 0.8, though, whose fingerprints differ in some ten bits, and no anchors cover that. So prefixes of the sets complete it: two sets of similarity t or more share one of the first m - ceil(t m) + 1 shingles of each, m being its size, in any one order of all
shingles; so only sets that meet there are compared, and none is missed. The order is by hash, with shingles that are
frequent there last: that choice changes the cost, never the result. Equal sets are one. Each set has a bitmap of a few bits a shingle, by which
most pairs that aren't similar are ruled out before whole sets are fetched: a bit that one set has and the other has not is a shingle they don't share. Where sets meet, all are compared with a few of them first,
twice, and only then with each other; each time only sets of different components are, as others can't change the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, broadcast_if, discard, free_shuffles, materialize
from .components import components
from .lm import _mix, _tokens
from .simhash import keep_rows, links

#: A shingle in more prefixes than this is put last, for the most frequent so many. For that, prefixes are taken as for a similarity lower by WIDER,
#: since what comes into them once others are put last should be known too.
FREQUENT, MOST_FREQUENT, WIDER = 20, 200_000, 0.25
BROADCAST_SETS, BROADCAST_BYTES = 200_000, 96 << 20
#: Sets of a bucket with which all of it are compared in each of the two first rounds.
CENTRES = 24
#: Bits of a set's bitmap for each of its shingles, at least; the next power of two.
BITS = 4


def shingles(text: str | None, n: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-cased (A-Z) text's word n-grams; of all its words, if it has fewer than n."""
    x = np.array(list(map(hashes.__getitem__, _tokens(text))), np.uint64)
    n = min(n, len(x))
    if n == 0:
        return np.zeros(0, np.int64)
    h = x[: len(x) - n + 1]
    for k in range(1, n):
        h = _mix(h, x[k : len(x) - n + 1 + k])
    return np.unique(h.view(np.int64))


def _fingerprint(h: np.ndarray) -> int:
    """64-bit SimHash of a set of hashes, signed."""
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def bitmap(h: np.ndarray) -> bytes:
    """Which low bits the hashes of a set end in."""
    n = 1 << max(6, (BITS * len(h) - 1).bit_length())
    there = np.zeros(n, bool)
    there[h & (n - 1)] = True
    return np.packbits(there).tobytes()


def most_shared(a: bytes, b: bytes, ma: int, mb: int) -> int:
    """No fewer than the hashes that two sets of ma and mb share, from their bitmaps. The longer one is folded to the other's length."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(ma - int(np.bitwise_count(x & ~y).sum()), mb - int(np.bitwise_count(y & ~x).sum()))


def _sets(rows: DataFrame, n: int, least: float, last=None, whole: bool = False) -> DataFrame:
    """rows with sid (a hash of the set), m (its size), fp (the set's SimHash), rare (how many are not in last), bits (its bitmap, if last is given) and hs: the set if whole, else its prefix."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        common = last.value if last is not None else np.zeros(0, np.int64)
        for texts in batches:
            hashes, out = WordHashes(), []
            for t in texts:
                h = shingles(t, n, hashes)
                sid, m = int(np.uint64(xxhash.xxh64_intdigest(h.tobytes())).view(np.int64)), len(h)
                fp, rare = 0 if whole or not m else _fingerprint(h), 0
                bits = bitmap(h) if last is not None else None
                if not whole:
                    if len(common) and m:
                        known = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
                        rare = m - int(known.sum())
                        h = h[np.argsort(known, kind="stable")]
                    h = h[: m - math.ceil(least * m - 1e-9) + 1]
                out.append((sid, m, fp, rare, bits, h))
            yield pd.DataFrame(out, columns=["sid", "m", "fp", "rare", "bits", "hs"])

    of = F.pandas_udf(run, "sid long, m int, fp long, rare int, bits binary, hs array<long>")
    return rows.withColumn("s", of("text")).select(*[c for c in rows.columns if c != "text"], "s.*")


def _written(df: DataFrame, name: str) -> DataFrame:
    """materialize(), and the shuffle files that it took are deleted at once: the sets' shingles take several times the disk of the texts."""
    out = materialize(df, name)
    free_shuffles(df.sparkSession)
    return out


def _likely(pairs: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) of sets whose bitmaps don't rule out a similarity of least."""

    @F.pandas_udf("boolean")
    def may(a: pd.Series, b: pd.Series, ma: pd.Series, mb: pd.Series) -> pd.Series:
        shared = np.array([most_shared(*x) for x in zip(a, b, ma.tolist(), mb.tolist(), strict=True)], float)
        return pd.Series(shared / (ma.to_numpy() + mb.to_numpy() - shared) >= least)

    a, b = (names.select(F.col("sid").alias(k), F.col("bits").alias(f"b{k}"), F.col("m").alias(f"m{k}")) for k in "uv")
    return pairs.join(a, "u").join(b, "v").filter(may("bu", "bv", "mu", "mv")).select("u", "v")


def _similar(pairs: DataFrame, names: DataFrame, texts: DataFrame, n: int, least: float) -> DataFrame:
    """The pairs (u, v) of sets whose similarity is at least least. names: (sid, th, m, bits), with a text of each set by its hash. Only texts of likely pairs are cut again."""
    pairs = _written(_likely(pairs.distinct(), names, least), "pairs")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("sid")).distinct().join(names.select("sid", "th"), "sid")
    chosen = texts.join(broadcast_if(materialize(wanted.select("th").distinct(), "wanted"), BROADCAST_SETS), "th", "left_semi").dropDuplicates(["th"])
    whole = _written(_sets(chosen.select("text"), n, least, whole=True).select("sid", "hs"), "sets")  # a text for each set
    sets = broadcast_if(whole, BROADCAST_SETS, BROADCAST_BYTES)  # else both joins are shuffled
    both = pairs.join(sets.select(F.col("sid").alias("u"), F.col("hs").alias("a")), "u").join(sets.select(F.col("sid").alias("v"), F.col("hs").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    out = _written(both.filter(shared / (F.size("a") + F.size("b") - shared) >= least).select("u", "v"), "similar")
    discard(whole)
    return out


def deduplicate(docs: DataFrame, n: int = 5, least: float = 0.8, t: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of pairs with a Jaccard similarity of at least least: that of the least (id, text hash), nulls first.

    Texts without words are alike. Columns stay as they are; repeated rows, and null or repeated ids, are no obstacle.
    """
    text = F.col(f"`{text_col}`").cast("string")
    th = F.xxhash64(F.coalesce(text, F.lit("")))
    texts = docs.select(th.alias("th"), text.alias("text"))
    often = _sets(texts.select("text"), n, least - WIDER).dropDuplicates(["sid"]).select(F.explode("hs").alias("h")).groupBy("h").count().filter(F.col("count") > FREQUENT)
    often = np.array([r.h for r in often.orderBy(F.desc("count"), "h").limit(MOST_FREQUENT).select("h").collect()], np.int64)
    free_shuffles(docs.sparkSession)
    last = docs.sparkSession.sparkContext.broadcast(np.sort(often))

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), th.alias("th"), text.alias("text"))
    rows = materialize(_sets(rows, n, least, last), "prefixes")
    names = _written(rows.groupBy("sid").agg(F.min("th").alias("th"), F.first("m").alias("m"), F.first("bits").alias("bits")), "set-names")
    near = lambda a, b: F.least(a, b) >= F.greatest(a, b) * (least - 1e-9)
    anchored = _similar(_anchored(rows, t, near), names, texts, n, least)
    joined = components(anchored)

    buckets = rows.select("sid", "m", "rare", "hs").dropDuplicates(["sid"]).join(joined, F.col("sid") == F.col("node"), "left")
    buckets = buckets.select("sid", "m", "rare", F.coalesce("root", "sid").alias("root"), F.posexplode("hs").alias("i", "h"))
    size = buckets.groupBy("h").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("h")
    buckets = _written(buckets.join(size, "h", "left_semi"), "buckets")

    def fits(ma, ia, mb, ib):
        """If a pair's first common shingle has places ia and ib in the order of all, the sets share at most what comes after; less than the least similarity needs rules the pair out here."""
        return near(ma, mb) & (F.least(ma - ia, mb - ib) >= F.ceil((ma + mb) * (least / (1 + least)) - 1e-9))

    def apart(x: DataFrame, y: DataFrame) -> DataFrame:
        """Pairs of different components that meet in a bucket of x and y and may be similar."""
        a, b = x.toDF("h", "u", "mu", "iu", "ru"), y.toDF("h", "v", "mv", "iv", "rv")
        met = a.join(b, "h").filter((F.col("ru") != F.col("rv")) & fits(F.col("mu"), F.col("iu"), F.col("mv"), F.col("iv")))
        return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))

    # All of a bucket are first compared with a few of it: those with the fewest shingles of their own, as patterns of many near copies
    # have, then others. What these have joined isn't compared again, so that only what is left is compared with all.
    linked, cols = anchored, ["h", "sid", "m", "i", "root"]
    for k, order in enumerate((["rare", "sid"], [F.xxhash64("sid"), F.col("sid")])):
        chosen = buckets.withColumn("__r", F.row_number().over(Window.partitionBy("h").orderBy(*order))).filter(F.col("__r") <= CENTRES)
        linked = linked.union(_similar(apart(buckets.select(*cols), chosen.select(*cols)), names, texts, n, least))
        placed = buckets.drop("root").join(components(linked), F.col("sid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "sid")).drop("node")
        mixed = placed.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("h")
        buckets = _written(placed.join(mixed, "h", "left_semi"), f"mixed-{k}")
    rest = buckets.select(*cols)
    roots = components(linked.union(_similar(apart(rest, rest), names, texts, n, least)))

    same = rows.groupBy("sid", "doc_id", "th").agg(F.count(F.lit(1)).alias("m"))
    best = same.groupBy("sid").agg(F.min(F.struct("doc_id", "th", "m")).alias("s"))
    keep = best.join(roots, F.col("sid") == F.col("node"), "left").groupBy(F.coalesce("root", "sid").alias("root")).agg(F.min("s").alias("s"))
    return keep_rows(docs, keep, th, id_col)


def _anchored(rows: DataFrame, t: int, near) -> DataFrame:
    """(u, v): sets of one fingerprint with the least of them, and the least sets of fingerprints that differ in t bits or fewer."""
    prints = rows.filter("m > 0").groupBy("sid").agg(F.first("m").alias("m"), F.first("fp").alias("fp"))
    least = materialize(prints.groupBy("fp").agg(F.min(F.struct("sid", "m")).alias("c"), F.count(F.lit(1)).alias("sets")), "prints")
    same = prints.join(least.filter("sets > 1"), "fp").filter((F.col("sid") != F.col("c.sid")) & near(F.col("c.m"), F.col("m"))).select(F.col("c.sid").alias("u"), F.col("sid").alias("v"))
    parts = min(max(8, least.count() // 20_000), 4096)
    apart = links(least.select("fp").repartition(parts, "fp"), t)
    apart = apart.join(least.select(F.col("fp").alias("u"), F.col("c").alias("a")), "u").join(least.select(F.col("fp").alias("v"), F.col("c").alias("b")), "v")
    apart = apart.filter(near(F.col("a.m"), F.col("b.m"))).select(F.least("a.sid", "b.sid").alias("u"), F.greatest("a.sid", "b.sid").alias("v"))
    return same.union(apart)
