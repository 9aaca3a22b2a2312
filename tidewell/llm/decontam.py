"""Benchmark decontamination over a distributed positional inverted index.

Items are cut into windows of consecutive words. For each window the collection's term
frequencies name its rarest terms; only the postings (term, doc_id, pos) of those terms are
stored. The lists of a window's two rarest terms are adjusted by the terms' offsets in the
window and intersected; what is left is checked against the document's words, which gives
exact phrase matches and, with a tolerance for each term's place, proximity matches.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM_GAP, broadcast_if, let, lower_ascii, materialize, without, words

#: Terms, windows and anchors are broadcast up to so many rows (tens of MB); beyond it these joins are shuffled.
BROADCAST_ROWS = 1_000_000


def item_words(c: Column) -> Column:
    return words(lower_ascii(c), ALNUM_GAP)


def windows(items: DataFrame, n: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, wid, terms): every run of n consecutive words; an item of fewer words, but not none, is one window."""
    w = items.select(F.col(f"`{item_col}`").cast("string").alias("item"), item_words(F.col(f"`{text_col}`")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    w = w.filter(F.size("w") > 0).withColumn("at", F.explode(starts))
    w = w.select("item", F.slice("w", F.col("at"), F.lit(n)).alias("terms"))
    return w.withColumn("wid", F.xxhash64(F.concat_ws(" ", "terms"))).distinct()


def term_frequencies(docs: DataFrame, vocabulary: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, tf) over all documents, for the terms of vocabulary."""
    tokens = docs.select(F.explode(item_words(F.col(f"`{text_col}`"))).alias("term"))
    return tokens.join(broadcast_if(vocabulary, BROADCAST_ROWS), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("tf"))


def postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index: (term, doc_id, pos) with pos from 0, for the given terms over all documents."""
    tokens = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.posexplode(item_words(F.col(f"`{text_col}`"))).alias("pos", "term"))
    return tokens.join(broadcast_if(terms, BROADCAST_ROWS), "term", "left_semi").select("term", "doc_id", "pos")


def search(docs: DataFrame, items: DataFrame, n: int = 10, slop: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"):
    """(docs' matches by doc id, windows): doc_id, matches: array of (wid, start). start is where an exact match would begin.

    A match's two rarest terms stand within slop of their places; match_kind() tells exact, near or none.
    """
    wins = materialize(windows(items, n, item_col, text_col), "windows")
    distinct = wins.select("wid", "terms").distinct()
    vocabulary = distinct.select(F.explode("terms").alias("term")).distinct()
    tf = materialize(term_frequencies(docs, vocabulary, text_col), "term-frequencies")

    # The rarest two places of each window; a window with a term that no document has cannot match.
    places = distinct.select("wid", F.concat_ws(" ", "terms").alias("key"), F.size("terms").alias("n"), F.posexplode("terms").alias("off", "term"))
    places = places.join(tf, "term")
    of_window = Window.partitionBy("key")
    rarest = of_window.orderBy("tf", "term", "off")
    places = places.withColumn("found", F.count(F.lit(1)).over(of_window)).withColumn("rank", F.row_number().over(rarest))
    anchors = materialize(places.filter("found = n and rank <= 2").select("term", "wid", "off", "rank", F.least("n", F.lit(2)).alias("need")).distinct(), "anchors")

    index = materialize(postings(docs, anchors.select("term").distinct(), id_col, text_col), "postings")
    adjusted = index.join(broadcast_if(anchors, BROADCAST_ROWS), "term").select("doc_id", "wid", "rank", "need", (F.col("pos") - F.col("off")).alias("start"))
    first, second = adjusted.filter("rank = 1"), adjusted.filter("rank = 2")
    # |start1 - start2| <= slop as an equality join: the second list is replicated to the neighbouring buckets.
    width = slop + 1
    bucket = F.floor(F.col("start") / F.lit(width))
    second = second.select("doc_id", "wid", F.col("start").alias("start2"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("b"))
    paired = first.filter("need = 2").withColumn("b", bucket).alias("x")
    second = second.alias("y")
    near = (F.expr("x.doc_id <=> y.doc_id")) & F.expr(f"x.wid = y.wid and x.b = y.b and abs(x.start - y.start2) <= {slop}")
    paired = paired.join(second, near, "left_semi").select("doc_id", "wid", "start")
    found = paired.unionByName(first.filter("need = 1").select("doc_id", "wid", "start"))
    return found.distinct(), wins


def _exact(w: Column, start: Column, terms: Column) -> Column:
    return (start >= 0) & (F.slice(w, F.greatest(start, F.lit(0)) + 1, F.size(terms)) == terms)


def _near(w: Column, start: Column, terms: Column, slop: int) -> Column:
    def has(term: Column, off: Column) -> Column:
        lo = F.greatest(start + off - slop, F.lit(0))
        hi = start + off + slop
        return F.array_contains(F.slice(w, lo + 1, F.greatest(hi - lo + 1, F.lit(0))), term)

    return F.forall(F.transform(terms, has), lambda x: x)


def decontaminate(
    docs: DataFrame, items: DataFrame, n: int = 10, slop: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """docs with n_words, n_hit, n_items, items, n_near, contaminated; input columns with these names are replaced.

    A word inside any occurrence of a window is hit. items: the sorted ids, as strings, of items with occurring
    windows. n_near: distinct windows that only match by proximity, each term within slop words of its place.
    Null or empty texts have no words; null items have no windows, and a null item id counts as the string "null".
    Each row is judged by its own text, so repeated rows, and rows with the same or a null id, are kept.
    """
    items = items.withColumn(item_col, F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null")))
    found, wins = search(docs, items, n, slop, id_col, text_col, item_col)
    # Windows in candidates carry their terms and items along, so that each document is read once more and checked in place.
    by_window = wins.groupBy("wid", "terms").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = found.join(broadcast_if(by_window, BROADCAST_ROWS), "wid")
    found = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "terms", "items")).alias("__tw_found"))
    found = materialize(found, "candidates").withColumnRenamed("doc_id", "__tw_id")

    # Never broadcast: as Parquet, lists of candidates take far less than in the driver's memory.
    rows = docs.join(found.hint("merge"), F.col(f"`{id_col}`").eqNullSafe(F.col("__tw_id")), "left")
    kind = rows.schema["__tw_found"].dataType
    all_words = item_words(F.col(f"`{text_col}`"))
    verdict = F.when(
        F.col("__tw_found").isNull(),
        F.struct(F.size(all_words).cast("long").alias("n"), F.lit(0).cast("long").alias("hit"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("near")),
    ).otherwise(let(all_words, lambda w: _verdict(w, F.coalesce("__tw_found", F.array().cast(kind)), slop)))
    rows = without(rows.withColumn("__tw_v", verdict), "n_words", "n_hit", "n_items", "items", "n_near", "contaminated")
    rows = rows.withColumns({"n_words": F.col("__tw_v.n"), "n_hit": F.col("__tw_v.hit"), "items": F.col("__tw_v.items"), "n_near": F.col("__tw_v.near")})
    rows = rows.withColumns({"n_items": F.size("items").cast("long"), "contaminated": F.col("n_hit") > 0})
    return rows.drop("__tw_id", "__tw_found", "__tw_v")


def _verdict(w: Column, found: Column, slop: int) -> Column:
    """(n, hit, items, near) of a document's words and its candidates."""

    def of(exact: Column) -> Column:
        # Covered words: spans sorted by start, each adding what lies beyond the furthest end so far.
        spans = F.array_sort(F.transform(exact, lambda c: F.struct(c["start"].alias("a"), (c["start"] + F.size(c["terms"])).alias("b"))))
        covered = F.aggregate(
            spans,
            F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
            lambda acc, s: F.struct(
                F.greatest(acc["end"], s["b"]).alias("end"),
                (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["end"], s["a"])).cast("long")).alias("n"),
            ),
            lambda acc: acc["n"],
        )
        near = F.filter(found, lambda c: ~_exact(w, c["start"], c["terms"]) & _near(w, c["start"], c["terms"], slop))
        only_near = F.array_except(F.transform(near, lambda c: c["terms"]), F.transform(exact, lambda c: c["terms"]))
        items = F.sort_array(F.array_distinct(F.flatten(F.transform(exact, lambda c: c["items"]))))
        return F.struct(F.size(w).cast("long").alias("n"), covered.alias("hit"), items.alias("items"), F.size(only_near).cast("long").alias("near"))

    return let(F.filter(found, lambda c: _exact(w, c["start"], c["terms"])), of)
