"""Incremental line deduplication: sharded cuckoo filters over exact reference tables.

The state has three tables, sharded by the line key's hash. refs: (key, doc_id), one row for
each document that holds the key: the exact reference table. counts: (key, n_docs, max_doc)
from it. filters: for each shard a cuckoo filter of the keys that enough documents hold.
Inserting documents adds references, deleting documents takes them away; both move keys in
or out of the filters, so that deleting what was inserted restores the decisions of before.
Documents are cleaned by a look-up in the filters, which rules out nearly all lines, and an
exact join for the others. Where the filters together are larger than may be broadcast, the
exact join takes all lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, materialize
from .cuckoo import CuckooFilter, buckets_for

BLANK = " \t\n\x0b\x0c\r"
CHANGES = "shard int, h long, add boolean, fresh boolean"
FILTERS = "shard int, buckets int, cells binary, full boolean"


@dataclass(frozen=True)
class LineState:
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    n_shards: int
    min_docs: int
    min_chars: int


def line_key(line: Column) -> Column:
    return lower_ascii(F.regexp_replace(line, r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", ""))


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def _hash(key: Column) -> Column:
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long")


def _shard(key: Column, n_shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_shards)).cast("int")


def references(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id), each once. A null id is one document."""
    lines = F.split(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "\n")
    keys = F.array_distinct(F.filter(F.transform(lines, line_key), lambda k: F.char_length(k) >= min_chars))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.explode(keys).alias("line"))
    return rows.select(_key(F.col("line")).alias("key"), "doc_id").distinct()


def _count(refs: DataFrame) -> DataFrame:
    return refs.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))


def _dense(counts: DataFrame, state: LineState) -> DataFrame:
    dense = counts.filter(F.col("n_docs") >= state.min_docs)
    return dense.select(_shard(F.col("key"), state.n_shards).alias("shard"), _hash(F.col("key")).alias("h"), "key")


def _turn(key, filters: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    """A shard's new filter. fresh: the changes hold all its keys, and the old filter is put aside. full: it must be built anew."""
    shard, full = int(key[0]), False
    if len(changes) == 0:
        return filters[["shard", "buckets", "cells", "full"]]
    add = changes[changes["add"]].h.to_numpy(np.int64).view(np.uint64)
    if changes.fresh.any() or len(filters) == 0:
        f = CuckooFilter.build(np.sort(add))
    else:
        f = CuckooFilter(np.frombuffer(filters.cells.iloc[0], np.uint16).reshape(-1, 4).copy())
        for h in np.sort(changes[~changes["add"]].h.to_numpy(np.int64).view(np.uint64)).tolist():
            f.delete(h)
        for h in np.sort(add).tolist():
            full = full or not f.insert(h)
    return pd.DataFrame({"shard": [shard], "buckets": [len(f.table)], "cells": [f.table.tobytes()], "full": [full]})


def _refilter(state: LineState, before: DataFrame | None, after: DataFrame) -> DataFrame:
    """Filters for the counts after; only shards with changes are touched, and only shards that outgrow or far underfill their filter are rebuilt."""
    new = _dense(after, state)
    if before is None:
        changes = new.select("shard", "h", F.lit(True).alias("add"), F.lit(True).alias("fresh"))
    else:
        old = _dense(before, state)
        size = F.udf(lambda n: buckets_for(n or 0), "int")
        need = new.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).join(state.filters.select("shard", "buckets"), "shard", "full")
        rebuilt = need.select("shard", ((F.coalesce(size("n"), F.lit(1)) > F.coalesce("buckets", F.lit(0))) | (F.coalesce(size("n"), F.lit(1)) * 2 < F.col("buckets"))).alias("fresh"))
        plus = new.join(old.select("key"), "key", "left_anti").withColumn("add", F.lit(True))
        minus = old.join(new.select("key"), "key", "left_anti").withColumn("add", F.lit(False))
        touched = plus.union(minus).join(rebuilt, "shard").filter("not fresh")
        whole = new.withColumn("add", F.lit(True)).join(rebuilt, "shard").filter("fresh")
        emptied = rebuilt.filter("fresh").join(new.select("shard").distinct(), "shard", "left_anti").select("shard", F.lit(0).cast("long").alias("h"), F.lit(False).alias("add"), "fresh")
        changes = touched.unionByName(whole).select("shard", "h", "add", "fresh").unionByName(emptied)
    turned = lambda filters, changes: materialize(filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(_turn, FILTERS), "line-filters")
    filters = turned(state.filters, changes)
    full = filters.filter("full").select("shard")
    if full.isEmpty():
        return filters
    # A key found no place below the load limit: these shards are built anew from the exact table, larger if need be.
    again = new.join(full, "shard", "left_semi").select("shard", "h", F.lit(True).alias("add"), F.lit(True).alias("fresh"))
    return turned(filters, again)


def empty_state(spark: SparkSession, id_type: str = "long", n_shards: int = 16, min_docs: int = 3, min_chars: int = 20) -> LineState:
    refs = spark.createDataFrame([], f"key binary, doc_id {id_type}")
    return LineState(refs, _count(refs), spark.createDataFrame([], FILTERS), n_shards, min_docs, min_chars)


def _with(state: LineState, refs: DataFrame, fresh: bool) -> LineState:
    counts = materialize(_count(refs), "line-counts")
    return replace(state, refs=refs, counts=counts, filters=_refilter(state, None if fresh else state.counts, counts))


def insert(state: LineState, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: bool = False) -> LineState:
    """The state with docs' references. Inserting a document again changes nothing. first: the state is known to be empty."""
    new = references(docs, state.min_chars, id_col, text_col)
    refs = new if first else state.refs.unionByName(new).distinct()
    return _with(state, materialize(refs, "line-refs"), first)


def delete(state: LineState, ids: DataFrame, id_col: str = "doc_id") -> LineState:
    """The state without the references of the documents with these ids."""
    gone = ids.select(F.col(f"`{id_col}`").alias("gone")).distinct()
    refs = state.refs.join(gone, state.refs["doc_id"].eqNullSafe(gone["gone"]), "left_anti")
    return _with(state, materialize(refs, "line-refs"), False)


def _clean(batches: Iterator[tuple[pd.Series, pd.Series]], min_chars: int) -> Iterator[pd.DataFrame]:
    for texts, drops in batches:
        out, lines, dropped = [], [], []
        for text, drop in zip(texts, drops, strict=True):
            parts = (text or "").encode().split(b"\n")
            lines.append(len(parts))
            if drop is not None and len(drop):
                gone = {bytes(k) for k in drop}
                kept = []
                for x in parts:
                    k = x.strip(b" \t\n\x0b\x0c\r").lower()
                    if not (len(k) >= min_chars and len(k.decode()) >= min_chars and hashlib.md5(k).digest() in gone):
                        kept.append(x)
                dropped.append(len(parts) - len(kept))
                parts = kept
            else:
                dropped.append(0)
            out.append(b"\n".join(parts).decode())
        yield pd.DataFrame({"text": out, "n_lines": lines, "n_dropped": dropped})


def drops(state: LineState, refs: DataFrame, most_filter_mb: int = 64) -> DataFrame:
    """(doc_id, keys): what each of the documents behind refs loses: dense keys of which it is not the last holder."""
    spark = refs.sparkSession
    size = state.filters.agg(F.sum(F.length("cells"))).first()[0] or 0
    if size <= most_filter_mb << 20:
        held = spark.sparkContext.broadcast({r.shard: bytes(r.cells) for r in state.filters.collect()})
        n_shards = state.n_shards

        def maybe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            filters = {k: CuckooFilter(np.frombuffer(v, np.uint16).reshape(-1, 4)) for k, v in held.value.items()}
            for b in batches:
                shards, h = b["shard"].to_numpy(), b["h"].to_numpy(np.int64).view(np.uint64)
                hit = np.zeros(len(b), bool)
                for k in np.unique(shards):
                    if k in filters:
                        at = shards == k
                        hit[at] = filters[k].contains(h[at])
                yield b.loc[hit, ["key", "doc_id"]]

        rows = refs.withColumns({"shard": _shard(F.col("key"), n_shards), "h": _hash(F.col("key"))})
        refs = rows.mapInPandas(maybe, refs.schema)
    dense = state.counts.filter(F.col("n_docs") >= state.min_docs).select("key", "max_doc")
    lost = refs.join(dense, "key").filter(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
    return lost.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))


def clean(state: LineState, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", refs: DataFrame | None = None) -> DataFrame:
    """docs with their text cleaned against the state, n_lines and n_dropped; input columns with the latter names are replaced.

    A key (the line stripped of ASCII white space, A-Z lower-cased) of at least min_chars code points that at least
    min_docs documents hold loses all its lines except in the largest doc_id. Null and empty texts are one empty line,
    and a null text becomes empty. Rows with a null id together are one document, smaller than any other; repeated rows
    are cleaned alike.
    """
    known = refs if refs is not None else references(docs, state.min_chars, id_col, text_col)
    lost = drops(state, known).withColumnRenamed("doc_id", "__tw_id").withColumnRenamed("keys", "__tw_keys")
    rows = docs.join(lost, F.col(f"`{id_col}`").eqNullSafe(F.col("__tw_id")), "left")
    min_chars = state.min_chars

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def cleaned(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        return _clean(batches, min_chars)

    rows = rows.withColumn("__tw_c", cleaned(F.col(f"`{text_col}`").cast("string"), F.col("__tw_keys")))
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    cols = [F.col("__tw_c.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in keep]
    return rows.select(*cols, F.col("__tw_c.n_lines").alias("n_lines"), F.col("__tw_c.n_dropped").alias("n_dropped"))


def deduplicate(docs: DataFrame, n_shards: int = 16, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """clean() of docs against a state into which they all were inserted."""
    state = empty_state(docs.sparkSession, docs.schema[id_col].dataType.simpleString(), n_shards, min_docs, min_chars)
    state = insert(state, docs, id_col, text_col, first=True)
    return clean(state, docs, id_col, text_col, refs=state.refs)
