"""Substring deduplication by suffix automata of reference shards.

A window (13 consecutive words) is repeated if its words also start in a document with a smaller
id. Streaming every document past the automata of all documents would grow with the square of
the corpus, so reference and documents are sharded by content. The least hash among a window's
6-word grams names its shard, so equal windows meet there. A context is a run of a document's
windows with one least gram; documents that hold the same context are streamed as one.

Grams in one document only can have no repeated window and are left out, by a Bloom filter of
bounded size or, for more grams than that, by a join. For every other gram a suffix automaton
grows in the order of ids. Each context is streamed through it: the state that is reached, and
from it by suffix links the state of the last 13 words, carries the smallest id that holds them;
where the context leaves known text it extends the automaton. So every context gets, for each of
its windows, the first document that holds it, and loses the maximal spans of windows whose first
document is smaller than its own. A gram with one context is an automaton without branches; its
windows start where the context first stood. A gram with more contexts than a shard may hold is
split by window: an automaton of one window is a path, so equality and a minimum are left of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .common import WordHashes, broadcast_if, materialize

GRAM = 6
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
NO_ID = -(1 << 63)
FLUSH = 1_000_000
#: Contexts of one gram beyond which it is split by window, and contexts a shard.
GRAM_CONTEXTS, SHARD_CONTEXTS = 5_000, 5_000
BLOOM_BITS, BLOOM_HASHES = 26, 3
BLOOM_KEYS = 1 << BLOOM_BITS - 2
HOT_ROWS = 100_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _slide(a: np.ndarray, n: int, f) -> np.ndarray:
    """f over every n consecutive items of a."""
    width, out = 1, a
    while width < n:
        step = min(width, n - width)
        out = f(out[: len(out) - step], out[step:])
        width += step
    return out


def contexts(words: list[bytes], window: int, hashes: WordHashes):
    """(gram hash, context hash, start, end) of every run of windows with one least gram, as arrays."""
    n = len(words)
    if n < window:
        return None
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    grams = n - GRAM + 1
    g = np.zeros(grams, np.uint64)
    for j in range(GRAM):
        g = g * MULTIPLIER + h[j : j + grams]
    least = _slide(_mix(g), window - GRAM + 1, np.minimum)
    a = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    b = np.concatenate((a[1:] - 1, [n - window])) + window
    # A polynomial of the context's words: sum of h[i] * M^(b - i), from prefix sums.
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, MULTIPLIER))))
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h[::-1] * power)))[::-1]  # prefix[i] = sum over k >= i of h[k] * M^(n-1-k)
    c = (prefix[a] - prefix[b]) * _inverse_powers(n)[n - b]
    c = _mix(c ^ _mix((b - a).astype(np.uint64)))
    return least[a].view(np.int64), c.view(np.int64), a, b


_INVERSE = {"p": np.ones(1, np.uint64)}


def _inverse_powers(n: int) -> np.ndarray:
    if len(_INVERSE["p"]) <= n:
        inv = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
        _INVERSE["p"] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(n, 4096) * 2, inv))))
    return _INVERSE["p"]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _count(window: int):
    """Batches of documents to (h, lo, hi, n): grams with their least and greatest document and number of contexts, combined before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list = []
        held = 0

        def flush():
            h, c, d = (np.concatenate([p[i] for p in parts]) for i in range(3))
            order = np.lexsort((c, h))
            h, c, d = h[order], c[order], d[order]
            new = np.concatenate(([True], h[1:] != h[:-1]))
            first = np.flatnonzero(new)
            fresh = (new | np.concatenate(([True], c[1:] != c[:-1]))).astype(np.int64)
            parts.clear()
            return pd.DataFrame({"h": h[first], "lo": np.minimum.reduceat(d, first), "hi": np.maximum.reduceat(d, first), "n": np.add.reduceat(fresh, first)})

        for b in batches:
            hashes = WordHashes()
            for doc, text in zip(b["doc"].to_numpy(np.int64).tolist(), b["text"], strict=True):
                found = contexts(_words(text), window, hashes)
                if found is not None:
                    parts.append((found[0], found[1], np.full(len(found[0]), doc, np.int64)))
                    held += len(found[0])
                if held >= FLUSH:
                    yield flush()
                    held = 0
        if parts:
            yield flush()

    return run


def _bloom_places(h: np.ndarray) -> list[np.ndarray]:
    x = _mix(h.view(np.uint64))
    return [(x >> np.uint64(19 * k) & np.uint64((1 << BLOOM_BITS) - 1)).astype(np.int64) for k in range(BLOOM_HASHES)]


def _bloom(keys: DataFrame) -> np.ndarray:
    """The bits of a Bloom filter of h, built on the executors: at most 2 ** BLOOM_BITS bits, whatever there are of keys."""

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.concatenate(_bloom_places(b["h"].to_numpy(np.int64)))
            yield pd.DataFrame({"w": at >> 6, "m": np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64)})

    rows = keys.select("h").mapInPandas(bits, "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(1 << BLOOM_BITS - 6, np.uint64)
    out[rows["w"].to_numpy()] = rows["m"].to_numpy().view(np.uint64)
    return out


def _occurrences(window: int, bloom):
    """Batches of documents to the contexts whose gram may be in the Bloom filter, with their places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = bloom.value if bloom is not None else None
        for b in batches:
            out, hashes = [], WordHashes()
            for doc, th, text in zip(b["doc"].to_numpy(np.int64).tolist(), b["th"].to_numpy(np.int64).tolist(), b["text"], strict=True):
                found = contexts(_words(text), window, hashes)
                if found is None:
                    continue
                h, c, a, e = found
                if bits is not None:
                    hit = np.ones(len(h), bool)
                    for at in _bloom_places(h):
                        hit &= (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                    h, c, a, e = h[hit], c[hit], a[hit], e[hit]
                if len(h):
                    out.append((h, c, np.full(len(h), doc), np.full(len(h), th), a.astype(np.int32), e.astype(np.int32)))
            if out:
                yield pd.DataFrame({k: np.concatenate([x[i] for x in out]) for i, k in enumerate(("h", "c", "doc", "th", "a", "b"))})

    return run


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents with places to contexts with their words."""
    for b in batches:
        out = []
        for text, places in zip(b["text"], b["places"], strict=True):
            words = _words(text)
            out += [(p["h"], p["c"], p["lo"], p["hot"], b" ".join(words[p["a"] : p["b"]]).decode()) for p in places]
        yield pd.DataFrame(out, columns=["h", "c", "lo", "hot", "words"])


def _match(window: int):
    """A reference shard: (h, c, x, y, first), runs of windows of its contexts with the first document that holds them."""

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["h", "lo", "c"])
        out = []
        for h, rows in groupby(zip(shard["h"].tolist(), shard["lo"].tolist(), shard["c"].tolist(), shard["words"], strict=True), lambda r: r[0]):
            automaton = SuffixAutomaton()
            for _, lo, c, words in rows:
                x, was = 0, None
                for i, first in enumerate(automaton.stream(words.split(" "), lo, window)):
                    if first != was:
                        if was is not None:
                            out.append((h, c, x, i - 1 + window, was))
                        x, was = i, first
                out.append((h, c, x, i + window, was))
        return pd.DataFrame(out, columns=["h", "c", "x", "y", "first"]).astype({"x": "int32", "y": "int32"})

    return run


def first_holders(rows: DataFrame, window: int = 13) -> tuple[DataFrame, DataFrame]:
    """rows: doc (long), th (long, tells texts of one id apart), text.

    Gives places (h, c, doc, th, a, b), the contexts of documents by word positions, and runs (h, c, x, y, first): words
    x to y of a context are windows that first stand in that document.
    """
    seen = rows.select("doc", "text").mapInPandas(_count(window), "h long, lo long, hi long, n long")
    seen = seen.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).filter("hi > lo")
    useful = materialize(seen.select("h", (F.col("n") > GRAM_CONTEXTS).alias("hot")), "grams")
    bloom = rows.sparkSession.sparkContext.broadcast(_bloom(useful)) if useful.count() <= BLOOM_KEYS else None
    places = rows.select("doc", "th", "text").mapInPandas(_occurrences(window, bloom), "h long, c long, doc long, th long, a int, b int")
    if bloom is None:
        places = places.join(useful, "h")
    else:
        places = places.join(broadcast_if(useful.filter("hot"), HOT_ROWS), "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    places = materialize(places, "places")

    known = places.groupBy("h", "c").agg(F.min(F.struct("doc", "th", "a", "b")).alias("at"), F.first("hot").alias("hot"))
    known = known.select("h", "c", F.col("at.doc").alias("lo"), F.col("at.th").alias("th"), F.col("at.a").alias("a"), F.col("at.b").alias("b"), "hot")
    cold = known.filter("not hot").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("h")))
    known = materialize(cold.unionByName(known.filter("hot").withColumn("n", F.lit(2).cast("long"))), "contexts")
    alone = known.filter("n = 1").select("h", "c", F.lit(0).alias("x"), (F.col("b") - F.col("a")).alias("y"), F.col("lo").alias("first"))

    own = known.filter("n > 1").groupBy(F.col("lo").alias("doc"), "th").agg(F.collect_list(F.struct("h", "c", "lo", "a", "b", "hot")).alias("places"))
    cut = rows.select("doc", "th", "text").join(own, ["doc", "th"]).dropDuplicates(["doc", "th"])
    cut = materialize(cut.select("text", "places").mapInPandas(_cut, "h long, c long, lo long, hot boolean, words string"), "first-contexts")
    few = cut.filter("not hot")
    shards = max(32, few.count() // SHARD_CONTEXTS)
    few = few.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    runs = few.groupBy("shard").applyInPandas(_match(window), "h long, c long, x int, y int, first long")

    w = cut.filter("hot").withColumn("w", F.split("words", " "))
    w = w.select("h", "c", "lo", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("w") - window), lambda i: F.unhex(F.md5(F.concat_ws(" ", F.slice("w", i + 1, window)).cast("binary"))))).alias("x", "k"))
    split = w.join(w.groupBy("k").agg(F.min("lo").alias("first")), "k").select("h", "c", "x", (F.col("x") + window).alias("y"), "first")
    return places, alone.unionByName(runs).unionByName(split)


def repeated_spans(rows: DataFrame, window: int = 13) -> DataFrame:
    """rows: doc (long), th (long), text. Gives (doc, th, a, b): word spans to remove, perhaps overlapping."""
    places, runs = first_holders(rows, window)
    found = places.join(materialize(runs, "first-holders"), ["h", "c"]).filter("first < doc")
    return found.select("doc", "th", (F.col("a") + F.col("x")).alias("a"), (F.col("a") + F.col("y")).alias("b"))


def deduplicate(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the kept words of their text, joined by one space, and n_words, n_removed; input columns of these names are replaced.

    Words are separated by ASCII white space. A word goes if a window over it also starts in a document with a smaller
    id; windows are judged on the input. Texts of fewer words than a window, null and empty ones lose nothing, and a
    null text becomes empty. A null id is smaller than any other. Rows with equal ids are one document that does not
    repeat itself, so repeated rows are treated alike. Ids must be integers.
    """
    th = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    doc = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    rows = docs.select(doc.alias("doc"), th.alias("th"), F.col(f"`{text_col}`").cast("string").alias("text"))
    spans = repeated_spans(rows, window)
    lost = spans.groupBy(F.col("doc").alias("__tw_d"), F.col("th").alias("__tw_t")).agg(F.collect_set(F.struct("a", "b")).alias("__tw_spans"))

    @F.pandas_udf("text string, n_words long, n_removed long")
    def keep(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, all_spans in batches:
            out = []
            for text, cuts in zip(texts, all_spans, strict=True):
                words = _words(text)
                n = len(words)
                if cuts is not None and len(cuts):
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, [s["a"] for s in cuts], 1)
                    np.add.at(edge, [s["b"] for s in cuts], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:n] == 0)]
                out.append((b" ".join(words).decode(), n, n - len(words)))
            yield pd.DataFrame(out, columns=["text", "n_words", "n_removed"])

    out = docs.withColumns({"__tw_doc": doc, "__tw_th": th})
    out = out.join(lost, (F.col("__tw_doc") == F.col("__tw_d")) & (F.col("__tw_th") == F.col("__tw_t")), "left")
    out = out.withColumn("__tw_k", keep(F.col(f"`{text_col}`").cast("string"), F.col("__tw_spans")))
    names = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed")]
    cols = [F.col("__tw_k.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in names]
    return out.select(*cols, F.col("__tw_k.n_words").alias("n_words"), F.col("__tw_k.n_removed").alias("n_removed"))
