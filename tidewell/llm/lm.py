"""Language-model scoring with backoff over all words, pairs and triples of the training documents.

An n-gram is kept from LEAST occurrences upward, the same count at every size, so what is gathered grows with
the corpus. Nothing of it reaches the driver or is broadcast. Documents are laid up in chunks of about CHUNK_BYTES
of text. A chunk sends the distinct keys of its n-grams to shards, which are ranges of keys; a shard adds up the counts of all
chunks and answers each with the counts of the keys it sent, in their order. With these a chunk knows the discounted
probability of all its kept n-grams. For the backoff weights each kept n-gram is owned by one of its chunks; that
chunk sends its count, and that of the order below, to the shard of the context, which adds them up and answers every
chunk that has to back off from the context. Shards grow in number, not in size, and a frequent n-gram is one row a chunk there.

With its answers a chunk builds an automaton (Automaton): kept n-grams are arcs between the states of their contexts, and a context's
failure arc carries its backoff weight. Each document is read once from left to right; the state that is carried is the longest kept context.
So the score of a token is the discounted probability of the longest kept n-gram that ends in it, times the backoff weights of the longer
contexts that are kept; at the empty context every token has its add-0.1 probability from its count. Words are told apart by 64-bit hashes, pairs
and triples by hashes with SPARE_BITS bits more than it takes to number the training tokens (64 at most), so that at any size about one
in a million shares its hash with another.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_shuffles, materialize

ADD, DISCOUNT = 0.1, 0.5
#: Both as parts of one, so that sums of discounted counts are sums of integers.
ADD_PARTS, DISCOUNT_PARTS = 10, 2
WORD_BITS, SPARE_BITS = 64, 20
LEAST = 2
CHUNK_BYTES = 6_000_000
#: Tokens whose arcs are laid out at a time.
BLOCK = 1 << 16
SHARD_TOKENS = 1_000_000
END = b" "  # no word has a blank


def held_out(id_col: str) -> F.Column:
    """crc32 of the id as text, mod 10, is 0. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the two in their order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ b >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


def _pack(a: np.ndarray) -> bytes:
    """Integers from 0, in the narrowest type that holds them all."""
    kind = np.min_scalar_type(int(a.max(initial=0)))
    return kind.char.encode() + zstandard.ZstdCompressor(level=1).compress(a.astype(kind).tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.dtype(blob[:1].decode())).astype(np.int64)


def _pack_keys(keys: np.ndarray, low: int) -> bytes:
    """Sorted keys from low as steps, four bytes each where that is enough."""
    steps = np.diff(keys, prepend=np.uint64(low))
    return steps.astype(np.uint32).tobytes() if not len(steps) or steps.max() < 1 << 32 else b"8" + steps.tobytes()


def _unpack_keys(blob: bytes, low: int) -> np.ndarray:
    steps = np.frombuffer(blob[1:], np.uint64) if len(blob) % 2 else np.frombuffer(blob, np.uint32).astype(np.uint64)
    return np.cumsum(steps, dtype=np.uint64) + np.uint64(low)


class _Numbers(dict):
    """Words to numbers, in the order of their first appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _pack_tokens(x: np.ndarray) -> bytes:
    """Word numbers as compressed planes of their bytes; the upper ones are nearly empty."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack_tokens(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents to rows of chunks: ids, held-out marks, tokens a document, and the lower-cased words by number, with the words' hashes."""
    ids, held, tokens, sizes, size, kind, numbers = [], [], [], [], 0, None, _Numbers()

    def row():
        x = np.concatenate(tokens)
        order = np.argsort(-np.bincount(x, minlength=len(numbers)), kind="stable")  # small numbers for frequent words
        new = np.empty(len(order), np.int64)
        new[order] = np.arange(len(order))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))[order]
        n = np.array(sizes, np.int64)
        out = {"docs": len(ids), "train": int(n[~np.array(held, bool)].sum()), "ids": ids, "held": held, "sizes": n.tobytes(), "hashes": hashes.tobytes(), "tokens": _pack_tokens(new[x])}
        types = {"docs": pa.int64(), "train": pa.int64(), "ids": pa.list_(kind), "held": pa.list_(pa.bool_()), "sizes": pa.binary(), "hashes": pa.binary(), "tokens": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([out[k]], t) for k, t in types.items()], names=list(types))

    for b in batches:
        kind = b.schema.field("doc_id").type
        for i, h, t in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), b.column("text").to_pylist(), strict=True):
            words = _tokens(t)
            words.append(END)
            ids.append(i)
            held.append(h)
            sizes.append(len(words))
            tokens.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            size += len(t or "") + 8
            if size >= CHUNK_BYTES:
                yield row()
                ids, held, tokens, sizes, size, numbers = [], [], [], [], 0, _Numbers()
    if ids:
        yield row()


def _grouped(k: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values of k, a place of each, and each place's number among them. k has values of so many bits."""
    n = len(k)
    at_bits = np.uint64(max(1, (n - 1).bit_length()))
    drop = np.uint64(max(0, bits + int(at_bits) - 64))
    order = (np.sort(k >> drop << at_bits | np.arange(n, dtype=np.uint64)) & ((np.uint64(1) << at_bits) - np.uint64(1))).astype(np.int64)
    s = k[order]
    if drop and (s[1:] < s[:-1]).any():  # two values that differ in the dropped bits only
        order = np.argsort(k, kind="stable")
        s = k[order]
    new = np.concatenate(([True], s[1:] != s[:-1])) if n else np.zeros(0, bool)
    inv = np.empty(n, np.int64)
    inv[order] = np.cumsum(new) - 1
    return s[new], order[new], inv


class _Chunk:
    """keys[o]: sorted distinct keys of order o + 1; at[o]: each position's place there, or -1; first[o]: a position of each key."""

    def __init__(self, row: dict, bits: int):
        self.sizes, hashes, words = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["hashes"], np.uint64), _unpack_tokens(row["tokens"])
        x, shift = hashes[words], np.uint64(64 - bits)
        self.starts = np.cumsum(self.sizes) - self.sizes
        since = np.arange(len(x)) - np.repeat(self.starts, self.sizes)
        train = ~np.repeat(np.array(row["held"], bool), self.sizes)
        two = np.zeros(len(x), np.uint64)
        two[1:] = _mix(x[:-1], x[1:])
        three = np.zeros(len(x), np.uint64)
        three[1:] = _mix(two[:-1], two[1:])
        keys, _, inv = _grouped(hashes, WORD_BITS)
        self.keys, self.at, self.first, self.n = [keys], [inv[words]], [np.zeros(len(keys), np.int64)], []
        self.first[0][self.at[0]] = np.arange(len(x))
        self.n.append(np.bincount(self.at[0][train], minlength=len(keys)))
        for o, k in ((1, two), (2, three)):
            here = np.flatnonzero(since >= o)
            keys, first, inv = _grouped(k[here] >> shift, bits)
            at = np.full(len(x), -1, np.int64)
            at[here] = inv
            self.keys.append(keys)
            self.first.append(here[first])
            self.at.append(at)
            self.n.append(np.bincount(inv[train[here]], minlength=len(keys)))

    def read_counts(self, answers: list[dict]) -> None:
        """Sets n to the counts in the corpus, 0 for n-grams that are not kept, and own."""
        got = [_joined(answers, o, "blob") for o in range(3)]
        self.n, self.own = [g >> 1 for g in got], [(g & 1).astype(bool) for g in got]

    def masses(self, o: int) -> tuple[np.ndarray, np.ndarray]:
        """For each key of order o as a context: the discounted counts of the continuations this chunk owns, and the same one order lower."""
        mine = np.flatnonzero(self.own[o] & (self.n[o] > 0))
        p = self.first[o][mine]
        context, below = self.at[o - 1][p - 1], self.at[o - 1][p]
        low = self.n[0][below] * ADD_PARTS + 1 if o == 1 else self.n[1][below] * DISCOUNT_PARTS - 1
        size = len(self.keys[o - 1])
        return tuple(np.bincount(context, w, size).astype(np.int64) for w in (self.n[o][mine] * DISCOUNT_PARTS - 1, low))

    def asks(self, o: int, mass: np.ndarray, least: int) -> np.ndarray:
        """The keys of order o - 1 to send: kept contexts whose continuations this chunk owns, or from which it backs off."""
        p = np.flatnonzero(self.at[o] >= 0)
        p = p[self.n[o][self.at[o][p]] == 0]
        needed = mass > 0
        needed[self.at[o - 1][p - 1]] = True
        return np.flatnonzero(needed & (self.n[o - 1] >= least))

    def backoffs(self, o: int, answers: list[dict], z: float, least: int) -> np.ndarray:
        """log10 of the backoff weight of each key of order o - 1 as a context; 0 for those that are not kept or not needed."""
        at = self.asks(o, self.masses(o)[0], least)
        a, b = _joined(answers, o - 1, "blob"), _joined(answers, o - 1, "low")
        mass = a / (DISCOUNT_PARTS * self.n[o - 1][at])
        low = b / (ADD_PARTS * z) if o == 1 else b / (DISCOUNT_PARTS * self.n[0][self.at[0][self.first[1][at]]])
        out = np.zeros(len(self.keys[o - 1]))
        out[at] = np.log10(np.maximum(1 - mass, 1e-9) / np.maximum(1 - low, 1e-9))
        return out


def _joined(answers: list[dict], order: int, name: str) -> np.ndarray:
    parts = sorted((a["shard"], a[name]) for a in answers if a["ord"] == order)
    return np.concatenate([np.zeros(0, np.int64), *[_unpack(b) for _, b in parts]])


def _edge(shard: int, n_shards: int, o: int, bits: int) -> int:
    return (shard << (bits if o else WORD_BITS)) // n_shards


def _slices(keys: np.ndarray, n_shards: int, o: int, bits: int) -> Iterator[tuple[int, slice]]:
    """(shard, its slice of the sorted keys of order o), empty ones left out."""
    edges = np.array([_edge(k, n_shards, o, bits) for k in range(1, n_shards)], np.uint64)
    cut = np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))
    for k in np.flatnonzero(np.diff(cut)).tolist():
        yield k, slice(cut[k], cut[k + 1])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


SENT = "ord int, shard int, chunk long, keys binary, a binary, b binary"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["ord", "shard", "chunk", "keys", "a", "b"])


def _send_counts(n_shards: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            c = _Chunk(r, bits)
            for o in range(3):
                rows = [(o, k, r["chunk"], _pack_keys(c.keys[o][s], _edge(k, n_shards, o, bits)), _pack(c.n[o][s]), None) for k, s in _slices(c.keys[o], n_shards, o, bits)]
                if rows:
                    yield _sent(rows)

    return run


def _add_counts(least: int, n_shards: int, bits: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("chunk")
        o = int(g["ord"].iloc[0])
        low = _edge(int(g["shard"].iloc[0]), n_shards, o, bits)
        keys = [_unpack_keys(k, low) for k in g["keys"]]
        n = np.concatenate([_unpack(a) for a in g["a"]])
        _, first, inv = _grouped(np.concatenate(keys), bits if o else WORD_BITS)
        total = np.bincount(inv, n).astype(np.int64)
        distinct = int((total > 0).sum())
        if o:
            total[total < least] = 0
        answer = total[inv] << 1
        answer[first] |= 1
        ends = np.cumsum([len(k) for k in keys])
        blobs = [_pack(a) for a in np.split(answer, ends[:-1])]
        return pd.DataFrame({"chunk": g["chunk"].to_numpy(), "ord": g["ord"].to_numpy(), "shard": g["shard"].to_numpy(), "blob": blobs, "words": [distinct if o == 0 and i == 0 else 0 for i, o in enumerate(g["ord"])]})

    return run


def _send_masses(n_shards: int, bits: int, least: int):
    """For every kept context of a chunk: the mass of the continuations it owns, and their mass one order lower."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            c = _Chunk(r, bits)
            c.read_counts(r["counts"])
            for o in (1, 2):
                mass, low = c.masses(o)
                at = c.asks(o, mass, least)
                keys, mass, low = c.keys[o - 1][at], mass[at], low[at]
                rows = [(o - 1, k, r["chunk"], _pack_keys(keys[s], _edge(k, n_shards, o - 1, bits)), _pack(mass[s]), _pack(low[s])) for k, s in _slices(keys, n_shards, o - 1, bits)]
                if rows:
                    yield _sent(rows)

    return run


def _add_masses(n_shards: int, bits: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("chunk")
        o = int(g["ord"].iloc[0])
        low = _edge(int(g["shard"].iloc[0]), n_shards, o, bits)
        keys = [_unpack_keys(k, low) for k in g["keys"]]
        inv = _grouped(np.concatenate(keys), bits if o else WORD_BITS)[2]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        mass, below = ([_pack(a) for a in np.split(np.bincount(inv, np.concatenate([_unpack(x) for x in g[c]])).astype(np.int64)[inv], cuts)] for c in ("a", "b"))
        return pd.DataFrame({"chunk": g["chunk"].to_numpy(), "ord": g["ord"].to_numpy(), "shard": g["shard"].to_numpy(), "blob": mass, "low": below})

    return run


class Automaton:
    """The model over a chunk's n-grams as a weighted automaton with failure arcs.

    State 0 is the empty context, 1 + w the word w, 1 + V + j the pair j. A kept n-gram is an arc from the state of its context to that of
    its longest kept end, with its log10 probability; the empty context has an arc for every word. The failure arc of a state drops its first word
    and weighs the log10 of its backoff weight. Only arcs of n-grams that end in some tokens can be taken while reading these, so arcs are
    laid out for BLOCK tokens at a time.
    """

    def __init__(self, c: _Chunk, z: float, backoffs: list[np.ndarray]):
        self.c, self.words = c, len(c.n[0])
        self.one = np.log10((c.n[0] + ADD) / z)
        self.fail = array("q", np.concatenate((np.zeros(1 + self.words, np.int64), 1 + c.at[0][c.first[1]])).tobytes())
        self.backoff = array("d", np.concatenate(([0.0], *backoffs)).tobytes())

    def arcs(self, start: int, end: int) -> dict[int, tuple[int, float]]:
        """state * V + word -> (next state, weight), of all n-grams that end at these positions."""
        (n1, n2, n3), (w, pair, triple) = self.c.n, self.c.at
        p = np.arange(start, end)
        two = p[(pair[p] >= 0) & (n2[pair[p]] > 0)] if len(n2) else p[:0]
        three = p[(triple[p] >= 0) & (n3[triple[p]] > 0)] if len(n3) else p[:0]
        parts = (
            (w[p], 1 + w[p], self.one[w[p]]),
            ((1 + w[two - 1]) * self.words + w[two], 1 + self.words + pair[two], np.log10((n2[pair[two]] - DISCOUNT) / n1[w[two - 1]])),
            ((1 + self.words + pair[three - 1]) * self.words + w[three], 1 + self.words + pair[three], np.log10((n3[triple[three]] - DISCOUNT) / n2[pair[three - 1]])),
        )
        out = {}
        for code, to, weight in parts:
            code, at = np.unique(code, return_index=True)
            out.update(zip(code.tolist(), zip(to[at].tolist(), weight[at].tolist(), strict=True), strict=True))
        return out

    def traverse(self, tokens: list[int], arcs: dict[int, tuple[int, float]], state: int) -> tuple[float, int]:
        """log10 of the probability of the tokens, read once from left to right, and the state after them."""
        fail, backoff, words, total = self.fail, self.backoff, self.words, 0.0
        for w in tokens:
            arc = arcs.get(state * words + w)
            while arc is None:
                total += backoff[state]
                state = fail[state]
                arc = arcs.get(state * words + w)
            state, weight = arc
            total += weight
        return total, state

    def scores(self) -> np.ndarray:
        """Of every document; a long one goes on in the next block with the state it has."""
        w, ends, out = self.c.at[0], np.cumsum(self.c.sizes).tolist(), np.zeros(len(self.c.sizes))
        doc = state = 0
        for start in range(0, len(w), BLOCK):
            end = min(start + BLOCK, len(w))
            arcs = self.arcs(start, end)
            while start < end:
                stop = min(end, ends[doc])
                total, state = self.traverse(w[start:stop].tolist(), arcs, state)
                out[doc] += total
                if stop == ends[doc]:
                    doc, state = doc + 1, 0
                start = stop
        return out


def _scorer(z: float, bits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = b.schema.field("ids").type.value_type
            for r in _rows(iter([b])):
                c = _Chunk(r, bits)
                c.read_counts(r["counts"])
                model = Automaton(c, z, [c.backoffs(o, r["backoffs"] or [], z, least) for o in (1, 2)])
                w = c.at[0]
                known = np.add.reduceat((c.n[0][w] > 0).astype(np.int64), c.starts)
                cols = [pa.array(r["ids"], kind), pa.array(r["held"], pa.bool_()), pa.array(c.sizes), pa.array(known), pa.array(np.add.reduceat(model.one[w], c.starts)), pa.array(model.scores())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, min_share: float = 0.0, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of docs.

    Tokens: words between ASCII white space, A-Z lower-cased, then one end token; null and empty texts have the end
    token only. The model learns from the rows that are not held out. Null ids are scored like others; repeated rows
    count, and are scored, as often as they occur. Without training rows every token is unknown. Pairs and triples are states from
    least occurrences upward; 1 keeps them all. A min_share above 0 also drops those with a smaller share of the training tokens.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    body = f"docs long, train long, ids array<{id_type}>, held array<boolean>, sizes binary, hashes binary, tokens binary"
    chunks = materialize(rows.mapInArrow(_chunks, body).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    total = chunks.agg(F.coalesce(F.sum("train"), F.lit(0))).first()[0]
    least, n_shards = max(least, math.ceil(min_share * total)), max(4, -(-total // SHARD_TOKENS))

    bits = min(64, max(1, total).bit_length() + SPARE_BITS)

    answer = "chunk long, ord int, shard int, blob binary"
    sent = chunks.select("chunk", "held", "sizes", "hashes", "tokens").mapInArrow(_send_counts(n_shards, bits), SENT)
    counts = materialize(sent.groupBy("ord", "shard").applyInPandas(_add_counts(least, n_shards, bits), answer + ", words long"), "counts")
    free_shuffles(docs.sparkSession)
    distinct = counts.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    z = total + ADD * (distinct + 1)
    gathered = lambda df, name, *cols: df.groupBy("chunk").agg(F.collect_list(F.struct("ord", "shard", *cols)).alias(name))
    counted = chunks.drop("docs", "train").join(gathered(counts, "counts", "blob"), "chunk")
    sent = counted.mapInArrow(_send_masses(n_shards, bits, least), SENT)
    backoffs = materialize(sent.groupBy("ord", "shard").applyInPandas(_add_masses(n_shards, bits), answer + ", low binary"), "backoffs")
    free_shuffles(docs.sparkSession)
    ready = counted.join(gathered(backoffs, "backoffs", "blob", "low"), "chunk", "left")
    out = ready.mapInArrow(_scorer(z, bits, least), f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
