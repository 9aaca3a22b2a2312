"""Resampling, clustering and search against plain implementations: nulls, odd vectors, ties, repeated rows, long texts, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import kmeans, resample, topk

NAN, INF = float("nan"), float("inf")


def quantized(v):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(64 * x) for x in v]


# resampling


def plain_words(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w]


def plain_buckets(t):
    w = plain_words(t)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(docs, target, percent=5):
    s, t = Counter(b for _, x in docs for b in plain_buckets(x)), Counter(b for x in target for b in plain_buckets(x))
    ss, tt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ss + 10_000) / ((s[b] + 1) * (tt + 10_000)))) for b in s}
    out = []
    for d, x in docs:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        f = plain_buckets(x)
        weight = sum(gain[b] for b in f)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(x)) >= 20))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = Counter((*r[:4], k) for k, r in enumerate(able[: percent * len(able) // 100], 1))
    rest = Counter((*r[:4], None) for r in out)
    for r in drawn.elements():
        rest[(*r[:4], None)] -= 1
    return +rest + drawn


TEXTS = ["", None, " \n\t", "a", "One two", "Zäh ÄÖ é 🎈 ß" * 9, "lorem ipsum dolor sit amet " * 6, "lorem ipsum dolor " * 60_000, "x\x00y z_1 " * 30, *(" ".join(f"w{(i * j) % 97}" for j in range(25)) for i in range(60))]
DOCS = [*enumerate(TEXTS), (6, TEXTS[6]), (6, TEXTS[6]), (7, "other text of the same id " * 5), (None, "a text without id " * 9), (None, None)]


@pytest.mark.parametrize("stable", [False, True])
def test_resample(spark, stable):
    target = ["lorem ipsum", None, "", "w3 w6 w9"]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in DOCS], "doc_id long, text string, weight string, rank int, w int").repartition(3)
    aim = spark.createDataFrame([(x, "b") for x in target], "text string, bucket string")
    s = resample.Settings(percent=40)
    got = resample.resample(docs, aim, s, stable=stable)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()) == plain_resample(DOCS, target, 40)
    assert resample.resample(docs.filter("doc_id = -1"), aim, stable=stable).count() == 0
    bare = resample.resample(docs, aim.filter("text = 'none'"), s, stable=stable).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in bare) == plain_resample(DOCS, [], 40)


def test_selected_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, f"{i} " + "word " * 30, "s") for i in range(40)], "doc_id long, text string, rank string")
    out = resample.selected(docs, resample.resample(docs, docs.limit(2), resample.Settings(percent=25)))
    assert out.columns == docs.columns and out.count() == 10


# clustering


def plain_kmeans(rows, k=16, rounds=3, size=64):
    kept = [(i, q) for i, v in rows if v is not None and len(v) == size and (q := quantized(v)) is not None]
    c = [q for _, q in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        to = [near(q)[1] for _, q in kept]
        c = [[sum(x) // to.count(j) for x in zip(*(q for (_, q), t in zip(kept, to, strict=True) if t == j), strict=True)] if j in to else x for j, x in enumerate(c)]
    last = [(i, *near(q)) for i, q in kept]
    per = Counter()
    for _, d, j in last:
        per[j] += d
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return Counter((i, j, d, per[j], sum(per.values()), sha[j]) for i, d, j in last)


def vectors(seed, n, size, spread=0.5):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(5, size))
    return [(i, [float(x) for x in centres[i % 5] + spread * g.normal(size=size)]) for i in range(n)]


def odd_vectors(size):
    base = vectors(1, 90, size)
    return [
        *base, *[(1000 + i, base[0][1]) for i in range(40)], (3, base[3][1]), (3, base[3][1]), (3, base[4][1]), (None, base[5][1]), (None, base[6][1]),
        (200, None), (201, []), (202, base[0][1][:-1]), (203, [*base[0][1], 1.0]), (204, [NAN, *base[0][1][1:]]), (220, [None, *base[0][1][1:]]), (240, [-INF, *base[0][1][1:]]), (260, base[7][1]),
    ]


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(*r, "c", 5, 1.0) for r in rows], f"vec_id long, embedding array<{kind}>, cluster string, id int, q double").repartition(3)


@pytest.mark.parametrize("size", [2, 64])
def test_clusters(spark, size):
    rows = odd_vectors(size)
    got = kmeans.cluster(frame(spark, rows), size=size)
    assert Counter(map(tuple, got.collect())) == plain_kmeans(rows, size=size)


def test_clusters_of_small_and_empty_tables(spark):
    few = vectors(2, 5, 64)
    assert Counter(map(tuple, kmeans.cluster(frame(spark, few)).collect())) == plain_kmeans(few)
    none = kmeans.cluster(frame(spark, few).filter("vec_id < 0"))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("dims, spread", [(2, 0.05), (3, 1.0), (64, 0.3)])
def test_tree_filters_exactly(dims, spread):
    q = np.array([[math.floor(64 * x) for x in v] for _, v in vectors(3, 1500, dims, spread)])
    q[100:400] = q[0]  # copies, in one leaf that can't be cut
    t = kmeans.Tree(q)
    c = np.array([*q[:9], q[0], q[0]])  # equal centroids: the smaller number wins
    to, whole = np.full(len(q), -1), 0
    for kind, at, found in t.filter(c):
        if kind == "rows":
            assert (to[at] == -1).all()
            to[at] = found
        for node, x in zip(at, found, strict=True) if kind == "nodes" else ():
            assert (to[t.start[node] : t.stop[node]] == -1).all()
            to[t.start[node] : t.stop[node]] = x
            whole += t.stop[node] - t.start[node]
            assert (t.sums[node] == t.q[t.start[node] : t.stop[node]].sum(axis=0)).all()
    assert (to == ((t.q[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert whole > 0 or dims > 2


def test_large_components(spark):
    rows = [(i, [float((-1) ** i * 2**20 + i), float(i)]) for i in range(40)]
    assert Counter(map(tuple, kmeans.cluster(frame(spark, rows), size=2).collect())) == plain_kmeans(rows, size=2)
    with pytest.raises(Exception, match="64 bits"):
        kmeans.cluster(frame(spark, [(1, [2.0**24, 0.0]), (2, [-(2.0**24), 0.0])]), size=2).collect()


# search


def plain_top_k(queries, rows, k):
    kept = [(i, q) for i, v in rows if (q := quantized(v)) is not None]
    out = Counter()
    for i, v in queries:
        q = quantized(v)
        if q is None or i is None:
            continue
        all_ = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j is None, j) for j, x in kept if j != i and len(x) == len(q))
        out.update((i, n, j, -s) for n, (s, _, j) in enumerate(all_[:k], 1))
    return out


@pytest.mark.parametrize("grid", [topk.Grid(), topk.Grid(cell_queries=3, cell_rows=17, tile=4, block=8, fan_in=2)])
def test_search(spark, grid):
    rows = odd_vectors(5)
    queries = [r for r in rows if r[0] is None or r[0] % 3 == 0]
    df = frame(spark, rows, "float").withColumn("embedding", F.col("embedding").cast("array<double>"))
    exact = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    ask = [r for r in exact if r[0] is None or r[0] % 3 == 0]
    for k in (1, 7, 500):
        got = topk.top_k(df.filter("vec_id % 3 = 0 or vec_id is null"), df, k, grid=grid)
        assert Counter(map(tuple, got.collect())) == plain_top_k(ask, exact, k)
    assert len(ask) == len(queries)


def test_search_in_empty_tables(spark):
    df = frame(spark, vectors(4, 9, 3))
    assert topk.top_k(df.filter("vec_id < 0"), df).count() == 0
    assert topk.top_k(df, df.filter("vec_id < 0")).count() == 0
    assert topk.top_k(df, df.filter("vec_id = 2")).count() == 8


def test_search_with_large_products(spark):
    """Beyond what a score and a place can share in 64 bits."""
    rows = [(i, [float(((-1) ** i) * (2**20 + i)), float(2**19 - i)]) for i in range(30)]
    df = frame(spark, rows)
    assert Counter(map(tuple, topk.top_k(df, df, 4).collect())) == plain_top_k(rows, rows, 4)
