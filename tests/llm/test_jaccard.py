"""The pipeline's near-dedup stage against the Jaccard similarity of all pairs."""

from __future__ import annotations

import os
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tidewell.llm import jaccard


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        n = min(5, len(w))
        out.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if n else frozenset())
    return out


def brute(rows):
    """Kept rows, and the pairs of distinct sets with a similarity of 0.8 or more."""
    sets = sets_of(t for _, t in rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    held, pairs = {}, set()
    for i, s in enumerate(sets):
        near = Counter(j for g in s for j in held.get(g, ()))
        for g in s:
            held.setdefault(g, []).append(i)
        if not s:
            near = Counter({j: 0 for j in range(i) if not sets[j]})
        for j, c in near.items():
            if not s or 5 * c >= 4 * (len(s) + len(sets[j]) - c):
                root[find(i)] = find(j)
                if s != sets[j]:
                    pairs.add((j, i))
    least = {}
    for i, r in enumerate(rows):
        k = find(i)
        least[k] = min(least.get(k, r), r, key=lambda r: (r[0] is not None, r[0] or 0))
    return Counter(least.values()), pairs


@pytest.mark.parametrize("frequent", [20, 0])
def test_stage_finds_all_near_copies(spark, sf, frequent, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rng, rows = random.Random(1), []
    common = [f"c{k}" for k in range(12)]
    for i in range(60):
        words = [*common, *(f"{i}x{k}" for k in range(rng.randrange(20, 120)))]
        rows.append((i, " ".join(words)))
        for copy in range(i % 4):
            words = [f"y{copy}" if rng.random() < 0.02 else w for w in words]  # chains, about the limit
            rows.append((100 + 10 * i + copy, " ".join(words).upper() if copy == 1 else " ".join(words)))
    rows += [(None, "one text of its own without any id at all"), (900, ""), (901, None), (902, "two words")]
    want, pairs = brute(rows)
    assert len(pairs) > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_dedup(spark, docs, sf)
    assert got.columns == docs.columns and Counter(map(tuple, got.collect())) == want


def test_stage_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want, _ = brute([tuple(r) for r in docs.collect()])
    assert Counter(map(tuple, corpus_pipeline.near_dedup(spark, docs, sf).collect())) == want


def test_bitmaps_rule_out_no_similar_pair():
    rng = np.random.default_rng(4)
    for m in (0, 1, 2, 30, 500, 4000):
        h = rng.integers(-(2**63), 2**63, 2 * m + 40)
        for own in (0, m // 50, m // 9, m // 2, m):
            a, b = h[: m + own], h[own : 2 * m]
            shared = len(np.intersect1d(a, b))
            assert jaccard.most_shared(jaccard.bitmap(a), jaccard.bitmap(b), len(a), len(b)) >= shared
            assert jaccard.most_shared(jaccard.bitmap(b), jaccard.bitmap(a), len(b), len(a)) >= shared
    a, b = h[:500], np.concatenate((h[:250], h[1000:1250]))
    assert jaccard.most_shared(jaccard.bitmap(a), jaccard.bitmap(b), 500, 500) < 350


def test_whole_sets_of_unlike_pairs_are_not_fetched(spark, sf, monkeypatch):
    """Texts that share a third of their words meet, but are ruled out before their sets are written; no set stays on the disk."""
    rng, names, cut = random.Random(2), [], []
    common = [f"c{k}" for k in range(60)]
    rows = [(i, " ".join([*common, *(f"{i}x{k}" for k in range(120))])) for i in range(30)]
    rows.append((99, rows[3][1] + " end"))
    rng.shuffle(rows)
    other = jaccard.materialize

    def materialize(df, name):
        out = other(df, name)
        names.append(out.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:"))
        if name == "sets":
            cut.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "materialize", materialize)
    monkeypatch.setattr(jaccard, "FREQUENT", 1000)
    got = jaccard.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == brute(rows)[0]
    assert sum(cut) == 2
    assert not [n for n in names if "/sets-" in n and os.path.exists(n)]
