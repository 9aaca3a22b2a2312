"""The pipeline against a plain implementation of its stages."""

from __future__ import annotations

import math
from collections import Counter

import plain

import corpus_pipeline
from tidewell.llm import packing, tokens


def test_stages(spark, sf):
    docs = {r.doc_id: (r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
    now, want = spark.read.parquet(f"{sf}/documents.parquet"), None
    stages = [lambda _: {d: docs[d][0] for d in plain.keeps(docs)}, plain.lines, plain.near, lambda t: plain.clean(t, items)]
    for (name, stage), f in zip(corpus_pipeline.STAGES, stages, strict=False):
        now = corpus_pipeline.materialize(stage(spark, now, sf), "test")
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        want = f(want)
        assert {r.doc_id: r.text for r in now.collect()} == want, name
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    encode = tokens.encoder(tokens.default_vocabulary()).encode_ordinary
    lengths = {d: len(encode(t)) + 1 for d, t in want.items()}
    assert Counter({d: sum(r.n_tokens for r in packed if r.doc_id == d) for d in lengths}) == Counter(lengths)
    hist = Counter(min(n - k, 8192) for n in lengths.values() for k in range(0, n, 8192))
    cost = {r.bin_id: packing.attention_cost(r.bin_capacity) for r in packed}
    assert math.isclose(sum(cost.values()), packing.make_plan(hist).cost)
