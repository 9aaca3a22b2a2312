"""Nulls, empty and long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

from __future__ import annotations

import hashlib
from collections import Counter

import plain
import pytest
from plain import base_stats
from pyspark.sql import functions as F

from tidewell.llm import decontam, lines, lm, packing, quality, shards, simhash, substring, tokens, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, n_words string, kept string, path int, n_tokens string, component_id string, Text_ string"
LONG = "lorem ipsum dolor " * 4000
ODD = [
    (1, None, None, None), (2, "", "en", None), (3, " \n\t ", None, "s"), (4, "a", "en", "s"), (5, LONG, "en", "s"), (6, LONG, "en", "s"), (6, LONG, "en", "s"),
    (None, "null id text with a shared line of words\nx", "en", "s"), (None, None, None, None), (7, "ÄÖÜ é ñ ß " * 30, "de", "s"), (8, "A shared line of words, long enough\ny", "en", "s"),
    (9, "a Shared line of words, long enough \nz", "en", "s"), (10, "  a shared LINE of words, long enough\n\nz", "en", "s"), (11, "x\x00y퟿ 🎈" * 3, "en", "s"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, 1, 2, "s", "w", "k", 3, "t", "c", "T") for r in ODD]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("doc_id = -1")


def words(t):
    return (t or "").encode().split()


def test_packing(odd, none):
    out = packing.pack(odd).collect()
    assert {r.doc_id for r in out} == {r[0] for r in ODD}
    bins = {}
    for r in out:
        bins.setdefault(r.bin_id, []).append(r)
    for rs in bins.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens
        assert at == rs[0].bin_used <= rs[0].bin_capacity in packing.SIZES
        assert not [s for s in packing.SIZES if at <= s < rs[0].bin_capacity]
    assert packing.pack(none).count() == 0


def test_packing_plan_is_best_fit():
    cost = packing.attention_cost

    def plain(items, sizes, allowed):
        bins = []
        for n in sorted(items, reverse=True):
            fit = [b for b in bins if b[0] >= n]
            if fit:
                b = min(fit, key=lambda b: b[0])
            else:
                size = min((s for s in allowed if s >= n), key=lambda s: (cost(s) / s, s))
                bins.append(b := [size, size])
            b[0] -= n
        return len(bins), sum(cost(min(s for s in sizes if s >= b[1] - b[0])) for b in bins)

    sizes = (8, 16, 32, 64)
    for seed in range(40):
        items = [hash((seed, i)) % 64 + 1 for i in range(seed * 3 + 1)]
        for allowed in ((64,), (16, 64), sizes):
            p = packing.best_fit(dict(Counter(items)), sizes, allowed, cost)
            n, total = plain(items, sizes, allowed)
            assert p.bins == n and p.cost == pytest.approx(total)
        assert packing.make_plan(dict(Counter(items)), sizes).cost <= total + 1e-9


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, "shared line of words long enough"), (2, None), (3, ""), (4, "A"), (4, "a"), (None, "lorem ipsum dolor lorem")], "item_id long, text string")
    out = decontam.decontaminate(odd, items)
    got = {(r.doc_id, r.n_words): (r.n_hit, list(r["items"])) for r in out.collect()}
    assert out.count() == len(ODD)
    assert got[8, 8] == (7, ["1", "4"]) and got[4, 1] == (1, ["4"]) and got[5, 12000] == (11998, ["null"])  # the last two words begin no window
    assert got[2, 0] == (0, [])
    assert decontam.decontaminate(none, items).count() == 0
    assert decontam.decontaminate(odd, items.filter("item_id = 2")).filter("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "one two x three four five"), (3, "five four three two one"), (4, "two one three four five"), (5, "one x y z q two three four five")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_near) for r in decontam.decontaminate(docs, items, slop=1).collect()}
    assert got == {1: (5, 0), 2: (0, 1), 3: (0, 0), 4: (0, 1), 5: (0, 0)}


def test_quality(spark, odd, none, sf):
    out = quality.judge(odd).collect()
    assert len(out) == len(ODD)
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, []).append(base_stats(r.text))
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in texts[r.doc_id]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality.judge(none).count() == 0
    assert quality.keep_good(odd).columns == odd.columns
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 150")
    for r in quality.judge(docs).select("text", *quality.BASE).collect():
        assert tuple(r[c] for c in quality.BASE) == base_stats(r.text)


def test_quality_inverse(spark):
    """The sweeps give the inverse and the determinant, in a plan of a few projections: one for each sweep filled the driver's heap."""
    import numpy as np

    g, names = np.random.default_rng(5), list("abcdef")
    found = [m @ m.T for m in g.normal(size=(4, 6, 6))]
    df = spark.createDataFrame([(k, *[float(m[i, j]) for i, j in quality._pairs(names)]) for k, m in enumerate(found)], ["k", *[f"u_{i}_{j}" for i, j in quality._pairs(names)]])
    out = quality._invert(df, ["k"], lambda i, j: f"u_{i}_{j}", names, dict.fromkeys(names, 0.3))
    for r in out.collect():
        m = found[r.k] + 0.09 * np.eye(6)
        assert all(np.isclose(r[f"w_{i}_{j}"], np.linalg.inv(m)[i, j]) and np.isclose(r[f"v_{i}_{j}"], m[i, j]) for i, j in quality._pairs(names))
        assert np.isclose(r.logdet, np.linalg.slogdet(m)[1])
    assert out._jdf.queryExecution().analyzed().toString().count("Project [") <= 4


def test_quality_estimate_against_numpy(spark):
    """The estimate resists 30 % of outliers and rejects those; its steps are those of a plain implementation."""
    import numpy as np

    rng = np.random.default_rng(5)
    names = list(quality.Rules().floors)
    p = len(names)
    mix = rng.normal(size=(p, p)) * 0.3 + np.eye(p)
    x = np.vstack([rng.normal(size=(700, p)) @ mix, rng.normal(size=(300, p)) * 0.2 + 12])
    df = spark.createDataFrame([("c", *map(float, r)) for r in x], "cohort string, " + ", ".join(f"__tw_x_{n} double" for n in names))
    rules = quality.Rules()
    fit = quality.fit_mcd(df, rules).first()
    m, cov = plain.mcd(x, rules)
    assert np.allclose([fit[f"m_{n}"] for n in names], m)
    assert np.allclose([fit[f"v_{i}_{j}"] for i in range(p) for j in range(i + 1)], [cov[i, j] for i in range(p) for j in range(i + 1)])
    out = df.withColumns({f"m_{n}": F.lit(fit[f"m_{n}"]) for n in names} | {f"w_{i}_{j}": F.lit(fit[f"w_{i}_{j}"]) for i in range(p) for j in range(i + 1)})
    far = [r[0] for r in out.select(quality._distance2(names)).collect()]
    assert np.allclose(far, plain.far(x, m, cov))
    assert min(far[700:]) > quality.chi2_quantile(rules.reject_quantile, p) and np.mean(np.array(far[:700]) > quality.chi2_quantile(rules.reject_quantile, p)) < 0.01


@pytest.mark.parametrize("others", [0, 400])
def test_quality_of_small_cohorts(spark, others):
    """Too few documents for an estimate of their own, alone or beside a large cohort, are judged by that of all."""
    text = lambda i: " ".join(hashlib.md5(f"{i} {k}".encode()).hexdigest()[: 3 + (i + k) % 7] for k in range(60))
    rows = [(i, text(i), "xx", "s") for i in range(60)] + [(100 + i, " ".join(w.upper() + "!!!###" for w in text(i).split()), "xx", "s") for i in range(5)]
    rows += [(1000 + i, text(1000 + i), "en", "s") for i in range(others)]
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed or r.distance2 is None for r in out.values())
    assert not any(out[100 + i].kept for i in range(5)) and all(out[i].kept for i in range(60))


@pytest.mark.parametrize(("limit", "keys"), [(5000, 1 << 24), (5000, -1), (0, 1 << 24), (0, -1)])
def test_substrings(odd, none, limit, keys, monkeypatch):
    """By automata and by windows, with the Bloom filter and with the join."""
    monkeypatch.setattr(substring, "GRAM_CONTEXTS", limit)
    monkeypatch.setattr(substring, "BLOOM_KEYS", keys)
    out = substring.deduplicate(odd)
    rows = sorted(((-1 if r.doc_id is None else r.doc_id), words(r.text)) for r in odd.collect())
    first = {}
    for i, w in rows:
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = []
    for i, w in rows:
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        want.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    got = [((-1 if r.doc_id is None else r.doc_id), r.n_words, r.n_removed, r.text) for r in out.collect()]
    assert sorted(got) == sorted(want)
    assert substring.deduplicate(none).count() == 0


@pytest.mark.parametrize("limit", [5000, 3])
def test_substrings_of_few_words(spark, limit, monkeypatch):
    """Random texts over two words, where every window has many places, with passages that start and end anywhere."""
    import random

    monkeypatch.setattr(substring, "GRAM_CONTEXTS", limit)
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for i in range(60)]
    passage = [f"p{k}" for k in range(40)]
    for i in range(60, 140):
        a = rng.randrange(30)
        docs.append((i, " ".join([f"x{i}"] * rng.randrange(5) + passage[a : a + rng.randrange(5, 40)] + [f"y{i}"] * rng.randrange(3))))
    first, want = {}, {}
    for i, t in docs:
        for k in range(len(t.split()) - 12):
            first.setdefault(tuple(t.split()[k : k + 13]), i)
    for i, t in docs:
        w = t.split()
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        want[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    got = {r.doc_id: r.text for r in substring.deduplicate(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert got == want


def test_automaton():
    """Matching statistics, and the first holder of every run, against the strings themselves."""
    import random

    from tidewell.llm.automaton import SuffixAutomaton

    rng = random.Random(1)
    for _ in range(200):
        seqs = [[rng.choice("abc") for _ in range(rng.randrange(1, 14))] for _ in range(5)]
        automaton, held = SuffixAutomaton(), []
        for label, q in enumerate(seqs):
            held.append({tuple(q[i:j]) for i in range(len(q)) for j in range(i, len(q) + 1)})
            want = [next(d for d, h in enumerate(held) if tuple(q[i : i + 3]) in h) for i in range(len(q) - 2)]
            assert list(automaton.stream(q, label, 3)) == want
        probe = [rng.choice("abcd") for _ in range(20)]
        every = set().union(*held)
        assert list(automaton.matching_statistics(probe)) == [max(n for n in range(i + 2) if tuple(probe[i + 1 - n : i + 1]) in every) for i in range(20)]


def key(x):
    return x.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()


def test_lines(spark, odd, none):
    rows = [((-1 if r.doc_id is None else r.doc_id), r.text or "") for r in odd.collect()]
    held = {}
    for i, t in rows:
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(i)
    want = sorted((i, "\n".join(x for x in t.split("\n") if len(held.get(key(x), ())) < 3 or max(held[key(x)]) == i)) for i, t in rows)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.text) for r in lines.deduplicate(odd).collect())
    assert got == want
    assert lines.deduplicate(none).count() == 0


def test_lines_are_reversible(spark):
    docs = spark.createDataFrame([(i, f"a common line of the corpus\nown line number {i} of it\nanother common line {i % 3} here") for i in range(30)], "doc_id long, text string")
    odd, even = docs.filter("doc_id % 2 = 1"), docs.filter("doc_id % 2 = 0")
    state = lines.insert(lines.empty_state(spark, n_shards=3), docs)
    state = lines.insert(state, docs)
    state = lines.delete(state, even.select("doc_id"))
    hashed = lambda df: sorted((r.doc_id, hashlib.md5(r.text.encode()).hexdigest()) for r in df.collect())
    assert hashed(lines.clean(state, odd)) == hashed(lines.deduplicate(odd))
    state = lines.insert(state, even)
    assert hashed(lines.clean(state, docs)) == hashed(lines.deduplicate(docs))
    assert hashed(lines.clean(lines.delete(state, docs.select("doc_id")), docs)) == hashed(docs)


def test_line_ends_of_other_kinds(spark):
    """Only \n ends a line, and only ASCII white space is stripped: a line may end in other terminators after spaces."""
    line = "a line that many documents hold"
    docs = [(i, f"{line} \t{end}\n{line}{end} \nown {i}") for i in range(4) for end in ["\x85\u2028\u2029\r"[i]]]
    docs += [(10 + i, f"{line}  \x85\nown {i}") for i in range(4)]
    want = plain.lines(dict(docs))
    got = {r.doc_id: r.text for r in lines.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want and sum(got[i] != t for i, t in docs) == 3


def test_lines_grow_in_small_shards(spark):
    """A filter that finds no place for a key below its load limit is built anew from the exact table."""
    state = lines.empty_state(spark, n_shards=1, min_docs=1)
    texts = [f"distinct line number 37 {i} of this corpus" for i in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    state = lines.insert(state, docs.filter("doc_id < 4"))
    state = lines.insert(state, docs.filter("doc_id >= 4"))
    again = spark.createDataFrame([(i + 100, t) for i, t in enumerate(texts)], "doc_id long, text string")
    state = lines.insert(state, again)
    assert {r.text for r in lines.clean(state, docs).collect()} == {""}
    assert sorted(r.text for r in lines.clean(state, again).collect()) == sorted(texts)


def test_full_cuckoo_filter_stays_as_it_was():
    import numpy as np

    from tidewell.llm.cuckoo import CuckooFilter

    rng = np.random.default_rng(2)
    refused = 0
    for _ in range(300):
        f, held = CuckooFilter(np.zeros((2, 4), np.uint16)), []
        for h in rng.integers(0, 1 << 63, 8, dtype=np.uint64).tolist():
            before = f.table.copy()
            if f.insert(h):
                held.append(h)
            else:
                refused += 1
                assert (f.table == before).all()
        assert f.contains(np.array(held, np.uint64)).all()
    assert refused


def test_cuckoo_filter():
    import numpy as np

    from tidewell.llm.cuckoo import CuckooFilter

    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    f = CuckooFilter.build(h)
    assert f.contains(h).all() and f.contains(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)).mean() < 0.01
    for x in h[:2500].tolist():
        assert f.delete(x)
    assert f.contains(h[2500:]).all() and f.contains(h[:2500]).mean() < 0.01


def test_language_model(odd, none):
    out = lm.score(odd, min_share=1e-3).collect()
    assert len(out) == len(ODD) and all(r.score < 0 for r in out if r.n_tokens > 1)
    assert lm.score(none).count() == 0


@pytest.mark.parametrize("least", [1, 2, 3])
def test_language_model_sums_to_one(least):
    """Over all words, the end and an unknown word, after any state of the automaton of a chunk that is the whole corpus."""
    import numpy as np
    import pyarrow as pa

    texts = ["a b a b c", "a b c c d", "b c a b", "d d a b e"] * 3 + ["once b"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([False] * len(texts)), pa.array(texts)], ["doc_id", "held_out", "text"])
    (row,) = lm._rows(lm._chunks(iter([batch])))
    c = lm._Chunk(row, 40)
    c.n[1:] = [np.where(n >= least, n, 0) for n in c.n[1:]]
    c.own = [np.ones(len(n), bool) for n in c.n]
    z, backoffs = c.n[0].sum() + lm.ADD * (len(c.n[0]) + 1), []
    for o in (1, 2):
        mass, low = c.masses(o)
        at = c.asks(o, mass, least)
        backoffs.append(c.backoffs(o, [{"ord": o - 1, "shard": 0, "blob": lm._pack(mass[at]), "low": lm._pack(low[at])}], z, least))
    m = lm.Automaton(c, z, backoffs)
    arcs = m.arcs(0, len(c.at[0]))
    kept = [s for s in range(len(m.fail)) if s <= m.words or c.n[1][s - 1 - m.words] > 0]
    for state in kept:
        unknown, s = np.log10(lm.ADD / z), state
        while s:
            unknown, s = unknown + m.backoff[s], m.fail[s]
        assert 10**unknown + sum(10 ** m.traverse([w], arcs, state)[0] for w in range(m.words)) == pytest.approx(1, abs=1e-6)


@pytest.mark.parametrize("options", [{}, {"min_share": 1e-9}, {"least": 1}, {"least": 4}])
def test_language_model_keeps_all_repeated_ngrams(spark, monkeypatch, options):
    """Every row against plain backoff over all n-grams seen often enough, over several chunks and shards."""
    import math
    import random
    import zlib

    monkeypatch.setattr(lm, "SHARD_TOKENS", 100)
    monkeypatch.setattr(lm, "BLOCK", 50)
    rng = random.Random(3)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.8)) % 60}" for _ in range(rng.randrange(40)))) for i in range(120)]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    seqs = {i: [*t.split(), None] for i, t in docs}
    prob, words, total = plain.language_model(seqs, held, options.get("least", 2))
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), **options).collect()}
    assert got.keys() == seqs.keys()
    for i, q in seqs.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(q), sum(words[w,] > 0 for w in q), total)
        assert r.base_score == pytest.approx(sum(math.log10(prob((), w)) for w in q))
        assert r.score == pytest.approx(sum(math.log10(prob(tuple(q[max(0, k - 2) : k]), w)) for k, w in enumerate(q)))


def test_language_model_grows_with_the_corpus(spark):
    """A pair seen twice keeps its weight when other text makes its share small."""
    docs = spark.createDataFrame([(1, "rare pair of words"), (2, "rare pair of words")], "doc_id long, text string")
    more = spark.range(100, 1000).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('filler', id % 7, ' '), 3000)").alias("text"))
    r = lm.score(docs.unionByName(more)).filter("doc_id = 2").first()
    assert r.train_tokens > 2_000_000 and r.score > r.base_score + 9


def test_simhash(odd, none):
    rows = odd.collect()
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == len(ODD)
    fp = {(r.doc_id, r.text): simhash.fingerprint(r.text) for r in rows}
    assert simhash.fingerprint(None) == simhash.fingerprint(" ") == 0
    assert Counter(r.fingerprint for r in out) == Counter(f"{fp[r.doc_id, r.text]:016x}" for r in rows)
    assert {r.component_id for r in out if r.fingerprint == "0" * 16} == {1}
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == len({r.component_id for r in out})
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicate(none).count() == 0


def test_simhash_survivors_without_unique_ids(spark):
    """Unlinked texts all survive, though their ids are null or equal; copies among them do not."""
    texts = [" ".join(hashlib.md5(f"{i} {k}".encode()).hexdigest() for k in range(40)) for i in range(8)]
    rows = [(None, t) for t in texts[:4]] + [(7, t) for t in texts[4:7]] + [(8, texts[7]), (9, texts[7]), (None, texts[0])]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(set(rows[:8]))


def test_simhash_replicas_are_not_broadcast(spark):
    """A hundred replicas of a fingerprint are sized as one: few enough fingerprints to be broadcast have too many replicas for it."""
    found = simhash.links(spark.range(500).select(F.xxhash64("id").alias("fp")).repartition(2, "fp"))
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_simhash_links_are_complete(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(6):
            x = b
            for k in rng.choice(64, rng.integers(1, 5), replace=False).tolist():
                x ^= 1 << k
            fps.add(x)
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert got == want


def test_components(spark):
    from tidewell.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (200, 200), (7, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 103: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_token_counts(odd, none):
    enc = tokens.encoder(tokens.default_vocabulary())
    n = [len(enc.encode_ordinary(r.text or "")) for r in odd.collect()]
    sums = tokens.suffix_sums(tokens.histogram(odd))
    for r in sums.collect():
        assert r.n_docs == n.count(r.length) and r.docs_from == sum(x >= r.length for x in n) and r.tokens_from == sum(x for x in n if x >= r.length)
        assert r.truncated_tokens == sum(min(x, r.length) for x in n) and r.tokens_total == sum(n)
    for r in tokens.at_limits(sums, [0, 3, 50, 10**7]).collect():
        assert r.truncated_tokens == sum(min(x, r.limit) for x in n) and r.docs_longer == sum(x > r.limit for x in n)
    assert tokens.suffix_sums(tokens.histogram(none)).count() == 0


def test_faster_pattern_cuts_alike():
    import random

    import regex

    rng, parts = random.Random(8), ["'s", "'re", "'", "'S", " ", "  ", "\n", "\u00a0", "\u3000", "a", "Zé", "ß", "中", "7", "٣", "½", "!", "-", "$ ", "_", "e\u0301", "\u200b", "🙂", "'ll"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(5000)]
    for t in texts:
        assert regex.findall(tokens.PATTERN, t) == regex.findall(tokens.FASTER, t)
    import tiktoken

    fast = tokens.encoder(tokens.default_vocabulary())
    plain_form = tiktoken.Encoding("plain", pat_str=tokens.PATTERN, mergeable_ranks=fast._mergeable_ranks, special_tokens={})
    assert all(fast.encode_ordinary(t) == plain_form.encode_ordinary(t) for t in texts)


def test_token_counts_of_long_white_space(spark):
    """Runs too long for the tokenizer's pattern are cut where it cuts them itself."""
    path = tokens.default_vocabulary()
    encode = tokens.encoder(path).encode_ordinary
    for blank in (" ", "\t", "\n", "\r\n", " \u2003\n", "\x85", "\u3000"):
        for text in ("a{}b", "{}", "{}b", "a{}", "a{}'s {}1{}!", "{}\x1cx", "é{} {}é"):
            text = text.replace("{}", blank * 12_000)
            assert tokens.encoded_length(text, path) == len(encode(text))
    huge = [(1, "a" + " " * 1_000_000 + "b"), (2, "\t" * 1_000_000), (3, "x" + "\n" * 1_000_000), (4, "y" * 2_000_000), (5, " y" * 1_500_000)]
    docs = spark.createDataFrame(huge, "doc_id long, text string")
    out = {r.doc_id: r.n_tokens for r in tokens.add_length(docs).collect()}
    assert out[1] == 1_000_001 and out[4] == len(encode(huge[3][1])) and out[5] == 1_500_000
    assert sum(r.n_docs for r in tokens.histogram(docs).collect()) == 5
    packed = Counter()
    for r in packing.pack(docs).collect():
        packed[r.doc_id] += r.n_tokens
    assert packed == {d: n + 1 for d, n in out.items()}


def test_packing_of_null_ids(spark):
    docs = spark.createDataFrame([(None, "one two three")] * 3000 + [(1, "one two three")] * 500, "doc_id long, text string")
    out = packing.pack(docs).collect()
    assert Counter(r.doc_id for r in out) == {None: 3000, 1: 500} and len({(r.bin_id, r.bin_offset) for r in out}) == 3500


def test_urls(spark):
    odd = ["http://a.EXAMPLE.com/en/7?x", "http://com/en/8#q/", "http://xcom/en/", "://", None, "x", "http://a.net?q=1://b", "HTTP://Net/de/", "http://com/en/", "http://a..com/en/x", "http://b.example.net/de/80"] * 2
    pages = spark.createDataFrame([(i, u, 1, "p") for i, u in enumerate(odd)] + [(None, odd[0], 1, "p")], "page_id long, url string, host int, Path string")
    rules = urls.literal_rules(spark, [*urls.RULES, ("com", None, "block"), (None, "/", "block"), ("net", "/de/", "block"), ("EXAMPLE.com", "/", "block")])
    out = urls.filter_urls(pages, rules)
    assert out.count() == len(odd) + 1
    known = {(h.lower(), p): v for h, p, v in [("example.com", "/", "block"), *urls.RULES]}
    for r in out.collect():
        fit = [(h + p, v) for (h, p), v in known.items() if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        want = max(fit, key=lambda x: len(x[0])) if fit else (None, "allow")
        assert (r.rule, r.verdict) == want, r
    assert urls.filter_urls(pages.filter("page_id = -1"), rules).count() == 0
    assert urls.filter_urls(pages, rules.filter("host = ''")).filter("rule is not null").count() == 0


def test_shards(spark, odd, none):
    out = shards.shard(odd, n_shards=3).collect()
    assert len(out) == len(ODD)
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert shards.shard(none).count() == 0
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one text for a third of all").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    size = {r.shard: r.b for r in shards.shard(hot).groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert len(size) == 8 and max(size.values()) - min(size.values()) <= 0.003 * sum(size.values())
    same = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("the same text").alias("text"), (F.col("id") % 2).alias("part"))
    for docs in (same, same.withColumn("doc_id", F.lit(None).cast("long")).unionByName(hot.withColumn("part", F.lit(5).cast("long")))):
        out = shards.shard(docs).collect()
        sizes, rows = Counter(), Counter()
        for r in out:
            sizes[r.shard] += r["size"]
            rows[r.shard] += 1
        assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 0.003 * sum(sizes.values())
        assert all(sorted(r.slot for r in out if r.shard == k) == list(range(n)) for k, n in rows.items())
        assert Counter(r.part for r in out) == Counter(r.part for r in docs.collect())
