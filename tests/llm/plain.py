"""Plain implementations that the operators are held against."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import xxhash

from tidewell.llm import quality

BLANK = " \t\n\x0b\x0c\r"


def base_stats(t):
    t = t or ""
    w = [x for x in "".join(" " if c in BLANK else c for c in t).split(" ") if x]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if x.strip(BLANK):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover)


def vector(text):
    n, chars, sym, dup, rep = base_stats(text)
    up, ex = sum(c.isascii() and c.isupper() for c in text), text.count("!")
    return [math.log1p(20 * sym / (n + 50)), math.log((chars + 250) / (n + 50)), math.log1p(20 * rep / (n + 50)), math.log1p(10 * dup / (text.count("\n") + 11)), math.log((up + 4) / (chars + 100)), math.log1p(20 * ex / (n + 50))]


def far(x, m, cov):
    return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)


def mcd(x, rules):
    """Centre and covariance (floors added) of the rows of x."""
    floors = np.array(list(rules.floors.values()))
    n, p = x.shape
    at, grid, f2 = math.ceil(n * 0.5) - 1, quality.GRID, np.diag(floors**2)
    cells = lambda v: np.sign(v) * np.floor(np.abs(v) * grid + 0.5)
    med = np.sort(cells(x), axis=0)[at] / grid
    d = 1.4826 * np.sort(cells(np.abs(x - med)), axis=0)[at] / grid
    z = (x - med) / np.sqrt(d**2 + floors**2)
    corr = []
    for y in (np.tanh(z), z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None]):
        s = y.T @ y
        with np.errstate(divide="ignore", invalid="ignore"):
            corr.append(np.nan_to_num(s / np.sqrt(np.outer(s.diagonal(), s.diagonal()))))
    for r in corr:
        np.fill_diagonal(r, 1)
    found = [(math.inf, k, med, r * np.outer(d, d) + f2) for k, r in enumerate([np.eye(p), *corr])]
    consistency = 0.5 / quality._chi2_cdf(quality.chi2_quantile(0.5, p), p + 2)
    for k in range(rules.max_steps):
        falls, after = False, []
        for old in found:
            cell = np.floor(np.log(far(x, *old[2:]) + 1e-9) * (grid // 4))
            near = x[cell <= np.sort(cell)[at]]
            cov = np.cov(near.T, bias=True) * consistency + f2
            new = (np.linalg.slogdet(cov)[1], old[1], near.mean(0), cov)
            falls |= new[0] < old[0] - 1e-6
            after.append(new if new[0] < old[0] - 1e-6 else old)
        found = [min(after, key=lambda e: e[:2])] if k == 1 else after
        if k and not falls:
            break
    q = rules.reweight_quantile
    near = x[far(x, *found[0][2:]) <= quality.chi2_quantile(q, p)]
    return near.mean(0), np.cov(near.T, bias=True) * q / quality._chi2_cdf(quality.chi2_quantile(q, p), p + 2) + f2


def judge(docs, rules=quality.Rules()):
    """docs: id -> (text, lang, source). Gives id -> (base_failed, squared distance or None)."""
    out, x = {}, {}
    for d, (text, _, _) in docs.items():
        n, *_, rep = base_stats(text)
        failed = n < rules.min_words or 100 * rep > rules.max_repeat_percent * n
        out[d] = failed, None
        if text:
            x[d] = np.array(vector(text))
    fit = [d for d in x if not out[d][0]]
    groups = {}
    for d in fit:
        for key in ((), docs[d][1:2], docs[d][1:]):
            groups.setdefault(key, []).append(d)
    found = {k: mcd(np.array([x[d] for d in ds]), rules) for k, ds in groups.items()}
    mix = lambda n, own, parent: [(n * a + rules.prior_rows * b) / (n + rules.prior_rows) for a, b in zip(own, parent, strict=True)]
    for d in x:
        key = docs[d][1:]
        if key in found:
            parent = mix(len(groups[key[:1]]), found[key[:1]], found[()])
            m, cov = mix(len(groups[key]), found[key], parent)
            out[d] = out[d][0], far(x[d][None], m, cov + np.eye(len(m)) * 1e-6)[0]
    return out


def keeps(docs, rules=quality.Rules()):
    cutoff = quality.chi2_quantile(rules.reject_quantile, len(rules.floors))
    return {d for d, (failed, far2) in judge(docs, rules).items() if not failed and (far2 is None or far2 <= cutoff)}


def line_key(x):
    return x.encode().strip(BLANK.encode()).lower().decode()


def lines(texts):
    held = {}
    for d, t in texts.items():
        for k in {line_key(x) for x in t.split("\n")}:
            held.setdefault(k, []).append(d)
    gone = {k: max(v) for k, v in held.items() if len(k) >= 20 and len(v) >= 3}
    return {d: "\n".join(x for x in t.split("\n") if gone.get(line_key(x), d) == d) for d, t in texts.items()}


def fingerprint(text, n=3):
    """SimHash by counting bits one by one."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    n = min(n, len(w))
    hashes = [xxhash.xxh64(b" ".join(w[i : i + n]), seed=42).intdigest() for i in range(len(w) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(keys, linked):
    """key -> a name of its component, for keys that linked(a, b) joins."""
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = list(keys)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(a, b):
                root[find(a)] = find(b)
    return {k: find(k) for k in keys}


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    n = min(n, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset()


def similar(a, b, least=0.8):
    if not a or not b:
        return a == b
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared) >= least


def near(texts):
    """One text of each component of five-word Jaccard links: that of the least id."""
    sets = {d: shingles(texts[d]) for d in sorted(texts)}
    root, least = groups(list(dict.fromkeys(sets.values())), similar), {}
    for d, s in sets.items():
        least.setdefault(root[s], d)
    return {d: texts[d] for d in least.values()}


def item_words(t):
    return [x.decode() for x in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower())]


def clean(texts, items):
    grams = {tuple(w[k : k + 10]) for w in map(item_words, items) if w for k in range(max(1, len(w) - 9))}
    sizes = {len(g) for g in grams}
    return {d: t for d, t in texts.items() for w in [item_words(t)] if not any(tuple(w[k : k + n]) in grams for n in sizes for k in range(len(w) - n + 1))}


def language_model(seqs, held, least=2):
    """seqs: id -> tokens, the end included. Gives prob(context, token), word counts and training tokens, of backoff over n-grams seen often enough."""
    n = [Counter(), Counter(), Counter()]
    for i, q in seqs.items():
        for o in range(3):
            n[o].update([] if held[i] else [tuple(q[k : k + o + 1]) for k in range(len(q) - o)])
    total, distinct = sum(n[0].values()), len(n[0])
    kept = [n[0], *({g: c for g, c in m.items() if c >= least} for m in n[1:])]
    after, weights = {}, {}
    for m in kept[1:]:
        for g in m:
            after.setdefault(g[:-1], []).append(g[-1])

    def prob(context, w):
        if not context:
            return (n[0][w,] + 0.1) / (total + 0.1 * (distinct + 1))
        if n[len(context) - 1][context] < least:
            return prob(context[1:], w)
        m, c = kept[len(context)], n[len(context) - 1][context]
        if (*context, w) in m:
            return (m[*context, w] - 0.5) / c
        if context not in weights:
            ws = after.get(context, [])
            weights[context] = max(1 - sum((m[*context, x] - 0.5) / c for x in ws), 1e-9) / max(1 - sum(prob(context[1:], x) for x in ws), 1e-9)
        return weights[context] * prob(context[1:], w)

    return prob, n[0], total
