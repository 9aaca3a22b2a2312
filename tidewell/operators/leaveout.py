"""Logistic fits of very many folds that each leave one subject out, in work that grows with the rows and not with rows times folds.

The loss of all training rows is expanded about the fit of all of them, as a polynomial in the coefficients, by class: its terms are sums over rows,
and so are a subject's own. What is left of a fold is their difference, and its fit is a few Newton steps on some hundred numbers, with the
fold's own scales and class weights. The expansion converges where |u'd| < pi for every row u and the step d between
the two fits; what is cut off after order K is within (|u'd| / pi)^K of the derivatives. A fold for which the greatest possible |u'd| makes that more than TOLERANCE is
left to a fit on the rows, as is one with a large share of them (there are few of these).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement
from math import comb, factorial, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.sources.shared import stored

from .blocks import tree_sum

TOLERANCE = 1e-7
#: Terms of the polynomials, at most; they decide the order.
TERMS = 1000
#: Folds with more than this share of the rows are fitted on the rows.
LARGE = 1 / 64


def order_of(q: int) -> int:
    k = 2
    while k < 8 and comb(q + k + 1, q) <= TERMS:
        k += 1
    return k


class Monomials:
    """u^a and u^a / a! for all exponents a of q variables up to an order, by growing order."""

    def __init__(self, q: int, order: int):
        self.q, self.order = q, order
        words = [w for k in range(order + 1) for w in combinations_with_replacement(range(q), k)]
        place = {w: i for i, w in enumerate(words)}
        self.count, self.below = len(words), [sum(len(w) <= k for w in words) for k in range(order + 1)]
        self.degree = np.array([len(w) for w in words])
        self.shorter = [(place[w[:-1]], w[-1]) for w in words[1:]]
        self.factorial = np.array([float(np.prod([factorial(w.count(j)) for j in range(q)])) for w in words])
        self.up = np.array([[place[tuple(sorted((*w, j)))] for w in words[: self.below[order - 1]]] for j in range(q)])

    def powers(self, u: np.ndarray) -> np.ndarray:
        out = np.ones((len(u), self.count))
        for i, (at, j) in enumerate(self.shorter, 1):
            np.multiply(out[:, at], u[:, j], out=out[:, i])
        return out


def slopes(z: np.ndarray, order: int) -> np.ndarray:
    """Derivatives of log(1 + exp(z)) up to an order, rows x (order + 1): polynomials in p, each p(1 - p) times the last one's derivative."""
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    out, poly, step = [np.logaddexp(0, z), p], np.polynomial.Polynomial([0, 1]), np.polynomial.Polynomial([0, 1, -1])
    for _ in range(order - 1):
        poly = poly.deriv() * step
        out.append(poly(p))
    return np.stack(out[: order + 1], 1)


def _terms(m: Monomials, u: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Rows x (2 terms): each row's expansion of the loss at beta in the columns of its class."""
    z = u @ beta
    d = slopes(z, m.order)
    d[:, 0] -= y * z
    d[:, 1] -= y
    t = m.powers(u) * d[:, m.degree] * w[:, None]
    return np.hstack([t * (y < 0.5)[:, None], t * (y >= 0.5)[:, None]])


def _solve(m: Monomials, left: np.ndarray, weight: np.ndarray, rho: np.ndarray, beta: np.ndarray, c: float, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of some folds, and whether the expansion holds there. left: folds x 2 x terms."""
    poly = c * (left * weight[:, :, None]).sum(1)
    ridge = np.hstack([rho**2, np.zeros((len(rho), 1))])
    d = np.zeros((len(left), m.q))
    first, second = m.below[m.order - 1], m.below[m.order - 2]
    step = np.inf
    for _ in range(30):
        x = m.powers(d) / m.factorial
        grad = ridge * (beta + d) + np.stack([(poly[:, m.up[j]] * x[:, :first]).sum(1) for j in range(m.q)], 1)
        hess = np.stack([np.stack([(poly[:, m.up[j][m.up[i][:second]]] * x[:, :second]).sum(1) for j in range(m.q)], 1) for i in range(m.q)], 1)
        step = np.linalg.solve(hess + np.eye(m.q) * (ridge[:, None, :] + 1e-12), grad[:, :, None])[:, :, 0]
        step = np.clip(np.nan_to_num(step), -1, 1)
        d = d - step
        if np.abs(step).max() < 1e-10:
            break
    far = (np.abs(d) * reach).sum(1)
    return beta + d, (np.abs(step).max(1) < 1e-8) & ((far / pi) ** m.order <= TOLERANCE)


def fold_fits(rows: DataFrame, p: int, every: dict, raw: np.ndarray, c: float, balanced: bool, but: list[int]) -> DataFrame:
    """(fold, b, fine): raw coefficients, intercept last, of every fold of rows, but for some, with both classes left; fine is false where they are not good enough.

    rows: x_0 .., y, w, fold, __learn, without fold -1. every: centre, scale and reach (greatest distance from the centre) of the columns, n and
    ones of all rows learned from. raw: their fit.
    """
    q = p + 1
    m = Monomials(q, order_of(q))
    xs = [f"x_{j}" for j in range(p)]
    centre, scale = every["centre"], every["scale"]
    beta = np.append(raw[:-1] * scale, raw[-1] + raw[:-1] @ centre)
    reach = np.append(every["reach"] / scale, 1.0)
    n_all, ones_all, sum_all, square_all = every["n"], every["ones"], every["sum"], every["square"]

    def coordinates(g: pd.DataFrame) -> np.ndarray:
        return np.hstack([(g[xs].to_numpy(float) - centre) / scale, np.ones((len(g), 1))])

    def part(batches: Iterator[pd.DataFrame]) -> np.ndarray:
        out = np.zeros(2 * m.count)
        for g in (b.iloc[i : i + 2048] for b in batches for i in range(0, len(b), 2048)):
            out += _terms(m, coordinates(g), g["y"].to_numpy(float), g["w"].to_numpy(float), beta).sum(0)
        return out

    total = tree_sum(rows.filter("__learn").select(*xs, "y", "w"), part)

    def fits(folds: np.ndarray, own: np.ndarray) -> pd.DataFrame:
        left = total - own[:, 2 + 2 * p :]
        n, ones = n_all - own[:, 0], ones_all - own[:, 1]
        ok = (ones > 0.5) & (n - ones > 0.5)
        folds, own, left, n, ones = folds[ok], own[ok], left[ok], n[ok], ones[ok]
        if not len(folds):
            return pd.DataFrame({"fold": folds, "b": [], "fine": np.zeros(0, bool)})
        mean, square = (sum_all - own[:, 2 : 2 + p]) / n[:, None], (square_all - own[:, 2 + p : 2 + 2 * p]) / n[:, None]
        raw_square = square * scale**2 + 2 * centre * scale * mean + centre**2
        var = square - mean**2
        rho = np.sqrt(np.where(var * scale**2 > 1e-12 * np.maximum(raw_square, 1e-300), var, 0.0))
        rho = np.where(rho > 0, rho, 1 / scale)  # a column that does not vary has scale 1
        weight = np.stack([n / (2 * (n - ones)), n / (2 * ones)], 1) if balanced else np.ones((len(n), 2))
        b, fine = _solve(m, left.reshape(len(n), 2, -1), weight, rho, beta, c, reach)
        slope = b[:, :-1] / scale
        b = np.hstack([slope, (b[:, -1] - slope @ centre)[:, None]])
        return pd.DataFrame({"fold": folds, "b": list(b), "fine": fine})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by fold; sums of a few hundred folds at a time."""
        ids: list[int] = []
        sums: list[np.ndarray] = []
        for g in (b.iloc[i : i + 2048] for b in batches for i in range(0, len(b), 2048)):
            f, learns = g["fold"].to_numpy(np.int64), g["__learn"].to_numpy(bool)
            u, y = coordinates(g), g["y"].to_numpy(float)
            each = np.hstack([np.ones((len(g), 1)), y[:, None], u[:, :-1], u[:, :-1] ** 2, _terms(m, u, y, g["w"].to_numpy(float), beta)])
            each[~learns] = 0.0
            starts = np.concatenate([[0], np.flatnonzero(f[1:] != f[:-1]) + 1])
            for fold, s in zip(f[starts].tolist(), np.add.reduceat(each, starts), strict=True):
                if ids and ids[-1] == fold:
                    sums[-1] = sums[-1] + s
                else:
                    if len(ids) >= 512:
                        yield fits(np.array(ids), np.stack(sums))
                        ids, sums = [], []
                    ids.append(fold)
                    sums.append(s)
        if ids:
            yield fits(np.array(ids), np.stack(sums))

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (rows.filter(~F.col("fold").isin(but)) if but else rows).select(*xs, "y", "w", "fold", F.coalesce("__learn", F.lit(False)).alias("__learn")).repartition(tasks, "fold").sortWithinPartitions("fold")
    return stored(dealt.mapInPandas(run, "fold long, b array<double>, fine boolean"), "fits")
