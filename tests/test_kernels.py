from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from tidewell.functions import columns, features, special
from tidewell.functions import signal as s
from tidewell.operators import models, select
from tidewell.operators.decode import exact_count_labels

FS = 100.0
T = np.arange(1000) / FS


def test_filter_passes_and_stops():
    b, a = s.butter(3, 0.5, 8.0, FS)
    inside = np.sin(2 * np.pi * 2 * T)
    assert np.abs(s.filtfilt(b, a, inside)[200:800] - inside[200:800]).max() < 0.02
    t = np.arange(4000) / FS  # long enough for the transients of the lower edge to die away
    assert np.abs(s.filtfilt(b, a, np.sin(2 * np.pi * 20 * t))[1000:3000]).max() < 0.005
    b, a = s.butter(2, None, 0.25 * FS, FS)
    w = np.exp(-1j * 2 * np.pi * 0.25)
    assert abs(abs(np.polyval(b[::-1], w) / np.polyval(a[::-1], w)) - math.sqrt(0.5)) < 1e-9  # half power at the edge


def test_peaks():
    x = np.array([0, 1, 0, 2, 2, 2, 0, 1, 3, 1, 0.0])
    assert s.find_peaks(x).tolist() == [1, 4, 8]
    assert s.find_peaks(x, distance=4).tolist() == [1, 8] or s.find_peaks(x, distance=4).tolist() == [4, 8]
    assert s.find_peaks(x, prominence=1.5).tolist() == [4, 8]
    assert s.n_extrema(np.sin(2 * np.pi * 2 * T)) == 40


def test_spectrum():
    f, p = s.welch(np.sin(2 * np.pi * 12.5 * T), FS, 256, 128)
    assert f[p.argmax()] == pytest.approx(12.5, abs=0.4)
    assert s.trapezoid(p, f) == pytest.approx(0.5, rel=0.02)
    rng = np.random.default_rng(0)
    white = s.spectral(*s.welch(rng.normal(size=(1, 20_000)), FS))
    assert white["spec_flatness"][0] > 0.95 and white["spec_entropy"][0] > 0.99


def test_heart_rate_and_breathing():
    beat = np.exp(-(((T % 0.8) - 0.2) ** 2) / 0.005)
    assert features.bvp_features(beat[None], FS)["hr_mean"][0] == pytest.approx(75, abs=1)
    t = np.arange(3000) / FS
    assert features.resp_features(np.sin(2 * np.pi * 0.25 * t)[None], FS)["rate"][0] == pytest.approx(15, abs=0.5)
    assert features.spo2_features(np.r_[np.full(50, 98.0), 90, np.full(50, 98.0)][None], FS)["dip_count"][0] == 1


def test_resampling():
    x = np.sin(2 * np.pi * 1 * T) + 0.3 * T
    for f in (s.resample_linear, s.resample_poly):
        y = f(x, 1022)
        assert len(y) == 1022
    assert np.abs(s.resample_linear(x, 1000) - x).max() < 1e-12
    mid = np.arange(1022) * 1000 / 1022 / FS
    want = np.sin(2 * np.pi * mid) + 0.3 * mid
    assert np.abs(s.resample_poly(x, 1022) - want)[50:970].max() < 0.01


def test_entropies_and_dimensions():
    rng = np.random.default_rng(1)
    noise, sine = rng.normal(size=500), np.sin(2 * np.pi * T)
    assert s.permutation_entropy(noise[None])[0] > 0.99 and s.permutation_entropy(np.arange(50.0)[None])[0] == 0
    (rough,), (rough2,) = s.match_entropies(noise[None])
    (smooth,), (smooth2,) = s.match_entropies(sine[None, :500])
    assert rough > smooth and rough2 > smooth2
    assert 0.4 < s.dfa_alpha(rng.normal(size=4000)) < 0.6
    assert s.hjorth(sine[None])[1][0] == pytest.approx(2 * np.pi / FS, rel=0.01)
    assert np.isnan(s.match_entropies(np.ones((1, 50)))[0][0])


def test_pairs_of_signals():
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    assert s.distance_correlation(x, 2 * x) == pytest.approx(1)
    assert s.lagged_correlation(x[5:], x[:-5], 8).argmax() - 8 == 5
    assert s.kuiper(x, x) == 0 and s.kuiper(x, x + 100) == pytest.approx(1)
    assert s.mutual_information(x, x) > s.mutual_information(x, rng.normal(size=400))
    assert s.beat_template(np.tile([0, 1, 0.0], 9), np.arange(1, 27, 3), 1, 2).tolist() == [0, 1, 0]


def test_gaps():
    x = np.array([1, np.nan, 3, np.nan, np.nan])
    assert s.strip_and_fill(x).tolist() == [1, 2, 3]
    got, status = features.segment_features({"bvp": [np.array([])]}, FS)
    assert all(np.isnan(v).all() for _, _, v in got) and {s for s, _ in status} == {"raw_bvp=ok", "tf_bvp=short", "physio_bvp=short"}


def test_entropies_by_definition():
    rng = np.random.default_rng(7)
    for n in (120, 700):
        x = rng.normal(size=(2, n))
        sample, approximate = s.match_entropies(x, cells=n * n)
        for row, got, also in zip(x, sample, approximate, strict=True):
            tol = 0.2 * row.std()

            def counts(v, m):
                t = np.lib.stride_tricks.sliding_window_view(v, m)
                return np.array([(np.abs(t - u).max(1) <= tol).sum() for u in t])  # noqa: B023

            phi = [np.log(c / len(c)).mean() for c in (counts(row, 2), counts(row, 3))]
            assert also == pytest.approx(phi[0] - phi[1])
            b, a = ((c - 1).sum() / len(c) for c in (counts(row[::2] if n > 600 else row, m) for m in (2, 3)))
            assert got == pytest.approx(-math.log(a / b))


def test_matrices_are_rows():
    """Filters, envelopes, spectra and resampling of a matrix are those of its rows."""
    x = np.random.default_rng(8).normal(size=(5, 200))
    b, a = s.butter(3, 0.5, 8.0, FS)
    for f in (lambda v: s.filtfilt(b, a, v), s.envelope, lambda v: s.welch(v, FS, 64, 32)[1], lambda v: s.resample_poly(v, 150), lambda v: s.slope(v, FS)):
        assert np.allclose(f(x), [f(r) for r in x])
    by_hand = np.zeros(200)
    for i in range(200):  # the difference equation
        by_hand[i] = sum(b[k] * x[0, i - k] for k in range(len(b)) if i >= k) - sum(a[k] * by_hand[i - k] for k in range(1, len(a)) if i >= k)
    assert np.allclose(s.lfilter(b, a, x[0]), by_hand)


def test_tail_probabilities():
    assert special.betainc(2, 3, 0.4) == pytest.approx(0.5248)
    assert special.gammainc_upper(1.0, 2.0) == pytest.approx(math.exp(-2))
    assert special.gammainc_upper(0.5, 3.841459 / 2) == pytest.approx(0.05, abs=1e-6)
    assert special.betainc(5, 1.5, 10 / (10 + 3 * 3.708265)) == pytest.approx(0.05, abs=1e-4)  # F(3, 10) at its 95 % point
    assert special.percent_point(0.975) == pytest.approx(1.959964, abs=1e-6)


def test_exact_rank_tests():
    """Against all sets of signs, and all orders."""
    for n in (1, 4, 9):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=n)]
        for w in range(n * (n + 1) // 4 + 1):
            assert special.wilcoxon_exact(n, w) == pytest.approx(min(1, 2 * np.mean([s <= w for s in sums])))
    for a, b in ((1, 3), (3, 4), (5, 3)):
        us = [sum(p > q for p in first for q in set(range(a + b)) - set(first)) for first in itertools.combinations(range(a + b), a)]
        for u in range(a * b + 1):
            assert special.mann_whitney_exact(a, b, u) == pytest.approx(min(1, 2 * np.mean([v >= max(u, a * b - u) for v in us])))


@pytest.mark.parametrize("seed", range(6))
def test_exact_counts_are_optimal(seed):
    rng = np.random.default_rng(seed)
    counts = [(3, 2, 2), (1, 0, 4), (2, 2, 3)][seed % 3]
    scores = rng.normal(size=(sum(counts), 3))
    pred = exact_count_labels(scores, counts)
    assert np.bincount(pred, minlength=3).tolist() == list(counts)
    labels = [c for c, n in enumerate(counts) for _ in range(n)]
    best = max(sum(scores[i, c] for i, c in enumerate(p)) for p in set(itertools.permutations(labels)))
    assert scores[np.arange(len(pred)), pred].sum() == pytest.approx(best)
    with pytest.raises(ValueError):
        exact_count_labels(scores, (1, 1, 1))


def test_logistic_and_isotonic():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(float)
    b = models.fit_logistic(x, y, np.ones(300))
    a = np.hstack([x, np.ones((300, 1))])
    grad = np.append(b[:2], 0) + a.T @ (1 / (1 + np.exp(-a @ b)) - y)
    assert np.abs(grad).max() < 1e-6
    xs, ys = models.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1]))
    assert ys.tolist() == [0, 0.5, 0.5, 1]


def test_names():
    assert columns.modality("BVP_RESP_x") == "cross" and columns.modality("BVP_RESP_x", first_match=True) == "bvp"
    assert columns.modality("SpO_2_mean") == "spo2"
    assert [columns.signal_axis(n) for n in ("Bvp_x", "raw_resp_y", "tf_eda_z", "SPO2_min", "tf_bvp_z")] == ["BVP/HR", "RESP", "EDA", "SpO2", "OTHER"]
    assert columns.unique_by_canonical(["raw_a", "b", "a", "raw_c"]) == ["a", "b", "raw_c"]
    assert select.greedy_forward(["a", "b", "c"], lambda n: len(n) - 10 * ("c" in n))[0] == ["a", "b"]
    scores = {1: 0.5, 2: 0.6, 3: 0.596, 4: 0.592, 5: 0.58}  # each step falls by less than 0.005 until the last
    assert len(select.greedy_forward(list("abcdefgh"), lambda n: scores.get(len(n), 0))[0]) == 4
