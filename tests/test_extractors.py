"""Extractors against answers worked out by hand, and the channels of the registered query."""

from __future__ import annotations

import numpy as np
import pytest

from tidewell.functions import detect
from tidewell.functions import features as fx
from tidewell.functions import signal as sg
from tidewell.plans import arrays, registry, reports  # noqa: F401  (modules register their queries)


def first(got):
    return {k: float(v[0]) for k, v in got.items()}


RATE = 100.0


def plain_peaks(y, distance, prominence):
    """Peaks by height, then what is too near goes, then what stands out too little."""
    found, i = [], 1
    while i < len(y) - 1:
        j = i
        while j < len(y) - 1 and y[j + 1] == y[i]:
            j += 1
        if y[i - 1] < y[i] and j < len(y) - 1 and y[j + 1] < y[i]:
            found.append((i + j) // 2)
        i = j + 1
    keep = set(found)
    for p in sorted(found, key=lambda p: (-y[p], -p)):
        if p in keep:
            keep -= {q for q in keep if q != p and abs(q - p) < distance}

    def stands_out(p):
        left, right = p, p
        while left > 0 and y[left - 1] <= y[p]:
            left -= 1
        while right < len(y) - 1 and y[right + 1] <= y[p]:
            right += 1
        return y[p] - max(y[left : p + 1].min(), y[p : right + 1].min())

    return np.array([p for p in sorted(keep) if stands_out(p) >= prominence], int), stands_out


def plain_beats(y):
    upper = [max(v, 0) ** 2 for v in y]
    average = lambda i, w: np.mean(upper[max(i - w // 2, 0) : i + w - w // 2])
    offset, beats, i = 0.02 * np.mean(upper), [], 0
    above = [average(i, 11) > average(i, 67) + offset for i in range(len(y))]
    while i < len(y):
        j = i
        while j < len(y) and above[j]:
            j += 1
        if j - i >= 11:
            p = i + int(np.argmax(y[i:j]))
            if not beats or p - beats[-1] > 30:
                beats.append(p)
        i = max(j, i + 1)
    return np.array(beats, int)


def plain_physio(x):
    """Names as in the extracted table."""
    out, n = {}, len(x)
    y = sg.filtfilt(*sg.butter(3, 0.5, 8.0, RATE), x)
    p = plain_beats(y)
    if len(p) < 2:
        p = plain_peaks(y, 35, 0.3 * y.std())[0]
    if len(p) > 1:
        rr = [(b - a) / RATE for a, b in zip(p, p[1:], strict=False)]
        out |= {"bvp_peak_count": len(p), "bvp_rr_mean": np.mean(rr), "bvp_hr_mean": 60 / np.mean(rr), "bvp_peak_amp_mean": np.mean(y[p]), "bvp_peak_amp_std": np.std(y[p])}
        if len(rr) > 1:
            steps = [1000 * (b - a) for a, b in zip(rr, rr[1:], strict=False)]
            out |= {"bvp_sdnn": 1000 * np.std(rr, ddof=1), "bvp_rmssd": np.mean(np.square(steps)) ** 0.5, "bvp_pnn20": np.mean([round(abs(v), 6) > 20 for v in steps])}
        troughs = plain_peaks(-y, 30, -np.inf)[0]
        rise = [(q - max(t for t in troughs if t < q)) / RATE for q in p if (troughs < q).any()]
        out["bvp_risetime_mean"] = np.mean(rise)
    spectrum = np.fft.fft(y)
    out["bvp_env_std"] = np.abs(np.fft.ifft(spectrum * np.where(np.arange(n) == 0, 1, np.where(np.arange(n) < n / 2, 2, np.where(np.arange(n) == n / 2, 1, 0))))).std()

    tonic, phasic = sg.filtfilt(*sg.butter(2, None, 0.05, RATE), x), sg.filtfilt(*sg.butter(2, 0.05, None, RATE), x)
    p, height = plain_peaks(phasic, 100, max(0.01, 0.1 * phasic.std()))
    out |= {"eda_tonic_mean": tonic.mean(), "eda_tonic_slope": np.polyfit(np.arange(n) / RATE, tonic, 1)[0], "eda_range": x.max() - x.min(), "eda_scr_count": len(p), "eda_scr_rate": len(p) / (n / RATE / 10)}
    out |= {"eda_scr_amp_mean": np.mean([height(q) for q in p]) if len(p) else 0.0, "eda_phasic_auc": sum((abs(a) + abs(b)) / 2 for a, b in zip(phasic, phasic[1:], strict=False)) / RATE}
    rises, falls, highs = [], [], []
    for k, q in enumerate(p):
        onset = min(range(p[k - 1] if k else 0, q + 1), key=lambda i: phasic[i])
        highs.append(phasic[q] - phasic[onset])
        rises.append((q - onset) / RATE)
        falls.append(next(((i - q) / RATE for i in range(q, p[k + 1] if k + 1 < len(p) else n) if phasic[i] <= phasic[q] - highs[-1] / 2), None))
    if len(p):
        out |= {"eda_scr_height_mean": np.mean(highs), "eda_scr_rise_mean": np.mean(rises), "eda_scr_recovered": np.mean([f is not None for f in falls])}
        if any(f is not None for f in falls):
            out["eda_scr_half_recovery_mean"] = np.mean([f for f in falls if f is not None])

    z = sg.filtfilt(*sg.butter(2, 0.1, 0.5, RATE), x)
    least = max(1e-6, 0.1 * z.std())
    p, t = plain_peaks(z, 100, least)[0], plain_peaks(-z, 100, least)[0]
    out["resp_rate"] = 0.0 if not len(p) else 60 / (n / RATE) if len(p) == 1 else 60 / np.mean(np.diff(p) / RATE)
    if len(p) > 1:
        out["resp_interval_std"] = np.std(np.diff(p) / RATE)
    if len(p):
        high = z[p] - (z[t].mean() if len(t) else 0)
        out |= {"resp_amp_mean": high.mean(), "resp_amp_std": high.std()}
    ratios = [(q - max(v for v in t if v < q)) / (min(v for v in t if v >= q) - q) for q in p if (t < q).any() and (t >= q).any()]
    if ratios:
        out["resp_ie_ratio"] = np.median(ratios)
    if n >= 3 * RATE:
        out["bvp_resp_envcorr"] = np.corrcoef(sg.envelope(y), z)[0, 1]
    return {f"physio_{k}": v for k, v in out.items()}


def plain_dfa(x):
    y, n = np.cumsum(x - x.mean()), len(x)
    scales = sorted({int(v) for v in np.logspace(np.log10(4), np.log10(n // 4), 10)})
    pts = []
    for w in scales:
        left = [v - np.polyval(np.polyfit(np.arange(w), v, 1), np.arange(w)) for v in (y[i * w : (i + 1) * w] for i in range(n // w))]
        pts.append((np.log(w), np.log(np.sqrt(np.mean(np.square(left))))))
    return np.polyfit(*np.array(pts).T, 1)[0]


def test_registered_extraction(spark, sf):
    """Every family of every recording is there, and the physiological values are those of plain loops."""
    recordings = {r.recording_id: np.array(r.samples) for r in registry.recordings(spark, sf).collect()}
    got: dict[int, dict[str, float]] = {i: {} for i in recordings}
    states = {}
    for r in registry.QUERIES["extract_features"](spark, sf).collect():
        if r.feature.startswith("status:"):
            family, state = r.feature[7:].split("=")
            states.setdefault(family, set()).add(state)
        else:
            got[r.recording_id][r.feature] = r.value
    assert states == {f"{family}_{name}": {"ok"} for family in ("raw", "tf", "physio") for name in fx.PHYSIO}
    for i, x in recordings.items():
        mine = {k: v for k, v in got[i].items() if k.startswith(("physio_bvp", "physio_eda", "physio_resp"))}
        want = plain_physio(x)
        assert mine.keys() == want.keys()
        assert mine == pytest.approx(want, abs=1e-5), i
        assert got[i]["tf_eda_dfa_alpha"] == pytest.approx(plain_dfa(x), abs=1e-5)
    assert sum("physio_bvp_sdnn" in g for g in got.values()) > 0.9 * len(got)


def test_registered_templates(spark, sf):
    got = {}
    for r in registry.QUERIES["beat_templates"](spark, sf).collect():
        got.setdefault(r.recording_id, {})[r.k] = r.x
    for r in registry.recordings(spark, sf).collect():
        y = sg.filtfilt(*sg.butter(3, 0.5, 8.0, RATE), np.array(r.samples))
        p = plain_beats(y)
        p = p if len(p) > 1 else plain_peaks(y, 35, 0.3 * y.std())[0]
        cuts = [y[q - 25 : q + 50] for q in p if q >= 25 and q + 50 <= len(y)]
        assert [got[r.recording_id][k] for k in range(75)] == pytest.approx(np.mean(cuts, 0), abs=1e-5)


@pytest.mark.parametrize("noise", [0.0, 0.1, 0.3])
def test_planted_beats_are_found(noise):
    """Pulses with a second, lower wave, 0.6 to 1.1 s apart, in noise of up to 0.3 of their height."""
    rng = np.random.default_rng(3)
    t = np.arange(6000) / RATE
    at = np.cumsum(rng.uniform(0.6, 1.1, 100)) + 0.5
    at = at[at < 59.7]
    x = sum(np.exp(-((t - a) ** 2) / 0.01) + 0.35 * np.exp(-((t - a - 0.28) ** 2) / 0.01) for a in at) + noise * rng.normal(size=len(t))
    found = fx.beats(fx.pulse_band(x[None], RATE), RATE)[0] / RATE
    hit = [np.abs(found - a).min() < 0.08 for a in at]
    assert np.mean(hit) == 1 and len(found) <= len(at) + 1


def test_planted_skin_responses_are_found():
    """Rises of 1 s, falls with a half life of 2 s."""
    t = np.arange(6000) / RATE
    one = lambda a, h: h * np.where(t < a, 0, np.where(t < a + 1, t - a, 0.5 ** ((t - a - 1) / 2)))
    r = detect.skin_responses(one(5, 1.0) + one(25, 0.5) + one(45, 2.0), RATE, 0.1)
    assert r["peak"] / RATE == pytest.approx([6, 26, 46], abs=0.02)
    assert r["amplitude"] == pytest.approx([1, 0.5, 2], abs=0.02)
    assert (r["recovery"] - r["peak"]) / RATE == pytest.approx([2, 2, 2], abs=0.15)
    assert (detect.skin_responses(np.zeros(50), RATE, 0.1)["peak"] == []).all()


def test_spo2():
    x = np.full(1000, 97.0)
    x[200], x[203], x[600], x[800] = 87.0, 90.0, 87.0, 95.5
    got = first(fx.spo2_features(x[None], 10.0))
    assert got["mean"] == pytest.approx(x.mean()) and got["min"] == 87 and got["dip_magnitude"] == pytest.approx(x.mean() - 87)
    assert got["dip_count"] == 2  # 203 is within half a second of a deeper one, 800 less than two below the mean


def test_eda():
    t = np.arange(2000) / 20
    got = first(fx.eda_features((3 + 0.01 * t)[None], 20.0))
    assert got["tonic_mean"] == pytest.approx(3.49975, abs=1e-3) and got["tonic_slope"] == pytest.approx(0.01, abs=1e-3)
    assert got["scr_count"] == 0 and got["scr_amp_mean"] == 0 and got["range"] == pytest.approx(0.01 * t[-1])
    bumps = 3 + sum(np.exp(-((t - c) ** 2) / 0.5) for c in range(5, 100, 5))
    got = first(fx.eda_features(bumps[None], 20.0))
    assert got["scr_count"] == 19 and got["scr_rate"] == pytest.approx(1.9) and got["scr_amp_mean"] == pytest.approx(1, abs=0.15)


def test_bvp():
    """Beats 0.7 and 0.9 s apart in turn, each rising for 0.2 s."""
    fs, x, at = 100.0, np.zeros(3000), [50]
    while at[-1] < 2900:
        at.append(at[-1] + (70 if len(at) % 2 else 90))
    for p in at[:-1]:
        x += np.exp(-((np.arange(3000) - p) ** 2) / 200)
    got = first(fx.bvp_features(x[None], fs))
    assert got["rr_mean"] == pytest.approx(0.8, abs=0.01) and got["hr_mean"] == pytest.approx(60 / got["rr_mean"])
    assert got["rmssd"] == pytest.approx(200, abs=15) and got["sdnn"] == pytest.approx(100, abs=10) and got["pnn20"] == 1
    assert got["peak_count"] == len(at) - 1 and 0.1 < got["risetime_mean"] < 0.5


def test_resp():
    """Rises of 1 s and falls of 3 s."""
    fs = 50.0
    phase = (np.arange(3000) / fs) % 4
    got = first(fx.resp_features(np.where(phase < 1, phase, (4 - phase) / 3)[None], fs))
    assert got["rate"] == pytest.approx(15, abs=0.3) and got["interval_std"] < 0.1 and 0.3 < got["ie_ratio"] < 1
    assert 0.5 < got["amp_mean"] < 1.2 and got["amp_std"] < 0.1


def test_short_signals_have_no_physiology():
    for name, f in fx.PHYSIO.items():
        assert f(np.ones((2, 8)), 10.0) == {}, name
    assert np.isnan(fx.coupling(np.ones((1, 20)), np.ones((1, 40)), 10.0)).all()


def test_coupling_follows_the_envelope():
    t = np.arange(4000) / 100
    slow = np.sin(2 * np.pi * 0.25 * t)
    got = fx.coupling(((1.5 + slow) * np.sin(2 * np.pi * 2 * t))[None], np.stack([slow]), 100.0)
    assert got[0] > 0.9


def test_subwindows_of_few_samples_are_zero():
    assert all((v == 0).all() for v in fx.subwindow_features(np.ones((3, 2))).values())


def test_failed_rows_do_not_take_others_along():
    def f(x):
        if (x < 0).any():
            raise ValueError
        return {"s": x.sum(1)}

    got = {int(i): None if v is None else float(v["s"][k]) for at, v in fx.by_length([np.ones(3), -np.ones(3), np.ones(2)], f) for k, i in enumerate(at)}
    assert got == {0: 3, 1: None, 2: 2}
