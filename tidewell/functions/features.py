"""Feature extractors: raw statistics, time-domain, spectral and physiological features.

Each takes a matrix with a segment of equal length in every row and gives name -> one value a row; NaN where undefined.
"""

from __future__ import annotations

import numpy as np

from . import detect
from . import signal as s

#: The frequency bands of the four signals, in Hz.
BANDS = {
    "bvp": {"vlf": (0.003, 0.04), "lf": (0.04, 0.15), "hf": (0.15, 0.4), "vhf": (0.4, 4.0)},
    "eda": {"tonic": (0.01, 0.1), "phasic": (0.1, 0.5), "higher": (0.5, 5.0)},
    "resp": {"breathing": (0.1, 0.5)},
    "spo2": {"low": (0.0, 0.1)},
}
#: The band whose strongest frequency is a feature of its own.
DOMINANT = {"bvp": ("vhf", "dom_freq_cardiac"), "resp": ("breathing", "dom_freq_breathing")}
RAW = ("mean", "std", "min", "max", "range", "median", "iqr", "skew", "kurtosis", "mad", "rms", "cv", "diff_std", "n_extrema")


def _ratio(a, b, otherwise=np.nan):
    """a / b where b > 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b > 0, np.divide(a, b), otherwise)


def _centred_moments(x: np.ndarray):
    """Mean, deviation, and the third and fourth standardised moments (NaN without spread)."""
    mean, std = x.mean(1), x.std(1)
    c = x - mean[:, None]
    return mean, std, _ratio((c**3).mean(1), std**3), _ratio((c**4).mean(1), std**4)


def raw_stats(x: np.ndarray) -> dict[str, np.ndarray]:
    k, n = x.shape
    if n == 0:
        return dict.fromkeys(RAW, np.full(k, np.nan))
    mean, std, m3, m4 = _centred_moments(x)
    med = np.median(x, 1)
    q1, q3 = np.percentile(x, [25, 75], axis=1)
    nan = np.full(k, np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        return {
            "mean": mean, "std": std, "min": x.min(1), "max": x.max(1), "range": np.ptp(x, 1), "median": med, "iqr": q3 - q1,
            "skew": m3 * np.sqrt(n * (n - 1)) / (n - 2) if n > 2 else nan,
            "kurtosis": (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 - 3) + 6) if n > 3 else nan,
            "mad": np.median(np.abs(x - med[:, None]), 1), "rms": np.sqrt((x**2).mean(1)), "cv": np.where(np.abs(mean) > 1e-12, std / mean, np.nan),
            "diff_std": np.diff(x, axis=1).std(1) if n > 1 else nan, "n_extrema": np.array([s.n_extrema(r) for r in x], float),
        }


def time_features(x: np.ndarray) -> dict[str, np.ndarray]:
    n = x.shape[1]
    if n < 4:
        return {}
    mean, std, m3, m4 = _centred_moments(x)
    p10, p25, p75, p90 = np.percentile(x, [10, 25, 75, 90], axis=1)
    activity, mobility, complexity = s.hjorth(x)
    sample, approximate = s.match_entropies(x)
    med = np.median(x, 1)
    return {
        "mean": mean, "std": std, "min": x.min(1), "max": x.max(1), "p10": p10, "p90": p90, "iqr": p75 - p25,
        "skew": np.where(std > 0, m3, 0.0), "kurtosis": np.where(std > 0, m4 - 3, 0.0), "rms": np.sqrt((x**2).mean(1)), "mean_abs": np.abs(x).mean(1),
        "mad": np.median(np.abs(x - med[:, None]), 1), "energy": (x**2).sum(1), "zcr": s.zero_cross_rate(x - mean[:, None]), "mcr": s.above_cross_rate(x, mean),
        "hjorth_activity": activity, "hjorth_mobility": mobility, "hjorth_complexity": complexity, "samp_entropy": sample, "approx_entropy": approximate,
        "perm_entropy": s.permutation_entropy(x), "petrosian_fd": s.petrosian(x), "dfa_alpha": np.array([s.dfa_alpha(r) if n >= 100 else np.nan for r in x]),
    }


def frequency_features(x: np.ndarray, fs: float, name: str, size: int = 256, overlap: int = 128) -> dict[str, np.ndarray]:
    if x.shape[1] < 16:
        return {}
    f, p = s.welch(x, fs, size, overlap)
    out = s.spectral(f, p)
    total = out["total_power"] = s.trapezoid(p, f)
    for band, (lo, hi) in BANDS[name].items():
        b = out[f"bp_{band}"] = s.band_power(f, p, lo, hi)
        out[f"bp_{band}_rel"] = _ratio(b, total)
    if name == "bvp":
        out["lf_hf_ratio"] = _ratio(out["bp_lf"], out["bp_hf"])
    if name in DOMINANT:
        band, feature = DOMINANT[name]
        lo, hi = BANDS[name][band]
        m = (f >= lo) & (f <= hi)
        out[feature] = f[m][p[:, m].argmax(1)] if m.any() else np.full(len(x), np.nan)
    if name == "spo2":
        out["total_variance"] = x.var(1)
    return out


def _rows(f, *matrices) -> dict[str, np.ndarray]:
    """f of every row, as columns."""
    got = [f(*r) for r in zip(*matrices, strict=True)]
    return {k: np.array([g[k] for g in got], float) for k in got[0]} if got else {}


def _long_enough(x: np.ndarray, fs: float) -> bool:
    return x.shape[1] >= int(2 * fs)


def pulse_band(x: np.ndarray, fs: float) -> np.ndarray:
    return s.filtfilt(*s.butter(3, 0.5, min(8.0, 0.45 * fs), fs), x)


def beats(y: np.ndarray, fs: float) -> list[np.ndarray]:
    """Beats of each row of band-passed pulses: by two moving averages, or by prominence where these find fewer than two."""
    found = detect.pulse_peaks(y, fs)
    return [p if len(p) > 1 else s.find_peaks(r, max(1, int(0.35 * fs)), 0.3 * r.std()) for p, r in zip(found, y, strict=True)]


def bvp_features(x: np.ndarray, fs: float) -> dict[str, np.ndarray]:
    """Beats of the 0.5 to 8 Hz band: rates and intervals (s; variability in ms), amplitudes, rise from the trough before, envelope."""
    if not _long_enough(x, fs):
        return {}
    y = pulse_band(x, fs)

    def of_beats(y: np.ndarray, peaks: np.ndarray) -> dict[str, float]:
        out = dict.fromkeys(("peak_count", "rr_mean", "hr_mean", "sdnn", "rmssd", "pnn20", "peak_amp_mean", "peak_amp_std", "risetime_mean"), np.nan)
        if len(peaks) < 2:
            return out
        rr = np.diff(peaks) / fs
        out |= {"peak_count": len(peaks), "rr_mean": rr.mean(), "hr_mean": 60 / rr.mean(), "peak_amp_mean": y[peaks].mean(), "peak_amp_std": y[peaks].std()}
        if len(rr) > 1:
            step = np.diff(rr * 1000)
            out |= {"sdnn": (rr * 1000).std(ddof=1), "rmssd": np.sqrt((step**2).mean()), "pnn20": (np.abs(step) > 20 + 1e-6).mean()}
        troughs = s.find_peaks(-y, max(1, int(0.3 * fs)))
        before = np.searchsorted(troughs, peaks) - 1
        if (before >= 0).any():
            out["risetime_mean"] = ((peaks - troughs[before]) / fs)[before >= 0].mean()
        return out

    return _rows(of_beats, y, beats(y, fs)) | {"env_std": s.envelope(y).std(1)}


def eda_features(x: np.ndarray, fs: float) -> dict[str, np.ndarray]:
    """Tonic level below 0.05 Hz, and responses in what lies above: how many, how high, how fast they rise and lose half their height."""
    if not _long_enough(x, fs):
        return {}
    tonic, phasic = (s.filtfilt(*s.butter(2, *band, fs), x) for band in ((None, 0.05), (0.05, None)))

    def responses(y: np.ndarray) -> dict[str, float]:
        r = detect.skin_responses(y, fs, max(0.01, 0.1 * y.std()))
        n, back = len(r["peak"]), r["recovery"] >= 0
        mean = lambda v: v.mean() if len(v) else np.nan
        return {
            "scr_count": n, "scr_rate": n / (len(y) / fs / 10), "scr_amp_mean": np.mean([s.peak_prominence(y, k) for k in r["peak"]]) if n else 0.0, "scr_height_mean": mean(r["amplitude"]),
            "scr_rise_mean": mean((r["peak"] - r["onset"]) / fs), "scr_half_recovery_mean": mean((r["recovery"] - r["peak"])[back] / fs), "scr_recovered": back.mean() if n else np.nan,
        }

    return _rows(responses, phasic) | {"tonic_mean": tonic.mean(1), "tonic_slope": s.slope(tonic, fs), "phasic_auc": s.trapezoid(np.abs(phasic), np.arange(x.shape[1])) / fs, "range": np.ptp(x, 1)}


def resp_features(x: np.ndarray, fs: float) -> dict[str, np.ndarray]:
    """Breaths of the 0.1 to 0.5 Hz band: rate a minute, spread of intervals, heights above the mean trough, inhaling by exhaling time."""
    if not _long_enough(x, fs):
        return {}

    def breaths(y: np.ndarray) -> dict[str, float]:
        least = max(1e-6, 0.1 * y.std())
        peaks, troughs = s.find_peaks(y, int(fs), least), s.find_peaks(-y, int(fs), least)
        out = {"rate": 0.0, "interval_std": np.nan, "amp_mean": np.nan, "amp_std": np.nan, "ie_ratio": np.nan}
        if len(peaks) == 1:
            out["rate"] = 60 / (len(y) / fs)
        elif len(peaks):
            gaps = np.diff(peaks) / fs
            out |= {"rate": 60 / gaps.mean(), "interval_std": gaps.std()}
        if len(peaks):
            height = y[peaks] - (y[troughs].mean() if len(troughs) else 0.0)
            out |= {"amp_mean": height.mean(), "amp_std": height.std()}
        after = np.searchsorted(troughs, peaks)
        both = (after > 0) & (after < len(troughs))
        if both.any():
            p, a = peaks[both], after[both]
            out["ie_ratio"] = np.median((p - troughs[a - 1]) / (troughs[a] - p))
        return out

    return _rows(breaths, s.filtfilt(*s.butter(2, 0.1, 0.5, fs), x))


def spo2_features(x: np.ndarray, fs: float) -> dict[str, np.ndarray]:
    """Level, depth of the lowest point, and dips of more than two below the mean."""
    if x.shape[1] < 10:
        return {}
    mean = x.mean(1)
    dips = [float((m - r[s.find_peaks(-r, int(0.5 * fs))] > 2).sum()) for r, m in zip(x, mean, strict=True)]
    return {"mean": mean, "std": x.std(1), "min": x.min(1), "dip_magnitude": mean - x.min(1), "dip_count": np.array(dips), "slope": s.slope(x, fs)}


def coupling(bvp: np.ndarray, resp: np.ndarray, fs: float) -> np.ndarray:
    """Correlation of the BVP envelope and the breathing band, from three seconds on."""
    n = min(bvp.shape[1], resp.shape[1])
    if n < int(3 * fs):
        return np.full(len(bvp), np.nan)
    env = s.envelope(pulse_band(bvp[:, :n], fs))
    band = s.filtfilt(*s.butter(2, 0.1, 0.5, fs), resp[:, :n])
    a, b = env - env.mean(1, keepdims=True), band - band.mean(1, keepdims=True)
    flat = (a.std(1) < 1e-12) | (b.std(1) < 1e-12)
    return np.where(flat, np.nan, _ratio((a * b).sum(1), np.sqrt((a * a).sum(1) * (b * b).sum(1))))


PHYSIO = {"bvp": bvp_features, "eda": eda_features, "resp": resp_features, "spo2": spo2_features}


def by_length(rows: list[np.ndarray], f):
    """(indices, f of them as a matrix) for all rows of each length. A matrix that fails is tried row by row; a row that fails gives None."""
    lengths = np.array([len(r) for r in rows])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        try:
            yield at, f(np.stack([rows[i] for i in at]))
        except (ValueError, IndexError, ZeroDivisionError, FloatingPointError, np.linalg.LinAlgError):
            for i in at:
                try:
                    yield at[at == i], f(rows[i][None])
                except (ValueError, IndexError, ZeroDivisionError, FloatingPointError, np.linalg.LinAlgError):
                    yield at[at == i], None


def segment_features(signals: dict[str, list], fs: float):
    """Of segments with these recordings: (feature, segment indices, values), prefixed raw_, tf_ and physio_, and (status, indices) of each family: ok, short or failed."""
    values, states = [], []
    filled = {k: [s.strip_and_fill(v) for v in rows] for k, rows in signals.items()}
    for name, rows in filled.items():
        families = {"raw": raw_stats, "tf": lambda x: time_features(x) | frequency_features(x, fs, name), "physio": lambda x: PHYSIO[name](x, fs)}  # noqa: B023
        for family, f in families.items():
            for at, got in by_length(rows, f):
                states.append((f"{family}_{name}={'failed' if got is None else 'ok' if got else 'short'}", at))
                values += [(f"{family}_{name}_{k}", at, v) for k, v in (got or {}).items()]
    if "bvp" in filled and "resp" in filled:
        n = [min(len(a), len(b)) for a, b in zip(filled["bvp"], filled["resp"], strict=True)]
        pairs = [np.concatenate([a[:k], b[:k]]) for a, b, k in zip(filled["bvp"], filled["resp"], n, strict=True)]
        for at, got in by_length(pairs, lambda x: coupling(*np.hsplit(x, 2), fs)):
            if got is not None:
                values.append(("physio_bvp_resp_envcorr", at, got))
    return values, states


def subwindow_features(x: np.ndarray) -> dict[str, np.ndarray]:
    """Compact statistics of sub-windows; 0 for windows of fewer than three samples. pos_frac: samples above the mean; slope: a sample."""
    k, n = x.shape
    if n < 3:
        return dict.fromkeys(("mean", "std", "slope", "range", "ptp", "rms", "median", "mad", "pos_frac", "ac1", "skew"), np.zeros(k))
    mean, std, m3, _ = _centred_moments(x)
    c, med = x - mean[:, None], np.median(x, 1)
    return {
        "mean": mean, "std": std, "slope": s.slope(x), "range": np.ptp(x, 1), "ptp": np.ptp(x, 1), "rms": np.sqrt((x**2).mean(1)), "median": med, "mad": np.median(np.abs(x - med[:, None]), 1),
        "pos_frac": (x > mean[:, None]).mean(1), "ac1": _ratio((c[:, 1:] * c[:, :-1]).sum(1), (c * c).sum(1), 0.0), "skew": np.where(std > 1e-8, m3, 0.0),
    }
