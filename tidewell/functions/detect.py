"""Event detectors over matrices of recordings: pulses by two moving averages, skin responses by onset and recovery."""

from __future__ import annotations

import numpy as np

from . import signal as s

#: Fixed values of the published two-moving-average detector: seconds of the windows and of the least gap, and the offset.
PEAK_WINDOW, BEAT_WINDOW, LEAST_GAP, OFFSET = 0.111, 0.667, 0.3, 0.02


def moving_average(x: np.ndarray, width: int) -> np.ndarray:
    """Over the last axis, centred; fewer samples at the ends."""
    width = max(1, width)
    before, after = width // 2, width - width // 2
    total = np.concatenate((np.zeros((*x.shape[:-1], 1)), np.cumsum(x, -1)), -1)
    at = np.arange(x.shape[-1])
    lo, hi = np.maximum(at - before, 0), np.minimum(at + after, x.shape[-1])
    return (total[..., hi] - total[..., lo]) / (hi - lo)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last places of the runs of True."""
    step = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def pulse_peaks(y: np.ndarray, fs: float) -> list[np.ndarray]:
    """Systolic peaks of each row of band-passed pulse signals.

    Where the short average of the squared upper half exceeds the long one and an offset, a block of at least the short window's
    length holds one beat, at its highest sample; of beats closer than the least gap the first stays.
    """
    upper = np.maximum(y, 0) ** 2
    short, long = moving_average(upper, round(PEAK_WINDOW * fs)), moving_average(upper, round(BEAT_WINDOW * fs))
    above = short > long + OFFSET * upper.mean(-1, keepdims=True)
    least, gap = round(PEAK_WINDOW * fs), round(LEAST_GAP * fs)
    out = []
    for row, mask in zip(y, above, strict=True):
        kept: list[int] = []
        for a, b in zip(*runs(mask), strict=True):
            if b - a >= least and (not kept or (p := a + int(row[a:b].argmax())) - kept[-1] > gap):
                kept.append(a + int(row[a:b].argmax()))
        out.append(np.array(kept, int))
    return out


def skin_responses(y: np.ndarray, fs: float, least: float) -> dict[str, np.ndarray]:
    """Peaks of one phasic signal at least that prominent and a second apart, with onset, recovery and amplitude.

    onset: the lowest sample since the response before, or the start. recovery: the first later sample that has lost half the amplitude, before the next response; -1 if none has.
    """
    peaks = s.find_peaks(y, max(1, int(fs)), least)
    since = np.concatenate(([0], peaks))[: len(peaks)].astype(int)
    until = np.append(peaks, len(y))[1:].astype(int)
    onset = np.array([a + int(y[a : p + 1].argmin()) for a, p in zip(since, peaks, strict=True)], int)
    amplitude = y[peaks] - y[onset]
    recovery = np.full(len(peaks), -1)
    for k, (p, b) in enumerate(zip(peaks, until, strict=True)):
        low = np.flatnonzero(y[p:b] <= y[p] - amplitude[k] / 2)
        recovery[k] = p + low[0] if len(low) else -1
    return {"peak": peaks, "onset": onset, "recovery": recovery, "amplitude": amplitude}
