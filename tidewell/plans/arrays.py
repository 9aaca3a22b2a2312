"""Queries over array columns: statistics, time-domain and spectral features, resampling, extraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidewell.functions import features as fx
from tidewell.functions import signal as sg
from tidewell.operators import relational as rel
from tidewell.operators import segments as seg

from .registry import SIG, query, recordings, signals

MEAN = "list_avg(samples)"
FS = 64.0
RATE = 100.0


def _var(x: str) -> str:
    return f"list_var_pop({x})"


@query("array_raw_stats", SIG + """, e AS (SELECT segment_id, unnest(samples) AS x FROM sig), g AS (SELECT segment_id, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max, median(x) AS median, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, skewness(x) AS skew, kurtosis(x) AS kurtosis, mad(x) AS mad, sqrt(avg(x * x)) AS rms FROM e GROUP BY segment_id),
dd AS (SELECT segment_id, list_stddev_pop(list_transform(range(1, 64), lambda i: samples[i + 1] - samples[i])) AS diff_std FROM sig)
--
SELECT segment_id, mean, std, min, max, max - min AS range, median, iqr, skew, kurtosis, mad, rms, CASE WHEN abs(mean) > 1e-12 THEN std / mean END AS cv, diff_std FROM g JOIN dd USING (segment_id)""", "mean std min max range median iqr skew kurtosis mad rms cv diff_std", "segment_id")  # fmt: skip
def array_raw_stats(spark, d):
    st = seg.raw_stats(F.col("samples"))
    return signals(spark, d).select("segment_id", *[v.alias(k) for k, v in st.items()])


@query("array_hjorth", SIG + """, x AS (SELECT segment_id, samples AS a, list_transform(range(1, 64), lambda i: samples[i + 1] - samples[i]) AS b, list_transform(range(1, 63), lambda i: samples[i + 2] - 2 * samples[i + 1] + samples[i]) AS c FROM sig), v AS (SELECT segment_id, list_var_pop(a) AS v0, list_var_pop(b) AS v1, list_var_pop(c) AS v2 FROM x)
--
SELECT segment_id, v0 AS activity, sqrt(v1 / v0) AS mobility, sqrt(v2 / v1) / sqrt(v1 / v0) AS complexity FROM v""", "activity mobility complexity", "segment_id")  # fmt: skip
def array_hjorth(spark, d):
    return signals(spark, d).select("segment_id", seg.hjorth(F.col("samples")).alias("h")).select("segment_id", "h.*")


@query("array_crossings", SIG + """, t AS (SELECT segment_id, list_avg(list_transform(range(1, 64), lambda i: CASE WHEN (samples[i] - list_avg(samples) < 0) <> (samples[i + 1] - list_avg(samples) < 0) THEN 1e0 ELSE 0e0 END)) AS zcr,
list_avg(list_transform(range(1, 64), lambda i: CASE WHEN (samples[i] > list_avg(samples)) <> (samples[i + 1] > list_avg(samples)) THEN 1e0 ELSE 0e0 END)) AS mcr,
len(list_filter(range(1, 63), lambda i: (samples[i + 1] - samples[i] < 0) <> (samples[i + 2] - samples[i + 1] < 0))) AS turns FROM sig)
--
SELECT segment_id, zcr, mcr, log10(64) / (log10(64) + log10(64 / (64 + 0.4 * turns))) AS petrosian FROM t""", "zcr mcr petrosian", "segment_id")  # fmt: skip
def array_crossings(spark, d):
    x = F.col("samples")
    return signals(spark, d).select("segment_id", seg.zero_cross_rate(x).alias("zcr"), seg.mean_cross_rate(x).alias("mcr"), seg.petrosian(x).alias("petrosian"))


@query("array_permutation_entropy", SIG + """, c AS (SELECT segment_id, unnest(list_transform(range(1, 63), lambda i: (samples[i] > samples[i + 1])::INT * 4 + (samples[i] > samples[i + 2])::INT * 2 + (samples[i + 1] > samples[i + 2])::INT)) AS code FROM sig), n AS (SELECT segment_id, code, count(*) / 62e0 AS p FROM c GROUP BY ALL)
--
SELECT segment_id, -sum(p * log2(p)) / log2(6) AS pe FROM n GROUP BY segment_id""", "pe", "segment_id")  # fmt: skip
def array_permutation_entropy(spark, d):
    return signals(spark, d).select("segment_id", seg.permutation_entropy3(F.col("samples")).alias("pe"))


@query("array_resample_linear", SIG + """, t AS (SELECT segment_id, samples, k, k * 63 / 31e0 AS t FROM sig, (SELECT unnest(range(0, 32)) AS k))
--
SELECT segment_id, sum(k * (samples[CAST(floor(t) AS INT) + 1] + (t - floor(t)) * (samples[least(CAST(floor(t) AS INT) + 2, 64)] - samples[CAST(floor(t) AS INT) + 1]))) AS moment FROM t GROUP BY segment_id""", "moment", "segment_id")  # fmt: skip
def array_resample_linear(spark, d):
    r = signals(spark, d).select("segment_id", F.posexplode(seg.resample_linear(F.col("samples"), 32)).alias("k", "x"))
    return r.groupBy("segment_id").agg(F.sum(F.col("k") * F.col("x")).alias("moment"))


@query("array_strip_and_pad", SIG + """, g AS (SELECT segment_id, CAST(64 - segment_id % 5 AS INTEGER) AS kept, samples FROM sig)
--
SELECT segment_id, kept, CAST(70 AS INTEGER) AS padded, CAST(10 AS INTEGER) AS cut, CAST(70 - kept AS INTEGER) AS n_null, list_sum(list_transform(range(1, kept + 1), lambda i: i * samples[i])) AS moment, list_sum(list_transform(range(1, 11), lambda i: i * samples[i])) AS cut_moment FROM g""", "moment cut_moment", "segment_id kept padded cut n_null")  # fmt: skip
def array_strip_and_pad(spark, d):
    s = signals(spark, d).withColumn("samples", F.transform("samples", lambda x, i: F.when(i < 64 - F.col("segment_id") % 5, x)))
    moment = lambda a: F.aggregate(F.transform(a, lambda x, i: F.coalesce((i + 1) * x, F.lit(0.0))), F.lit(0.0), lambda t, x: t + x)
    s = s.select("segment_id", seg.strip_trailing(F.col("samples")).alias("a"), seg.fit_length(F.col("samples"), 70).alias("b"), seg.fit_length(F.col("samples"), 10).alias("c"))
    n_null = F.size(F.filter("b", lambda x: x.isNull()))
    return s.select("segment_id", F.size("a").alias("kept"), F.size("b").alias("padded"), F.size("c").alias("cut"), n_null.alias("n_null"), moment("a").alias("moment"), moment("c").alias("cut_moment"))


@query("subwindow_means", SIG + ", w AS (SELECT segment_id, CAST(w AS INTEGER) AS win, samples[w * 21 + 1 : w * 21 + 21] AS s FROM sig, (SELECT unnest(range(0, 3)) AS w))\n--\nSELECT segment_id, win, list_avg(s) AS mean, list_stddev_pop(s) AS std FROM w", "mean std", "segment_id win")
def subwindow_means(spark, d):
    w = seg.subwindows(signals(spark, d), "samples", 3)
    return w.select("segment_id", F.col("window").alias("win"), seg.mean(F.col("samples")).alias("mean"), F.sqrt(seg.var_pop(F.col("samples"))).alias("std"))


@query("subwindows_wide", SIG + "\n--\nSELECT segment_id, list_avg(samples[1:21]) AS w0_mean, list_avg(samples[22:42]) AS w1_mean, list_avg(samples[43:63]) AS w2_mean FROM sig", "w0_mean w1_mean w2_mean", "segment_id")
def subwindows_wide(spark, d):
    w = seg.subwindows(signals(spark, d), "samples", 3).select("segment_id", F.concat(F.lit("w"), "window").alias("w"), seg.mean(F.col("samples")).alias("m"))
    return rel.widen(w, ["segment_id"], "w", ["w0", "w1", "w2"], "m", "_mean")


@query("class_waveforms", SIG + ", e AS (SELECT class, unnest(range(0, 64)) AS pos, unnest(samples) AS x FROM sig)\n--\nSELECT class, CAST(pos AS INTEGER) AS pos, avg(x) AS mean, stddev_samp(x) / sqrt(count(x)) AS sem, count(x) AS n FROM e GROUP BY ALL", "mean sem", "class pos n")
def class_waveforms(spark, d):
    return seg.position_means(signals(spark, d), ["class"], "samples")


@query("slope", SIG + ", e AS (SELECT segment_id, unnest(range(0, 64)) AS t, unnest(samples) AS x FROM sig)\n--\nSELECT segment_id, regr_slope(x, t) AS slope FROM e GROUP BY segment_id", "slope", "segment_id")
def slope(spark, d):
    e = signals(spark, d).select("segment_id", F.posexplode("samples").alias("t", "x"))
    return e.groupBy("segment_id").agg(F.regr_slope("x", F.col("t").cast("double")).alias("slope"))


DFT = SIG + """, k AS (SELECT segment_id, k, i, samples[i + 1] AS x FROM sig, (SELECT unnest(range(0, 33)) AS k), (SELECT unnest(range(0, 64)) AS i)), p AS (SELECT segment_id, k, sum(x * cos(i * k * 2 * pi() / 64)) ** 2 + sum(x * sin(i * k * 2 * pi() / 64)) ** 2 AS p FROM k GROUP BY ALL)
--
SELECT segment_id, CAST(k AS INTEGER) AS k, p FROM p"""


@query("spectrum_dft", DFT, "p", "segment_id k")
def spectrum_dft(spark, d):
    """By Arrow batches of the fast transform."""
    power = seg.map_matrix(F.col("samples"), lambda x: np.abs(np.fft.rfft(x)) ** 2)
    return signals(spark, d).select("segment_id", F.posexplode(power).alias("k", "p"))


@query("spectrum_dft_all", DFT, "p", "segment_id k")
def spectrum_dft_all(spark, d):
    """By column expressions, from the definition."""
    return signals(spark, d).select("segment_id", F.posexplode(seg.dft_power(F.col("samples"), 64)).alias("k", "p"))


@query("psd_welch", SIG + """, c AS (SELECT segment_id, list_transform(range(0, 64), lambda i: (samples[i + 1] - list_avg(samples)) * (0.5 - 0.5 * cos(2 * pi() * i / 64))) AS x FROM sig), k AS (SELECT segment_id, k, i, x[i + 1] AS x FROM c, (SELECT unnest(range(0, 33)) AS k), (SELECT unnest(range(0, 64)) AS i)),
p AS (SELECT segment_id, k, (sum(x * cos(i * k * 2 * pi() / 64)) ** 2 + sum(x * sin(i * k * 2 * pi() / 64)) ** 2) / (64 * 24e0) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS p FROM k GROUP BY segment_id, k)
--
SELECT segment_id, CAST(k AS INTEGER) AS k, p FROM p""", "p", "segment_id k")  # fmt: skip
def psd_welch(spark, d):
    s = signals(spark, d).select("segment_id", seg.psd(F.col("samples"), FS, 64, 0).alias("s"))
    return s.select("segment_id", F.posexplode("s.p").alias("k", "p"))


TIME = "mean std min max p10 p90 iqr skew kurtosis rms mean_abs mad energy zcr mcr hjorth_activity hjorth_mobility hjorth_complexity samp_entropy approx_entropy perm_entropy petrosian_fd"


@query("time_features", SIG + """, e AS (SELECT segment_id, unnest(range(0, 64)) AS i, unnest(samples) AS x FROM sig),
l AS (SELECT *, avg(x) OVER p AS m, median(x) OVER p AS md, 0.2 * stddev_pop(x) OVER p AS tol, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM e WINDOW p AS (PARTITION BY segment_id), o AS (PARTITION BY segment_id ORDER BY i)),
g AS (SELECT segment_id, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max, quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.9) AS p90, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr,
avg((x - m) ** 3) / stddev_pop(x) ** 3 AS skew, avg((x - m) ** 4) / stddev_pop(x) ** 4 - 3 AS kurtosis, sqrt(avg(x * x)) AS rms, avg(abs(x)) AS mean_abs, median(abs(x - md)) AS mad, sum(x * x) AS energy,
count(*) FILTER ((x - m < 0) <> (y - m < 0)) / 63e0 AS zcr, count(*) FILTER ((x > m) <> (y > m)) / 63e0 AS mcr, var_pop(x) AS v0, var_pop(y - x) AS v1, var_pop(z - 2 * y + x) FILTER (z IS NOT NULL) AS v2, count(*) FILTER ((y - x < 0) <> (z - y < 0)) AS turns FROM l GROUP BY segment_id),
c AS (SELECT segment_id, (x > y)::INT * 4 + (x > z)::INT * 2 + (y > z)::INT AS code, count(*) / 62e0 AS q FROM l WHERE z IS NOT NULL GROUP BY ALL), h AS (SELECT segment_id, -sum(q * ln(q)) / ln(6) AS perm_entropy FROM c GROUP BY segment_id),
n AS (SELECT a.segment_id, a.i, count(*) AS c2, count(*) FILTER (a.z IS NOT NULL AND b.z IS NOT NULL AND abs(a.z - b.z) <= a.tol) AS c3 FROM l a JOIN l b ON a.segment_id = b.segment_id AND a.y IS NOT NULL AND b.y IS NOT NULL AND abs(a.x - b.x) <= a.tol AND abs(a.y - b.y) <= a.tol GROUP BY ALL),
s AS (SELECT segment_id, sum(c2 - 1) / 63e0 AS bb, sum(c3 - 1) FILTER (c3 > 0) / 62e0 AS aa, avg(ln(c2 / 63e0)) - avg(ln(c3 / 62e0)) FILTER (c3 > 0) AS approx_entropy FROM n GROUP BY segment_id)
--
SELECT segment_id, mean, std, min, max, p10, p90, iqr, skew, kurtosis, rms, mean_abs, mad, energy, zcr, mcr, v0 AS hjorth_activity, sqrt(v1 / v0) AS hjorth_mobility, sqrt(v2 / v1) / sqrt(v1 / v0) AS hjorth_complexity,
CASE WHEN aa > 0 AND bb > 0 THEN -ln(aa / bb) END AS samp_entropy, approx_entropy, perm_entropy, log10(64) / (log10(64) + log10(64 / (64 + 0.4 * turns))) AS petrosian_fd FROM g JOIN h USING (segment_id) JOIN s USING (segment_id)""", TIME, "segment_id")  # fmt: skip
def time_features(spark, d):
    return seg.features(signals(spark, d), ["segment_id"], "samples", fx.time_features, TIME.split())


SPECTRAL = "total_power spec_entropy spec_centroid spec_spread spec_flatness spec_edge_95 peak_freq peak_power peak_rel_power bp_vlf bp_lf bp_hf bp_vhf bp_vlf_rel bp_lf_rel bp_hf_rel bp_vhf_rel lf_hf_ratio dom_freq_cardiac"
#: Sampling rate of the spectral queries, at which 64 samples reach all bands.
SLOW = 2.0
HANN32 = """c AS (SELECT segment_id, class, w, list_transform(range(0, 32), lambda i: (s[i + 1] - list_avg(s)) * (0.5 - 0.5 * cos(2 * pi() * i / 32))) AS x FROM (SELECT segment_id, class, w, samples[w * 16 + 1 : w * 16 + 32] AS s FROM sig, (SELECT unnest(range(0, 3)) AS w))),
ks AS (SELECT segment_id, class, w, k, i, x[i + 1] AS x FROM c, (SELECT unnest(range(0, 17)) AS k), (SELECT unnest(range(0, 32)) AS i)),
ws AS (SELECT segment_id, class, w, k, (sum(x * cos(i * k * 2 * pi() / 32)) ** 2 + sum(x * sin(i * k * 2 * pi() / 32)) ** 2) / (2 * 12e0) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END AS p FROM ks GROUP BY segment_id, class, w, k),
psd AS (SELECT segment_id, class, k, k / 16e0 AS f, avg(p) AS p FROM ws GROUP BY segment_id, class, k)"""


def _band(lo: float, hi: float) -> str:
    return f"coalesce(sum((p + nextp) / 2 / 16e0) FILTER (f >= {lo} AND f + 1 / 16e0 <= {hi}), 0)"


@query("spectral_features", SIG + ", " + HANN32 + f""", n AS (SELECT *, lead(p) OVER (PARTITION BY segment_id ORDER BY k) AS nextp, sum(p) OVER (PARTITION BY segment_id) AS total, sum(f * p) OVER (PARTITION BY segment_id) / sum(p) OVER (PARTITION BY segment_id) AS mid, sum(p) OVER (PARTITION BY segment_id ORDER BY k) AS upto FROM psd),
g AS (SELECT segment_id, sum((p + nextp) / 2 / 16e0) AS total_power, -sum(p / (total + 1e-12) * ln(p / (total + 1e-12))) FILTER (p > 0) / ln(count(*) FILTER (p > 0)) AS spec_entropy, any_value(mid) AS spec_centroid, sqrt(sum((f - mid) ** 2 * p) / any_value(total)) AS spec_spread,
exp(avg(ln(p)) FILTER (p > 0)) / avg(p) FILTER (p > 0) AS spec_flatness, min(f) FILTER (upto / total >= 0.95) AS spec_edge_95, arg_max(f, p) AS peak_freq, max(p) AS peak_power, max(p) / (any_value(total) + 1e-12) AS peak_rel_power,
{_band(0.003, 0.04)} AS bp_vlf, {_band(0.04, 0.15)} AS bp_lf, {_band(0.15, 0.4)} AS bp_hf, {_band(0.4, 4.0)} AS bp_vhf, arg_max(f, p) FILTER (f >= 0.4 AND f <= 4.0) AS dom_freq_cardiac FROM n GROUP BY segment_id)
--
SELECT *, bp_vlf / total_power AS bp_vlf_rel, bp_lf / total_power AS bp_lf_rel, bp_hf / total_power AS bp_hf_rel, bp_vhf / total_power AS bp_vhf_rel, CASE WHEN bp_hf > 0 THEN bp_lf / bp_hf END AS lf_hf_ratio FROM g""", SPECTRAL, "segment_id")  # fmt: skip
def spectral_features(spark, d):
    return seg.features(signals(spark, d), ["segment_id"], "samples", lambda x: fx.frequency_features(x, SLOW, "bvp", 32, 16), SPECTRAL.split())


@query("spectral_features_resp", SIG + ", " + HANN32 + f", n AS (SELECT *, lead(p) OVER (PARTITION BY segment_id ORDER BY k) AS nextp FROM psd)\n--\nSELECT segment_id, {_band(0.1, 0.5)} AS bp_breathing, {_band(0.1, 0.5)} / sum((p + nextp) / 2 / 16e0) AS bp_breathing_rel, arg_max(f, p) FILTER (f >= 0.1 AND f <= 0.5) AS dom_freq_breathing FROM n GROUP BY segment_id", "bp_breathing bp_breathing_rel dom_freq_breathing", "segment_id")
def spectral_features_resp(spark, d):
    return seg.features(signals(spark, d), ["segment_id"], "samples", lambda x: fx.frequency_features(x, SLOW, "resp", 32, 16), ["bp_breathing", "bp_breathing_rel", "dom_freq_breathing"])


@query("psd_welch_averaged", SIG + ", " + HANN32 + "\n--\nSELECT segment_id, CAST(k AS INTEGER) AS k, p FROM psd", "p", "segment_id k")
def psd_welch_averaged(spark, d):
    """Three overlapping windows of each segment."""
    s = signals(spark, d).select("segment_id", seg.psd(F.col("samples"), SLOW, 32, 16).alias("s"))
    return s.select("segment_id", F.posexplode("s.p").alias("k", "p"))


@query("class_mean_psd", SIG + ", " + HANN32 + "\n--\nSELECT class, CAST(k AS INTEGER) AS k, avg(p) AS mean, count(*) AS n FROM psd GROUP BY ALL", "mean", "class k n")
def class_mean_psd(spark, d):
    s = signals(spark, d).select("class", seg.psd(F.col("samples"), SLOW, 32, 16).alias("s"))
    return s.select("class", F.posexplode("s.p").alias("k", "p")).groupBy("class", "k").agg(F.avg("p").alias("mean"), F.count(F.lit(1)).alias("n"))


@query("baseline_waveforms", SIG + """, b AS (SELECT segment_id % 7 AS grp, class, samples, segment_id FROM sig), x AS (SELECT grp, unnest(samples) AS x FROM b WHERE class = (SELECT min(class) FROM b)), g AS (SELECT grp, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY grp HAVING count(x) >= 10 AND stddev_pop(x) >= 1e-6),
e AS (SELECT class, grp, unnest(range(0, 64)) AS pos, unnest(samples) AS x FROM b)
--
SELECT class, CAST(pos AS INTEGER) AS pos, avg((x - m) / s) AS mean, stddev_samp((x - m) / s) / sqrt(count(*)) AS sem, count(*) AS n FROM e JOIN g USING (grp) GROUP BY ALL""", "mean sem", "class pos n")  # fmt: skip
def baseline_waveforms(spark, d):
    """Mean waveform of each class after each group's samples were set against its first class."""
    s = signals(spark, d).withColumn("subject", F.col("segment_id") % 7)
    first = s.agg(F.min("class")).first()[0]
    return seg.position_means(seg.baseline_normalised(s, F.col("class") == first).filter(F.col("samples").isNotNull()), ["class"], "samples")


@query("extract_features")
def extract_features(spark, d):
    """Raw, time-frequency and physiological features of recordings of ten seconds, each as every one of the four channels."""
    return seg.extract(recordings(spark, d), ["recording_id"], dict.fromkeys(("bvp", "eda", "resp", "spo2"), "samples"), RATE)


SUBWINDOW = "mean std slope range ptp rms median mad pos_frac ac1 skew"


@query("subwindow_features", SIG + """, e AS (SELECT segment_id, CAST(w AS INTEGER) AS win, unnest(range(0, 21)) AS t, unnest(samples[w * 21 + 1 : w * 21 + 21]) AS x FROM sig, (SELECT unnest(range(0, 3)) AS w)),
l AS (SELECT *, avg(x) OVER p AS m, median(x) OVER p AS md, lead(x) OVER (PARTITION BY segment_id, win ORDER BY t) AS y FROM e WINDOW p AS (PARTITION BY segment_id, win))
--
SELECT segment_id, win, avg(x) AS mean, stddev_pop(x) AS std, regr_slope(x, t) AS slope, max(x) - min(x) AS range, max(x) - min(x) AS ptp, sqrt(avg(x * x)) AS rms, median(x) AS median, median(abs(x - md)) AS mad, avg(CASE WHEN x > m THEN 1e0 ELSE 0e0 END) AS pos_frac,
sum((x - m) * (y - m)) / sum((x - m) ** 2) AS ac1, avg((x - m) ** 3) / stddev_pop(x) ** 3 AS skew FROM l GROUP BY ALL""", SUBWINDOW, "segment_id win")  # fmt: skip
def subwindow_features(spark, d):
    w = seg.subwindows(signals(spark, d), "samples", 3).withColumnRenamed("window", "win")
    return seg.features(w, ["segment_id", "win"], "samples", fx.subwindow_features, SUBWINDOW.split())


@query("filtered_envelope")
def filtered_envelope(spark, d):
    b, a = sg.butter(2, 2.0, 8.0, FS)
    return seg.spread(signals(spark, d), ["segment_id"]).select("segment_id", F.posexplode(seg.map_matrix(F.col("samples"), lambda x: sg.envelope(sg.filtfilt(b, a, x)))).alias("t", "x"))


@query("resample_polyphase")
def resample_polyphase(spark, d):
    return signals(spark, d).select("segment_id", F.posexplode(seg.map_matrix(F.col("samples"), lambda x: sg.resample_poly(x, 48))).alias("t", "x"))


@query("peaks")
def peaks(spark, d):
    return signals(spark, d).select("segment_id", F.explode(seg.map_array(F.col("samples"), lambda x: sg.find_peaks(x, 4, 0.2))).alias("t"))


@query("spectrogram")
def spectrogram(spark, d):
    return signals(spark, d).select("segment_id", F.posexplode(seg.map_array(F.col("samples"), lambda x: sg.spectrogram(x, FS, 32, 16).ravel())).alias("cell", "db"))
