"""Queries of the reporting tables, subject diagnostics, sweeps, pair statistics, and of models that are kept."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidewell.functions import features as fx
from tidewell.functions import signal as sg
from tidewell.functions.columns import CLASSES, is_pain
from tidewell.operators import aggregate as agg
from tidewell.operators import decode, metrics, models, normalize, relational, select, stats, sweep
from tidewell.operators import segments as seg
from tidewell.sources.shared import new_path

from .arrays import RATE
from .norms import ANOVA, F2_TAIL, F_RATIO, LONG, NORMAL_TAIL, P, PRED, RANKS, V, _long, _pred
from .registry import FEATURES, SEG, SIG, query, recordings, segments, signals


def _mwu_sql(name: str, table: str, a: str, b: str) -> str:
    """CTEs <name>: feature, n1, n2, u, delta, p of Mann-Whitney over table (feature, class, value)."""
    return f"""{name}_r AS (SELECT feature, class, {RANKS.format(by='feature', v='value')} AS r, count(*) OVER (PARTITION BY feature, value) AS c FROM {table} WHERE class IN ('{a}', '{b}') AND value IS NOT NULL),
{name}_t AS (SELECT feature, count(*) FILTER (class = '{a}') AS n1, count(*) FILTER (class = '{b}') AS n2, sum(r) FILTER (class = '{a}') AS s, sum(c * c - 1e0) AS ties FROM {name}_r GROUP BY feature),
{name}_z AS (SELECT *, s - n1 * (n1 + 1) / 2e0 AS u, greatest(abs(s - n1 * (n1 + 1) / 2e0 - n1 * n2 / 2e0) - 0.5, 0) / sqrt(n1 * n2 / 12e0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1e0)))) AS z FROM {name}_t),
{name} AS (SELECT feature, n1, n2, u, 2 * u / (n1 * n2) - 1 AS delta, {NORMAL_TAIL.format(z='z')} AS p FROM {name}_z)"""


def _wilcoxon_sql(name: str, pairs: str) -> str:
    """CTEs <name>: feature, n, w, rb, p of the paired test over pairs (feature, a, b)."""
    return f"""{name}_d AS (SELECT feature, a - b AS d, abs(a - b) AS ad FROM {pairs} WHERE a <> b),
{name}_r AS (SELECT feature, d, {RANKS.format(by='feature', v='ad')} AS r, count(*) OVER (PARTITION BY feature, ad) AS c FROM {name}_d),
{name}_t AS (SELECT feature, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS up, coalesce(sum(r) FILTER (d < 0), 0) AS down, sum(c * c - 1e0) AS ties FROM {name}_r GROUP BY feature),
{name}_z AS (SELECT *, abs(least(up, down) - n * (n + 1) / 4e0) / sqrt(n * (n + 1) * (2 * n + 1) / 24e0 - ties / 48) AS z FROM {name}_t),
{name} AS (SELECT feature, n, least(up, down) AS w, (up - down) / (n * (n + 1) / 2e0) AS rb, {NORMAL_TAIL.format(z='z')} AS p FROM {name}_z)"""


def _ranked(source: str, ps: list[str]) -> str:
    return f"SELECT *, {', '.join(f'row_number() OVER (ORDER BY {p}, feature) AS rank_{p}, count(*) OVER () AS m_{p}' for p in ps)} FROM ({source})"


def _with_fdr(source: str, ps: list[str]) -> str:
    q = ", ".join(f"least(1, min({p} * m_{p} / rank_{p}) OVER (ORDER BY rank_{p} DESC ROWS UNBOUNDED PRECEDING)) AS {p}_fdr" for p in ps)
    return f"SELECT *, {', '.join(f'{p}_fdr <= 0.05 AS ' + p.replace('_p', '', 1) + '_signif' for p in ps)} FROM (SELECT *, {q} FROM ({_ranked(source, ps)}))"


def _pairs_sql(table: str, a: str, b: str) -> str:
    return f"SELECT feature, subject, avg(value) FILTER (class = '{a}') AS a, avg(value) FILTER (class = '{b}') AS b FROM {table} GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL"


POOLED = "both_ AS (SELECT feature, subject, 'Pain' AS class, avg(value) AS value FROM means WHERE class <> 'NoPain' GROUP BY ALL UNION ALL SELECT feature, subject, class, value FROM means WHERE class = 'NoPain')"


@query("pain_vs_nopain", LONG + ", " + POOLED + f""", pr AS ({_pairs_sql('both_', 'Pain', 'NoPain')}), {_wilcoxon_sql('wx', 'pr')}, {_mwu_sql('mw', 'both_', 'Pain', 'NoPain')},
g AS (SELECT feature, class, count(*) n, avg(value) m, var_pop(value) v FROM both_ GROUP BY ALL), t AS (SELECT feature, sum(n) nn, sum(n * v) ssw, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) ssb FROM g GROUP BY feature),
me AS (SELECT feature, avg(value) FILTER (class = 'Pain') AS mean_pain, avg(value) FILTER (class = 'NoPain') AS mean_rest, least(count(*) FILTER (class = 'Pain'), count(*) FILTER (class = 'NoPain')) AS n_subjects FROM both_ GROUP BY feature)
--
SELECT feature, mean_pain, mean_rest, n_subjects, ssb / (ssw / (nn - 2)) AS anova_f, ssb / (ssb + ssw) AS eta2, wx.w AS wilcoxon_w, wx.rb AS wilcoxon_rb, wx.p AS wilcoxon_p, delta, CASE WHEN mean_pain > mean_rest THEN 'Pain > NoPain' ELSE 'Pain < NoPain' END AS direction FROM me JOIN t USING (feature) JOIN wx USING (feature) JOIN mw USING (feature)""", "mean_pain mean_rest anova_f eta2 wilcoxon_w wilcoxon_rb wilcoxon_p delta", "feature n_subjects direction")  # fmt: skip
def pain_vs_nopain(spark, d):
    out = stats.pain_table(_long(spark, d))
    return out.select("feature", "mean_pain", "mean_rest", "n_subjects", "anova_f", "eta2", "wilcoxon_w", "wilcoxon_rb", "wilcoxon_p", "delta", "direction")


@query("pain_vs_nopain_fdr")
def pain_vs_nopain_fdr(spark, d):
    """The table with its ANOVA p (two classes: no closed form in SQL) and the FDR of both tests."""
    return stats.pain_table(_long(spark, d))


ARM_HAND = LONG + f""", pr AS ({_pairs_sql('means', 'PainArm', 'PainHand')}), lg AS (SELECT feature, 'PainArm' AS class, a AS value FROM pr UNION ALL SELECT feature, 'PainHand', b FROM pr), {_wilcoxon_sql('wx', 'pr')}, {_mwu_sql('mw', 'lg', 'PainArm', 'PainHand')},
me AS (SELECT feature, avg(value) FILTER (class = 'PainArm') AS mean_a, avg(value) FILTER (class = 'PainHand') AS mean_b FROM means GROUP BY feature), ns AS (SELECT feature, count(*) AS n_subjects FROM pr GROUP BY feature)"""
ARM_HAND_BODY = _with_fdr("SELECT feature, mean_a, mean_b, n_subjects, wx.w AS wilcoxon_w, wx.p AS wilcoxon_p, wx.rb AS wilcoxon_rb, mw.u AS mw_u, mw.p AS mw_p, delta, CASE WHEN mean_a > mean_b THEN 'PainArm > PainHand' ELSE 'PainArm < PainHand' END AS direction FROM me JOIN ns USING (feature) JOIN wx USING (feature) JOIN mw USING (feature)", ["wilcoxon_p", "mw_p"])


@query("arm_vs_hand", ARM_HAND + "\n--\n" + ARM_HAND_BODY, "mean_a mean_b wilcoxon_w wilcoxon_p wilcoxon_rb mw_u mw_p delta wilcoxon_p_fdr mw_p_fdr", "feature n_subjects direction wilcoxon_signif mw_signif")
def arm_vs_hand(spark, d):
    return stats.pair_table(_long(spark, d), "PainArm", "PainHand")


def _battery_sql() -> tuple[str, str, str]:
    pairs = [(x, y) for i, x in enumerate(CLASSES) for y in CLASSES[i + 1 :]]
    ctes = [LONG + ANOVA, f"an AS (SELECT feature, {F_RATIO} AS f, {F2_TAIL.format(f=F_RATIO, d='nn - k')} AS p, ssb / (ssb + ssw) AS eta2 FROM t)"]
    ctes.append(f"kr AS (SELECT feature, class, {RANKS.format(by='feature', v='value')} AS r, count(*) OVER (PARTITION BY feature, value) AS c FROM means), kg AS (SELECT feature, class, count(*) n, sum(r) s, sum(c * c - 1e0) ties FROM kr GROUP BY ALL), kt AS (SELECT feature, sum(n) n, sum(s * s / n) q, sum(ties) ties FROM kg GROUP BY feature), kw AS (SELECT feature, (12e0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM kt)")
    ctes.append(f"lm AS (SELECT feature, class, abs(value - median(value) OVER (PARTITION BY feature, class)) AS value FROM means), lg AS (SELECT feature, class, count(*) n, avg(value) m, var_pop(value) v FROM lm GROUP BY ALL), lt AS (SELECT feature, count(*) k, sum(n) nn, sum(n * v) ssw, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) ssb FROM lg GROUP BY feature), lv AS (SELECT feature, {F_RATIO} AS w, {F2_TAIL.format(f=F_RATIO, d='nn - k')} AS p FROM lt)")
    cols, joins = ["feature", "an.f AS anova_f", "an.p AS anova_p", "eta2", "h AS kruskal_h", "exp(-h / 2) AS kruskal_p", "lv.w AS levene_w", "lv.p AS levene_p"], "an JOIN kw USING (feature) JOIN lv USING (feature)"
    doubles, ps = ["anova_f", "anova_p", "eta2", "kruskal_h", "kruskal_p", "levene_w", "levene_p"], ["anova_p", "kruskal_p"]
    for x, y in pairs:
        n = f"{x}_{y}"
        ctes += [_mwu_sql(f"mw_{n}", "means", x, y), f"pr_{n} AS ({_pairs_sql('means', x, y)})", _wilcoxon_sql(f"wx_{n}", f"pr_{n}")]
        cols += [f"mw_{n}.u AS u_{n}", f"mw_{n}.delta AS delta_{n}", f"mw_{n}.p AS mwu_p_{n}", f"wx_{n}.w AS w_{n}", f"wx_{n}.rb AS rbc_{n}", f"wx_{n}.p AS wilcoxon_p_{n}"]
        joins += f" JOIN mw_{n} USING (feature) JOIN wx_{n} USING (feature)"
        doubles += [c.split(" AS ")[1] for c in cols[-6:]]
        ps += [f"mwu_p_{n}", f"wilcoxon_p_{n}"]
    return ", ".join(ctes) + "\n--\n" + _with_fdr(f"SELECT {', '.join(cols)} FROM {joins}", ps), " ".join([*doubles, *[f"{p}_fdr" for p in ps]]), " ".join(["feature", *[p.replace("_p", "", 1) + "_signif" for p in ps]])


@query("test_battery", *_battery_sql())
def test_battery(spark, d):
    return stats.battery(_long(spark, d), CLASSES)


RESPONDER = LONG + """, g AS (SELECT subject, feature, avg(value) FILTER (class <> 'NoPain') m1, avg(value) FILTER (class = 'NoPain') m0, var_samp(value) FILTER (class <> 'NoPain') v1, var_samp(value) FILTER (class = 'NoPain') v0 FROM long GROUP BY ALL HAVING count(*) FILTER (class <> 'NoPain') >= 2 AND count(*) FILTER (class = 'NoPain') >= 2),
dd AS (SELECT subject, feature, (m1 - m0) / CASE WHEN sqrt((v1 + v0) / 2) > 1e-8 THEN sqrt((v1 + v0) / 2) ELSE 1 END AS d FROM g), cs AS (SELECT feature, sign(median(d)) AS c FROM dd GROUP BY feature),
r AS (SELECT subject, avg(abs(d)) AS separability, avg(CASE WHEN sign(d) = c THEN 1e0 ELSE 0e0 END) AS sign_consistency FROM dd JOIN cs USING (feature) GROUP BY subject),
k AS (SELECT *, (rank() OVER (ORDER BY separability) + (count(*) OVER (PARTITION BY separability) - 1) / 2e0) / count(*) OVER () AS sep_rank, (rank() OVER (ORDER BY sign_consistency) + (count(*) OVER (PARTITION BY sign_consistency) - 1) / 2e0) / count(*) OVER () AS sign_rank FROM r)"""


@query("responder_scores", RESPONDER + "\n--\nSELECT *, 0.6 * sep_rank + 0.4 * sign_rank AS responder_score, sep_rank < 0.2 AS low_separability, sign_consistency < 0.5 AS sign_flipper, 0.6 * sep_rank + 0.4 * sign_rank < 0.25 AS non_responder FROM k", "separability sign_consistency sep_rank sign_rank responder_score", "subject low_separability sign_flipper non_responder")
def responder_scores(spark, d):
    return stats.responder_scores(segments(spark, d), FEATURES)


@query("hard_easy_comparison", LONG + """, g AS (SELECT feature AS metric, CASE WHEN subject % 3 = 0 THEN 'hard' ELSE 'easy' END AS side, avg(value) AS v FROM long GROUP BY feature, subject),
c AS (SELECT a.metric, avg(CAST(sign(a.v - b.v) AS DOUBLE)) AS cliffs_delta FROM g a JOIN g b ON a.metric = b.metric AND a.side = 'easy' AND b.side = 'hard' GROUP BY a.metric),
m AS (SELECT metric, avg(v) FILTER (side = 'hard') AS hard_mean, median(v) FILTER (side = 'hard') AS hard_median, avg(v) FILTER (side = 'easy') AS easy_mean, median(v) FILTER (side = 'easy') AS easy_median FROM g GROUP BY metric)
--
SELECT *, easy_mean - hard_mean AS delta_mean FROM m JOIN c USING (metric)""", "hard_mean hard_median easy_mean easy_median delta_mean cliffs_delta", "metric")  # fmt: skip
def hard_easy_comparison(spark, d):
    s = agg.subject_means(segments(spark, d), FEATURES, ("subject",))
    return stats.compare_groups(s, FEATURES, F.col("subject") % 3 != 0, F.col("subject") % 3 == 0)


@query("signal_quality", SEG + "\n--\nSELECT subject, (avg(bvp_value) + avg(eda_k)) / 2 AS bvp_signal_std, avg(resp_minute) AS resp_signal_std, 0e0 AS spo2_signal_std FROM seg GROUP BY subject", "bvp_signal_std resp_signal_std spo2_signal_std", "subject")
def signal_quality(spark, d):
    return stats.signal_quality(segments(spark, d), {"bvp": ["bvp_value", "eda_k"], "resp": ["resp_minute"], "spo2": []})


@query("separability_summary", LONG + """, g AS (SELECT subject, feature, avg(value) FILTER (class = 'NoPain') m1, avg(value) FILTER (class = 'PainArm') m2, var_samp(value) FILTER (class = 'NoPain') v1, var_samp(value) FILTER (class = 'PainArm') v2, count(value) FILTER (class = 'NoPain') n1, count(value) FILTER (class = 'PainArm') n2 FROM long GROUP BY ALL),
c AS (SELECT subject, abs(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS a FROM g WHERE (n1 - 1) * v1 + (n2 - 1) * v2 > 0)
--
SELECT subject, avg(a) AS mean, median(a) AS median, max(a) AS top_mean FROM c WHERE a IS NOT NULL GROUP BY subject""", "mean median top_mean", "subject")  # fmt: skip
def separability_summary(spark, d):
    return stats.separability(stats.cohens_d(segments(spark, d), FEATURES, "NoPain", "PainArm"))


@query("significant_counts", LONG + f""", g AS (SELECT feature, subject, class, count(*) n, avg(value) m, var_pop(value) v FROM long GROUP BY ALL), t AS (SELECT feature, subject, count(*) k, sum(n) nn, sum(n * v) ssw, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) ssb FROM g GROUP BY feature, subject HAVING count(*) = 3 AND sum(n) > 3),
p AS (SELECT feature, ssb / (ssb + ssw) AS eta2, {F2_TAIL.format(f=F_RATIO, d='nn - k')} AS p FROM t WHERE ssw > 0)
--
SELECT feature, count(*) AS n, avg(eta2) AS mean_effect, count(*) FILTER (p < 0.05) AS n_significant FROM p GROUP BY feature""", "mean_effect", "feature n n_significant")  # fmt: skip
def significant_counts(spark, d):
    long = segments(spark, d).unpivot(["subject", "class"], FEATURES, "feature", "value")
    tests = stats.anova(long, ["feature", "subject"]).filter("k = 3 and n > 3 and f is not null")
    return stats.significant_counts(tests, ["feature"], "eta2")


@query("config_summary", SEG + "\n--\nSELECT class, split, count(*) AS n, avg(bvp_value) AS bvp_value_mean, stddev_samp(bvp_value) AS bvp_value_std, sum(resp_minute) AS elapsed FROM seg GROUP BY ALL", "bvp_value_mean bvp_value_std elapsed", "class split n")
def config_summary(spark, d):
    return agg.config_summary(segments(spark, d), ["class", "split"], [V], "resp_minute")


CLIPPED = "c AS (SELECT segment_id, ln(greatest(1e-6, least(1 - 1e-6, proba))) AS a, ln(greatest(1e-6, least(1 - 1e-6, 1 - proba))) AS r, ln(greatest(1e-6, least(1 - 1e-6, p1))) AS b, ln(greatest(1e-6, least(1 - 1e-6, 1 - p1))) AS e, y * 0.4 + 0.3 AS conf FROM p)"


@query("gated_scores", PRED + ", " + CLIPPED + "\n--\nSELECT segment_id, 0.8 * a AS s0, 1.2 * r + 1.4 * (0.5 + conf) * b AS s1, 1.2 * r + 1.4 * (0.5 + conf) * e AS s2 FROM c", "s0 s1 s2", "segment_id")
def gated_scores(spark, d):
    p = _pred(spark, d).withColumn("conf", F.col("y") * 0.4 + 0.3)
    return decode.gated_scores(p, "proba", "p1", "conf", (0.8, 1.2, 1.4)).select("segment_id", "s0", "s1", "s2")


@query("auxiliary_scores", PRED + ", " + CLIPPED + "\n--\nSELECT segment_id, a + 0.5 * ln(1 - conf) AS s0, r + b + 0.5 * ln(conf) AS s1, r + e + 0.5 * ln(conf) AS s2 FROM c", "s0 s1 s2", "segment_id")
def auxiliary_scores(spark, d):
    p = _pred(spark, d).withColumn("conf", F.col("y") * 0.4 + 0.3)
    return decode.gated_scores(p, "proba", "p1", "conf", mode="aux").select("segment_id", "s0", "s1", "s2")


def _counts(p):
    return p.groupBy("subject").agg(*[F.count_if(F.col("class") == k).alias(f"n{i}") for i, k in enumerate(CLASSES)])


def _code(cls):
    return F.when(cls == "NoPain", 0).when(cls == "PainArm", 1).otherwise(2)


def _validation(spark, d):
    """The stand-in predictions of the validation split, with class codes."""
    held = segments(spark, d).filter("split = 'validation'").select("segment_id")
    return _pred(spark, d).join(held, "segment_id", "left_semi").withColumn("y", _code(F.col("class")))


@query("direct_three_class")
def direct_three_class(spark, d):
    """A three-class model's probabilities, decoded under each validation subject's class counts: metrics."""
    from .fits import multiclass_ml

    p = multiclass_ml(spark, d).join(segments(spark, d).select("segment_id", "subject", "class"), "segment_id")
    scores = decode.class_scores(p, [f"p_{k}" for k in CLASSES])
    pred = decode.exact_count_decode(scores, ["s0", "s1", "s2"], _counts(p)).select("segment_id", F.col("pred").alias("decoded"))
    return metrics.summary(p.join(pred, "segment_id").withColumn("y", _code(F.col("class"))), "y", "decoded")


@query("cached_decode")
def cached_decode(spark, d):
    """Predictions of two configurations, stored as a table and read back: one of them decoded with given weights, with its metrics."""
    p = _validation(spark, d)
    path = new_path(spark, "predictions")
    p.withColumn("config_id", F.lit("a")).unionByName(p.withColumn("proba", 1 - F.col("proba")).withColumn("config_id", F.lit("b"))).write.partitionBy("config_id").parquet(path)
    return decode.decode_stored(spark.read.parquet(path), "config_id", "a", "proba", "p1", "y", (0.8, 1.2, 1.4))


@query("weight_sweep")
def weight_sweep(spark, d):
    """Metrics of the validation subjects for each triple of stage weights."""
    p = _validation(spark, d)
    grid = [(a, b, c) for a in (0.4, 0.6, 0.8, 1.0, 1.2, 1.4) for b in (0.6, 0.8, 1.0, 1.2, 1.4) for c in (0.6, 0.8, 1.0, 1.2, 1.4, 1.6)]
    return decode.sweep_weights(p, "proba", "p1", "y", grid, _counts(p))


@query("subwindow_vote", SIG + ", w AS (SELECT segment_id, samples[w * 21 + 1 : w * 21 + 21] AS s FROM sig, (SELECT unnest(range(0, 3)) AS w))\n--\nSELECT segment_id, avg(1 / (1 + exp(-list_avg(s)))) AS p FROM w GROUP BY segment_id", "p", "segment_id")
def subwindow_vote(spark, d):
    """Probabilities of sub-windows, averaged over each segment."""
    w = seg.subwindows(signals(spark, d), "samples", 3).select("segment_id", (1 / (1 + F.exp(-seg.mean(F.col("samples"))))).alias("p"))
    return models.average_views([w], "segment_id", "p")


@query("mixture_of_experts")
def mixture_of_experts(spark, d):
    s = segments(spark, d)
    strength = stats.responder_strength(s, FEATURES, "PainArm", "NoPain")
    s = s.join(strength, "subject").withColumn("y", is_pain(F.col("class")))
    return models.experts(s, FEATURES, "y", F.col("split") == "train", "strength", 2)


@query("train_and_score")
def train_and_score(spark, d):
    """A fit on the training split with its calibration, stored, read back, and scoring the validation split."""
    s = normalize.subject_z(segments(spark, d), FEATURES).withColumn("y", is_pain(F.col("class")))
    model = models.fit_model(s.filter("split = 'train'"), FEATURES, "y")
    path = new_path(spark, "model") + ".json"
    models.save_model(spark, path, model, norm="subject_z")
    again, settings = models.load_model(spark, path)
    fresh = normalize.norm_map(segments(spark, d).withColumn("y", is_pain(F.col("class"))), FEATURES)[settings["norm"]]
    return fresh.filter("split = 'validation'").select("segment_id", "y", again.proba().alias("proba"))


@query("norm_map_forms", SEG + f"""\n--\nSELECT segment_id, 'global' AS form, bvp_value FROM seg UNION ALL SELECT segment_id, 'subject_z', coalesce((bvp_value - avg(bvp_value) OVER ({P})) / CASE WHEN stddev_pop(bvp_value) OVER ({P}) > 0 THEN stddev_pop(bvp_value) OVER ({P}) ELSE 1 END, 0) FROM seg
UNION ALL SELECT segment_id, 'subject_robust', coalesce((bvp_value - q[2]) / CASE WHEN q[3] - q[1] > 0 THEN q[3] - q[1] ELSE 1 END, 0) FROM seg JOIN (SELECT subject, quantile_cont(bvp_value, [0.25, 0.5, 0.75]) AS q FROM seg GROUP BY subject) USING (subject)""", V, "segment_id form")  # fmt: skip
def norm_map_forms(spark, d):
    forms = [x.select("segment_id", F.lit(k).alias("form"), V) for k, x in normalize.norm_map(segments(spark, d), [V]).items()]
    return forms[0].unionByName(forms[1]).unionByName(forms[2])


@query("flat_segments", SIG + ", e AS (SELECT segment_id, unnest(list_transform(samples, lambda x: CASE WHEN segment_id % 9 = 0 THEN 0.25e0 ELSE x END)) AS x FROM sig)\n--\nSELECT segment_id FROM e GROUP BY segment_id HAVING max(x) = min(x)", "", "segment_id")
def flat_segments(spark, d):
    s = signals(spark, d).withColumn("samples", F.when(F.col("segment_id") % 9 == 0, F.transform("samples", lambda x: F.lit(0.25))).otherwise(F.col("samples")))
    return s.filter(seg.is_flat(F.col("samples"))).select("segment_id")


@query("last_rows", SEG + "\n--\nSELECT segment_id, bvp_value FROM (SELECT *, row_number() OVER (ORDER BY bvp_value DESC, segment_id DESC) AS r FROM seg) WHERE r <= 20", V, "segment_id")
def last_rows(spark, d):
    """The tail of the rows in the order of value and key, taken from the other end."""
    return segments(spark, d).orderBy(F.desc(V), F.desc("segment_id")).limit(20).select("segment_id", V)


@query("kuiper", LONG + """, x AS (SELECT feature, class, value FROM long WHERE class IN ('NoPain', 'PainArm') AND value IS NOT NULL), c AS (SELECT feature, value, count(*) FILTER (class = 'NoPain') AS a, count(*) FILTER (class = 'PainArm') AS b FROM x GROUP BY ALL),
s AS (SELECT feature, sum(a) OVER w / sum(a) OVER (PARTITION BY feature) - sum(b) OVER w / sum(b) OVER (PARTITION BY feature) AS d FROM c WINDOW w AS (PARTITION BY feature ORDER BY value))
--
SELECT feature, greatest(max(d), 0) + greatest(max(-d), 0) AS v FROM s GROUP BY feature""", "v", "feature")  # fmt: skip
def kuiper(spark, d):
    long = segments(spark, d).unpivot(["subject", "class"], FEATURES, "feature", "value")
    return stats.kuiper(long, "NoPain", "PainArm")


@query("mutual_information", SEG + """, r AS (SELECT min(bvp_value) AS lx, max(bvp_value) AS hx, min(eda_k) AS ly, max(eda_k) AS hy FROM seg), b AS (SELECT least(CAST(floor((bvp_value - lx) / (hx - lx) * 16) AS INT), 15) AS i, least(CAST(floor((eda_k - ly) / (hy - ly) * 16) AS INT), 15) AS j FROM seg, r WHERE bvp_value IS NOT NULL AND eda_k IS NOT NULL),
c AS (SELECT i, j, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM b GROUP BY i, j), m AS (SELECT p, sum(p) OVER (PARTITION BY i) AS pi, sum(p) OVER (PARTITION BY j) AS pj FROM c)
--
SELECT sum(p * ln(p / (pi * pj))) AS mi FROM m""", "mi")  # fmt: skip
def mutual_information(spark, d):
    return stats.mutual_information(segments(spark, d), V, "eda_k")


@query("lagged_correlation", SIG + """, l AS (SELECT segment_id, samples, CAST(unnest(range(-3, 4)) AS INTEGER) AS lag FROM sig), e AS (SELECT segment_id, lag, unnest(list_transform(range(greatest(1, 1 - lag), least(32, 32 - lag) + 1), lambda t: [samples[t], samples[32 + t + lag]])) AS xy FROM l)
--
SELECT segment_id, lag, corr(xy[1], xy[2]) AS r FROM e GROUP BY ALL""", "r", "segment_id lag")  # fmt: skip
def lagged_correlation(spark, d):
    """The two halves of each signal against each other."""
    s = _halves(spark, d)
    out = s.select("segment_id", seg.map_pair(F.col("x"), F.col("y"), lambda x, y: sg.lagged_correlation(x, y, 3)).alias("r"))
    return out.select("segment_id", F.posexplode("r").alias("k", "r")).select("segment_id", (F.col("k") - 3).alias("lag"), "r")


def _halves(spark, d):
    return signals(spark, d).select("segment_id", F.slice("samples", 1, 32).alias("x"), F.slice("samples", 33, 32).alias("y"))


@query("distance_correlation", SIG + """, i AS (SELECT unnest(range(1, 33)) AS i), dd AS (SELECT segment_id, a.i, b.i AS j, abs(samples[a.i] - samples[b.i]) AS x, abs(samples[32 + a.i] - samples[32 + b.i]) AS y FROM sig, i a, i b),
c AS (SELECT segment_id, x - avg(x) OVER r - avg(x) OVER k + avg(x) OVER s AS x, y - avg(y) OVER r - avg(y) OVER k + avg(y) OVER s AS y FROM dd WINDOW r AS (PARTITION BY segment_id, i), k AS (PARTITION BY segment_id, j), s AS (PARTITION BY segment_id))
--
SELECT segment_id, sqrt(greatest(avg(x * y), 0) / sqrt(avg(x * x) * avg(y * y))) AS r FROM c GROUP BY segment_id""", "r", "segment_id")  # fmt: skip
def distance_correlation(spark, d):
    s = _halves(spark, d)
    return s.select("segment_id", F.get(seg.map_pair(F.col("x"), F.col("y"), lambda x, y: np.array([sg.distance_correlation(x, y)])), F.lit(0)).alias("r"))


@query("beat_templates")
def beat_templates(spark, d):
    """Mean shape of the band-passed pulse about the beats of each recording, a quarter of a second before to half a second after."""

    def template(x: np.ndarray) -> np.ndarray:
        y = fx.pulse_band(x[None], RATE)
        return sg.beat_template(y[0], fx.beats(y, RATE)[0], 25, 50)

    s = recordings(spark, d).select("recording_id", seg.map_array(F.col("samples"), template).alias("t"))
    return s.select("recording_id", F.posexplode("t").alias("k", "x")).filter(~F.isnan("x"))


@query("sympathetic_envelope")
def sympathetic_envelope(spark, d):
    """Paired Wilcoxon tests over the segments' mean envelope of the sympathetic band, and the phasic part's deviation."""
    s = signals(spark, d).withColumn("subject", F.col("segment_id") % 25)
    s = s.withColumns({"e": seg.map_array(F.col("samples"), lambda x: sg.tvsymp(x, 2.0)), "f": seg.map_array(F.col("samples"), lambda x: sg.phasic(x, 2.0))})
    s = s.withColumns({"tvsymp": seg.mean(F.col("e")), "phasic": F.sqrt(seg.var_pop(F.col("f")))})
    labels = [r[0] for r in s.select("class").distinct().orderBy("class").limit(2).collect()]
    means = agg.subject_means(s, ["tvsymp", "phasic"]).unpivot(["subject", "class"], ["tvsymp", "phasic"], "feature", "value")
    return stats.wilcoxon(stats.paired_by_feature(means, *labels))


@query("top_variance_columns", SEG + ", v AS (SELECT 'bvp_value' AS feature, var_samp(bvp_value) AS v FROM seg UNION ALL SELECT 'eda_k', var_samp(eda_k) FROM seg UNION ALL SELECT 'resp_minute', var_samp(resp_minute) FROM seg)\n--\nSELECT feature FROM (SELECT feature, row_number() OVER (ORDER BY v DESC, feature) AS r FROM v) WHERE r <= 2", "", "feature")
def top_variance_columns(spark, d):
    names = agg.top_variance(segments(spark, d), FEATURES, 2)
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query("subject_sample")
def subject_sample(spark, d):
    """Rows of a seeded sample of the training subjects."""
    return relational.seeded_subset(segments(spark, d), "subject", 10, 42).select("segment_id", "subject")


@query("ranked_sets")
def ranked_sets(spark, d):
    """The feature sets that rankings give: the best by effect, by ANOVA and by consistency."""
    s = segments(spark, d)
    found = {"effect_top2": select.names_of(select.rank_binary(s, FEATURES, "PainArm", "PainHand"), 2), "anova_top2": select.names_of(select.rank_multiclass(s, FEATURES), 2), "consistent_top2": select.names_of(select.rank_consistent(s, FEATURES, "PainArm", "PainHand"), 2)}
    return spark.createDataFrame([(k, i, n) for k, ns in found.items() for i, n in enumerate(ns)], "pool string, place int, feature string")


@query("resumed_sweep", PRED + """, g AS (SELECT a AS alpha, k FROM (SELECT unnest([0.25e0, 0.5e0, 0.75e0]) AS a), (SELECT unnest([6, 12]) AS k)),
r AS (SELECT alpha, k, y, row_number() OVER (PARTITION BY alpha, k, subject ORDER BY alpha * proba + (1 - alpha) * p1 DESC, segment_id) AS place FROM p, g)
--
SELECT alpha, CAST(k AS INTEGER) AS k, avg(CASE WHEN (place <= k) = (y = 1) THEN 1e0 ELSE 0e0 END) AS accuracy, count(*) AS n FROM r GROUP BY alpha, k""", "alpha accuracy", "k n")  # fmt: skip
def resumed_sweep(spark, d):
    """Blend, then exact counts, over six configurations: a sweep that stopped after three, taken up by another."""
    p = _pred(spark, d)
    blend = sweep.Stage("blend", ("alpha",), lambda c, _: p.select("segment_id", "subject", "y", (c["alpha"] * F.col("proba") + (1 - c["alpha"]) * F.col("p1")).alias("p")))
    decoded = sweep.Stage("decode", ("k",), lambda c, before: metrics.summary(agg.exact_top(before[0], "subject", "p", "segment_id", c["k"]), "y", "pred").select("accuracy", "n"))
    configs, root = sweep.grid(alpha=[0.25, 0.5, 0.75], k=[6, 12]), new_path(spark, "sweep")
    sweep.Sweep(spark, root, [blend, decoded]).run(configs[:3])
    return sweep.Sweep(spark, root, [blend, decoded]).run(configs).select("alpha", "k", "accuracy", "n")
