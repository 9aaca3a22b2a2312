"""Queries over scans, expressions, joins, aggregates, reshaping and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import columns as c
from tidewell.operators import aggregate as agg
from tidewell.operators import inventory as inv
from tidewell.operators import metrics, normalize
from tidewell.operators import relational as rel

from .registry import FEATURES, SEG, SIG, query, segments, signals, table

X3 = " ".join(FEATURES)


@query("minimum_slice", SEG + """, z AS (SELECT *, (bvp_value - avg(bvp_value) OVER (PARTITION BY subject)) / CASE WHEN stddev_pop(bvp_value) OVER (PARTITION BY subject) > 0 THEN stddev_pop(bvp_value) OVER (PARTITION BY subject) ELSE 1 END AS zv FROM seg),
p AS (SELECT CASE WHEN class = 'NoPain' THEN 0 ELSE 1 END AS y, CASE WHEN row_number() OVER (PARTITION BY subject ORDER BY zv DESC, segment_id) <= 12 THEN 1 ELSE 0 END AS pred FROM z),
k AS (SELECT unnest([0, 1]) AS cls), f AS (SELECT cls, (SELECT count(*) FROM p WHERE y = cls AND pred = cls) AS tp, (SELECT count(*) FROM p WHERE y = cls) AS sup, (SELECT count(*) FROM p WHERE pred = cls) AS pr FROM k)
--
SELECT (SELECT avg(CASE WHEN y = pred THEN 1e0 ELSE 0e0 END) FROM p) AS accuracy, avg(tp / sup) AS balanced_accuracy, avg(2e0 * tp / (pr + sup)) AS macro_f1, CAST(sum(sup) AS BIGINT) AS n FROM f""", "accuracy balanced_accuracy macro_f1", "n")  # fmt: skip
def minimum_slice(spark, d):
    z = normalize.subject_z(segments(spark, d), ["bvp_value"])
    z = agg.exact_top(z, "subject", "bvp_value", "segment_id", 12).withColumn("y", c.is_pain(F.col("class")))
    return metrics.summary(z, "y", "pred")


@query("scan_filter_project", SEG + "\n--\nSELECT segment_id, bvp_value FROM seg WHERE split = 'train' AND class IN ('PainArm', 'PainHand') AND subject NOT IN (1, 2, 3) AND bvp_value BETWEEN 50 AND 250", "bvp_value", "segment_id")
def scan_filter_project(spark, d):
    s = segments(spark, d)
    return s.filter((F.col("split") == "train") & F.col("class").isin("PainArm", "PainHand") & ~F.col("subject").isin(1, 2, 3) & F.col("bvp_value").between(50, 250)).select("segment_id", "bvp_value")


@query("key_build_and_parse", SEG + """, k AS (SELECT segment_id, subject || '_' || CASE class WHEN 'NoPain' THEN 'Baseline' WHEN 'PainArm' THEN 'ARM' ELSE 'HAND' END || '_' || segment_id AS key, class, subject FROM seg)
--
SELECT segment_id, key, CAST(split_part(key, '_', 1) AS INTEGER) AS subject_no, class AS parsed, CAST(split_part(key, '_', 3) AS INTEGER) AS idx, subject || '_' || class || '_' || segment_id AS id2, class AS class2 FROM k""", "", "segment_id key subject_no parsed idx id2 class2")  # fmt: skip
def key_build_and_parse(spark, d):
    tag = c.map_value(F.col("class"), {"NoPain": "Baseline", "PainArm": "ARM", "PainHand": "HAND"})
    k = segments(spark, d).withColumn("key", c.segment_key(F.col("subject"), tag, F.col("segment_id")))
    p = c.parse_key(F.col("key"))
    k = k.select("segment_id", "key", p["subject"].alias("subject_no"), p["class"].alias("parsed"), p["segment_idx"].alias("idx"))
    k = k.withColumn("id2", c.segment_key(F.col("subject_no"), F.col("parsed"), F.col("idx")))
    return k.withColumn("class2", c.class_of_key(F.col("id2")))


@query("scalar_math", SEG + """
--
SELECT segment_id, ln(bvp_value) AS l, ln(1 + bvp_value) AS l1, log10(bvp_value) AS l10, exp(-bvp_value / 100) AS e, sqrt(bvp_value) AS s, abs(bvp_value - 200) AS a, CAST(sign(bvp_value - 200) AS DOUBLE) AS g,
greatest(50, least(150, bvp_value)) AS cl, 1 / (1 + exp(-(bvp_value - 200) / 100)) AS sg, CASE WHEN eda_k <> 0 THEN bvp_value / eda_k ELSE 0 END AS q FROM seg""", "l l1 l10 e s a g cl sg q", "segment_id")  # fmt: skip
def scalar_math(spark, d):
    v = F.col("bvp_value")
    return segments(spark, d).select(
        "segment_id", c.ieee_log(v).alias("l"), c.ieee_log(v + 1).alias("l1"), c.ieee_log(v, 10).alias("l10"), F.exp(-v / 100).alias("e"), F.sqrt(v).alias("s"), F.abs(v - 200).alias("a"), F.when(F.isnan(v), 0.0).otherwise(F.signum(v - 200)).alias("g"),
        c.clip(v, 50.0, 150.0).alias("cl"), c.sigmoid((v - 200) / 100).alias("sg"), c.ratio(v, F.col("eda_k"), 0.0).alias("q"),
    )


#: Names of feature columns as the events give them: a family, a signal in some spelling, and an event type.
NAMES = """n AS (SELECT DISTINCT ['physio_', 'raw_', 'tf_', ''][user_id % 4 + 1] || ['BVP', 'eda', 'Resp', 'SpO2', 'BVP_RESP', 'age'][event_id % 6 + 1] || '_' || event_type AS name FROM events)"""


def _names(spark, d):
    pick = lambda options, k: F.get(F.array(*[F.lit(x) for x in options]), k.cast("int"))
    family, signal = pick(("physio_", "raw_", "tf_", ""), F.col("user_id") % 4), pick(("BVP", "eda", "Resp", "SpO2", "BVP_RESP", "age"), F.col("event_id") % 6)
    return table(spark, d, "events").select(F.concat(family, signal, F.lit("_"), "event_type").alias("name")).distinct()


@query("modality_and_family", NAMES + """, m AS (SELECT name, list_filter(['bvp', 'eda', 'resp', 'spo2'], lambda k: contains(lower(name), k)) AS hits FROM n)
--
SELECT name, CASE len(hits) WHEN 0 THEN 'other' WHEN 1 THEN hits[1] ELSE 'cross' END AS modality, CASE WHEN regexp_matches(name, '^(physio|raw|tf)_') THEN regexp_extract(name, '^(physio|raw|tf)_', 1) ELSE 'other' END AS family FROM m""", "", "name modality family")  # fmt: skip
def modality_and_family(spark, d):
    n = _names(spark, d)
    return n.select("name", c.modality_column(F.col("name")).alias("modality"), c.family_column(F.col("name")).alias("family"))


@query("canonical_names", NAMES + """
--
SELECT name, canonical FROM (SELECT name, regexp_replace(name, '^raw_', '') AS canonical, row_number() OVER (PARTITION BY regexp_replace(name, '^raw_', '') ORDER BY starts_with(name, 'raw_'), name) AS rn FROM n) WHERE rn = 1""", "", "name canonical")  # fmt: skip
def canonical_names(spark, d):
    return rel.unique_names(_names(spark, d), "name")


@query("impute_and_prune", SEG + """, g AS (SELECT segment_id, CASE WHEN segment_id % 20 = 0 THEN NULL ELSE bvp_value END AS bvp_value, CASE WHEN segment_id % 3 = 0 THEN NULL ELSE eda_k END AS eda_k, split FROM seg), m AS (SELECT median(bvp_value) FILTER (split = 'train') AS mb FROM g)
--
SELECT segment_id, coalesce(bvp_value, mb) AS bvp_value FROM g, m""", "bvp_value", "segment_id")  # fmt: skip
def impute_and_prune(spark, d):
    """eda_k is dropped for its gaps, a constant for its variance."""
    s = segments(spark, d).select("segment_id", F.when(F.col("segment_id") % 20 != 0, F.col("bvp_value")).alias("bvp_value"), F.when(F.col("segment_id") % 3 != 0, F.col("eda_k")).alias("eda_k"), "split", F.lit(4.0).alias("flat"))
    return rel.clean(s, ["bvp_value", "eda_k", "flat"], F.col("split") == "train").drop("split")


@query("feature_join", SEG + "\n--\nSELECT a.segment_id, a.bvp_value, b.bvp_value * 2 AS raw_bvp_value, b.eda_k FROM seg a JOIN seg b USING (segment_id) WHERE a.split = 'train'", "bvp_value raw_bvp_value eda_k", "segment_id")
def feature_join(spark, d):
    s = segments(spark, d)
    left = s.filter("split = 'train'").select("segment_id", "bvp_value")
    return rel.join_features([left, s.select("segment_id", (F.col("bvp_value") * 2).alias("BVP_value"), "eda_k")], ["physio", "raw"]).withColumnRenamed("raw_BVP_value", "raw_bvp_value")


@query("left_join_default", SEG + "\n--\nSELECT a.segment_id, coalesce(b.bvp_value, 0.5) AS bvp_value FROM seg a LEFT JOIN (SELECT * FROM seg WHERE class = 'PainArm') b USING (segment_id)", "bvp_value", "segment_id")
def left_join_default(spark, d):
    s = segments(spark, d)
    return rel.align(s.select("segment_id"), s.filter("class = 'PainArm'"), "segment_id", ["bvp_value"], 0.5)


@query("strict_align", SEG + "\n--\nSELECT segment_id, bvp_value FROM seg WHERE split = 'validation'", "bvp_value", "segment_id")
def strict_align(spark, d):
    s = segments(spark, d)
    return rel.align(s.filter("split = 'validation'").select("segment_id"), s, "segment_id", ["bvp_value"], strict=True)


@query("paired_classes", SEG + "\n--\nSELECT subject, avg(bvp_value) FILTER (class = 'PainArm') AS a, avg(bvp_value) FILTER (class = 'PainHand') AS b FROM seg GROUP BY subject HAVING count(*) FILTER (class = 'PainArm') > 0 AND count(*) FILTER (class = 'PainHand') > 0", "a b", "subject")
def paired_classes(spark, d):
    return rel.paired(segments(spark, d), "subject", "class", "bvp_value", "PainArm", "PainHand")


@query("multi_key_join", SEG + """, a AS (SELECT subject, split, avg(bvp_value) AS m FROM seg GROUP BY ALL), b AS (SELECT subject, split, count(*) AS n FROM seg WHERE class = 'NoPain' GROUP BY ALL), e AS (SELECT subject, split, max(eda_k) AS k FROM seg GROUP BY ALL)
--
SELECT subject, split, m, n, k FROM a JOIN b USING (subject, split) JOIN e USING (subject, split)""", "m k", "subject split n")  # fmt: skip
def multi_key_join(spark, d):
    s = segments(spark, d)
    a, b, e = s.groupBy("subject", "split").agg(F.avg("bvp_value").alias("m")), s.filter("class = 'NoPain'").groupBy("subject", "split").agg(F.count(F.lit(1)).alias("n")), s.groupBy("subject", "split").agg(F.max("eda_k").alias("k"))
    return a.join(b, ["subject", "split"]).join(e, ["subject", "split"])


@query("semi_anti_join", SEG + ", ids AS (SELECT DISTINCT subject FROM seg WHERE bvp_value > 480)\n--\nSELECT subject, 'in' AS side, count(*) AS n FROM seg WHERE subject IN (SELECT subject FROM ids) GROUP BY subject UNION ALL SELECT subject, 'out', count(*) FROM seg WHERE subject NOT IN (SELECT subject FROM ids) GROUP BY subject", "", "subject side n")
def semi_anti_join(spark, d):
    s = segments(spark, d)
    ids = s.filter("bvp_value > 480").select("subject").distinct()
    count = lambda how, side: s.join(ids, "subject", how).groupBy("subject").agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"))
    return count("left_semi", "in").unionByName(count("left_anti", "out"))


@query("upsert", SEG + "\n--\nSELECT segment_id, CASE WHEN split = 'validation' THEN -bvp_value ELSE bvp_value END AS v FROM seg", "v", "segment_id")
def upsert(spark, d):
    s = segments(spark, d)
    return rel.upsert(s.select("segment_id", F.col("bvp_value").alias("v")), s.filter("split = 'validation'").select("segment_id", (-F.col("bvp_value")).alias("v")), ["segment_id"])


@query("group_mean_std_sem", SEG + "\n--\nSELECT class, avg(bvp_value) AS bvp_value_mean, stddev_samp(bvp_value) AS bvp_value_std, count(bvp_value) AS bvp_value_n, stddev_samp(bvp_value) / sqrt(count(bvp_value)) AS bvp_value_sem FROM seg GROUP BY class", "bvp_value_mean bvp_value_std bvp_value_sem", "class bvp_value_n")
def group_mean_std_sem(spark, d):
    return agg.class_means(segments(spark, d), ["bvp_value"])


@query("lineitem_channels", """l AS (SELECT l_returnflag AS class, 'quantity' AS feature, l_quantity AS value FROM lineitem UNION ALL SELECT l_returnflag, 'price', l_extendedprice FROM lineitem UNION ALL SELECT l_returnflag, 'discount', l_discount FROM lineitem UNION ALL SELECT l_returnflag, 'tax', l_tax FROM lineitem)
--
SELECT class, feature, avg(value) AS mean, stddev_pop(value) AS std, count(value) AS n FROM l GROUP BY ALL""", "mean std", "class feature n")  # fmt: skip
def lineitem_channels(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("class"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return agg.long_summary(li, ["quantity", "price", "discount", "tax"], ("class",))


@query("subject_class_wide_means", "\n--\nSELECT l_suppkey AS subject, avg(l_quantity) FILTER (l_returnflag = 'A') AS \"A_mean\", avg(l_quantity) FILTER (l_returnflag = 'N') AS \"N_mean\", avg(l_quantity) FILTER (l_returnflag = 'R') AS \"R_mean\" FROM lineitem GROUP BY l_suppkey", "A_mean N_mean R_mean", "subject")
def subject_class_wide_means(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("subject"), "l_returnflag").agg(F.avg("l_quantity").alias("m"))
    return rel.widen(m, ["subject"], "l_returnflag", ["A", "N", "R"], "m", "_mean")


@query("class_counts_zero_fill", SEG + "\n--\nSELECT split, subject, count(*) AS n_segments, count(*) FILTER (class = 'NoPain') AS \"n_NoPain\", count(*) FILTER (class = 'PainArm') AS \"n_PainArm\", count(*) FILTER (class = 'PainHand') AS \"n_PainHand\" FROM seg GROUP BY split, subject", "", 'split subject n_segments "n_NoPain" "n_PainArm" "n_PainHand"')
def class_counts_zero_fill(spark, d):
    return agg.class_counts(segments(spark, d), ["split", "subject"], "class", c.CLASSES)


@query("inventory_lengths", SIG + """, g AS (SELECT class, 40 + segment_id % 25 AS n FROM sig)
--
SELECT class, min(n) AS len_min, median(n) AS len_median, max(n) AS len_max, stddev_pop(n) AS len_std, count(*) FILTER (n < 50) AS n_shorter, count(*) FILTER (n > 50) AS n_longer, count(*) FILTER (n = 50) AS n_equal, count(*) AS n_total FROM g GROUP BY class""", "len_median len_std", "class len_min len_max n_shorter n_longer n_equal n_total")  # fmt: skip
def inventory_lengths(spark, d):
    s = signals(spark, d).withColumn("samples", F.slice("samples", F.lit(1), (40 + F.col("segment_id") % 25).cast("int")))
    out = inv.lengths(s, ["class"], "samples", 50)
    return out.withColumns({k: F.col(k).cast("long") for k in ("len_min", "len_max")})


@query("inventory_gaps", SIG + """, g AS (SELECT class, list_transform(samples, lambda x: CASE WHEN x > 0.25 THEN NULL WHEN x < -0.25 THEN CAST('-inf' AS DOUBLE) ELSE x END) AS s FROM sig), h AS (SELECT class, len(list_filter(s, lambda x: x IS NULL)) AS a, len(list_filter(s[1:10], lambda x: x IS NULL)) AS b, len(list_filter(s, lambda x: isinf(x))) AS c, len(list_filter(s[1:10], lambda x: isinf(x))) AS e FROM g)
--
SELECT class, count(*) FILTER (a > 0) AS with_nan, count(*) FILTER (c > 0) AS with_inf, count(*) FILTER (b > 0) AS with_nan_head, count(*) FILTER (e > 0) AS with_inf_head, CAST(sum(a) AS BIGINT) AS nan_samples, CAST(sum(c) AS BIGINT) AS inf_samples, count(*) AS n_total FROM h GROUP BY class""", "", "class with_nan with_inf with_nan_head with_inf_head nan_samples inf_samples n_total")  # fmt: skip
def inventory_gaps(spark, d):
    s = signals(spark, d).withColumn("samples", F.transform("samples", lambda x: F.when(x < -0.25, float("-inf")).when(x <= 0.25, x)))
    return inv.gaps(s, ["class"], "samples", 10)


@query("inventory_ranges", SIG + ", e AS (SELECT class, unnest(samples) AS x FROM sig)\n--\nSELECT class, min(x) AS min, quantile_cont(x, 0.01) AS p1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.99) AS p99, max(x) AS max, count(x) AS n_finite FROM e GROUP BY class", "min p1 median p99 max", "class n_finite")
def inventory_ranges(spark, d):
    return inv.ranges(signals(spark, d), ["class"], "samples")


@query("inventory_constants", SIG + ", e AS (SELECT segment_id, unnest(list_transform(samples, lambda x: CASE WHEN segment_id % 7 = 0 THEN 1.5e0 ELSE x END)) AS x FROM sig)\n--\nSELECT segment_id, stddev_pop(x) AS std, count(x) AS n FROM e GROUP BY segment_id HAVING count(x) >= 2 AND stddev_pop(x) < 1e-8", "std", "segment_id n")
def inventory_constants(spark, d):
    s = signals(spark, d).withColumn("samples", F.when(F.col("segment_id") % 7 == 0, F.transform("samples", lambda x: F.lit(1.5))).otherwise(F.col("samples")))
    return inv.constants(s, "segment_id", "samples")


@query("inventory_duplicates", "g AS (SELECT doc_id, source, count(*) OVER (PARTITION BY source, text) AS group_size FROM documents)\n--\nSELECT doc_id, source, group_size FROM g WHERE group_size > 1", "", "doc_id source group_size")
def inventory_duplicates(spark, d):
    return inv.duplicates(table(spark, d, "documents"), ["source"], "text").select("doc_id", "source", "group_size")


@query("split_membership", SEG + ", s AS (SELECT subject, CASE WHEN segment_id % 97 = 0 THEN 'train' ELSE split END AS split FROM seg)\n--\nSELECT subject, bool_or(split = 'train') AS in_train, bool_or(split = 'validation') AS in_validation, CAST(count(DISTINCT split) AS INTEGER) AS n_splits FROM s GROUP BY subject", "", "subject in_train in_validation n_splits")
def split_membership(spark, d):
    """With some segments of validation subjects in the training split, as an inventory should find."""
    return inv.split_membership(segments(spark, d).withColumn("split", F.when(F.col("segment_id") % 97 == 0, "train").otherwise(F.col("split"))))


@query("describe_by_class", SEG + "\n--\nSELECT class, count(bvp_value) AS count, avg(bvp_value) AS mean, stddev_samp(bvp_value) AS std, min(bvp_value) AS min, max(bvp_value) AS max, quantile_cont(bvp_value, 0.25) AS p25, quantile_cont(bvp_value, 0.5) AS p50, quantile_cont(bvp_value, 0.75) AS p75 FROM seg GROUP BY class", "mean std min max p25 p50 p75", "class count")
def describe_by_class(spark, d):
    return agg.describe(segments(spark, d), "bvp_value", ["class"])


@query("score_spread", SEG + "\n--\nSELECT subject, avg(bvp_value) AS mean, stddev_pop(bvp_value) AS std, min(bvp_value) AS min, median(bvp_value) AS median, max(bvp_value) AS max, count(*) FILTER (bvp_value < 100) AS n_low FROM seg GROUP BY subject", "mean std min median max", "subject n_low")
def score_spread(spark, d):
    return agg.spread_of_scores(segments(spark, d), "bvp_value", ["subject"], 100)


@query("distinct_and_value_counts", SEG + "\n--\nSELECT class, count(*) AS n, count(DISTINCT subject) AS subjects, count(DISTINCT eda_k) AS ks FROM seg GROUP BY class", "", "class n subjects ks")
def distinct_and_value_counts(spark, d):
    return segments(spark, d).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("subject").alias("subjects"), F.countDistinct("eda_k").alias("ks"))


@query("first_values", SEG + "\n--\nSELECT subject, arg_min(class, segment_id) AS first_class, arg_min(bvp_value, segment_id) AS first_value FROM seg GROUP BY subject", "first_value", "subject first_class")
def first_values(spark, d):
    return segments(spark, d).groupBy("subject").agg(F.min_by("class", "segment_id").alias("first_class"), F.min_by("bvp_value", "segment_id").alias("first_value"))


@query("correlation_matrix", SEG + "\n--\nSELECT 'bvp_value' AS a, 'eda_k' AS b, corr(bvp_value, eda_k) AS r FROM seg UNION ALL SELECT 'bvp_value', 'resp_minute', corr(bvp_value, resp_minute) FROM seg UNION ALL SELECT 'eda_k', 'resp_minute', corr(eda_k, resp_minute) FROM seg", "r", "a b")
def correlation_matrix(spark, d):
    return agg.correlations(segments(spark, d), FEATURES)


@query("target_correlation", SEG + "\n--\nSELECT 'bvp_value' AS feature, corr(bvp_value, CASE WHEN class = 'NoPain' THEN 0 ELSE 1 END) AS r, count(*) AS n FROM seg UNION ALL SELECT 'eda_k', corr(eda_k, CASE WHEN class = 'NoPain' THEN 0 ELSE 1 END), count(*) FROM seg", "r", "feature n")
def target_correlation(spark, d):
    return agg.target_correlations(segments(spark, d).withColumn("y", c.is_pain(F.col("class"))), ["bvp_value", "eda_k"], "y")


@query("top_k_per_group", SEG + "\n--\nSELECT class, segment_id, bvp_value, rank FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY bvp_value DESC, segment_id) AS rank FROM seg) WHERE rank <= 10", "bvp_value", "class segment_id rank")
def top_k_per_group(spark, d):
    return agg.top_k(segments(spark, d), ["class"], [F.desc("bvp_value"), F.col("segment_id")], 10).select("class", "segment_id", "bvp_value", "rank")


@query("sort_and_head", SEG + "\n--\nSELECT segment_id, bvp_value FROM seg ORDER BY bvp_value DESC NULLS LAST, segment_id LIMIT 25", "bvp_value", "segment_id")
def sort_and_head(spark, d):
    return segments(spark, d).orderBy(F.desc_nulls_last("bvp_value"), "segment_id").limit(25).select("segment_id", "bvp_value")


@query("arg_max_row", SEG + "\n--\nSELECT subject, segment_id AS best FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY bvp_value DESC, segment_id) AS r FROM seg) WHERE r = 1", "", "subject best")
def arg_max_row(spark, d):
    """The row of the greatest value; of equal ones that of the least key."""
    return segments(spark, d).groupBy("subject").agg(F.max_by("segment_id", F.struct("bvp_value", -F.col("segment_id"))).alias("best"))


@query("exact_top_12", SEG + "\n--\nSELECT segment_id, CASE WHEN row_number() OVER (PARTITION BY subject ORDER BY bvp_value DESC, segment_id) <= 12 THEN 1 ELSE 0 END AS pred FROM seg", "", "segment_id pred")
def exact_top_12(spark, d):
    return agg.exact_top(segments(spark, d), "subject", "bvp_value", "segment_id", 12).select("segment_id", "pred")


@query("class_argmax", SEG + "\n--\nSELECT segment_id, CASE WHEN bvp_value >= eda_k AND bvp_value >= resp_minute THEN 'bvp_value' WHEN eda_k >= resp_minute THEN 'eda_k' ELSE 'resp_minute' END AS best FROM seg", "", "segment_id best")
def class_argmax(spark, d):
    return segments(spark, d).select("segment_id", agg.argmax(FEATURES).alias("best"))


@query("direction_tags", SEG + """, m AS (SELECT subject, coalesce(avg(bvp_value) FILTER (class = 'NoPain'), 0) AS a, coalesce(avg(bvp_value) FILTER (class = 'PainArm'), 0) AS b FROM seg GROUP BY subject)
--
SELECT subject, CASE WHEN a >= b THEN 'NoPain > PainArm' ELSE 'PainArm > NoPain' END AS tag FROM m""", "", "subject tag")  # fmt: skip
def direction_tags(spark, d):
    m = segments(spark, d).groupBy("subject").agg(*[F.coalesce(F.avg(F.when(F.col("class") == k, F.col("bvp_value"))), F.lit(0.0)).alias(k) for k in ("NoPain", "PainArm")])
    return m.select("subject", c.direction_tag([("NoPain", F.col("NoPain")), ("PainArm", F.col("PainArm"))]).alias("tag"))


@query("union_and_sets", SEG + """, a AS (SELECT DISTINCT subject FROM seg WHERE bvp_value > 470), b AS (SELECT DISTINCT subject FROM seg WHERE eda_k > 95)
--
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'all', count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""", "", "op n")  # fmt: skip
def union_and_sets(spark, d):
    s = segments(spark, d)
    a, b = s.filter("bvp_value > 470").select("subject").distinct(), s.filter("eda_k > 95").select("subject").distinct()
    count = lambda df, op: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return count(a.union(b).distinct(), "union").union(count(a.intersect(b), "intersect")).union(count(a.subtract(b), "except")).union(count(a.union(b), "all"))


@query("pivot_means", SEG + "\n--\nSELECT subject, avg(bvp_value) FILTER (class = 'NoPain') AS \"NoPain\", avg(bvp_value) FILTER (class = 'PainArm') AS \"PainArm\", avg(bvp_value) FILTER (class = 'PainHand') AS \"PainHand\" FROM seg GROUP BY subject", "NoPain PainArm PainHand", "subject")
def pivot_means(spark, d):
    return segments(spark, d).groupBy("subject").pivot("class", list(c.CLASSES)).agg(F.avg("bvp_value"))


@query("melt_long", SEG + "\n--\nSELECT segment_id, 'bvp_value' AS feature, bvp_value AS value FROM seg UNION ALL SELECT segment_id, 'eda_k', eda_k FROM seg", "value", "segment_id feature")
def melt_long(spark, d):
    return rel.melt(segments(spark, d), ["segment_id"], ["bvp_value", "eda_k"])


@query("crosstab_grid", SEG + """, g AS (SELECT unnest(['NoPain', 'PainArm', 'PainHand', 'Other']) AS class)
--
SELECT g.class, count(seg.segment_id) FILTER (split = 'train') AS train, count(seg.segment_id) FILTER (split = 'validation') AS validation, count(seg.segment_id) FILTER (split = 'test') AS test FROM g LEFT JOIN seg ON g.class = seg.class GROUP BY g.class""", "", "class train validation test")  # fmt: skip
def crosstab_grid(spark, d):
    return rel.crosstab(segments(spark, d), "class", "split", ["NoPain", "PainArm", "PainHand", "Other"], ["train", "validation", "test"])


@query("grid_and_resume", "g AS (SELECT DISTINCT user_id % 5 AS w0, event_type AS w1 FROM events), e AS (SELECT user_id % 5 AS w0, event_type AS w1 FROM events WHERE value > 250)\n--\nSELECT w0, w1 FROM g WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.w0 = g.w0 AND e.w1 = g.w1)", "", "w0 w1")
def grid_and_resume(spark, d):
    """Of the grid of subject groups and event types, what no run has reached yet; a run is an event of a great value."""
    e = table(spark, d, "events").select((F.col("user_id") % 5).alias("w0"), F.col("event_type").alias("w1"), "value")
    kinds = [sorted(r[0] for r in e.select(k).distinct().collect()) for k in ("w0", "w1")]
    return rel.pending(rel.parameter_grid(spark, w0=kinds[0], w1=kinds[1]), e.filter("value > 250"), ["w0", "w1"])
