"""Group-wise tests on long tables (feature, subject, class, value), all features in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import special
from tidewell.functions.columns import ratio, settled
from tidewell.sources.shared import stored

FEATURE = ["feature"]


def ranked_counts(df: DataFrame, by: list[str], value: str, others: list[str] | None = None, ranges: int = 64) -> DataFrame:
    """(by, others, value, n, t, r): counts of distinct values, t rows of the value in all, r their rank from 1, ties sharing their mean rank.

    Rows are counted before they are shuffled. A group's values are cut into ranges by quantiles, which need not be exact: totals run over
    the ranges, then within each, so no task sorts a whole group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, *(others or []), value).agg(F.count(F.lit(1)).alias("n"))
    keys = [*by, "__one"]
    counts = counts.withColumn("__one", F.lit(1))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), 1000).alias("__cuts"))
    rows = counts.join(cuts, keys).withColumn("__b", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    rows = stored(rows, "ranges")  # else both branches below cut anew, and neither the cuts nor values that are means need come out the same
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy(*keys, "__b").agg(F.sum("n").alias("__n")).withColumn("__before", before).drop("__n")
    here = Window.partitionBy(*keys, "__b")
    rows = rows.withColumn("__upto", F.sum("n").over(here.orderBy(value))).withColumn("t", F.sum("n").over(Window.partitionBy(*keys, "__b", value)))
    out = rows.join(starts, [*keys, "__b"]).withColumn("r", F.col("__before") + F.col("__upto") - F.col("t") + (F.col("t") + 1) / 2.0)
    return out.select(*by, *(others or []), value, "n", "t", "r")


def with_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with the mean rank of value as a share of the rows that have one; null for the others."""
    r = ranked_counts(df, [], value).select(F.col(value).alias("__v"), "t", "r")
    n = r.agg(F.sum("t").alias("__n"))
    share = r.crossJoin(F.broadcast(n)).select("__v", (F.col("r") / F.col("__n")).alias(out))  # one row
    return df.join(share, F.col(value) == F.col("__v"), "left").drop("__v")


def _ties() -> Column:
    return F.sum(F.col("n") * (F.col("t").cast("double") * F.col("t") - 1.0))


def anova(long: DataFrame, by: list[str] = FEATURE, cls: str = "class", value: str = "value") -> DataFrame:
    """(by, k, n, f, p, eta2): one-way analysis of variance."""
    groups = long.filter(F.col(value).isNotNull()).groupBy(*by, cls).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    t = groups.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n_all"), F.sum(F.col("n") * F.col("v")).alias("ssw"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q")
    )
    ssb = F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n_all"), F.lit(0.0))
    t = t.withColumn("ssb", ssb).withColumn("f", ratio(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / F.when(F.col("n_all") > F.col("k"), F.col("n_all") - F.col("k"))))
    t = t.withColumn("eta2", ratio(F.col("ssb"), F.col("ssb") + F.col("ssw")))
    return t.select(*by, "k", F.col("n_all").alias("n"), "f", special.f_sf(F.col("f"), F.col("k") - 1, F.col("n_all") - F.col("k")).alias("p"), "eta2")


def _rank_sums(long: DataFrame, by: list[str], cls: str, value: str) -> DataFrame:
    """(by, cls, n, s, ties): rows, rank sum and ties of each class."""
    r = ranked_counts(long, by, value, [cls])
    return r.groupBy(*by, cls).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("r")).alias("s"), _ties().alias("ties"))


def _kruskal(sums: DataFrame, by: list[str]) -> DataFrame:
    t = sums.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.sum("ties").alias("ties"), F.count(F.lit(1)).alias("k"))
    n = F.col("n").cast("double")
    h = 12.0 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    t = t.withColumn("h", ratio(h, 1 - F.col("ties") / F.when(n > 1, n * n * n - n)))
    return t.select(*by, "h", special.chi2_sf(F.col("h"), F.col("k") - 1).alias("p"))


def kruskal(long: DataFrame, by: list[str] = FEATURE, cls: str = "class", value: str = "value") -> DataFrame:
    """(by, h, p) with the correction for ties."""
    return _kruskal(_rank_sums(long, by, cls, value), by)


def levene(long: DataFrame, by: list[str] = FEATURE, cls: str = "class", value: str = "value") -> DataFrame:
    """(by, w, p), centred at the class medians."""
    med = long.groupBy(*by, cls).agg(F.median(value).alias("__med"))
    spread = long.join(med, [*by, cls]).withColumn(value, F.abs(F.col(value) - F.col("__med")))
    return anova(spread, by, cls, value).select(*by, F.col("f").alias("w"), "p")


def _mann_whitney(sums: DataFrame, first: Column, by: list[str]) -> DataFrame:
    of = lambda k, v: F.coalesce(F.sum(F.when(k, F.col(v))), F.lit(0))
    t = sums.groupBy(*by).agg(of(first, "n").alias("n1"), of(~first, "n").alias("n2"), of(first, "s").alias("s"), F.sum("ties").alias("ties")).filter("n1 > 0 and n2 > 0")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    t = t.withColumn("u", F.col("s") - n1 * (n1 + 1) / 2)
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("ties") / (n * F.greatest(n - 1, F.lit(1.0)))))
    z = ratio(F.greatest(F.abs(F.col("u") - n1 * n2 / 2) - 0.5, F.lit(0.0)), sd)
    return t.select(*by, "n1", "n2", "u", (2 * F.col("u") / (n1 * n2) - 1).alias("delta"), F.when((F.least(n1, n2) <= 8) & (F.greatest(n1, n2) <= special.MOST_EXACT) & (F.col("ties") == 0), special.mann_whitney_p(n1, n2, F.col("u"))).otherwise(special.normal_two_sided(z)).alias("p"))


def mann_whitney(long: DataFrame, a: str, b: str, by: list[str] = FEATURE, cls: str = "class", value: str = "value") -> DataFrame:
    """(by, n1, n2, u, delta, p): U of class a, Cliff's delta, and p: exact without ties if a class has at most eight rows, else the tie-corrected normal approximation with continuity correction."""
    return _mann_whitney(_rank_sums(long.filter(F.col(cls).isin(a, b)), by, cls, value), F.col(cls) == a, by)


def cliffs_delta(long: DataFrame, a: str, b: str, by: list[str] = FEATURE, cls: str = "class", value: str = "value") -> DataFrame:
    """(by, delta): by ranks, exact with ties; no pairs are formed."""
    return mann_whitney(long, a, b, by, cls, value).select(*by, "delta")


def wilcoxon(pairs: DataFrame, by: list[str] = FEATURE, a: str = "a", b: str = "b") -> DataFrame:
    """(by, n, w, rank_biserial, p) of paired columns: zero differences dropped; p exact for up to 50 differences without zeros and ties, else the normal approximation with tie correction."""
    d = pairs.select(*by, (F.col(a) - F.col(b)).alias("__d")).filter("__d is not null")
    d = d.withColumns({"__a": F.abs("__d"), "__up": F.col("__d") > 0})
    zeros = d.groupBy(*by).agg(F.count_if(F.col("__d") == 0).alias("zeros"))
    r = ranked_counts(d.filter("__d <> 0"), by, "__a", ["__up"])
    side = lambda c: F.coalesce(F.sum(F.when(c, F.col("n") * F.col("r"))), F.lit(0.0))
    t = r.groupBy(*by).agg(side(F.col("__up")).alias("up"), side(~F.col("__up")).alias("down"), _ties().alias("ties"), F.sum("n").alias("n")).join(zeros, by)
    n = F.col("n").cast("double")
    w = F.least("up", "down")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = ratio(F.abs(w - n * (n + 1) / 4), sd)
    return t.select(*by, "n", w.alias("w"), ((F.col("up") - F.col("down")) / (n * (n + 1) / 2)).alias("rank_biserial"), F.when((F.col("n") <= 50) & (F.col("zeros") == 0) & (F.col("ties") == 0), special.wilcoxon_p(n, w)).otherwise(special.normal_two_sided(z)).alias("p"))


def paired_by_feature(means: DataFrame, a: str, b: str, subject: str = "subject", cls: str = "class", value: str = "value") -> DataFrame:
    of = lambda k: F.avg(F.when(F.col(cls) == k, F.col(value)))
    return means.groupBy("feature", subject).agg(of(a).alias("a"), of(b).alias("b")).filter("a is not null and b is not null")


def kuiper(long: DataFrame, a: str, b: str, by: list[str] = FEATURE, cls: str = "class", value: str = "value") -> DataFrame:
    """(by, v): greatest excess of either class's distribution function over the other, summed; by counts of distinct values."""
    x = long.filter(F.col(cls).isin(a, b) & F.col(value).isNotNull())
    c = x.groupBy(*by, value).agg(F.count_if(F.col(cls) == a).alias("a"), F.count_if(F.col(cls) == b).alias("b"))
    upto, whole = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by)
    share = lambda k: F.sum(k).over(upto) / F.when(F.sum(k).over(whole) > 0, F.sum(k).over(whole))
    d = c.withColumn("d", share("a") - share("b"))
    return d.groupBy(*by).agg((F.greatest(F.max("d"), F.lit(0.0)) + F.greatest(F.max(-F.col("d")), F.lit(0.0))).alias("v"))


def mutual_information(df: DataFrame, x: str, y: str, bins: int = 16) -> DataFrame:
    """(mi): of the two-dimensional histogram over both ranges, in nats. The histogram has bins * bins cells at most."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null")
    ends = rows.agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))])
    cell = lambda c: F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")).otherwise(1.0) * bins), F.lit(bins - 1))
    cells = rows.crossJoin(F.broadcast(ends)).groupBy(cell("x").alias("i"), cell("y").alias("j")).agg(F.count(F.lit(1)).alias("n"))  # ends: one row
    everything = Window.partitionBy()
    cells = cells.withColumn("p", F.col("n") / F.sum("n").over(everything))
    outer = F.sum("p").over(Window.partitionBy("i")) * F.sum("p").over(Window.partitionBy("j"))
    return cells.withColumn("t", F.col("p") * F.log(F.col("p") / outer)).agg(F.sum("t").alias("mi"))


def fdr(df: DataFrame, p: str = "p", out: str = "q", by: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg: the running minimum from the greatest p of p * m / rank, at most 1; null p stay null."""
    part = [*(by or []), F.col(p).isNotNull()]
    w = Window.partitionBy(*part)
    rank = F.row_number().over(w.orderBy(p, *[c for c in ("feature",) if c in df.columns]))
    raw = df.withColumn("__m", F.count(p).over(w)).withColumn("__r", rank)
    raw = raw.withColumn("__v", F.col(p) * F.col("__m") / F.col("__r"))
    back = w.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("__v").over(back)))).drop("__m", "__r", "__v")


def with_fdr(df: DataFrame, columns: list[str], alpha: float = 0.05) -> DataFrame:
    """df with <p>_fdr and <test>_signif for each column of p values <test>_p...; one row a feature, so one task holds all."""
    for p in columns:
        df = fdr(df, p, f"{p}_fdr").withColumn(p.replace("_p", "", 1) + "_signif", F.coalesce(F.col(f"{p}_fdr") <= alpha, F.lit(False)))
    return df


def battery(means: DataFrame, classes: tuple[str, str, str]) -> DataFrame:
    """One row a feature: ANOVA, Kruskal-Wallis, Levene, three Mann-Whitney and three Wilcoxon tests on subject means, with FDR of all but Levene's.

    Tests of a kind are one table keyed by what is compared, so all rank tests over classes take one ranking, all paired ones another, and all p values one FDR pass.
    """
    pairs = [(f"{x}_{y}", x, y) for x, y in ((classes[0], classes[1]), (classes[0], classes[2]), (classes[1], classes[2]))]
    key = ["what", "feature"]
    rows = means.filter(F.col("value").isNotNull()).select("feature", "subject", "class", F.col("value").cast("double").alias("value"))

    groups = F.filter(F.array(F.lit("all"), *[F.when(F.col("class").isin(x, y), F.lit(name)) for name, x, y in pairs]), lambda g: g.isNotNull())
    sums = _rank_sums(rows.select(F.explode(groups).alias("what"), "feature", "class", "value"), key, "class", "value")
    first = F.element_at(F.create_map(*[F.lit(v) for name, x, _ in pairs for v in (name, x)]), F.col("what")) == F.col("class")
    kw, mw = _kruskal(sums.filter("what = 'all'"), key), _mann_whitney(sums.filter("what <> 'all'"), first, key)

    of = lambda k: F.avg(F.when(F.col("class") == k, F.col("value"))).alias(k)
    wide = rows.groupBy("feature", "subject").agg(*[of(k) for k in classes])
    both = wide.select("feature", F.inline(F.array(*[F.struct(F.lit(name).alias("what"), F.col(x).alias("a"), F.col(y).alias("b")) for name, x, y in pairs])))
    wx = wilcoxon(both.filter("a is not null and b is not null"), key)

    med = rows.groupBy("feature", "class").agg(F.median("value").alias("med"))
    two = rows.join(med, ["feature", "class"]).select("feature", "class", F.inline(F.array(F.struct(F.lit("anova").alias("what"), F.col("value").alias("v")), F.struct(F.lit("levene").alias("what"), F.abs(F.col("value") - F.col("med")).alias("v")))))
    var = anova(two, key, "class", "v")

    row = lambda df, test, one, other: df.select("feature", test.alias("test"), F.col(one).alias("one"), (F.col(other) if other else F.lit(None).cast("double")).alias("other"), "p")
    what = F.col("what")
    found = row(var, what, "f", "eta2").unionByName(row(kw, F.lit("kruskal"), "h", None)).unionByName(row(mw, F.concat(F.lit("mwu_"), what), "u", "delta")).unionByName(row(wx, F.concat(F.lit("wilcoxon_"), what), "w", "rank_biserial"))
    found = fdr(found, "p", "q", ["test"])
    at = lambda test, c, name: F.max(F.when(F.col("test") == test, F.col(c))).alias(name)
    out = [at("anova", "one", "anova_f"), at("anova", "p", "anova_p"), at("anova", "other", "eta2"), at("kruskal", "one", "kruskal_h"), at("kruskal", "p", "kruskal_p"), at("levene", "one", "levene_w"), at("levene", "p", "levene_p")]
    tests = {"anova_p": "anova", "kruskal_p": "kruskal"}
    for name, *_ in pairs:
        out += [at(f"mwu_{name}", "one", f"u_{name}"), at(f"mwu_{name}", "other", f"delta_{name}"), at(f"mwu_{name}", "p", f"mwu_p_{name}")]
        out += [at(f"wilcoxon_{name}", "one", f"w_{name}"), at(f"wilcoxon_{name}", "other", f"rbc_{name}"), at(f"wilcoxon_{name}", "p", f"wilcoxon_p_{name}")]
        tests |= {f"mwu_p_{name}": f"mwu_{name}", f"wilcoxon_p_{name}": f"wilcoxon_{name}"}
    t = found.groupBy("feature").agg(*out, *[at(test, "q", f"{p}_fdr") for p, test in tests.items()])
    return t.withColumns({p.replace("_p", "", 1) + "_signif": F.coalesce(F.col(f"{p}_fdr") <= 0.05, F.lit(False)) for p in tests})


def pain_table(means: DataFrame, rest: str = "NoPain") -> DataFrame:
    """Subject means, the other classes pooled by their mean, against rest: means, ANOVA, paired Wilcoxon, delta, FDR and direction of every feature."""
    other = means.filter(F.col("class") != rest).groupBy("feature", "subject").agg(F.avg("value").alias("value")).withColumn("class", F.lit("Pain"))
    both = other.unionByName(means.filter(F.col("class") == rest).select("feature", "subject", "value", "class"))
    at = lambda k: F.when(F.col("class") == k, F.col("value"))
    out = both.groupBy("feature").agg(F.avg(at("Pain")).alias("mean_pain"), F.avg(at(rest)).alias("mean_rest"), F.least(F.count(at("Pain")), F.count(at(rest))).alias("n_subjects"))
    out = out.join(anova(both).select("feature", F.col("f").alias("anova_f"), F.col("p").alias("anova_p"), "eta2"), "feature", "left")
    paired = wilcoxon(paired_by_feature(both, "Pain", rest)).select("feature", F.col("w").alias("wilcoxon_w"), F.col("p").alias("wilcoxon_p"), F.col("rank_biserial").alias("wilcoxon_rb"))
    out = out.join(paired, "feature", "left").join(cliffs_delta(both, "Pain", rest), "feature", "left")
    return with_fdr(out, ["anova_p", "wilcoxon_p"]).withColumn("direction", F.when(F.col("mean_pain") > F.col("mean_rest"), f"Pain > {rest}").otherwise(f"Pain < {rest}"))


def pair_table(means: DataFrame, a: str, b: str) -> DataFrame:
    """Subjects' means in two classes, of subjects with both: paired Wilcoxon, Mann-Whitney, delta, FDR and direction of every feature."""
    both = paired_by_feature(means, a, b)
    long = both.select("feature", F.inline(F.array(F.struct(F.lit(a).alias("class"), F.col("a").alias("value")), F.struct(F.lit(b).alias("class"), F.col("b").alias("value")))))
    at = lambda k: F.avg(F.when(F.col("class") == k, F.col("value")))
    out = means.groupBy("feature").agg(at(a).alias("mean_a"), at(b).alias("mean_b")).join(both.groupBy("feature").agg(F.count(F.lit(1)).alias("n_subjects")), "feature")
    paired = wilcoxon(both).select("feature", F.col("w").alias("wilcoxon_w"), F.col("p").alias("wilcoxon_p"), F.col("rank_biserial").alias("wilcoxon_rb"))
    out = out.join(paired, "feature", "left").join(mann_whitney(long, a, b).select("feature", F.col("u").alias("mw_u"), F.col("p").alias("mw_p"), "delta"), "feature", "left")
    return with_fdr(out, ["wilcoxon_p", "mw_p"]).withColumn("direction", F.when(F.col("mean_a") > F.col("mean_b"), f"{a} > {b}").otherwise(f"{a} < {b}"))


def significant_counts(tests: DataFrame, by: list[str], effect: str, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """(by, n, mean_effect, n_significant) of tests."""
    return tests.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(effect).alias("mean_effect"), F.count_if(F.col(p) < alpha).alias("n_significant"))


def responder_scores(df: DataFrame, columns: list[str], rest: str = "NoPain", subject: str = "subject", cls: str = "class") -> DataFrame:
    """Of subjects with two rows or more at rest and otherwise: how far and how consistently they differ, as weighted ranks, and flags.

    separability: mean absolute standardized difference; sign_consistency: share of features with the sign of the median subject.
    """
    long = df.unpivot([subject, cls], columns, "feature", "value")
    at = lambda c: F.when(c, F.col("value"))
    still, moved = F.col(cls) == rest, F.col(cls) != rest
    g = long.groupBy(subject, "feature").agg(F.avg(at(moved)).alias("m1"), F.avg(at(still)).alias("m0"), F.var_samp(at(moved)).alias("v1"), F.var_samp(at(still)).alias("v0"), F.count_if(moved).alias("n1"), F.count_if(still).alias("n0"))
    pooled = F.sqrt((F.col("v1") + F.col("v0")) / 2)
    d = g.filter("n1 >= 2 and n0 >= 2").withColumn("d", (F.col("m1") - F.col("m0")) / F.when(pooled > 1e-8, pooled).otherwise(1.0))
    consensus = d.groupBy("feature").agg(F.signum(F.median("d")).alias("consensus"))
    d = d.join(F.broadcast(consensus), "feature")  # a row for each feature
    out = d.groupBy(subject).agg(settled(F.avg(F.abs("d"))).alias("separability"), F.avg((F.signum("d") == F.col("consensus")).cast("double")).alias("sign_consistency"))
    out = with_rank(with_rank(out, "separability", "sep_rank"), "sign_consistency", "sign_rank")
    out = out.withColumn("responder_score", 0.6 * F.col("sep_rank") + 0.4 * F.col("sign_rank"))
    return out.withColumns({"low_separability": F.col("sep_rank") < 0.2, "sign_flipper": F.col("sign_consistency") < 0.5, "non_responder": F.col("responder_score") < 0.25})


def compare_groups(subjects: DataFrame, metrics: list[str], easy: Column, hard: Column) -> DataFrame:
    """(metric, hard_mean, hard_median, easy_mean, easy_median, delta_mean, cliffs_delta) of metrics that both groups of subjects have."""
    side = F.when(easy, "easy").when(hard, "hard")
    long = subjects.withColumn("class", side).filter("class is not null").unpivot(["class"], metrics, "feature", "value").filter("value is not null")
    at = lambda k: F.when(F.col("class") == k, F.col("value"))
    out = long.groupBy("feature").agg(*[f(at(k)).alias(f"{k}_{n}") for k in ("hard", "easy") for n, f in (("mean", F.avg), ("median", F.median))])
    out = out.join(cliffs_delta(long, "easy", "hard"), "feature").withColumn("delta_mean", F.col("easy_mean") - F.col("hard_mean"))
    return out.withColumnsRenamed({"feature": "metric", "delta": "cliffs_delta"})


def signal_quality(df: DataFrame, columns: dict[str, list[str]], subject: str = "subject") -> DataFrame:
    """(subject, <modality>_signal_std): mean over a modality's columns of their means; 0 for a modality without columns."""
    mean = lambda cs: sum((F.avg(c) for c in cs[1:]), F.avg(cs[0])) / len(cs) if cs else F.lit(0.0)
    return df.groupBy(subject).agg(*[mean(cs).alias(f"{m}_signal_std") for m, cs in columns.items()])


def cohens_d(df: DataFrame, columns: list[str], a: str, b: str, subject: str = "subject", cls: str = "class") -> DataFrame:
    """(subject, feature, d): mean difference by the pooled sample variance."""
    long = df.unpivot([subject, cls], columns, "feature", "value")
    at = lambda k: F.when(F.col(cls) == k, F.col("value"))
    g = long.groupBy(subject, "feature").agg(F.avg(at(a)).alias("m1"), F.avg(at(b)).alias("m2"), F.var_samp(at(a)).alias("v1"), F.var_samp(at(b)).alias("v2"), F.count(at(a)).alias("n1"), F.count(at(b)).alias("n2"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / F.when(F.col("n1") + F.col("n2") > 2, F.col("n1") + F.col("n2") - 2))
    return g.select(subject, "feature", ratio(F.col("m1") - F.col("m2"), pooled).alias("d"))


def separability(d: DataFrame, subject: str = "subject") -> DataFrame:
    """Of each subject's absolute d over the features: mean, median, and mean of the greatest tenth (one at least)."""
    per = Window.partitionBy(subject)
    place = F.row_number().over(per.orderBy(F.desc("a"), "feature"))
    d = d.filter("d is not null").withColumn("a", F.abs("d")).withColumn("top", place <= F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(per) / 10)))
    return d.groupBy(subject).agg(F.avg("a").alias("mean"), F.median("a").alias("median"), F.avg(F.when(F.col("top"), F.col("a"))).alias("top_mean"))


def sign_consistency(means: DataFrame, a: str, b: str) -> DataFrame:
    """(feature, consensus, consistency, n): how many subjects' differences have the sign of the median difference."""
    d = paired_by_feature(means, a, b).withColumn("d", F.col("a") - F.col("b"))
    d = d.withColumn("consensus", F.signum(F.median("d").over(Window.partitionBy("feature"))))
    return d.groupBy("feature").agg(F.max("consensus").alias("consensus"), F.avg((F.signum("d") == F.col("consensus")).cast("double")).alias("consistency"), F.count(F.lit(1)).alias("n"))


def direction_consistency(train: DataFrame, validation: DataFrame, a: str, b: str) -> DataFrame:
    """(feature, train_diff, validation_diff, same): signs of the mean differences of two splits."""

    def diff(x: DataFrame, name: str) -> DataFrame:
        return paired_by_feature(x, a, b).groupBy("feature").agg(F.avg(F.col("a") - F.col("b")).alias(name))

    out = diff(train, "train_diff").join(diff(validation, "validation_diff"), "feature")
    return out.withColumn("same", F.signum("train_diff") == F.signum("validation_diff"))


def within_subject(df: DataFrame, columns: list[str], subject: str = "subject") -> DataFrame:
    """(subject, feature, cv, outliers): deviation by absolute mean, and the share of values beyond three deviations."""
    long = df.unpivot([subject], columns, "feature", "value")
    w = Window.partitionBy(subject, "feature")
    long = long.withColumns({"m": F.avg("value").over(w), "s": F.stddev_samp("value").over(w)})
    far = (F.abs(F.col("value") - F.col("m")) > 3 * F.col("s")).cast("double")
    return long.groupBy(subject, "feature").agg(ratio(F.max("s"), F.abs(F.max("m"))).alias("cv"), F.avg(F.coalesce(far, F.lit(0.0))).alias("outliers"))


def responder_strength(df: DataFrame, columns: list[str], a: str, b: str, subject: str = "subject", cls: str = "class") -> DataFrame:
    """(subject, strength): length of the vector of mean differences between two classes."""
    at = lambda k, c: F.avg(F.when(F.col(cls) == k, F.col(c)))
    total = sum((F.pow(F.coalesce(at(a, c) - at(b, c), F.lit(0.0)), F.lit(2.0)) for c in columns), F.lit(0.0))
    return df.groupBy(subject).agg(F.sqrt(total).alias("strength"))
