"""A linear mixed model with a random intercept for each group, for many features at once, by restricted likelihood from sums of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.special import normal_two_sided
from tidewell.sources.shared import stored

#: The log of the ratio of variances (of groups to rows) is looked for between -SPAN and SPAN: first at every whole number, then ROUNDS - 1 times
#: among as many points around the best, each time FINER. So the ratio is known to some 1 part in 4,000.
SPAN, ROUNDS, FINER = 16, 4, 16
FEWEST_GROUPS = 5


def group_sums(long: DataFrame, feature: str, group: str, effect: str, value: str) -> DataFrame:
    """A row for each feature and group: n, means mx and my less those of the feature, sums of squares and products within the group. Rows without value or effect are left out."""
    x, y = F.col(f"`{effect}`").cast("double"), F.col(f"`{value}`").cast("double")
    rows = long.select(F.col(f"`{feature}`").alias("feature"), F.col(f"`{group}`").alias("grp"), x.alias("x"), F.nanvl(y, F.lit(None).cast("double")).alias("y")).dropna(subset=["grp", "x", "y"])
    n = F.count(F.lit(1)).cast("double")
    sums = rows.groupBy("feature", "grp").agg(n.alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.var_pop("x") * n).alias("sxx"), (F.covar_pop("x", "y") * n).alias("sxy"), (F.var_pop("y") * n).alias("syy"))
    sums = stored(sums, "group-sums")
    whole = sums.groupBy("feature").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups"), *[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(f"{c}0") for c in ("mx", "my")])
    whole = stored(whole, "features")  # one row a feature, whose size is known to the join
    joined = sums.join(whole, F.equal_null(sums["feature"], whole["feature"])).drop(whole["feature"])
    return joined.withColumns({"mx": F.col("mx") - F.col("mx0"), "my": F.col("my") - F.col("my0")}).drop("mx0", "my0")


def _profile(at: DataFrame) -> DataFrame:
    """at: group sums, each with a log ratio l. A row for each feature and l with the fit there and its criterion, minus twice the restricted log likelihood."""
    w = F.col("n") / (1 + F.exp("l") * F.col("n"))
    a = at.withColumn("w", w).groupBy("feature", "l").agg(
        F.first("rows").alias("rows"), F.first("groups").alias("groups"), F.sum("w").alias("ww"), F.sum(F.col("w") * F.col("mx")).alias("wx"), F.sum(F.col("w") * F.col("my")).alias("wy"),
        F.sum(F.col("sxx") + F.col("w") * F.col("mx") * F.col("mx")).alias("xx"), F.sum(F.col("sxy") + F.col("w") * F.col("mx") * F.col("my")).alias("xy"),
        F.sum(F.col("syy") + F.col("w") * F.col("my") * F.col("my")).alias("yy"), F.sum(F.log1p(F.exp("l") * F.col("n"))).alias("logv"),
    )
    # The intercept goes by what is left of each sum once the weighted means are taken out.
    cxx, cxy, cyy = F.expr("xx - wx * wx / ww"), F.expr("xy - wx * wy / ww"), F.expr("yy - wy * wy / ww")
    f = a.select("feature", "l", "rows", "groups", "ww", "logv", cxx.alias("cxx"), cxy.alias("cxy"), cyy.alias("cyy"), F.col("yy"), F.col("xx"))
    f = f.filter((F.col("cxx") > 1e-12 * F.col("xx")) & (F.col("cyy") > 1e-12 * F.col("yy")) & (F.col("rows") > 2))
    f = f.withColumn("rss", F.expr("cyy - cxy * cxy / cxx")).filter("rss > 1e-12 * cyy")
    return f.withColumn("crit", F.expr("(rows - 2) * ln(rss) + logv + ln(ww) + ln(cxx)"))


def random_intercept(long: DataFrame, feature: str = "feature", group: str = "subject", effect: str = "effect", value: str = "value", fewest_groups: int = FEWEST_GROUPS) -> DataFrame:
    """value ~ 1 + effect + (1 | group) for every feature: (feature, n, groups, estimate, se, z, p, ratio).

    estimate: of the effect, p its two-sided normal one, ratio: the variance of the groups' intercepts over that of rows, by restricted maximum
    likelihood. Everything comes from sums of (feature, group), which are added up before they are shuffled; a round looks at
    33 ratios for all features in one pass over them, and a feature's rows are never together. Features of fewer groups, and
    those whose value or effect does not vary, or whose value the effect explains wholly, have null results; a feature without rows has no row.
    """
    sums = stored(group_sums(long, feature, group, effect, value), "centred-sums")
    offsets, best = F.explode(F.array(*[F.lit(float(i)) for i in range(-SPAN, SPAN + 1)])), None
    for k in range(ROUNDS):
        step = F.lit(float(FINER**-k))
        mid = F.lit(0.0) if best is None else F.col("mid")
        at = sums if best is None else sums.join(best.select(F.col("feature").alias("f"), F.col("b.l").alias("mid")), F.equal_null("feature", "f")).drop("f")
        fits = _profile(at.withColumn("l", offsets).withColumn("l", mid + F.col("l") * step))
        fit = F.struct("l", "rss", "cxx", "cxy", "rows")
        best = stored(fits.groupBy("feature").agg(F.min_by(fit, F.struct("crit", "l")).alias("b")), "profile")
    estimate, se = F.expr("b.cxy / b.cxx"), F.expr("sqrt(b.rss / (b.rows - 2) / b.cxx)")
    fitted = best.select(F.col("feature").alias("f"), estimate.alias("estimate"), se.alias("se"), F.exp("b.l").alias("ratio"))
    every = sums.groupBy("feature").agg(F.sum("n").cast("long").alias("n"), F.count(F.lit(1)).alias("groups"))
    out = every.join(fitted, F.equal_null("feature", "f") & (F.col("groups") >= fewest_groups), "left").withColumn("z", F.col("estimate") / F.col("se"))
    return out.select("feature", "n", "groups", "estimate", "se", "z", normal_two_sided(F.col("z")).alias("p"), "ratio")
