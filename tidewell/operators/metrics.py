"""Classification metrics from counts: exact, distributed, per group where asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.columns import ieee_log, ratio

from . import stats
from .aggregate import running_totals

ZERO = 0.0


def confusion(df: DataFrame, y: str, pred: str, by: list[str] | None = None, n: str | None = None) -> DataFrame:
    """n: a column of how many rows each row stands for."""
    return df.groupBy(*(by or []), y, pred).agg((F.sum(n) if n else F.count(F.lit(1))).alias("n"))


def confusion_normalised(df: DataFrame, y: str, pred: str) -> DataFrame:
    return confusion(df, y, pred).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(y)))


def classwise(df: DataFrame, y: str, pred: str, by: list[str] | None = None, n: str | None = None) -> DataFrame:
    """(by, class, precision, recall, f1, support) for classes that occur as truth or prediction; a ratio by zero is 0."""
    by = by or []
    sides = confusion(df, y, pred, by, n).select(*by, "n", F.inline(F.array(F.struct(F.col(y).alias("class"), F.lit(True).alias("truth")), F.struct(F.col(pred).alias("class"), F.lit(False).alias("truth")))), (F.col(y) == F.col(pred)).alias("hit"))
    t = sides.groupBy(*by, "class").agg(
        F.coalesce(F.sum(F.when(F.col("truth"), F.col("n"))), F.lit(0)).alias("support"), F.coalesce(F.sum(F.when(~F.col("truth"), F.col("n"))), F.lit(0)).alias("predicted"), F.coalesce(F.sum(F.when(F.col("truth") & F.col("hit"), F.col("n"))), F.lit(0)).alias("tp")
    )
    return t.select(*by, "class", ratio(F.col("tp"), F.col("predicted"), ZERO).alias("precision"), ratio(F.col("tp"), F.col("support"), ZERO).alias("recall"), ratio(2 * F.col("tp"), F.col("predicted") + F.col("support"), ZERO).alias("f1"), "support", "tp")


def summary(df: DataFrame, y: str, pred: str, by: list[str] | None = None, n: str | None = None) -> DataFrame:
    """(by, accuracy, balanced_accuracy, macro_f1, n). Balanced accuracy is over the classes that occur as truth."""
    by = by or []
    c = classwise(df, y, pred, by, n)
    return c.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), F.sum("support").alias("n")
    )


def roc_auc(df: DataFrame, y: str, score: str, by: list[str] | None = None) -> DataFrame:
    """(by, auc, n_pos, n_neg): from the ranks of distinct scores, over ranges, so that what is ranked is counts and no task has all of them."""
    by = by or []
    rows = df.filter(F.col(y).isin(0, 1)).select(*by, (F.col(y) == 1).alias("__pos"), F.col(score).alias("__s"))
    of = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0))
    t = stats.ranked_counts(rows, by, "__s", ["__pos"]).groupBy(*by).agg(of(F.col("__pos"), F.col("n")).alias("n_pos"), of(~F.col("__pos"), F.col("n")).alias("n_neg"), of(F.col("__pos"), F.col("n") * F.col("r")).alias("__sum"))
    won = F.col("__sum") - F.col("n_pos") * (F.col("n_pos").cast("double") + 1) / 2
    return t.select(*by, ratio(won, F.col("n_pos").cast("double") * F.col("n_neg")).alias("auc"), "n_pos", "n_neg")


def roc_points(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, tpr, fpr) at each distinct score, from the greatest."""
    counts = df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("q"))
    run = running_totals(counts, "threshold", ["p", "q"])
    return run.select("threshold", ratio(F.col("run_p"), F.col("all_p")).alias("tpr"), ratio(F.col("run_q"), F.col("all_q")).alias("fpr"))


def reliability(df: DataFrame, y: str, p: str, bins: int = 8) -> DataFrame:
    """(bin, mean_p, rate, n) over equal bins of [0, 1]."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))


def reliability_quantile(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """The same over bins between quantiles, intervals open below."""
    q = df.agg(F.percentile(p, F.array(*[F.lit(k / bins) for k in range(1, bins)])).alias("__q"))
    b = F.size(F.filter("__q", lambda e: e < F.col(p)))
    return df.crossJoin(F.broadcast(q)).groupBy(b.alias("bin")).agg(F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))


def brier_log_loss(df: DataFrame, y: str, p: str, eps: float | None = 1e-15, by: list[str] | None = None) -> DataFrame:
    """(by, brier, log_loss). Probabilities are clipped to eps and 1 - eps for the log loss; with eps None they are not, so it is infinite or NaN where one is 0, 1 or beyond."""
    t = F.col(y).cast("double")
    if eps is None:
        loss = -(t * ieee_log(F.col(p)) + (1 - t) * ieee_log(1 - F.col(p)))
    else:
        q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(p)))
        loss = -(t * F.log(q) + (1 - t) * F.log(1 - q))
    return df.groupBy(*(by or [])).agg(F.avg((F.col(p) - t) * (F.col(p) - t)).alias("brier"), F.avg(loss).alias("log_loss"))
