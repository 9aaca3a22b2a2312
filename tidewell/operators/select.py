"""Feature ranking, named feature sets and greedy selection."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import modality, unique_by_canonical

from . import metrics, models, stats
from .aggregate import subject_means


def rank_binary(df: DataFrame, columns: list[str], a: str, b: str, least_pairs: int = 5) -> DataFrame:
    """(feature, delta, score): by absolute Cliff's delta of subject means, for features with enough subjects in both classes."""
    long = subject_means(df, columns).unpivot(["subject", "class"], columns, "feature", "value")
    pairs = stats.paired_by_feature(long, a, b)
    enough = pairs.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_pairs).select("feature")
    both = pairs.select("feature", F.inline(F.array(F.struct(F.lit(a).alias("class"), F.col("a").alias("value")), F.struct(F.lit(b).alias("class"), F.col("b").alias("value")))))
    out = stats.cliffs_delta(both, a, b).join(enough, "feature", "left_semi")
    return out.withColumn("score", F.abs("delta")).orderBy(F.desc("score"), "feature")


def rank_multiclass(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, score): by the F of an ANOVA of subject means; 0 without spread between classes, infinite without spread within."""
    long = subject_means(df, columns).unpivot(["subject", "class"], columns, "feature", "value")
    f = stats.anova(long)
    score = F.when(F.col("f").isNotNull(), F.col("f")).when(F.col("eta2") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    return f.select("feature", score.alias("score")).orderBy(F.desc("score"), "feature")


def rank_consistent(df: DataFrame, columns: list[str], a: str, b: str) -> DataFrame:
    """(feature, consistency, effect, score): share of subjects with the consensus sign, times the absolute delta."""
    long = subject_means(df, columns).unpivot(["subject", "class"], columns, "feature", "value")
    out = stats.sign_consistency(long, a, b).join(stats.cliffs_delta(long, a, b), "feature")
    out = out.select("feature", "consistency", F.abs("delta").alias("effect"))
    return out.withColumn("score", F.col("consistency") * F.col("effect")).orderBy(F.desc("score"), "feature")


def names_of(ranked: DataFrame, k: int) -> list[str]:
    return [r.feature for r in ranked.limit(k).collect()]


#: Feature sets of the two stages and of three classes, as parts (modalities, how many of the best ranked; None: all in their order).
STAGE1 = {
    "bvp_only": [(("bvp",), None)], "eda_only": [(("eda",), None)], "bvp_eda_core": [(("bvp",), None), (("eda",), None)],
    "bvp_eda_resp_small": [(("bvp", "eda"), 60), (("resp",), 10)], "all": [(None, None)],
}
STAGE2 = {
    "resp_all": [(("resp",), None)], "resp_top20": [(("resp",), 20)], "resp_bvp5": [(("resp",), 20), (("bvp",), 5)],
    "eda_resp_top30": [(("eda", "resp"), 30)], "bvp_resp_top30": [(("bvp", "resp"), 30)], "all_top40": [(("bvp", "eda", "resp"), 40)],
}
MULTICLASS = {
    "bvp_eda_resp": [(("bvp",), None), (("eda",), None), (("resp",), None)], "top80": [(("bvp", "eda", "resp"), 80)],
    "all_top120": [(None, 120)], "all_modalities": [(None, None)],
}


def named_sets(recipes: dict[str, list], columns: list[str], ranked: list[str], fixed: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """The recipes' sets of columns, without the raw_ twins of other columns. ranked: best first; its order within any modality is that of the whole.

    fixed: further sets by name, of which the columns that exist are kept. "all_raw" has every column, twins too.
    """
    unique = unique_by_canonical(columns)
    best = [c for c in ranked if c in set(unique)]

    def part(tags, k):
        return [c for c in (unique if k is None else best) if tags is None or modality(c) in tags][:k]

    out = {name: [c for tags, k in parts for c in part(tags, k)] for name, parts in recipes.items()}
    return out | {"all_raw": columns} | {name: [c for c in names if c in columns] for name, names in (fixed or {}).items()}


def feature_sets(columns: list[str], first_match: bool = False) -> dict[str, list[str]]:
    """Pools by modality, without the raw_ twins of other columns."""
    unique = unique_by_canonical(columns)
    tag = {c: modality(c, first_match) for c in unique}
    of = lambda *m: [c for c in unique if tag[c] in m]
    return {"all": unique, "bvp": of("bvp"), "eda": of("eda"), "resp": of("resp"), "spo2": of("spo2"), "bvp_eda": of("bvp", "eda"), "bvp_eda_resp": of("bvp", "eda", "resp")}


def top_k_sweep(names: list[str], sizes: Iterable[int], score: Callable[[list[str]], float]) -> list[tuple[int, float]]:
    return [(k, score(names[:k])) for k in sizes if k <= len(names)]


def greedy_forward(names: list[str], score: Callable[[list[str]], float], most: int = 8, drop: float = 0.005) -> tuple[list[str], list[float]]:
    """Add the name that scores best, first of equals, until the score falls by more than drop below that of the step before."""
    chosen: list[str] = []
    history: list[float] = []
    while len(chosen) < min(most, len(names)):
        scored = [(score([*chosen, n]), n) for n in names if n not in chosen]
        best = max(scored, key=lambda x: x[0])
        if history and best[0] < history[-1] - drop:
            break
        chosen.append(best[1])
        history.append(best[0])
    return chosen, history


def set_scores(df: DataFrame, sets: list[list[str]], label: str, train: Column, key: str = "segment_id", by: str = "subject", **options) -> list[tuple[float, float]]:
    """(left-out AUC of the training subjects, AUC of the other rows) of a logistic fit on each set of columns; NaN without both classes. All sets share every pass."""
    p = models.loso_many(df, sets, label, train, key=key, by=by, **options).join(df.select(key, label), key)
    p = p.withColumn("part", (F.col("fold") == -1).cast("int"))
    found = {(r["set"], r.part): r.auc for r in metrics.roc_auc(p, label, "proba", ["set", "part"]).collect()}
    value = lambda v: float("nan") if v is None else v
    return [(value(found.get((i, 0))), value(found.get((i, 1)))) for i in range(len(sets))]


def top_k_shared(df: DataFrame, ranked: list[str], sizes: Iterable[int], label: str, train: Column, **options) -> list[tuple[int, float, float]]:
    """(k, left-out AUC, AUC of the other rows) of the first k ranked columns, for all sizes at once."""
    sizes = [k for k in sizes if k <= len(ranked)]
    return [(k, *s) for k, s in zip(sizes, set_scores(df, [ranked[:k] for k in sizes], label, train, **options), strict=True)]


def greedy_shared(df: DataFrame, names: list[str], label: str, train: Column, most: int = 8, drop: float = 0.005, **options) -> tuple[list[str], list[float]]:
    """greedy_forward by the left-out AUC; all candidates of a step are fitted and scored together, so a step's jobs don't grow with their number."""
    chosen: list[str] = []
    history: list[float] = []
    while len(chosen) < min(most, len(names)):
        rest = [n for n in names if n not in chosen]
        scores = [s for s, _ in set_scores(df, [[*chosen, n] for n in rest], label, train, **options)]
        best = max(range(len(rest)), key=lambda i: scores[i])
        if history and scores[best] < history[-1] - drop:
            break
        chosen.append(rest[best])
        history.append(scores[best])
    return chosen, history
