"""Model families by name, each as left-out probabilities of all folds at once; one against the rest; stacking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import models
from .boost import Boosting, loso_boosting
from .kernel import Svm, loso_svm
from .models import ModelSpec
from .neighbors import nearest


def _with(kind, spec: ModelSpec, **usual):
    return kind(**(usual | {k: v for k, v in spec.params.items() if k in {f.name for f in fields(kind)}}))


def _logistic(df, columns, label, train, spec, **options):
    return models.loso(df, columns, label, train, c=spec.params.get("c", 1.0), robust=spec.params.get("robust", False), **options)


def _svm(landmarks: int):
    return lambda df, columns, label, train, spec, **options: loso_svm(df, columns, label, train, _with(Svm, spec, landmarks=landmarks), **options).drop("decision")


def _knn(df, columns, label, train, spec, key="segment_id", by="subject", weight=None, learn=None):
    """Share of class 1 among the k nearest training rows of other subjects, by columns scaled by all training rows."""
    rows = models.standard_scale(df.withColumns({"__y": F.col(label).cast("double"), "__fold": F.when(train, F.col(by).cast("long")).otherwise(-1), "__learn": learn if learn is not None else F.lit(True)}), columns, train)
    rows = rows.select(key, by, "__fold", "__y", "__learn", F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns]).alias("__v"), F.xxhash64(key).alias("__id"))
    known = rows.filter("__fold <> -1 and __learn and __y is not null")
    found = nearest(rows, known, spec.params.get("k", 5), "__id", "__v", own=F.col("__fold"), tag=F.col("__y"))
    share = F.aggregate("neighbours", F.lit(0.0), lambda s, n: s + n["tag"]) / F.when(F.size("neighbours") > 0, F.size("neighbours"))
    return rows.join(found.select(F.col("query_id").alias("__id"), share.alias("proba")), "__id").filter("proba is not null").select(key, by, F.col("__fold").alias("fold"), "proba")


#: name -> f(df, columns, label, train, spec, key=, by=, weight=, learn=) -> (key, by, fold, proba)
FAMILIES: dict[str, Callable] = {
    "logreg": _logistic,
    "xgb": lambda df, columns, label, train, spec, **options: loso_boosting(df, columns, label, train, _with(Boosting, spec), **options),
    "svm_linear": _svm(0),
    "svm_rbf": _svm(256),
    "knn": _knn,
}


def left_out(df: DataFrame, spec: ModelSpec, columns: list[str], label: str, train: Column, key: str = "segment_id", by: str = "subject", **options) -> DataFrame:
    """(key, by, fold, proba) of the named family: training subjects by models without them, other rows by one of all training rows (fold -1)."""
    return FAMILIES[spec.name](df, columns, label, train, spec, key=key, by=by, **options)


def one_vs_rest(df: DataFrame, spec: ModelSpec, columns: list[str], label: str, classes: int, train: Column, key: str = "segment_id", by: str = "subject", **options) -> DataFrame:
    """(key, by, fold, proba_0 ..): each class against the others, normalised. xgb has a softmax of its own."""
    if spec.name == "xgb":
        return loso_boosting(df, columns, label, train, _with(Boosting, spec), classes, key, by, **options)
    each = [left_out(df.withColumn("__y", (F.col(label) == c).cast("int")), spec, columns, "__y", train, key, by, **options).withColumnRenamed("proba", f"p{c}") for c in range(classes)]
    both = reduce(lambda a, b: a.join(b.drop(by, "fold"), key), each)
    total = reduce(lambda a, b: a + b, [F.col(f"p{c}") for c in range(classes)])
    return both.select(key, by, "fold", *[(F.col(f"p{c}") / total).alias(f"proba_{c}") for c in range(classes)])


def stack(
    df: DataFrame, specs: list[ModelSpec], columns: list[str], label: str, train: Column, groups: int = 5, c: float = 1.0, seed: int = 42, key: str = "segment_id", by: str = "subject", **options
) -> DataFrame:
    """(key, by, stack_group, proba): a logistic fit over the first level's log odds. key must be unique.

    Training subjects are dealt to groups by a seeded hash. A row of group g is scored by a second level fitted on the other groups,
    whose first-level values come from models that saw neither g nor the row's own group; its own come from models without g.
    So nothing about g's labels reaches its scores, at either level. Other rows (group -1) are scored by both levels over all
    training rows, the second again fitted on values from models without the row's group.
    """
    names = [f"z{i}" for i in range(len(specs))]
    group = F.pmod(F.xxhash64(F.lit(seed), F.col(by)), F.lit(groups)).cast("int")
    rows = df.withColumn("__train", F.coalesce(train, F.lit(False))).withColumn("stack_group", F.when(F.col("__train"), group).otherwise(-1))
    there = sorted(r[0] for r in rows.select("stack_group").distinct().collect())
    out = None
    for g in there:
        learns = F.col("__train") & (F.col("stack_group") != g)
        level = rows.select(key, by, "stack_group", label, learns.alias("__learns"))
        for name, spec in zip(names, specs, strict=True):
            first = left_out(rows, spec, columns, label, learns, key, "stack_group", **options)
            level = level.join(first.select(key, (log_odds(F.col("proba"))).alias(name)), key)
        level = level.persist()
        try:
            second = models.fit_model(level.filter("__learns"), names, label, c)
        except ValueError:  # one class only
            continue
        finally:
            level.unpersist()
        scored = level.filter(F.col("stack_group") == g).select(key, by, "stack_group", second.proba().alias("proba"))
        out = scored if out is None else out.unionByName(scored)
    return out


def log_odds(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.log(q / (1 - q))
