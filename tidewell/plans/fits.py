"""Queries that fit models and decode end to end, and queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.columns import CLASSES, is_pain
from tidewell.operators import decode, metrics, models, normalize, select

from .registry import FEATURES, query, segments


def _two_stage(spark, d):
    """(segment_id, subject, class, split, p0, p1) of subject-z features: P(NoPain), then P(PainArm) by a fit on pain rows, scored on all."""
    s = normalize.subject_z(segments(spark, d), FEATURES)
    s = s.withColumns({"y0": 1 - is_pain(F.col("class")), "y1": (F.col("class") == "PainArm").cast("int")})
    train = F.col("split") == "train"
    first = models.loso(s, FEATURES, "y0", train).select("segment_id", F.col("proba").alias("p0"))
    # Stage 2 learns from pain rows of other subjects and scores every row of the held-out one.
    second = models.loso(s, FEATURES, "y1", train, weight=None, learn=F.col("class") != "NoPain").select("segment_id", F.col("proba").alias("p1"))
    return s.select("segment_id", "subject", "class", "split").join(first, "segment_id").join(second, "segment_id")


@query("two_stage_decoded")
def two_stage_decoded(spark, d):
    """Per split: metrics of the two-stage model, decoded under each subject's class counts."""
    p = _two_stage(spark, d)
    counts = p.groupBy("subject").agg(*[F.count_if(F.col("class") == k).alias(f"n{i}") for i, k in enumerate(CLASSES)])
    pred = decode.exact_count_decode(decode.joint_scores(p, "p0", "p1"), ["s0", "s1", "s2"], counts)
    y = F.when(F.col("class") == "NoPain", 0).when(F.col("class") == "PainArm", 1).otherwise(2)
    return metrics.summary(p.withColumn("y", y).join(pred.select("segment_id", "pred"), "segment_id"), "y", "pred", ["split"])


@query("multiclass_ml")
def multiclass_ml(spark, d):
    """pyspark.ml logistic regression over three classes, fitted on the training split: validation probabilities."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    s = models.standard_scale(segments(spark, d), FEATURES, F.col("split") == "train")
    s = s.withColumn("label", F.when(F.col("class") == "NoPain", 0.0).when(F.col("class") == "PainArm", 1.0).otherwise(2.0))
    s = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(s)
    model = models.classifier(models.ModelSpec("logreg", {"maxIter": 50, "regParam": 0.01})).fit(s.filter("split = 'train'"))
    out = model.transform(s.filter("split = 'validation'")).withColumn("p", vector_to_array("probability"))
    return out.select("segment_id", F.col("prediction").cast("int").alias("pred"), *[F.get("p", F.lit(i)).alias(f"p_{k}") for i, k in enumerate(CLASSES)])


@query("feature_set_auc")
def feature_set_auc(spark, d):
    """Validation AUC of each feature pool."""
    s = segments(spark, d).withColumn("y", is_pain(F.col("class")))
    out = None
    for name, cols in select.feature_sets(FEATURES).items():
        if cols:
            model = models.fit_model(s.filter("split = 'train'"), cols, "y")  # what loso() scores other rows with; no fold is needed
            auc = metrics.roc_auc(s.filter("split <> 'train'").select("y", model.proba().alias("proba")), "y", "proba").select(F.lit(name).alias("pool"), "auc")
            out = auc if out is None else out.unionByName(auc)
    return out
