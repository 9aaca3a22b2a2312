"""Queries of the learned models: boosting, support vector machines, neighbours, stacking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.columns import CLASSES, is_pain
from tidewell.operators import aggregate, boost, dependence, families, kernel, neighbors, select
from tidewell.operators.boost import Boosting
from tidewell.operators.models import ModelSpec

from .registry import FEATURES, SEG, query, segments, table

SMALL = Boosting(rounds=10, depth=3, rate=0.2, bins=64)
TRAIN = "split = 'train'"


def _labelled(spark, d):
    code = F.when(F.col("class") == CLASSES[0], 0).when(F.col("class") == CLASSES[1], 1).otherwise(2)
    return segments(spark, d).withColumns({"y": is_pain(F.col("class")), "kind": code})


@query("boosted_probabilities")
def boosted_probabilities(spark, d):
    """Boosting that leaves a subject out, for all subjects at once, and on the validation split."""
    return boost.loso_boosting(_labelled(spark, d), FEATURES, "y", F.expr(TRAIN), SMALL)


@query("boosted_multiclass")
def boosted_multiclass(spark, d):
    """Softmax boosting over three classes: validation probabilities."""
    s = _labelled(spark, d)
    return boost.fit_boosting(s, FEATURES, "kind", F.expr(TRAIN), SMALL, classes=3, leave_out=False).score(s.filter("split <> 'train'"), ["segment_id"]).drop("fold")


@query("boosting_curve")
def boosting_curve(spark, d):
    """Loss of the training rows, of held-out ones that stop it, and of the validation split, round by round."""
    s = Boosting(rounds=25, depth=4, bins=128, patience=5)
    return boost.fit_boosting(_labelled(spark, d), FEATURES, "y", F.expr(TRAIN), s, leave_out=False).curve(spark)


@query("boosting_importances")
def boosting_importances(spark, d):
    return boost.fit_boosting(_labelled(spark, d), FEATURES, "y", F.expr(TRAIN), SMALL, leave_out=False).importances(spark)


@query("svm_rbf_probabilities")
def svm_rbf_probabilities(spark, d):
    """A radial kernel over 48 landmarks, leaving a subject out."""
    return kernel.loso_svm(_labelled(spark, d), FEATURES, "y", F.expr(TRAIN), kernel.Svm(landmarks=48))


@query("svm_linear_probabilities")
def svm_linear_probabilities(spark, d):
    return kernel.loso_svm(_labelled(spark, d), FEATURES, "y", F.expr(TRAIN), kernel.Svm(landmarks=0))


@query("nearest_neighbours", """e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) ** 2)) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT query_id, id, sqrt(d) AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS INTEGER) AS rank FROM p)
--
SELECT * FROM r WHERE rank <= 10""", "distance", "query_id rank id")  # fmt: skip
def nearest_neighbours(spark, d):
    """The ten nearest vectors of every vector."""
    rows = table(spark, d, "embeddings")
    return neighbors.neighbour_rows(neighbors.nearest(rows, rows, 10))


@query("knn_probabilities")
def knn_probabilities(spark, d):
    return families.left_out(_labelled(spark, d), ModelSpec("knn", {"k": 9}), FEATURES, "y", F.expr(TRAIN))


@query("stacked_probabilities")
def stacked_probabilities(spark, d):
    """Logistic regression and boosting under a logistic second level, in nested folds of subject groups."""
    return families.stack(_labelled(spark, d), [ModelSpec("logreg"), ModelSpec("xgb", {"rounds": 5, "depth": 2, "bins": 32})], FEATURES, "y", F.expr(TRAIN), groups=3)


COMPONENTS = [f"x{i:02d}" for i in range(64)]


def _components(spark, d):
    """Signals as rows of 64 features: every eighth a subject's, class 0 against the others, two subjects for validation."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("segment_id"), (F.col("vec_id") % 8).cast("int").alias("subject"), (F.col("label") == 0).cast("int").alias("y"), (F.col("vec_id") % 8 < 6).alias("train"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(COMPONENTS)])


@query("component_correlations", """e AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding) AS x FROM embeddings)
--
SELECT 'x' || lpad(CAST(p.i AS VARCHAR), 2, '0') AS a, 'x' || lpad(CAST(q.i AS VARCHAR), 2, '0') AS b, corr(CAST(p.x AS DOUBLE), CAST(q.x AS DOUBLE)) AS r FROM e p JOIN e q ON p.vec_id = q.vec_id AND p.i < q.i GROUP BY p.i, q.i""", "r", "a b")  # fmt: skip
def component_correlations(spark, d):
    """All pairs of 64 columns, in one pass over blocks."""
    return aggregate.correlations(_components(spark, d), COMPONENTS)


@query("shared_selection")
def shared_selection(spark, d):
    """Forward selection among 64 columns, all candidates of a step in the same passes: (step, feature, auc)."""
    chosen, history = select.greedy_shared(_components(spark, d), COMPONENTS, "y", F.col("train"), most=3)
    return spark.createDataFrame([(i, f, a) for i, (f, a) in enumerate(zip(chosen, history, strict=True))], "step int, feature string, auc double")


@query("top_k_auc")
def top_k_auc(spark, d):
    """Left-out and validation AUC of the first columns by their distance between the classes, for several numbers of columns at once."""
    s = _components(spark, d)
    mean = s.filter("train").groupBy("y").agg(*[F.avg(c).alias(c) for c in COMPONENTS]).collect()
    ranked = sorted(COMPONENTS, key=lambda c: (-abs(mean[0][c] - mean[1][c]), c))
    return spark.createDataFrame(select.top_k_shared(s, ranked, [1, 2, 4, 8, 16, 32], "y", F.col("train")), "k int, loso_auc double, validation_auc double")


@query("distance_correlation_columns", SEG + """, a AS (SELECT p.segment_id AS i, q.segment_id AS j, abs(p.bvp_value - q.bvp_value) AS a, abs(p.eda_k - q.eda_k) AS b FROM seg p, seg q WHERE p.bvp_value IS NOT NULL AND p.eda_k IS NOT NULL AND q.bvp_value IS NOT NULL AND q.eda_k IS NOT NULL),
m AS (SELECT avg(a * b) AS ab, avg(a * a) AS aa, avg(b * b) AS bb FROM a), r AS (SELECT i, avg(a) AS a, avg(b) AS b FROM a GROUP BY i),
s AS (SELECT avg(a) AS a, avg(b) AS b, avg(a * b) AS ab, avg(a * a) AS aa, avg(b * b) AS bb FROM r)
--
SELECT sqrt(greatest(m.ab + s.a * s.b - 2 * s.ab, 0) / sqrt((m.aa + s.a * s.a - 2 * s.aa) * (m.bb + s.b * s.b - 2 * s.bb))) AS r FROM m, s""", "r")  # fmt: skip
def distance_correlation_columns(spark, d):
    """Of two columns over all segments."""
    return spark.createDataFrame([(dependence.distance_correlation(segments(spark, d), "bvp_value", "eda_k"),)], "r double")
