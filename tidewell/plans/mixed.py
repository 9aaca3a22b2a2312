"""Queries of the mixed model."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import mixed
from tidewell.operators.relational import melt

from .norms import NORMAL_TAIL
from .registry import FEATURES, LONG, query, segments


def _rounds() -> str:
    """The same search for the ratio in SQL, a pair of tables a round."""
    out, mid = [], "0e0"
    for k in range(mixed.ROUNDS):
        before = "" if k == 0 else f" JOIN b{k - 1} USING (feature)"
        out.append(f"""p{k} AS (SELECT feature, l, any_value(total) AS total, sum(w) AS ww, sum(w * mx) AS wx, sum(w * my) AS wy, sum(sxx + w * mx * mx) AS xx, sum(sxy + w * mx * my) AS xy, sum(syy + w * my * my) AS yy, sum(ln(1 + exp(l) * n)) AS logv
  FROM (SELECT *, n / (1 + exp(l) * n) AS w FROM (SELECT c.*, {mid} + i * {float(mixed.FINER**-k)!r} AS l FROM c{before}, (SELECT unnest(range({-mixed.SPAN}, {mixed.SPAN + 1})) AS i))) GROUP BY feature, l),
b{k} AS (SELECT feature, arg_min(l, crit) AS l, arg_min(cxx, crit) AS cxx, arg_min(cxy, crit) AS cxy, arg_min(rss, crit) AS rss, any_value(total) AS total
  FROM (SELECT *, (total - 2) * ln(rss) + logv + ln(ww) + ln(cxx) AS crit FROM (SELECT *, cyy - cxy * cxy / cxx AS rss FROM (SELECT *, xx - wx * wx / ww AS cxx, xy - wx * wy / ww AS cxy, yy - wy * wy / ww AS cyy FROM p{k}))) GROUP BY feature)""")
        mid = f"b{k}.l"
    return ",\n".join(out)


@query("mixed_model_p", LONG + f""", d AS (SELECT feature, subject, CAST(class = 'PainHand' AS INTEGER) AS x, value AS y FROM long WHERE split = 'train' AND class <> 'NoPain' AND value IS NOT NULL),
s AS (SELECT feature, subject, CAST(count(*) AS DOUBLE) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy, var_pop(y) * count(*) AS syy FROM d GROUP BY ALL),
g AS (SELECT feature, sum(n) AS total, count(*) AS groups, sum(n * mx) / sum(n) AS gx, sum(n * my) / sum(n) AS gy FROM s GROUP BY feature),
c AS (SELECT feature, n, mx - gx AS mx, my - gy AS my, sxx, sxy, syy, total FROM s JOIN g USING (feature)),
{_rounds()},
e AS (SELECT g.feature, CAST(g.total AS BIGINT) AS n, g.groups, cxy / cxx AS estimate, sqrt(rss / (b.total - 2) / cxx) AS se FROM g JOIN b{mixed.ROUNDS - 1} b USING (feature))
--
SELECT *, estimate / se AS z, {NORMAL_TAIL.format(z='abs(estimate / se)')} AS p FROM e""", "estimate se z p", "feature n groups")  # fmt: skip
def mixed_model_p(spark, d):
    """Arm against hand pain with an intercept for each training subject, for every feature."""
    rows = segments(spark, d).filter("split = 'train' AND class <> 'NoPain'")
    rows = melt(rows, ["subject", "class"], FEATURES).withColumn("effect", (F.col("class") == "PainHand").cast("int"))
    return mixed.random_intercept(rows).drop("ratio")
