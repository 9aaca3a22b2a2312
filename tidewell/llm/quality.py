"""Quality rules: base rules, and robust multivariate outliers by minimum covariance determinant.

Each document becomes a short vector of transformed rates. Documents that pass the base rules
fit one estimate for each language and source, one for each language, and one of all. There are
three deterministic starts; each concentration step takes the half of the cohort with the least
Mahalanobis distances and estimates centre and covariance from it. Steps go on until no
determinant falls; the start with the least one wins, and a reweighting step follows. A language
and source is judged by its own estimate, drawn to that of its language, and this to that of all,
by a fixed number of pseudo-rows, so that few rows do not make a cohort of outliers the rule.
Medians and distance quantiles come from exact counts on a fine grid, so that every row counts, a
group is never gathered in one task, and results do not depend on the order of rows. A document
is rejected if its distance from its estimate is beyond the cutoff. DataFrame functions only; the
covariance is inverted by sweeps over its rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import collect_garbage, let, materialize, without, words

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
GRID = 256  # cells a unit for medians; a distance's logarithm has GRID / 4
BROADCAST_COHORTS = 5_000


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20
    #: Rows that the estimate of the language, and that of all documents, counts for beside a cohort's own.
    prior_rows: int = 50
    max_steps: int = 20
    reweight_quantile: float = 0.975
    reject_quantile: float = 1 - 1e-7
    #: Least standard deviation of each statistic; a cohort of near-equal documents rejects nothing within it.
    floors: dict[str, float] = field(default_factory=lambda: {"symbols": 0.25, "word_length": 0.10, "repeats": 0.50, "dup_lines": 0.25, "upper": 0.35, "exclaim": 0.25})


def _chi2_cdf(x: float, k: int) -> float:
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, k) < p else (lo, mid)
    return (lo + hi) / 2


def _repeat_words(w: Column) -> Column:
    """Words in 5-word windows found twice or more in w."""
    grams = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(5)])))

    def covered(g: Column) -> Column:
        by_gram = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        twice = let(
            by_gram,
            lambda s: F.filter(
                F.transform(s, lambda x, k: F.when((x["g"] == F.get(s, k - 1)["g"]) | (x["g"] == F.get(s, k + 1)["g"]), x["i"])),
                lambda i: i.isNotNull(),
            ),
        )
        return let(
            F.sort_array(twice),
            lambda p: F.aggregate(F.transform(p, lambda a, k: F.least(F.coalesce(F.get(p, k + 1) - a, F.lit(5)), F.lit(5))), F.lit(0), lambda a, b: a + b),
        )

    some = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0)))
    return F.when(F.size(w) >= 6, some).otherwise(F.lit(0)).cast("long")


def add_base(docs: DataFrame, rules: Rules, text_col: str = "text") -> DataFrame:
    """docs with the base statistics, base_failed, and the vector's columns __tw_x_*."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    docs = without(docs, *BASE, "base_failed", "kept", "distance2")

    def stats(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
        chars = F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))
        count = lambda chars_: F.length(text) - F.length(F.translate(text, chars_, ""))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            chars.cast("long").alias("word_chars"),
            count(SYMBOLS).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.split(text, "\n")).alias("n_lines"),
            count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("upper"),
            count("!").alias("exclaim"),
        )

    out = docs.withColumn("__tw_s", let(words(F.col(f"`{text_col}`")), stats))
    out = out.withColumns({c: F.col(f"__tw_s.{c}") for c in BASE})
    n = F.col("n_words").cast("double")
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    # Rates are shrunk towards the usual one by some dozens of pseudo-words, so that short documents do not stand out.
    vector = {
        "symbols": F.log1p(F.lit(20.0) * F.col("n_symbols") / (n + 50)),
        "word_length": F.log((F.col("word_chars") + 5.0 * 50) / (n + 50)),
        "repeats": F.log1p(F.lit(20.0) * F.col("n_repeat_words") / (n + 50)),
        "dup_lines": F.log1p(F.lit(10.0) * F.col("n_dup_lines") / (F.col("__tw_s.n_lines") + 10)),
        "upper": F.log((F.col("__tw_s.upper") + 4.0) / (F.col("word_chars") + 100.0)),
        "exclaim": F.log1p(F.lit(20.0) * F.col("__tw_s.exclaim") / (n + 50)),
    }
    assert list(vector) == list(rules.floors)
    return out.withColumns({"base_failed": failed} | {f"__tw_x_{k}": v for k, v in vector.items()}).drop("__tw_s")


def _quantile(rows: DataFrame, keys: list[str], cell: Column, share: float) -> DataFrame:
    """(keys, q): the least cell up to which share of a key's rows lie, by exact counts. Cells are integers."""
    counts = rows.groupBy(*keys, cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    run = F.sum("n").over(w.orderBy("cell"))
    counts = counts.withColumn("run", run).withColumn("all", F.sum("n").over(w))
    return counts.filter(F.col("run") >= F.ceil(F.col("all") * share)).groupBy(*keys).agg(F.min("cell").alias("q"))


def _num(x: float) -> str:
    """A double in SQL."""
    return f"{x!r}D"


def _pairs(names: list[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(names)) for j in range(i + 1)]


def _distance2(names: list[str]) -> Column:
    """Squared Mahalanobis distance of the row's x from (m_*, w_*_*), w being the inverse covariance."""
    d = [f"(__tw_x_{a} - m_{a})" for a in names]
    return F.expr(f"greatest({' + '.join(f'{1 if i == j else 2} * w_{i}_{j} * {d[i]} * {d[j]}' for i, j in _pairs(names))}, 0D)")


def _invert(df: DataFrame, keep: list[str], v, names: list[str], floors: dict[str, float]) -> DataFrame:
    """keep, the covariance v(i, j) (SQL) plus the squared floors on the diagonal as v_*_*, its inverse w_*_*, and logdet: one sweep for each row.

    The sweeps go over an array: as projections of all columns, one for each sweep, they filled the driver with plans.
    """
    pairs, p = _pairs(names), len(names)
    vs = [f"v_{i}_{j}" for i, j in pairs]
    df = df.selectExpr(*keep, *[f"{v(i, j)} + {_num(floors[names[i]] ** 2 if i == j else 0.0)} AS v_{i}_{j}" for i, j in pairs])
    full = ", ".join(f"v_{max(i, j)}_{min(i, j)}" for i in range(p) for j in range(p))
    pivot = f"greatest(s.w[k * {p + 1}], 1e-12D)"
    swept = f"CASE WHEN c div {p} = k AND c % {p} = k THEN -1 / {pivot} WHEN c div {p} = k OR c % {p} = k THEN x / {pivot} ELSE x - s.w[c - c % {p} + k] * s.w[k * {p} + c % {p}] / {pivot} END"
    sweeps = f"aggregate(sequence(0, {p - 1}), struct(array({full}) AS w, 0D AS logdet), (s, k) -> struct(transform(s.w, (x, c) -> {swept}) AS w, s.logdet + ln({pivot}) AS logdet))"
    df = df.selectExpr(*keep, *vs, f"{sweeps} AS swept")
    return df.selectExpr(*keep, *vs, *[f"-swept.w[{i * p + j}] AS w_{i}_{j}" for i, j in pairs], "swept.logdet AS logdet")


def _estimate(names: list[str]) -> list[str]:
    return [*[f"{x}_{a}" for x in "cm" for a in names], *[f"{x}_{i}_{j}" for x in "vw" for i, j in _pairs(names)], "logdet"]


def _moments(rows: DataFrame, keys: list[str], names: list[str], factor: float, floors: dict[str, float]) -> DataFrame:
    """The keys with their centre and covariance from all rows; the latter times factor, plus the floors."""
    x = [f"(__tw_x_{a} - c_{a})" for a in names]  # about the medians, so that sums of squares keep their digits
    aggs = [f"avg({x[i]}) AS a_{i}" for i in range(len(names))] + [f"avg({x[i]} * {x[j]}) AS s_{i}_{j}" for i, j in _pairs(names)] + [f"first(c_{a}) AS c_{a}" for a in names]
    out = rows.groupBy(*keys).agg(*map(F.expr, aggs))
    cs, ms = [f"c_{a}" for a in names], [f"m_{a}" for a in names]
    out = out.selectExpr(*keys, *cs, *[f"c_{a} + a_{i} AS m_{a}" for i, a in enumerate(names)], *[f"(s_{i}_{j} - a_{i} * a_{j}) * {_num(factor)} AS u_{i}_{j}" for i, j in _pairs(names)])
    return _invert(out, [*keys, *cs, *ms], lambda i, j: f"u_{i}_{j}", names, floors)


def _starts(vectors: DataFrame, names: list[str], floors: dict[str, float], small) -> DataFrame:
    """(cohort, start, estimate) with medians as centres and the scales of the MADs: 0 with no correlations, 1 with those of tanh(z), 2 with those of z / |z|."""
    p = len(names)
    long = vectors.select("cohort", F.expr("inline(array(" + ", ".join(f"named_struct('name', '{a}', 'x', __tw_x_{a})" for a in names) + "))"))
    median = materialize(_quantile(long, ["cohort", "name"], F.expr(f"CAST(round(x * {GRID}) AS INT)"), 0.5), "mcd-median").withColumnRenamed("q", "mid")
    spread = _quantile(long.join(small(median), ["cohort", "name"]), ["cohort", "name"], F.expr(f"CAST(round(abs(x - mid / {GRID}) * {GRID}) AS INT)"), 0.5)
    of = lambda a, c: f"max(CASE WHEN name = '{a}' THEN {c} / {GRID} END)"
    mids = median.join(spread, ["cohort", "name"]).groupBy("cohort").agg(*[F.expr(f"{of(a, 'mid')} AS c_{a}") for a in names], *[F.expr(f"1.4826D * {of(a, 'q')} AS d_{i}") for i, a in enumerate(names)])
    mids = materialize(mids, "mcd-mids")
    z = [f"(__tw_x_{a} - c_{a}) / sqrt(d_{i} * d_{i} + {_num(floors[a] ** 2)})" for i, a in enumerate(names)]
    rows = vectors.join(small(mids), "cohort").selectExpr("cohort", *[f"{c} AS z_{i}" for i, c in enumerate(z)])
    norm = f"greatest(sqrt({' + '.join(f'z_{i} * z_{i}' for i in range(p))}), 1e-9D)"
    rows = rows.selectExpr("cohort", *[f"tanh(z_{i}) AS z1_{i}" for i in range(p)], *[f"z_{i} / {norm} AS z2_{i}" for i in range(p)])
    found = mids.join(rows.groupBy("cohort").agg(*[F.expr(f"avg({z}_{i} * {z}_{j}) AS {z}_{i}_{j}") for z in ("z1", "z2") for i, j in _pairs(names)]), "cohort")

    def covariance(i: int, j: int) -> str:
        r = lambda z: f"coalesce(try_divide({z}_{i}_{j}, sqrt({z}_{i}_{i} * {z}_{j}_{j})), 0D)"
        return f"d_{i} * d_{i}" if i == j else f"d_{i} * d_{j} * CASE start WHEN 1 THEN {r('z1')} WHEN 2 THEN {r('z2')} ELSE 0D END"

    cs = [f"c_{a}" for a in names]
    found = found.selectExpr("*", "explode(array(0, 1, 2)) AS start").selectExpr("cohort", "start", *cs, *[f"c_{a} AS m_{a}" for a in names], *[f"{covariance(i, j)} AS u_{i}_{j}" for i, j in _pairs(names)])
    found = _invert(found, ["cohort", "start", *cs, *[f"m_{a}" for a in names]], lambda i, j: f"u_{i}_{j}", names, floors)
    return found.withColumn("logdet", F.lit(float("inf")))


def fit_mcd(vectors: DataFrame, rules: Rules, small=F.broadcast) -> DataFrame:
    """vectors: cohort, __tw_x_*. Gives one row a cohort: cohort, c_*, m_*, v_*_*, w_*_*, logdet.

    Concentration steps from three starts; after two of them the start with the least determinant goes on, until no
    cohort's determinant falls further. Each cohort keeps the least determinant that it met. small marks tables of a row
    or a few for each cohort for their joins.
    """
    names, floors = list(rules.floors), rules.floors
    p = len(names)
    params = materialize(_starts(vectors, names, floors, small), "mcd-starts")
    consistency = 0.5 / _chi2_cdf(chi2_quantile(0.5, p), p + 2)
    keys = ["cohort", "start"]
    cell = F.floor(F.log(F.col("d2") + 1e-9) * (GRID // 4)).cast("int")
    for k in range(rules.max_steps):
        near = vectors.join(small(params), "cohort").withColumn("d2", _distance2(names)).withColumn("cell", cell)
        limit = materialize(_quantile(near, keys, F.col("cell"), 0.5), f"mcd-half-{k}")
        after = _moments(near.join(small(limit), keys).filter("cell <= q"), keys, names, consistency, floors)
        packed = lambda df, name: df.selectExpr(*keys, f"struct({', '.join(_estimate(names))}) AS {name}")
        both = packed(after, "new").join(packed(params, "old"), keys).withColumn("falls", F.expr("new.logdet < old.logdet - 1e-6D"))
        both = both.selectExpr(*keys, "falls", "CASE WHEN falls THEN new ELSE old END AS e")
        if k == 1:
            both = both.groupBy("cohort").agg(F.expr("min_by(struct(start, falls, e), struct(e.logdet, start)) AS b")).select("cohort", "b.*")
        both = materialize(both, f"mcd-{k}")
        params = both.select(*keys, "e.*")
        collect_garbage(vectors.sparkSession)  # plans and broadcasts of a step, else the driver's heap grows with the steps
        if k and both.filter("falls").isEmpty():
            break
    q = rules.reweight_quantile
    near = vectors.join(small(params), "cohort").withColumn("d2", _distance2(names)).filter(F.col("d2") <= chi2_quantile(q, p))
    return materialize(_moments(near, ["cohort"], names, q / _chi2_cdf(chi2_quantile(q, p), p + 2), floors), "mcd-final")


def _shrunk(sizes: DataFrame, params: DataFrame, names: list[str], rules: Rules) -> DataFrame:
    """(__tw_lang, __tw_source, m_*, w_*_*): the estimate of each language and source, drawn to that of the language and that to the one of all by prior_rows pseudo-rows."""
    values = [f"m_{a}" for a in names] + [f"v_{i}_{j}" for i, j in _pairs(names)]
    level = lambda tag: params.selectExpr(f"cohort AS {tag}_cohort", f"struct({', '.join(values)}) AS {tag}")
    out = sizes.withColumn("lang_n", F.sum("n").over(Window.partitionBy("__tw_lang")))
    out = out.join(level("own"), F.concat_ws("\x01", "__tw_lang", "__tw_source") == F.col("own_cohort"))
    out = out.join(level("lang"), F.col("__tw_lang") == F.col("lang_cohort")).join(level("everyone"), F.col("everyone_cohort") == "")
    k = _num(float(rules.prior_rows))
    mix = lambda c: f"(n * own.{c} + {k} * (lang_n * lang.{c} + {k} * everyone.{c}) / (lang_n + {k})) / (n + {k})"
    ms, where = [f"m_{a}" for a in names], ["__tw_lang", "__tw_source"]
    out = out.selectExpr(*where, *[f"{mix(c)} AS {c}" for c in ms], *[f"{mix(f'v_{i}_{j}')} AS u_{i}_{j}" for i, j in _pairs(names)])
    out = _invert(out, [*where, *ms], lambda i, j: f"u_{i}_{j}", names, dict.fromkeys(names, 1e-3))  # the floors are in the estimates already
    return out.select(*where, *ms, *[f"w_{i}_{j}" for i, j in _pairs(names)])


def judge(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep_text: bool = True) -> DataFrame:
    """docs, without the text unless keep_text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance2, kept.

    Input columns with these names are replaced. A null text has no words and fails the base rules. Null languages
    and sources are values of their own. Every language and source has its own estimate, whatever its size, drawn to
    that of its language and of all documents. Rows are judged one by one, so repeated rows stay. A language and source
    without a document that passes the base rules has no distance2.
    """
    names, p = list(rules.floors), len(rules.floors)
    rows = add_base(docs, rules, text_col)
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("?"))
    rows = rows.withColumns({"__tw_lang": part(lang_col), "__tw_source": part(source_col)})
    # Written before anything is filtered: a filter would be pushed below the statistics and compute them again.
    table = materialize(rows if keep_text else rows.drop(text_col), "quality-vectors")
    fitted = table.filter("not base_failed").select("__tw_lang", "__tw_source", *[f"__tw_x_{a}" for a in names])
    sizes = materialize(fitted.groupBy("__tw_lang", "__tw_source").agg(F.count(F.lit(1)).alias("n")), "cohorts")
    levels = F.array(F.concat_ws("\x01", "__tw_lang", "__tw_source"), F.col("__tw_lang"), F.lit(""))
    vectors = materialize(fitted.withColumn("cohort", F.explode(levels)).drop("__tw_lang", "__tw_source"), "cohort-vectors")
    # A broadcast of at most some ten rows of seventy numbers for each language and source, unless there are very many of these.
    small = F.broadcast if sizes.count() <= BROADCAST_COHORTS else lambda df: df
    params = materialize(_shrunk(sizes, fit_mcd(vectors, rules, small), names, rules), "quality-estimates")

    out = table.join(small(params), ["__tw_lang", "__tw_source"], "left")
    out = out.withColumn("distance2", F.when(F.col("w_0_0").isNotNull(), _distance2(names)))
    cutoff = chi2_quantile(rules.reject_quantile, p)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= cutoff))
    return out.drop("__tw_lang", "__tw_source", *[f"__tw_x_{a}" for a in names], *[f"m_{a}" for a in names], *[f"w_{i}_{j}" for i in range(p) for j in range(i + 1)])


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that judge() keeps, with the columns of docs."""
    return judge(docs, rules).filter("kept").select(*[F.col(f"`{c}`") for c in docs.columns])
