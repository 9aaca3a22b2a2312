"""Anchor scores, joint log scores, and decoding under exact class counts for each subject, of any number of rows."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewell.functions.columns import sigmoid
from tidewell.sources.shared import stored

from .aggregate import exact_top
from .metrics import summary
from .normalize import _scaled

EPS = 1e-6


def log_clipped(p: Column) -> Column:
    return F.log(F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p)))


def anchor_scores(df: DataFrame, columns: list[str], p: str, k: int, weight: float, mode: str = "center", key: str = "segment_id", by: str = "subject") -> DataFrame:
    """anchor_dist and anchor_score = z(p) - weight * z(distance to the mean of the subject's k most probable rows).

    mode center: root mean square of the differences; z: mean absolute difference by the anchors' deviation.
    """
    marked = exact_top(df, by, p, key, k, "__anchor")
    w = Window.partitionBy(by)
    at = lambda c: F.when(F.col("__anchor") == 1, F.col(c))
    diffs = []
    for c in columns:
        d = F.col(c) - F.avg(at(c)).over(w)
        diffs.append(d * d if mode == "center" else F.abs(_scaled(F.col(c), F.avg(at(c)).over(w), F.stddev_pop(at(c)).over(w))))
    mean = sum(diffs[1:], diffs[0]) / len(columns)
    out = marked.withColumn("anchor_dist", F.sqrt(mean) if mode == "center" else mean)
    z = lambda c: _scaled(F.col(c), F.avg(c).over(w), F.stddev_pop(c).over(w))
    return out.withColumn("anchor_score", z(p) - weight * z("anchor_dist")).drop("__anchor")


def distance_confidence(df: DataFrame, dist: str = "anchor_dist", by: str = "subject") -> DataFrame:
    """confidence: a sigmoid of the subject's median distance minus the distance, by the deviation."""
    w = Window.partitionBy(by)
    return df.withColumn("confidence", sigmoid(_scaled(F.median(dist).over(w) - F.col(dist), F.lit(0.0), F.stddev_pop(dist).over(w))))


def joint_scores(df: DataFrame, p0: str, p1: str, w: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """s0, s1, s2: weighted log probabilities of class 0, and of classes 1 and 2 as the second stage parts the rest."""
    rest = log_clipped(1 - F.col(p0))
    return df.withColumns({"s0": w[0] * log_clipped(F.col(p0)), "s1": w[1] * (rest + log_clipped(F.col(p1))), "s2": w[2] * (rest + log_clipped(1 - F.col(p1)))})


def gated_scores(df: DataFrame, p0: str, p1: str, confidence: str, w: tuple[float, float, float] = (1.0, 1.0, 1.0), mode: str = "gate", alpha: float = 0.5) -> DataFrame:
    """s0, s1, s2 with a confidence: gate weighs the second stage by 0.5 + confidence; aux adds alpha times its log, or that of its rest for class 0."""
    rest, c = log_clipped(1 - F.col(p0)), F.col(confidence)
    gain, yes, no = (0.5 + c, F.lit(0.0), F.lit(0.0)) if mode == "gate" else (F.lit(1.0), alpha * log_clipped(c), alpha * log_clipped(1 - c))
    second = lambda p: w[1] * rest + w[2] * gain * log_clipped(p) + yes
    return df.withColumns({"s0": w[0] * log_clipped(F.col(p0)) + no, "s1": second(F.col(p1)), "s2": second(1 - F.col(p1))})


def class_scores(df: DataFrame, probabilities: list[str]) -> DataFrame:
    """s0, s1, ...: log probabilities of a model of all classes."""
    return df.withColumns({f"s{k}": log_clipped(F.col(p)) for k, p in enumerate(probabilities)})


@dataclass(frozen=True)
class Decoding:
    in_task: int = 200_000  #: most rows of a group that one task decodes
    sample: int = 50_000  #: rows from which a larger group's prices are first taken
    near: float = 0.05  #: share of rows, nearest to another class, that stay open at those prices
    seed: int = 42


def sweep_weights(
    df: DataFrame, p0: str, p1: str, y: str, weights: list[tuple[float, float, float]], counts: DataFrame, key: str = "segment_id", by: str = "subject", s: Decoding = Decoding()
) -> DataFrame:
    """(w0, w1, w2, accuracy, balanced_accuracy, macro_f1, n) of exact-count decoding with each triple of weights.

    A task decodes a subject with every triple and gives how many rows of each class it labelled how. Subjects of more than s.in_task rows are decoded as in exact_count_decode.
    """
    spark, kinds = df.sparkSession, {f.name: f.dataType.simpleString() for f in df.schema}
    rest = log_clipped(1 - F.col(p0))
    logs = df.select(by, key, y, log_clipped(F.col(p0)).alias("__l0"), (rest + log_clipped(F.col(p1))).alias("__l1"), (rest + log_clipped(1 - F.col(p1))).alias("__l2"))
    given = counts.select(by, F.array(*[F.col(f"n{c}").cast("long") for c in range(3)]).alias("__n"))
    sizes = df.groupBy(by).agg((F.count(F.lit(1)) > s.in_task).alias("__large")).join(given, by)
    rows, w = logs.join(sizes, by), np.array(weights, float)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by group and key; a group at a time."""
        totals: Counter = Counter()
        held: list[pa.RecordBatch] = []

        def decoded() -> None:
            g = pa.Table.from_batches(held)
            x, n = np.stack([g.column(f"__l{c}").to_numpy() for c in range(3)], 1), g.column("__n")[0].as_py()
            code, names = pd.factorize(g.column("__y").to_pandas(), use_na_sentinel=False)
            step = max(1, 1_000_000 // len(x))
            for at in range(0, len(w), step):
                for i, pred in enumerate(count_labels(w[at : at + step, None, :] * x, n), at):
                    for cell, m in enumerate(np.bincount(3 * code + pred, minlength=3 * len(names)).tolist()):
                        if m:
                            totals[i, names[cell // 3], cell % 3] += m

        for batch in batches:
            of = batch.column("__by").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:], strict=False) if len(of) else ():
                part = batch.slice(a, b - a)
                if held and held[0].column("__by")[0] != part.column("__by")[0]:
                    decoded()
                    held = []
                held.append(part)
        if held:
            decoded()
        if totals:
            g, truth, pred = zip(*totals, strict=True)
            truth = pa.array([None if pd.isna(v) else v for v in truth], of_y)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), truth, pa.array(pred, pa.int32()), pa.array(totals.values(), pa.int64())], ["__g", "__y", "pred", "__m"])

    of_y = to_arrow_type(df.schema[y].dataType)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    small = rows.filter("not __large").select(F.col(by).alias("__by"), F.col(key).alias("__key"), F.col(y).alias("__y"), "__l0", "__l1", "__l2", "__n")
    cells = small.repartition(tasks, "__by").sortWithinPartitions("__by", "__key").drop("__key").mapInArrow(solve, f"__g int, __y {kinds[y]}, pred int, __m long")
    if not sizes.filter("__large").isEmpty():
        grid = F.array(*[F.struct(*[F.lit(float(v)).alias(f"w{i}") for i, v in enumerate(t)]) for t in weights])
        x = rows.filter("__large").select(by, key, y, "__n", "__l0", "__l1", "__l2", F.posexplode(grid).alias("__g", "__w")).withColumns({f"s{c}": F.col(f"__w.w{c}") * F.col(f"__l{c}") for c in range(3)})
        x = x.withColumn("__case", F.concat_ws("|", F.col(by).cast("string"), F.col("__g").cast("string")))
        cases = x.select("__case", *[F.col("__n")[c].alias(f"n{c}") for c in range(3)]).distinct()
        pred = exact_count_decode(x, ["s0", "s1", "s2"], cases, key, "__case", s=s)
        cells = cells.unionByName(x.join(pred, ["__case", key]).select("__g", F.col(y).alias("__y"), "pred", F.lit(1).cast("long").alias("__m")))
    found = summary(cells, "__y", "pred", ["__g"], "__m")
    triples = spark.createDataFrame([(i, *map(float, t)) for i, t in enumerate(weights)], "__g int, w0 double, w1 double, w2 double")
    return triples.join(found, "__g").drop("__g")


def exact_count_labels(scores: np.ndarray, counts: Sequence[int]) -> np.ndarray:
    """The labels of greatest total score with exactly counts[k] of class k.

    Dynamic programming over the numbers used so far of each class; of equal totals the one reached by the lower class stays.
    """
    n, k = scores.shape
    if sum(counts) != n:
        raise ValueError(f"counts sum to {sum(counts)}, rows are {n}")
    if k == 1:
        return np.zeros(n, np.int64)
    shape = tuple(c + 1 for c in counts[:-1])  # of the last class there are as many as the others leave
    used = sum(np.indices(shape))
    best = np.full(shape, -np.inf)
    best[(0,) * (k - 1)] = 0.0
    picks = np.full((n, *shape), -1, np.int8)
    for i, row in enumerate(scores):
        new, pick = np.full(shape, -np.inf), picks[i]
        for c in range(k):
            to = tuple(slice(1, None) if j == c else slice(None) for j in range(k - 1))
            frm = tuple(slice(None, -1) if j == c else slice(None) for j in range(k - 1))
            cand = best[frm] + row[c]
            if c == k - 1:
                cand = np.where(i + 1 - used <= counts[-1], cand, -np.inf)
            better = cand > new[to]
            new[to] = np.where(better, cand, new[to])
            pick[to] = np.where(better, c, pick[to])
        best = new
    at, out = list(counts[:-1]), np.zeros(n, np.int64)
    for i in range(n - 1, -1, -1):
        c = out[i] = int(picks[i][tuple(at)])
        if c < k - 1:
            at[c] -= 1
    return out


def count_flow(scores: np.ndarray, counts: Sequence[int], prices: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Labels of greatest total score with exactly counts[k] of class k, and prices that prove it.

    Rows first take their best class at given prices, which is optimal for the counts that come out. Then one row after the other goes from
    a class with too many to one with too few along the path between classes that loses least; of rows that lose the same the
    first moves. At the prices every row's class is its best: score - price, so no other labels with these counts have a greater total.
    """
    n, k = scores.shape
    counts = _checked(counts, n)
    price = np.zeros((1, k)) if prices is None else np.array(prices, float)[None]
    price = _approach(scores[None], counts, price)[0]
    label = _moved(scores, counts, price)
    for _ in range(k):  # price[b] - price[a] is at least what a row of a would gain in b
        for a in range(k):
            own = label == a
            if own.any():
                price = np.maximum(price, np.where(np.arange(k) == a, -np.inf, price[a] + (scores[own] - scores[own, a, None]).max(0)))
    return label, price


def count_labels(scores: np.ndarray, counts: Sequence[int]) -> Iterator[np.ndarray]:
    """The labels of count_flow for each of several scores of the same rows: cases x rows x classes."""
    counts = _checked(counts, scores.shape[1])
    prices = _approach(scores, counts, np.zeros((len(scores), scores.shape[2])))
    return (_moved(x, counts, price) for x, price in zip(scores, prices, strict=True))


def _checked(counts: Sequence[int], n: int) -> np.ndarray:
    counts = np.asarray(counts, np.int64)
    if counts.sum() != n or (counts < 0).any():
        raise ValueError(f"counts sum to {counts.sum()}, rows are {n}")
    return counts


def _moved(scores: np.ndarray, counts: np.ndarray, price: np.ndarray) -> np.ndarray:
    """Labels: each row's best class at the prices, and then as few rows moved as the counts need."""
    k = len(price)
    label = (scores - price).argmax(1)
    excess = np.bincount(label, minlength=k) - counts
    heaps: dict[tuple[int, int], list] = {}
    for a in range(k) if excess.any() else ():
        at = np.flatnonzero(label == a)
        for b in range(k):
            if a != b:
                heaps[a, b] = list(zip((scores[at, a] - scores[at, b]).tolist(), at.tolist(), strict=True))
                heapq.heapify(heaps[a, b])

    def loss(a: int, b: int) -> float:
        h = heaps[a, b]
        while h and label[h[0][1]] != a:
            heapq.heappop(h)
        return h[0][0] if h else math.inf

    while excess.any():
        cost = [[loss(a, b) if a != b else math.inf for b in range(k)] for a in range(k)]
        far, came = [0.0 if e > 0 else math.inf for e in excess], [-1] * k
        for _ in range(k - 1):
            for a in range(k):
                for b in range(k):
                    if far[a] + cost[a][b] < far[b] - 1e-12:
                        far[b], came[b] = far[a] + cost[a][b], a
        b = min((j for j in range(k) if excess[j] < 0), key=lambda j: far[j])
        excess[b] += 1
        while (a := came[b]) >= 0:
            i = heaps[a, b][0][1]
            label[i] = b
            for c in range(k):
                if c != b:
                    heapq.heappush(heaps[b, c], (float(scores[i, b] - scores[i, c]), i))
            b = a
        excess[b] -= 1
    return label


def _approach(scores: np.ndarray, counts: np.ndarray, price: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Prices (cases x classes) at which about the right numbers choose each class: each class in turn takes the price at which exactly its number does."""
    n, k = scores.shape[1:]

    def off(x: np.ndarray, price: np.ndarray) -> np.ndarray:
        label = (x - price[:, None]).argmax(2)
        return sum(np.abs((label == c).sum(1) - counts[c]) for c in range(k))

    best, least = price.copy(), off(scores, price)
    for r in range(rounds if n else 0):
        on = np.flatnonzero(least > 2 * k)
        if not len(on):
            break
        c = r % k
        if not 0 < counts[c] < n:
            continue
        x, at = scores[on], price[on]
        other = (x - at[:, None])[:, :, [j for j in range(k) if j != c]].max(2)
        at[:, c] = np.partition(x[:, :, c] - other, n - counts[c] - 1)[:, n - counts[c] - 1]
        price[on], now = at, off(x, at)
        better = on[now < least[on]]
        best[better], least[better] = price[better], now[now < least[on]]
    return best


def exact_count_decode(df: DataFrame, scores: list[str], counts: DataFrame, key: str = "segment_id", by: str = "subject", label: str = "pred", s: Decoding = Decoding()) -> DataFrame:
    """(by, key, pred): the labels of each subject with the greatest total score under its exact class counts; counts: (by, n0, n1, ...), one row a subject.

    Groups of up to s.in_task rows are decoded in one task. Of larger ones, a seeded choice of rows gives class prices, at which most rows' classes
    are clear; the others stay open, with the counts that are left, and so on until a task can hold them. Its final prices are then
    checked on all rows: if every row's class is its best at them, the labels are optimal, as in small groups. If not, more rows stay
    open. Equal totals are settled by key.
    """
    k, names = len(scores), [f"n{i}" for i in range(len(scores))]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    given = counts.select(F.col(by).alias("__by"), F.array(*[F.col(n).cast("long") for n in names]).alias("__n"))
    rows = df.select(F.col(by).alias("__by"), F.col(key).alias("__key"), F.array(*[F.col(c).cast("double") for c in scores]).alias("__s"))
    sizes = rows.groupBy("__by").agg(F.count(F.lit(1)).alias("__rows")).join(given, "__by")
    total = F.aggregate("__n", F.lit(0).cast("long"), lambda a, x: a + x)
    wrong = F.concat(F.lit("counts sum to "), total.cast("string"), F.lit(", rows are "), F.col("__rows").cast("string"))
    sizes = sizes.withColumn("__n", F.when(total == F.col("__rows"), F.col("__n")).otherwise(F.raise_error(wrong)))
    schema = f"`__by` {kinds[by]}, `__key` {kinds[key]}, `__pred` int, `__price` array<double>"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by group and key; a group at a time."""
        held: list[pa.RecordBatch] = []

        def decoded() -> pa.RecordBatch:
            g = pa.Table.from_batches(held).combine_chunks()
            x = g.column("__s").combine_chunks().flatten().to_numpy().reshape(-1, k)
            pred, price = count_flow(x, g.column("__n")[0].as_py())
            prices = pa.array([price.tolist()] + [None] * (len(pred) - 1), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([*(g.column(c).combine_chunks() for c in ("__by", "__key")), pa.array(pred.astype(np.int32)), prices], ["__by", "__key", "__pred", "__price"])

        for batch in batches:
            of = batch.column("__by").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:], strict=False) if len(of) else ():
                part = batch.slice(a, b - a)
                if held and held[0].column("__by")[0] != part.column("__by")[0]:
                    yield decoded()
                    held = []
                held.append(part)
        if held:
            yield decoded()

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def solved(open_rows: DataFrame, left: DataFrame) -> DataFrame:
        # so many tasks however small the rows are: the work is in the decoding
        return open_rows.join(left, "__by").repartition(tasks, "__by").sortWithinPartitions("__by", "__key").mapInArrow(solve, schema)

    named = lambda d: d.select(F.col("__by").alias(by), F.col("__key").alias(key), F.col("__pred").alias(label))
    small = solved(rows, sizes.filter(F.col("__rows") <= s.in_task).drop("__rows"))
    if sizes.filter(F.col("__rows") > s.in_task).isEmpty():
        return named(small)
    large = sizes.filter(F.col("__rows") > s.in_task)
    return named(small.drop("__price")).unionByName(named(_decode_large(rows.join(large.select("__by"), "__by", "left_semi"), large, k, s, solved, kinds[by])))


def _decode_large(rows: DataFrame, sizes: DataFrame, k: int, s: Decoding, solved, kind: str) -> DataFrame:
    """(__by, __key, __pred) of groups that no single task decodes."""
    rows, sizes = stored(rows, "large"), stored(sizes, "sizes")
    done, todo, near = None, sizes, s.near
    while True:
        out = _narrowed(rows.join(todo.select("__by"), "__by", "left_semi"), todo, k, s, near, solved, kind)
        # a group is settled if all of its rows are best where they are at its final prices
        price = out.filter("__price is not null").select("__by", F.col("__price").alias("__p"))
        all_ = rows.join(out.select("__by", "__key", "__pred"), ["__by", "__key"]).join(price, "__by")
        gain = F.array_max(F.zip_with("__s", "__p", lambda a, b: a - b)) - (F.get("__s", F.col("__pred")) - F.get("__p", F.col("__pred")))
        bad = all_.groupBy("__by").agg(F.max(gain).alias("__gain")).filter(F.col("__gain") > 1e-9)
        left = stored(todo.join(bad, "__by", "left_semi"), "unsettled")
        fine = out.join(left, "__by", "left_anti").select("__by", "__key", "__pred")
        done = fine if done is None else done.unionByName(fine)
        if left.isEmpty():
            return done
        todo, near = left, min(1.0, 4 * near)


def _narrowed(rows: DataFrame, sizes: DataFrame, k: int, s: Decoding, near: float, solved, kind: str) -> DataFrame:
    """Labels of all rows, and the final prices of each group on one of its rows."""
    fixed, open_rows, left = None, rows, sizes.select("__by", "__rows", "__n")
    while near < 1 and not left.filter(F.col("__rows") > s.in_task).isEmpty():
        pick = F.pmod(F.xxhash64(F.lit(s.seed), "__key"), F.greatest("__rows", F.lit(1))) < s.sample
        chosen = open_rows.join(left, "__by").filter(pick)

        def price(g: pd.DataFrame) -> pd.DataFrame:
            x, n = np.stack(g["__s"].to_list()), np.asarray(g["__n"].iloc[0], float)
            share = np.floor(n / n.sum() * len(x)).astype(int)
            share[np.argsort(-(n / n.sum() * len(x) - share), kind="stable")[: len(x) - share.sum()]] += 1
            return pd.DataFrame({"__by": g["__by"].iloc[:1], "__p": [count_flow(x, share)[1].tolist()]})

        prices = stored(chosen.select("__by", "__s", "__n").groupBy("__by").applyInPandas(price, f"`__by` {kind}, `__p` array<double>"), "prices")
        value = F.zip_with("__s", "__p", lambda a, b: a - b)
        at = open_rows.join(prices, "__by").withColumn("__v", value)
        order = F.sort_array("__v", asc=False)
        at = at.withColumns({"__pred": (F.array_position("__v", F.array_max("__v")) - 1).cast("int"), "__margin": F.get(order, F.lit(0)) - F.get(order, F.lit(1))}).drop("__v", "__p")
        edge = at.join(left.select("__by", "__rows"), "__by").groupBy("__by").agg(F.percentile_approx("__margin", near, 10_000).alias("__edge"), F.first("__rows").alias("__all"))
        at = stored(at.join(edge, "__by").withColumn("__open", (F.col("__margin") <= F.col("__edge")) | (F.col("__all") <= s.in_task)).drop("__edge", "__all"), "marked")
        clear = at.filter(~F.col("__open"))
        taken = clear.groupBy("__by").agg(F.array(*[F.count_if(F.col("__pred") == c) for c in range(k)]).alias("__t"))
        after = left.join(taken, "__by", "left").withColumn("__n", F.coalesce(F.zip_with("__n", "__t", lambda a, b: a - b), F.col("__n"))).drop("__t")
        after = stored(after.withColumn("__rows", F.aggregate("__n", F.lit(0).cast("long"), lambda a, x: a + x)), "left")
        if not after.filter(F.exists("__n", lambda x: x < 0)).isEmpty():  # prices were too far off for so few open rows
            near = min(1.0, 4 * near)
            continue
        clear = clear.select("__by", "__key", "__pred")
        fixed = clear if fixed is None else fixed.unionByName(clear)
        open_rows, left = at.filter("__open").select("__by", "__key", "__s"), after
    last = solved(open_rows, left.drop("__rows"))
    none = F.lit(None).cast("array<double>").alias("__price")
    return stored(last if fixed is None else last.unionByName(fixed.select("*", none)), "decoded")


def decode_stored(table: DataFrame, config: str, which: str, p0: str, p1: str, y: str, w: tuple[float, float, float], key: str = "segment_id", by: str = "subject") -> DataFrame:
    """Metrics of one configuration's stored predictions, decoded with weights w under the true class counts (y: 0, 1, 2) of each subject."""
    one = table.filter(F.col(config) == which)
    counts = one.groupBy(by).agg(*[F.count_if(F.col(y) == k).alias(f"n{k}") for k in range(3)])
    pred = exact_count_decode(joint_scores(one, p0, p1, w), ["s0", "s1", "s2"], counts, key, by, "decoded").select(key, "decoded")
    return summary(one.join(pred, key), y, "decoded")


def split_top_k(df: DataFrame, p0: str, p1: str, k0: Column | int, k1: Column | int, key: str = "segment_id", by: str = "subject", label: str = "pred") -> DataFrame:
    """Class 0 for the k0 rows of greatest p0, then 1 for the k1 of greatest p1 among the rest, else 2."""
    w = Window.partitionBy(by)
    out = df.withColumn("__zero", F.row_number().over(w.orderBy(F.desc(p0), key)) <= k0)
    place = F.row_number().over(Window.partitionBy(by, "__zero").orderBy(F.desc(p1), key))
    return out.withColumn(label, F.when(F.col("__zero"), 0).when(place <= k1, 1).otherwise(2)).drop("__zero")


def unconstrained(df: DataFrame, p0: str, p1: str, label: str = "pred") -> DataFrame:
    return df.withColumn(label, F.when(F.col(p0) >= 0.5, 0).when(F.col(p1) >= 0.5, 1).otherwise(2))
