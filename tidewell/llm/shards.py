"""Sharding by histogram sort.

Rows are ordered by a 63-bit key: 39 bits of the text's hash above 24 bits of a hash of
(id, text, copy), so equal texts stand together and yet a group that holds a third of all rows
can be cut anywhere; copy numbers the rows that are equal in id and text. Rounds count the exact bytes and rows between candidate boundaries;
the cells that hold a splitter not yet within tolerance, or too many rows, get finer
probes between their least and greatest key. Once all splitters meet the tolerance, every
row is exchanged once, by cell; a cell lies in one shard and its rows are bounded, so slots
are numbered cell by cell, starting from the rows of the shard's earlier cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, materialize, without

KEY_BITS = 63
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Probes:
    """Candidate boundaries lo, lo + step, ... below hi."""

    lo: int
    hi: int
    step: int


def _key(id_col: Column, text: Column, copy: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 25), 24)
    return high.bitwiseOR(F.xxhash64(id_col, text, copy).bitwiseAND(F.lit((1 << 24) - 1)))


def _cell(key: Column, levels: list[list[Probes]]) -> Column:
    """The least key of the finest cell that key lies in."""

    def within(p: Probes) -> Column:
        return F.lit(p.lo) + F.expr(f"(__tw_key - {p.lo}L) div {p.step}L") * F.lit(p.step)

    out = within(levels[0][0])
    for level in levels[1:]:
        finer = None
        for p in level:
            hit = (key >= F.lit(p.lo)) & (key < F.lit(p.hi))
            finer = F.when(hit, within(p)) if finer is None else finer.when(hit, within(p))
        if finer is not None:
            out = F.coalesce(finer, out)
    return out


def find_splitters(keyed: DataFrame, n_shards: int, tolerance: float, probes: int, cell_rows: int, max_rounds: int):
    """keyed: __tw_key, __tw_size. Gives the probe levels and the n_shards - 1 splitters (least key of the shard).

    There are probes cells or as many as give cells of cell_rows rows; those of more than four times as many are cut
    further. The driver holds the counts of all cells: a few numbers for each cell_rows rows.
    """
    most_rows = keyed.count()
    cell_rows = max(16, min(cell_rows, most_rows // 512))
    levels = [[Probes(0, 1 << KEY_BITS, (1 << KEY_BITS) // max(probes, most_rows // cell_rows))]]
    cells: dict[int, tuple[int, int, int, int]] = {}
    key = F.col("__tw_key")
    splitters: list[int] = []
    refine: dict[int, Probes] = {}
    for _ in range(max_rounds):
        finest = levels[-1]
        part = keyed
        if len(levels) > 1:
            inside = F.lit(False)
            for p in finest:
                inside = inside | ((key >= F.lit(p.lo)) & (key < F.lit(p.hi)))
            part = keyed.filter(inside)
        counts = part.groupBy(_cell(key, levels).alias("cell")).agg(
            F.sum("__tw_size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("__tw_key").alias("lo"), F.max("__tw_key").alias("hi")
        )
        for parent in refine:
            del cells[parent]
        cells.update({r.cell: (r.bytes, r.n, r.lo, r.hi) for r in counts.collect()})
        order = sorted(cells)
        total = sum(c[0] for c in cells.values())
        slack = tolerance * total / n_shards
        refine, splitters, below, k = {}, [], 0, 1
        for lo in order:
            size, n, least, most = cells[lo]
            can = most > least
            while k < n_shards and below + size >= k * total / n_shards:
                at = k * total / n_shards
                near_lo, near_hi = at - below, below + size - at
                if can and min(near_lo, near_hi) > slack:
                    refine[lo] = Probes(least, most + 1, max(1, -(-(most + 1 - least) // probes)))
                splitters.append(lo if near_lo <= near_hi else lo + 1)  # lo + 1: the next cell's
                k += 1
            if can and n > 4 * cell_rows:
                refine[lo] = Probes(least, most + 1, max(1, -(-(most + 1 - least) // probes)))
            below += size
        splitters = [s if s in cells else next((c for c in order if c >= s), (1 << KEY_BITS) - 1) for s in splitters]
        if not refine:
            break
        levels.append(list(refine.values()))
    else:
        raise RuntimeError("splitters do not meet the tolerance: raise max_rounds")
    return levels, splitters


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with __tw_copy, which numbers rows that are equal in all columns, so that they can be told apart.

    Ids and texts are hashed first; only rows whose hash occurs twice or more are grouped, and these groups are counted
    before they are shuffled.
    """
    hashed = docs.withColumn("__tw_row", F.xxhash64(F.lit(1), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))
    twice = materialize(hashed.groupBy("__tw_row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__tw_row"), "repeated-rows")
    zero = F.lit(0).cast("long")
    if twice.isEmpty():
        return docs.withColumn("__tw_copy", zero)
    twice = broadcast_if(twice, BROADCAST_ROWS)
    once = hashed.join(twice, "__tw_row", "left_anti").withColumn("__tw_copy", zero)
    more = hashed.join(twice, "__tw_row", "left_semi").groupBy(*[F.col(f"`{c}`") for c in hashed.columns]).agg(F.count(F.lit(1)).alias("__tw_n"))
    more = more.withColumn("__tw_copy", F.explode(F.sequence(zero, F.col("__tw_n") - 1))).drop("__tw_n")
    return once.unionByName(more).drop("__tw_row")


def shard(
    docs: DataFrame,
    n_shards: int = 8,
    tolerance: float = 0.001,
    probes: int = 1024,
    cell_rows: int = 1_000_000,
    max_rounds: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """docs with size, text_crc32, shard and slot; input columns with these names are replaced.

    size: UTF-8 bytes plus 1 (null text: 1). text_crc32: of the UTF-8 bytes (null: 0). Shards hold bytes that
    differ from an eighth (for 8 shards) by at most the tolerance, or by one row where one row is larger. Slots
    run from 0 in each shard in the order of key, id and checksum; repeated rows get slots of their own, and may
    stand in several shards. A null id is a value like any other. An empty table gives an empty table.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = _numbered(docs, id_col, text_col)
    rows = rows.withColumn("__tw_key", _key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.col("__tw_copy"))).drop("__tw_copy")
    rows = rows.withColumn("__tw_size", F.octet_length(text).cast("long") + 1).withColumn("__tw_crc", F.crc32(text.cast("binary")))
    keyed = materialize(rows.select("__tw_key", "__tw_size"), "shard-keys")
    levels, splitters = find_splitters(keyed, n_shards, tolerance, probes, cell_rows, max_rounds)

    def shard_of(c: Column) -> Column:
        out = F.lit(0)
        for s in splitters:
            out = out + (c >= F.lit(s)).cast("int")
        return out

    cell = _cell(F.col("__tw_key"), levels)
    cells = keyed.groupBy(cell.alias("__tw_cell")).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("__tw_shard", shard_of(F.col("__tw_cell")))
    before = Window.partitionBy("__tw_shard").orderBy("__tw_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("__tw_cell", "__tw_shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__tw_first"))
    # Three numbers a cell, and a cell has some cell_rows rows: broadcast unless there are very many.
    out = rows.withColumn("__tw_cell", cell).join(broadcast_if(cells, BROADCAST_ROWS), "__tw_cell")
    place = F.row_number().over(Window.partitionBy("__tw_cell").orderBy("__tw_key", F.col(f"`{id_col}`"), "__tw_crc"))
    out = out.withColumn("__tw_slot", F.col("__tw_first") + place - 1)
    out = without(out, "size", "text_crc32", "shard", "slot")
    return out.withColumnsRenamed({"__tw_size": "size", "__tw_crc": "text_crc32", "__tw_shard": "shard", "__tw_slot": "slot"}).drop("__tw_key", "__tw_cell", "__tw_first")
