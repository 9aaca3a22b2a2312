"""Column expressions and column-name rules: keys, modality tags, guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

META = ("split", "subject", "class", "segment_idx", "segment_id")
CLASSES = ("NoPain", "PainArm", "PainHand")
#: Column tags of the recordings and their classes.
TAG_CLASS = {"baseline": "NoPain", "rest": "NoPain", "nopain": "NoPain", "arm": "PainArm", "painarm": "PainArm", "hand": "PainHand", "painhand": "PainHand"}
MODALITIES = ("bvp", "eda", "resp", "spo2")


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def map_value(c: Column, pairs: dict, strict: bool = False) -> Column:
    """Dictionary map; values that are not in it become null, or raise if strict."""
    out = F.try_element_at(literal_map(pairs), c)
    return F.when(c.isNotNull() & out.isNull(), F.raise_error(F.concat(F.lit("no entry for "), c))).otherwise(out) if strict else out


def parse_key(c: Column) -> dict[str, Column]:
    """subject, class and index of a key "<subject>_<tag>_<index>"; the tag may hold underscores and is matched in lower case."""
    parts = F.split(c, "_")
    tag = F.lower(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), ""))
    return {"subject": F.element_at(parts, 1).cast("int"), "class": map_value(tag, TAG_CLASS, strict=True), "segment_idx": F.element_at(parts, -1).cast("int")}


def segment_key(subject: Column, cls: Column, idx: Column) -> Column:
    return F.concat_ws("_", subject.cast("string"), cls, idx.cast("string"))


def class_of_key(c: Column) -> Column:
    return F.split_part(c, F.lit("_"), F.lit(2))


def is_pain(cls: Column) -> Column:
    return (cls != "NoPain").cast("int")


def modality(name: str, first_match: bool = False) -> str:
    """bvp, eda, resp or spo2 by substring; "cross" where two match (unless first_match), "other" where none does."""
    low = name.lower().replace("spo_2", "spo2")
    found = [m for m in MODALITIES if m in low]
    return "other" if not found else found[0] if first_match or len(found) == 1 else "cross"


AXES = {"bvp": "BVP/HR", "eda": "EDA", "resp": "RESP", "spo2": "SpO2"}


def signal_axis(name: str) -> str:
    """The report's axis of a feature, by how its name begins; EDA also by its second part."""
    low = canonical(name.lower())
    found = next((a for m, a in AXES.items() if low.startswith(m)), None)
    return found or ("EDA" if "eda" in name.lower().split("_")[:2] else "OTHER")


def modality_column(name: Column) -> Column:
    low = F.replace(F.lower(name), F.lit("spo_2"), F.lit("spo2"))
    hits = F.filter(F.array(*[F.lit(m) for m in MODALITIES]), lambda m: F.contains(low, m))
    return F.when(F.size(hits) == 0, "other").when(F.size(hits) > 1, "cross").otherwise(F.get(hits, F.lit(0)))


def canonical(name: str) -> str:
    return name.removeprefix("raw_")


def unique_by_canonical(names: list[str]) -> list[str]:
    """One name for each canonical name, the one without raw_ first, in the order of first appearance."""
    best: dict[str, str] = {}
    for n in names:
        k = canonical(n)
        if k not in best or (best[k].startswith("raw_") and not n.startswith("raw_")):
            best[k] = n
    return list(best.values())


def family_column(name: Column) -> Column:
    return F.when(F.startswith(name, F.lit("raw_")), "raw").when(F.startswith(name, F.lit("tf_")), "tf").when(F.startswith(name, F.lit("physio_")), "physio").otherwise("other")


def ratio(a: Column, b: Column, default: float | None = None) -> Column:
    """a / b, or the default where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(default).cast("double"))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def direction_tag(pairs: list[tuple[str, Column]]) -> Column:
    """Names in descending order of their values, joined by " > "."""
    order = F.array_sort(F.array(*[F.struct((-v).alias("v"), F.lit(n).alias("n")) for n, v in pairs]))
    return F.array_join(F.transform(order, lambda x: x["n"]), " > ")


def ieee_log(v: Column, base: float | None = None) -> Column:
    """The logarithm as IEEE has it: of zero it is -infinity, of a negative number NaN (F.log gives null for both)."""
    log = F.log10(v) if base == 10 else F.log(v)
    return F.when(v > 0, log).when(v == 0, float("-inf")).when(v.isNotNull(), float("nan"))


def settled(v: Column) -> Column:
    """v to 12 significant digits, so that sums that differ by the order of their terms only are equal, and tie in ranks."""
    return F.when(v.isNotNull(), F.coalesce(F.format_string("%.11e", v).try_cast("double"), v))
