from __future__ import annotations

import math
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewell.operators import relational, select
from tidewell.sources import io
from tidewell.streaming import sinks


def _recordings(root, subject=7, signals=io.SIGNALS, extra=""):
    for k, sig in enumerate(signals):
        folder = os.path.join(root, "train", sig)
        os.makedirs(folder, exist_ok=True)
        head = f"{subject}_Baseline_1,{subject}_ARM_1{extra if sig == 'Eda' else ''}"
        rows = [f"{i + k},{i * 2 if i < 3 else ''}" for i in range(5)]
        with open(os.path.join(folder, f"{subject}.csv"), "w") as f:
            f.write("\n".join([head, *rows]) + "\n")


def test_wide_csv_to_segments(spark, tmp_path):
    root = str(tmp_path)
    _recordings(root)
    _recordings(root, 8)
    assert io.subjects(spark, root, "train") == [7, 8]
    out = {r.segment_id: r for r in io.build_split(spark, root, "train").collect()}
    assert sorted(out) == ["7_NoPain_1", "7_PainArm_1", "8_NoPain_1", "8_PainArm_1"]
    assert list(out["7_PainArm_1"].samples_Bvp) == [0, 2, 4] and out["7_PainArm_1"].raw_len_Eda == 3
    assert list(out["8_NoPain_1"].samples_SpO2) == [3, 4, 5, 6, 7]


def test_unknown_tag_raises(spark, tmp_path):
    root = str(tmp_path)
    _recordings(root, extra="x_1")
    with pytest.raises(PySparkException):
        io.build_split(spark, root, "train").collect()


def test_cache_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert io.cached(spark, f"{tmp_path}/c", build).count() == 3
    assert len(calls) == 1


def test_splits_are_kept_by_length(spark, tmp_path):
    root = str(tmp_path)
    _recordings(root)
    a = {r.segment_id: r for r in io.load_split(spark, root, "train", 4, f"{root}/c").collect()}
    assert list(a["7_PainArm_1"].samples_Bvp) == [0, 2, 4, None] and a["7_PainArm_1"].raw_len_Bvp == 3 and len(a["7_NoPain_1"].samples_Eda) == 4
    _recordings(root, 8)  # comes too late for the table of four samples, not for that of six
    counts = lambda n: sorted(map(tuple, io.prime(spark, root, ["train"], n, f"{root}/c").collect()))
    assert counts(4) == [("train", "NoPain", 1), ("train", "PainArm", 1)] and counts(6) == [("train", "NoPain", 2), ("train", "PainArm", 2)]
    spark.conf.set("spark.tidewell.cache.dir", f"{root}/other/")
    try:
        assert io.cache_root(spark, "x") == f"{root}/other" and io.load_split(spark, root, "train", 4).count() == 4
    finally:
        spark.conf.unset("spark.tidewell.cache.dir")
    assert os.path.isdir(f"{root}/other/train_4")


def test_named_sets():
    columns = [f"bvp_{i}" for i in range(70)] + [f"eda_{i}" for i in range(30)] + [f"resp_{i}" for i in range(30)] + ["raw_resp_0", "spo_2_mean"]
    ranked = sorted(columns, key=lambda c: c[::-1])
    one = select.named_sets(select.STAGE1, columns, ranked, {"fwd": ["eda_3", "gone"]})
    assert one["bvp_eda_core"] == columns[:100] and one["fwd"] == ["eda_3"] and one["all_raw"] == columns and len(one["all"]) == len(columns) - 1
    assert one["bvp_eda_resp_small"] == [c for c in ranked if c[:3] in ("bvp", "eda")][:60] + [c for c in ranked if c.startswith("resp")][:10]
    two = select.named_sets(select.STAGE2, columns, ranked)
    assert two["resp_bvp5"][20:] == [c for c in ranked if c.startswith("bvp")][:5] and len(two["all_top40"]) == 40
    three = select.named_sets(select.MULTICLASS, columns, ranked)
    assert len(three["top80"]) == 80 and "spo_2_mean" not in three["bvp_eda_resp"] and "spo_2_mean" in three["all_modalities"]
    assert relational.features_of(relational_frame(columns)) == columns


class relational_frame:
    """Something with columns."""

    def __init__(self, columns):
        self.columns = ["subject", *columns, "class"]


def test_small_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, None)], "a int, b double")
    io.write_csv(df, f"{tmp_path}/csv")
    io.write_csv(df, f"{tmp_path}/csv", append=True)
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 4
    assert io.to_markdown(df.orderBy("a")).splitlines()[2] == "| 1 | 0.5000 |"
    io.write_json(spark, f"{tmp_path}/x.json", {"a": [1, 2]})
    assert io.read_json(spark, f"{tmp_path}/x.json") == {"a": [1, 2]}


def test_stream_upserts_once(spark, tmp_path):
    sink = sinks.upsert_batches(f"{tmp_path}/t", ["k"])
    one = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    two = spark.createDataFrame([(2, 5.0), (3, 6.0)], "k int, v double")
    for batch, n in ((one, 0), (two, 1), (one, 1)):
        sink(batch, n)
    assert sorted(map(tuple, sinks.current(spark, f"{tmp_path}/t").collect())) == [(1, 1.0), (2, 5.0), (3, 6.0)]


def test_case_collisions_and_strict_join(spark):
    a = spark.createDataFrame([(1, 1.0)], "segment_id int, SPO2_mean double")
    b = spark.createDataFrame([(1, 2.0)], "segment_id int, SpO2_mean double")
    assert relational.join_features([a, b], ["physio", "tf"]).columns == ["segment_id", "SPO2_mean", "tf_SpO2_mean"]
    with pytest.raises(PySparkException):
        relational.align(spark.createDataFrame([(2,)], "segment_id int"), a, "segment_id", ["SPO2_mean"], strict=True).collect()
    assert math.isclose(relational.align(spark.createDataFrame([(2,)], "segment_id int"), a, "segment_id", ["SPO2_mean"], 0.5).first()[1], 0.5)


def test_split_needs_no_row_a_sample(spark, tmp_path, monkeypatch):
    """Recordings are written and read by whole columns; lengths differ, one is empty, one has gaps."""
    rows = [(1, "1_Baseline_1", [1.0, None, 3.0]), (1, "1_ARM_1", []), (2, "2_HAND_1", [0.5]), (2, "2_Baseline_2", [1.5, 2.5, None])]
    df = spark.createDataFrame(rows, "subject int, key string, x array<double>")
    io.write_split(df.select("subject", "key", *[F.col("x").alias(f"samples_{s}") for s in io.SIGNALS]), str(tmp_path), "train")
    assert (tmp_path / "train/Bvp/1.csv").read_text() == "1_ARM_1,1_Baseline_1\n,1.0\n,\n,3.0\n"
    monkeypatch.setattr(io, "to_segments", None)
    got = {(r.subject, r.segment_idx, r["class"]): (r.samples_Eda, r.raw_len_SpO2) for r in io.build_split(spark, str(tmp_path), "train").collect()}
    assert sorted(got.values(), key=str) == sorted([([1.0, None, 3.0], 3), ([], 0), ([0.5], 1), ([1.5, 2.5], 2)], key=str)
