from __future__ import annotations

import pytest
from parity import assert_same

import __spark_entry__
from tidewell.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, sf, name):
    assert_same(spark, sf, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_spectrum_of_every_segment(spark, sf):
    """As numpy has it, in both forms."""
    import numpy as np

    want = {r.segment_id: np.abs(np.fft.rfft(r.samples)) ** 2 for r in registry.signals(spark, sf).collect()}
    for name in ("spectrum_dft", "spectrum_dft_all"):
        got = {}
        for r in registry.QUERIES[name](spark, sf).collect():
            got.setdefault(r.segment_id, {})[r.k] = r.p
        assert got.keys() == want.keys()
        assert all(np.allclose([got[i][k] for k in range(33)], p, atol=1e-5) for i, p in want.items())


def test_channel_z_of_every_sample(spark, sf):
    """norm_channel_z has a digest of a segment's samples; norm_channel_z_samples has all 64, as numpy has them."""
    import numpy as np

    got = {(r.segment_id, r.pos): r.z for r in registry.QUERIES["norm_channel_z_samples"](spark, sf).collect()}
    rows = registry.signals(spark, sf).collect()
    assert len(got) == sum(len(r.samples) for r in rows)
    for c in {r["class"] for r in rows}:
        x = np.array([r.samples for r in rows if r["class"] == c])
        z = (x - x.mean()) / x.std()
        ids = [r.segment_id for r in rows if r["class"] == c]
        assert np.allclose([[got[i, k] for k in range(x.shape[1])] for i in ids], z, atol=2e-6)
