from __future__ import annotations

import pytest
from parity import assert_same

from tidewell.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    assert_same(spark, sf, QUERIES[name], SQL[name])
