from __future__ import annotations

from pathlib import Path

import pytest

from lexquarry.llm import queries as Q

DATA = Path("/root/testdata/sf0.001")
MAY_BE_EMPTY = {"p1_found", "p5_found", "p6_found", "p6_pieces", "p9_found"}


@pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_queries_run_on_the_test_tables(spark, name):
    df = Q.QUERIES[name](spark, str(DATA))
    assert df.columns and (df.count() > 0 or name in MAY_BE_EMPTY)
