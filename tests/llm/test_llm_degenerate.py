"""The queries of this subpackage on empty tables, and on tables with rows of nulls and clashing columns."""

import os

import pytest

from stratamap.llm.queries import QUERIES
from tests import degenerate
from tests.oracle import TESTDATA

pytestmark = pytest.mark.skipif(not os.path.isdir(f"{TESTDATA}/sf0.001"), reason="no test tables here")
#: One row per document: the row of nulls comes out, too, and counts in the rates.
PER_DOCUMENT = {"p7_ids", "p7_offsets", "p9_scores", "p9_rates"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    out = QUERIES[name](spark, degenerate.empty(tmp_path))
    assert out.count() == 0 and out.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_null_rows_and_clashing_columns(spark, tmp_path, name):
    got, want = degenerate.rows(QUERIES[name](spark, degenerate.dirty(tmp_path))), degenerate.rows(QUERIES[name](spark, f"{TESTDATA}/sf0.001"))
    if name in PER_DOCUMENT:
        new = [x for x in got if x not in set(want)]
        assert len(new) == 1 and ("None" in new[0])
    else:
        assert got == want
