"""The general queries on empty tables, and on tables with rows of nulls and clashing columns."""

import os

import pytest

from stratamap.plans.problems import QUERIES
from tests import degenerate
from tests.oracle import TESTDATA

pytestmark = pytest.mark.skipif(not os.path.isdir(f"{TESTDATA}/sf0.001"), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    out = QUERIES[name](spark, degenerate.empty(tmp_path))
    assert out.count() == 0 and out.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_null_rows_and_clashing_columns(spark, tmp_path, name):
    assert degenerate.rows(QUERIES[name](spark, degenerate.dirty(tmp_path))) == degenerate.rows(QUERIES[name](spark, f"{TESTDATA}/sf0.001"))
