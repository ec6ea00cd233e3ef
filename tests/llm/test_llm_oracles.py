"""Every query of the subpackage against its SQL, and the rest for rows."""

import os

import pytest

from stratamap.llm.queries import ORACLES, QUERIES
from tests.oracle import TESTDATA, compare

pytestmark = pytest.mark.skipif(not os.path.isdir(f"{TESTDATA}/sf0.001"), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, f"{TESTDATA}/sf0.001").count() >= 0
