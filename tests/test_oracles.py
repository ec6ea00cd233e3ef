"""Every registered core query against its SQL, and the rest for rows and schema."""

import os

import pytest

from stratamap.plans import elements, format, problems
from tests.oracle import TESTDATA, compare

QUERIES, ORACLES = elements.QUERIES | format.QUERIES | problems.QUERIES, elements.ORACLES | format.ORACLES | problems.ORACLES
pytestmark = pytest.mark.skipif(not os.path.isdir(f"{TESTDATA}/sf0.001"), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, f"{TESTDATA}/sf0.001").count() > 0


def test_wide_rows_match_sql(spark):
    """p6_wide as text, as the types of its columns have no equal in a data frame of the SQL engine."""
    text = lambda s, d: (w := QUERIES["p6_wide"](s, d)).select("elem_kind", "id", *[w[a].cast("string").alias(a) for a in problems._ATTRS])
    assert compare(spark, text, ORACLES["p6_text"]) > 0


def test_pruning_by_zones_reads_fewer_blobs_and_gives_the_same_rows(spark):
    from stratamap.dataset import Extract
    from stratamap.operators import extract
    from stratamap.sources.fixtures import extract_of

    x = Extract(spark, extract_of(spark, f"{TESTDATA}/sf0.001", "main"))
    zones, held = x.blob_zones(), x.node_zones()
    assert held is x.node_zones() and len(x.index()) == x.blobs().count() and x.index() is x.index()
    assert {tuple(r) for r in zones.collect()} == {tuple(r) for r in extract.blob_zones(x.elements(["path", "blob_offset", "kind", "id"])).collect()}
    some = spark.createDataFrame([(0,)], "id bigint")
    hit = extract.zones_hit(held, some)
    assert 0 < len(hit) < zones.filter("kind = 'node'").count()
    assert {r.id for r in x.nodes(["id"], offsets=hit).collect()} >= {0}
    assert len(extract.held_zones(zones, 1)) == 2
