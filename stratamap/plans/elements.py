"""Queries over extracts: every one goes through the codec, while its SQL reads the tables directly."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamap.dataset import Extract
from stratamap.functions import decimicro, degrees, deleted, has_tag, info_timestamp, tag, with_coordinates
from stratamap.operators import extract
from stratamap.sources.fixtures import extract_of

BUILDING = ("building", "yes")


def _open(spark: SparkSession, d: str, name: str = "main") -> Extract:
    return Extract(spark, extract_of(spark, d, name))


def count_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return _open(spark, d).count_by_kind()


def count_ways(spark: SparkSession, d: str) -> DataFrame:
    return _open(spark, d).ways(["kind"]).agg(F.count(F.lit(1)).alias("n_ways"))


def count_row(spark: SparkSession, d: str) -> DataFrame:
    return extract.count_row(_open(spark, d).elements(["kind"]))


def map_reduce_sum(spark: SparkSession, d: str) -> DataFrame:
    def fold(batch):
        kinds = dict(zip(*(x.to_pylist() for x in pc.value_counts(batch.column("kind")).flatten())))
        return tuple(kinds.get(k, 0) for k in ("node", "way", "relation"))

    n = _open(spark, d).map_reduce(fold, (0, 0, 0), lambda a, b: tuple(x + y for x, y in zip(a, b)), ["kind"])
    return spark.createDataFrame([n], "nodes bigint, ways bigint, relations bigint")


def node_coords(spark: SparkSession, d: str) -> DataFrame:
    n = with_coordinates(_open(spark, d).nodes(["id", "nano_lat", "nano_lon"]))
    return n.select("id", "nano_lat", "nano_lon", "lat", "lon", "decimicro_lat", "decimicro_lon")


def node_dense_vs_plain(spark: SparkSession, d: str) -> DataFrame:
    n = _open(spark, d).nodes(["id", "is_dense", "nano_lat"])
    dense, plain = n.filter("is_dense"), n.filter("not is_dense")
    return dense.unionByName(plain).select("id", "is_dense", "nano_lat")


def node_tags(spark: SparkSession, d: str) -> DataFrame:
    return _open(spark, d).tags(("node",)).select("id", "pos", "key", "value")


def tag_filter_ways(spark: SparkSession, d: str) -> DataFrame:
    return _open(spark, d).ways(["id", "tags"]).filter(has_tag("priority", "1-URGENT")).select("id", tag("status").alias("status"))


def tag_value_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _open(spark, d).tags(("node", "way")).groupBy("kind", "key", "value").agg(F.count(F.lit(1)).alias("n"))


def way_refs(spark: SparkSession, d: str) -> DataFrame:
    return _open(spark, d).way_refs()


def way_raw_refs(spark: SparkSession, d: str) -> DataFrame:
    return _open(spark, d).ways(["id", "raw_refs"]).select(F.col("id").alias("way_id"), F.posexplode("raw_refs").alias("pos", "raw_ref"))


def way_ref_counts(spark: SparkSession, d: str) -> DataFrame:
    return _open(spark, d).ways(["id", "refs", "tags"]).select(F.col("id").alias("way_id"), F.size("refs").alias("n_refs"), F.size("tags").alias("n_tags"))


def way_info(spark: SparkSession, d: str) -> DataFrame:
    return _open(spark, d).ways(["id", "info"]).select("id", "info.version", "info.timestamp_ms", "info.changeset", "info.uid", F.col("info.user").alias("user_name"), "info.visible", deleted().alias("is_deleted"))


def way_locations(spark: SparkSession, d: str) -> DataFrame:
    w = _open(spark, d, "located").ways(["id", "node_locations"]).select(F.col("id").alias("way_id"), F.posexplode("node_locations").alias("pos", "p"))
    return w.select("way_id", "pos", "p.nano_lat", "p.nano_lon", degrees("p.nano_lat").alias("lat"), decimicro("p.nano_lon").alias("decimicro_lon"))


def way_locations_via_join(spark: SparkSession, d: str) -> DataFrame:
    x = _open(spark, d)
    n = x.nodes(["id", "nano_lat", "nano_lon"])
    return x.way_refs().join(n, F.col("node_ref") == F.col("id")).select("way_id", "pos", "nano_lat", "nano_lon", degrees("nano_lat").alias("lat"), decimicro("nano_lon").alias("decimicro_lon"))


def _deps(spark: SparkSession, d: str, pruned: bool = False) -> DataFrame:
    return _open(spark, d).ways_and_deps(has_tag(*BUILDING), pruned).select("kind", "id", F.coalesce(F.size("refs"), F.lit(0)).alias("n_refs"))


def ways_and_deps(spark: SparkSession, d: str) -> DataFrame:
    return _deps(spark, d)


def ways_and_deps_pruned(spark: SparkSession, d: str) -> DataFrame:
    return _deps(spark, d, True)


def ways_and_deps_counts(spark: SparkSession, d: str) -> DataFrame:
    return extract.count_row(_deps(spark, d))


def for_each_node(spark: SparkSession, d: str) -> DataFrame:
    return _open(spark, d).nodes(["id", "nano_lat", "nano_lon", "tags"]).select("id", "nano_lat", "nano_lon", tag("brand").alias("brand"))


def distinct_ref_ids(spark: SparkSession, d: str) -> DataFrame:
    return extract.distinct_refs(_open(spark, d).ways(["refs"]))


def dangling_refs(spark: SparkSession, d: str) -> DataFrame:
    x = _open(spark, d, "partial")
    return x.way_refs().join(x.nodes(["id"]), F.col("node_ref") == F.col("id"), "left_anti")


def relation_members(spark: SparkSession, d: str) -> DataFrame:
    return _open(spark, d).relation_members().select("relation_id", "pos", "member_type", "member_id", "role")


def relation_member_types(spark: SparkSession, d: str) -> DataFrame:
    return _open(spark, d).relation_members().groupBy("member_type", "role").agg(F.count(F.lit(1)).alias("n"))


def relation_tags(spark: SparkSession, d: str) -> DataFrame:
    return _open(spark, d).relations(["id", "tags"]).select("id", tag("name").alias("name"), tag("region").alias("region"))


def history_versions(spark: SparkSession, d: str) -> DataFrame:
    return _open(spark, d, "history").nodes(["id", "info"]).select("id", "info.version", "info.changeset", "info.visible")


def history_deleted(spark: SparkSession, d: str) -> DataFrame:
    return _open(spark, d, "history").nodes(["id", "info"]).filter(deleted()).select("id", "info.version")


def timestamps_ms(spark: SparkSession, d: str) -> DataFrame:
    return _open(spark, d, "history").nodes(["info"]).select("info.changeset", "info.timestamp_ms", F.unix_millis(info_timestamp()).alias("via_timestamp"))


def id_ranges(spark: SparkSession, d: str) -> DataFrame:
    return _open(spark, d).blob_zones().groupBy("kind").agg(F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"), F.sum("n").alias("n"))


def header_features(spark: SparkSession, d: str) -> DataFrame:
    h = _open(spark, d, "history").header()
    return h.select(F.explode("required_features").alias("feature"), "writing_program").distinct()


def blob_index(spark: SparkSession, d: str) -> DataFrame:
    return _open(spark, d).blobs().select("blob_seq", "blob_offset", "blob_type", "header_size", "datasize")


def string_tables(spark: SparkSession, d: str) -> DataFrame:
    return _open(spark, d).string_tables().select("blob_offset", F.posexplode("strings").alias("sid", "s")).select("blob_offset", "sid", F.decode("s", "UTF-8").alias("string"))


def raw_tags(spark: SparkSession, d: str) -> DataFrame:
    """Raw tags looked up in the blob's string table by a join: the same rows as ``node_tags``."""
    x = _open(spark, d)
    raw = x.nodes(["path", "blob_offset", "id", "raw_tags"]).select("path", "blob_offset", "id", F.posexplode("raw_tags").alias("pos", "t"))
    look = lambda c: F.decode(F.get("strings", F.col(c).cast("int")), "UTF-8")
    return raw.join(x.string_tables(), ["path", "blob_offset"]).select("id", "pos", look("t.key_sid").alias("key"), look("t.value_sid").alias("value"))


QUERIES = {
    f.__name__: f
    for f in (
        count_by_kind, count_ways, count_row, map_reduce_sum, node_coords, node_dense_vs_plain, node_tags, tag_filter_ways, tag_value_histogram, way_refs, way_raw_refs, way_ref_counts,
        way_info, way_locations, way_locations_via_join, ways_and_deps, ways_and_deps_pruned, ways_and_deps_counts, for_each_node, distinct_ref_ids, dangling_refs, relation_members,
        relation_member_types, relation_tags, history_versions, history_deleted, timestamps_ms, id_ranges, header_features, blob_index, string_tables, raw_tags,
    )
}

_LAT = "CAST(((CAST({k} AS BIGINT) * 791903) % 1800000001 - 900000000) * 100 + 37 AS BIGINT)"
_LON = "CAST(((CAST({k} AS BIGINT) * 1299709) % 3600000001 - 1800000000) * 100 - 41 AS BIGINT)"


def _c(s: str, k: str) -> str:
    return s.format(k=k)


_PART = f"SELECT p_partkey AS id, {_c(_LAT, 'p_partkey')} AS nano_lat, {_c(_LON, 'p_partkey')} AS nano_lon, p_name, p_brand, p_type FROM part"
_REFS = "SELECT l_orderkey AS way_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INTEGER) AS pos, l_partkey AS node_ref FROM lineitem"
_COUNTS = "(SELECT count(*) FROM part) AS nodes, (SELECT count(*) FROM orders) AS ways, (SELECT count(*) FROM nation) AS relations"
_LOCATED = f"SELECT way_id, pos, {_c(_LAT, 'node_ref')} AS nano_lat, {_c(_LON, 'node_ref')} AS nano_lon, 1e-9 * {_c(_LAT, 'node_ref')} AS lat, CAST({_c(_LON, 'node_ref')} // 100 AS INTEGER) AS decimicro_lon FROM ({_REFS})"
_NODE_TAGS = "SELECT p_partkey AS id, CAST(0 AS INTEGER) AS pos, 'name' AS key, p_name AS value FROM part UNION ALL SELECT p_partkey, 1, 'brand', p_brand FROM part UNION ALL SELECT p_partkey, 2, 'type', p_type FROM part"
_WAY_TAGS = "SELECT o_orderkey AS id, 'status' AS key, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders UNION ALL SELECT o_orderkey, 'building', 'yes' FROM orders WHERE o_orderkey % 97 = 0"
_NREFS = "SELECT o_orderkey, CAST(count(l_orderkey) AS INTEGER) AS n_refs FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"
_DEPS = f"SELECT 'way' AS kind, o_orderkey AS id, n_refs FROM ({_NREFS}) WHERE o_orderkey % 97 = 0 UNION ALL SELECT 'node', p_partkey, CAST(0 AS INTEGER) FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 97 = 0)"
_MEMBERS = """SELECT CAST(k AS BIGINT) AS relation_id, CAST(row_number() OVER (PARTITION BY k ORDER BY o, member_id) - 1 AS INTEGER) AS pos, member_type, member_id, role FROM (
  SELECT c_nationkey AS k, 0 AS o, 'way' AS member_type, o_orderkey AS member_id, o_orderstatus AS role FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT s_nationkey, 1, 'node', s_suppkey, 'supplier' FROM supplier) WHERE k IN (SELECT n_nationkey FROM nation)"""
_HISTORY = "SELECT user_id AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS version, event_id AS changeset, event_type <> 'error' AS visible FROM events"

ORACLES = {
    "count_by_kind": "SELECT 'node' AS kind, count(*) AS n FROM part UNION ALL SELECT 'way', count(*) FROM orders UNION ALL SELECT 'relation', count(*) FROM nation",
    "count_ways": "SELECT count(*) AS n_ways FROM orders",
    "count_row": f"SELECT {_COUNTS}",
    "map_reduce_sum": f"SELECT {_COUNTS}",
    "node_coords": f"SELECT id, nano_lat, nano_lon, 1e-9 * nano_lat AS lat, 1e-9 * nano_lon AS lon, CAST(nano_lat // 100 AS INTEGER) AS decimicro_lat, CAST(nano_lon // 100 AS INTEGER) AS decimicro_lon FROM ({_PART})",
    "node_dense_vs_plain": f"SELECT id, id % 2 = 0 AS is_dense, nano_lat FROM ({_PART})",
    "node_tags": _NODE_TAGS,
    "tag_filter_ways": "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderpriority = '1-URGENT'",
    "tag_value_histogram": f"SELECT 'node' AS kind, key, value, count(*) AS n FROM ({_NODE_TAGS}) GROUP BY 2, 3 UNION ALL SELECT 'way', key, value, count(*) FROM ({_WAY_TAGS}) GROUP BY 2, 3",
    "way_refs": _REFS,
    "way_raw_refs": f"SELECT way_id, pos, node_ref - coalesce(lag(node_ref) OVER (PARTITION BY way_id ORDER BY pos), 0) AS raw_ref FROM ({_REFS})",
    "way_ref_counts": f"SELECT o_orderkey AS way_id, n_refs, CAST(CASE WHEN o_orderkey % 97 = 0 THEN 3 ELSE 2 END AS INTEGER) AS n_tags FROM ({_NREFS})",
    "way_info": "SELECT o_orderkey AS id, CAST(1 AS INTEGER) AS version, CAST(epoch_us(o_orderdate) // 1000 AS BIGINT) AS timestamp_ms, o_orderkey AS changeset, CAST(o_custkey AS INTEGER) AS uid, c_name AS user_name, true AS visible, false AS is_deleted FROM orders JOIN customer ON c_custkey = o_custkey",
    "way_locations": _LOCATED,
    "way_locations_via_join": _LOCATED,
    "ways_and_deps": _DEPS,
    "ways_and_deps_pruned": _DEPS,
    "ways_and_deps_counts": f"SELECT count(*) FILTER (kind = 'node') AS nodes, count(*) FILTER (kind = 'way') AS ways, CAST(0 AS BIGINT) AS relations FROM ({_DEPS})",
    "for_each_node": f"SELECT id, nano_lat, nano_lon, p_brand AS brand FROM ({_PART})",
    "distinct_ref_ids": "SELECT DISTINCT l_partkey AS id FROM lineitem",
    "dangling_refs": f"SELECT * FROM ({_REFS}) WHERE node_ref NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 5 <> 0)",
    "relation_members": _MEMBERS,
    "relation_member_types": f"SELECT member_type, role, count(*) AS n FROM ({_MEMBERS}) GROUP BY 1, 2",
    "relation_tags": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey",
    "history_versions": _HISTORY,
    "history_deleted": f"SELECT id, version FROM ({_HISTORY}) WHERE NOT visible",
    "timestamps_ms": "SELECT event_id AS changeset, CAST(epoch_us(ts) // 1000 AS BIGINT) AS timestamp_ms, CAST(epoch_us(ts) // 1000 AS BIGINT) AS via_timestamp FROM events",
    "id_ranges": "SELECT 'node' AS kind, min(p_partkey) AS min_id, max(p_partkey) AS max_id, count(*) AS n FROM part UNION ALL SELECT 'way', min(o_orderkey), max(o_orderkey), count(*) FROM orders UNION ALL SELECT 'relation', CAST(min(n_nationkey) AS BIGINT), CAST(max(n_nationkey) AS BIGINT), count(*) FROM nation",
    "header_features": "SELECT unnest(['OsmSchema-V0.6', 'DenseNodes', 'HistoricalInformation']) AS feature, 'stratamap' AS writing_program",
    "raw_tags": _NODE_TAGS,
}
