"""The general data problems on the element tables: queries p1, p3, p4 and p6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamap.operators import history, near, orphans, regions, wide
from stratamap.operators.current import current_rows, present_elements, present_ids, visible, with_blob_params
from stratamap.session import input_rows, table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    way_refs, zones = table(spark, d, "way_refs"), table(spark, d, "blob_zones")
    refs = orphans.element_references(way_refs, zones).distinct()
    present = present_ids(table(spark, d, "dense_nodes")).select(F.lit("node").alias("kind"), F.col("id").alias("node_id"))
    found = orphans.orphan_references(refs, present, ["kind", "node_id"], match="simple", total=input_rows(way_refs))
    return found.select("ref_table", "owner_key", F.col("node_id").alias("missing_id"), "month_key")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """References to nodes that are not present, distinct."""
    return _orphans(spark, d)


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Distinct orphan references and missing ids per table and month."""
    return orphans.orphan_report(_orphans(spark, d), "ref_table", "month_key")


def p1_versions(spark: SparkSession, d: str) -> DataFrame:
    """Updates of node versions that ``dense_nodes`` does not store, per month of receipt and by which columns were given.

    The key is (id, info_version) under partial match: an update without version only needs its id to be stored.
    """
    feed = table(spark, d, "node_updates")
    refs = feed.select("id", "info_version", F.date_format("received_at", "yyyy-MM").alias("month_key"))
    found = orphans.orphan_references(refs, table(spark, d, "dense_nodes").select("id", "info_version"), ["id", "info_version"], match="partial", total=input_rows(feed))
    given = F.concat_ws("+", F.when(F.col("id").isNotNull(), "id"), F.when(F.col("info_version").isNotNull(), "version"))
    return found.groupBy("month_key", given.alias("given")).agg(F.count(F.lit(1)).alias("n_refs"), F.count_distinct(F.struct("id", "info_version")).alias("n_missing"))


def _positions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Positions of present nodes, and of all stored rows."""
    rows = with_blob_params(table(spark, d, "dense_nodes").select("file_path", "blob_offset", "id", "lat", "lon", "info_version", "info_visible"), table(spark, d, "blobs"), ["granularity", "lat_offset", "lon_offset"])
    stored = rows.select(
        "id", "info_version", visible(F.col("info_visible")).alias("vis"),
        F.expr("try_add(lat_offset, try_multiply(granularity, lat))").alias("p_lat"), F.expr("try_add(lon_offset, try_multiply(granularity, lon))").alias("p_lon"),
    )
    return current_rows(stored, ["id"], ["vis", "p_lat", "p_lon"]).filter("vis").select("id", "p_lat", "p_lon"), stored


def p3_found(spark: SparkSession, d: str, metres: float = 20.0) -> DataFrame:
    """Pairs of present nodes at most 20 m apart."""
    points, stored = _positions(spark, d)
    return near.near_pairs(points, metres, sample=stored, rows=input_rows(table(spark, d, "dense_nodes")))


def p3_regions(spark: SparkSession, d: str) -> DataFrame:
    """The closed way of the smallest bounding box (in square degrees, ties by the smaller id) around each present node inside any.

    Of several references at one place of a way the one added last counts, ties by the greater node. A way is closed
    if its first and last reference are the same node; vertices that are not present are skipped.
    """
    refs = table(spark, d, "way_refs").filter("way_id is not null and pos is not null")
    placed = refs.groupBy("way_id", "pos").agg(F.max(F.struct("added_at", "node_ref")).alias("r")).select("way_id", "pos", F.col("r.node_ref").alias("node_ref"))
    ends = placed.groupBy("way_id").agg(F.min(F.struct("pos", "node_ref")).alias("a"), F.max(F.struct("pos", "node_ref")).alias("b"))
    closed = ends.filter("b.pos >= a.pos + 3 and a.node_ref = b.node_ref").select("way_id")
    present, stored = _positions(spark, d)
    points = present.filter(near.VALID).select("id", (F.lit(1e-9) * F.col("p_lon")).alias("x"), (F.lit(1e-9) * F.col("p_lat")).alias("y"))
    vertices = placed.join(closed, "way_id").join(points, F.col("node_ref") == F.col("id")).select(F.col("way_id").alias("region"), "pos", "x", "y")
    sample, rows = stored.filter(near.VALID).select((F.lit(1e-9) * F.col("p_lon")).alias("x")), input_rows(table(spark, d, "dense_nodes"))
    return regions.points_in_regions(points, regions.ring_edges(vertices), smallest=True, rows=rows, sample=sample).select("id", F.col("region").alias("way_id"))


def _periods(spark: SparkSession, d: str, payload: list[str], collapse: bool = False) -> DataFrame:
    """Validity periods of the update feed; the years of receipt are its periods."""
    feed = table(spark, d, "node_updates")
    rows = with_blob_params(feed.select("file_path", "blob_offset", "id", "info_version", "info_timestamp", "info_visible", "info_changeset", "received_at"), table(spark, d, "blobs"), ["date_granularity"])
    timed = rows.withColumns({"ms": F.expr("try_multiply(date_granularity, info_timestamp)"), "vis": visible(F.col("info_visible"))})
    return history.validity_periods(timed, "id", "info_version", "ms", "received_at", payload, collapse, period=F.year("received_at"), rows=input_rows(feed))


def p4_history(spark: SparkSession, d: str) -> DataFrame:
    """Every version of every node with its period, deletions included."""
    out = _periods(spark, d, ["vis", "info_changeset"])
    return out.select(F.col("k").alias("id"), F.col("v").cast("int").alias("info_version"), F.col("s").alias("valid_from"), "valid_to", F.col("vis").alias("is_visible"), "info_changeset")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Visible versions whose period is open or longer than zero."""
    return p4_history(spark, d).filter("is_visible and (valid_to = -1 or valid_to > valid_from)").select("id", "info_version", "valid_from", "valid_to")


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    """History collapsed on payload change: one row per run of versions with one visibility."""
    out = _periods(spark, d, ["vis"], collapse=True)
    return out.select(F.col("k").alias("id"), F.col("v").cast("int").alias("first_version"), F.col("s").alias("valid_from"), "valid_to", F.col("vis").alias("is_visible"))


def _wide(spark: SparkSession, d: str, empty: bool) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The wide text table; with ``empty`` tagged elements that have no listed attribute keep a row."""
    attrs = wide.discover(table(spark, d, "attr_types"))
    names = [a for a, _ in attrs]
    elements = present_elements(table(spark, d, "dense_nodes"), table(spark, d, "ways"), table(spark, d, "string_tables"), None if empty else names)
    tags = F.explode_outer(F.filter("tags", lambda t: t["key"].isin(names))) if empty else F.explode("tags")
    rows = elements.filter(F.size("tags") > 0).select("elem_kind", "id", tags.alias("t")).select("elem_kind", "id", F.col("t.key").alias("attr"), "t.value", "t.pos")
    return wide.pivot_wide(rows, ["elem_kind", "id"], attrs), attrs


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The filled cells of the wide table of present elements."""
    text, attrs = _wide(spark, d, empty=False)
    return wide.cells(text, ["elem_kind", "id"], attrs)


def p6_wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per present element that has any tag, with typed columns, all null where no listed attribute fits."""
    text, attrs = _wide(spark, d, empty=True)
    return wide.typed(text, ["elem_kind", "id"], attrs)


def p6_text(spark: SparkSession, d: str) -> DataFrame:
    """The wide table of ``p6_wide`` with all values as canonical text, numbers of any length included."""
    return _wide(spark, d, empty=True)[0]


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_versions, p3_found, p3_regions, p4_history, p4_found, p4_runs, p6_found, p6_wide, p6_text)}

_PRESENT = "SELECT id FROM (SELECT id, info_visible, row_number() OVER (PARTITION BY id ORDER BY info_version DESC NULLS LAST, info_visible DESC NULLS FIRST) AS rn FROM dense_nodes WHERE id IS NOT NULL) WHERE rn = 1 AND coalesce(info_visible, true)"

_ORPHANS = f"""WITH present AS ({_PRESENT}), refs AS (
  SELECT 'way_refs' AS ref_table, CAST(way_id AS VARCHAR) AS owner_key, node_ref AS missing_id, strftime(added_at, '%Y-%m') AS month_key FROM way_refs
  UNION SELECT 'blob_zones', file_path || '@' || CAST(blob_offset AS VARCHAR), min_id, strftime(indexed_at, '%Y-%m') FROM blob_zones WHERE kind = 'node'
  UNION SELECT 'blob_zones', file_path || '@' || CAST(blob_offset AS VARCHAR), max_id, strftime(indexed_at, '%Y-%m') FROM blob_zones WHERE kind = 'node')
"""

_VERSIONS = """WITH timed AS (
  SELECT u.id, u.info_version AS v, coalesce(b.date_granularity, 1000) * u.info_timestamp AS ms, coalesce(u.info_visible, true) AS vis, u.info_changeset AS cs, u.received_at
  FROM node_updates u LEFT JOIN blobs b ON b.file_path = u.file_path AND b.blob_offset = u.blob_offset
  WHERE u.id IS NOT NULL AND u.info_version IS NOT NULL AND u.info_timestamp IS NOT NULL),
 lastly AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, v ORDER BY received_at DESC NULLS LAST, ms DESC, vis DESC, cs DESC NULLS LAST) AS rn FROM timed) WHERE rn = 1),
 hist AS (SELECT id, CAST(v AS INTEGER) AS info_version, CAST(ms AS BIGINT) AS valid_from, CAST(coalesce(lead(ms) OVER (PARTITION BY id ORDER BY v), -1) AS BIGINT) AS valid_to, vis AS is_visible, CAST(cs AS BIGINT) AS info_changeset FROM lastly)
"""

_TAGS = """WITH both_kinds AS (
  SELECT 'node' AS elem_kind, id, info_version, info_visible, file_path, blob_offset, range(0, len(keys_vals_indices) // 2) AS ps,
         list_transform(range(0, len(keys_vals_indices) // 2), lambda i: keys_vals_indices[2 * i + 1]) AS ks, list_transform(range(0, len(keys_vals_indices) // 2), lambda i: keys_vals_indices[2 * i + 2]) AS vs FROM dense_nodes
  UNION ALL SELECT 'way', id, info_version, info_visible, file_path, blob_offset, range(0, least(len(key_indices), len(val_indices))), key_indices, val_indices FROM ways),
 cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY elem_kind, id ORDER BY info_version DESC NULLS LAST) AS rn FROM both_kinds WHERE id IS NOT NULL) WHERE rn = 1 AND coalesce(info_visible, true)),
 flat AS (SELECT elem_kind, id, file_path, blob_offset, p, ks[p + 1] AS k, vs[p + 1] AS v FROM (SELECT *, unnest(ps) AS p FROM cur)),
 tags AS (SELECT f.elem_kind, f.id, f.p AS pos, lower(trim(s.strings[f.k + 1], chr(32) || chr(9))) AS attr, trim(s.strings[f.v + 1], chr(32) || chr(9)) AS val, s.strings[f.v + 1] AS stored
   FROM flat f JOIN string_tables s ON s.file_path = f.file_path AND s.blob_offset = f.blob_offset)
"""

_CELLS = (
    _TAGS
    + r""", typed AS (SELECT t.*, a.attr_type,
   CASE a.attr_type
     WHEN 'string' THEN nullif(val, '')
     WHEN 'int' THEN CASE WHEN regexp_matches(val, '^[+-]?[0-9]+$') THEN CASE WHEN val[1] = '-' AND regexp_matches(val, '[1-9]') THEN '-' ELSE '' END || regexp_replace(ltrim(val, '+-'), '^0+([0-9])', '\1') END
     WHEN 'decimal' THEN CASE WHEN regexp_matches(val, '^[0-9]+([.,][0-9]{1,2})?( ?m)?$') THEN regexp_replace(regexp_extract(val, '^[0-9]+'), '^0+([0-9])', '\1') || '.' || rpad(regexp_extract(val, '^[0-9]+[.,]([0-9]+)', 1), 2, '0') END
     WHEN 'bool' THEN CASE WHEN lower(val) IN ('yes','true','1') THEN 'true' WHEN lower(val) IN ('no','false','0') THEN 'false' END
     WHEN 'date' THEN CASE WHEN regexp_matches(val, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN CAST(try_cast(val AS DATE) AS VARCHAR)
                           WHEN regexp_matches(val, '^[0-9]{4}/[0-9]{2}/[0-9]{2}$') THEN CAST(try_cast(replace(val, '/', '-') AS DATE) AS VARCHAR)
                           WHEN regexp_matches(val, '^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$') THEN CAST(try_cast(val[7:10] || '-' || val[4:5] || '-' || val[1:2] AS DATE) AS VARCHAR) END
   END AS attr_text FROM tags t JOIN attr_types a ON a.attr = t.attr)
"""
)

#: The attributes of the test tables.
_ATTRS = "title surface roadclass operator lanes levels speed capacity height width oneway lit fee opened closed_on".split()

_WIDE = (
    _CELLS
    + ", firsts AS (SELECT elem_kind, id, attr, attr_text FROM (SELECT *, row_number() OVER (PARTITION BY elem_kind, id, attr ORDER BY pos) AS rn FROM typed WHERE attr_text IS NOT NULL) WHERE rn = 1) SELECT elem_kind, id, "
    + ", ".join(f"max(attr_text) FILTER (attr = '{a}') AS {a}" for a in _ATTRS)
    + " FROM (SELECT DISTINCT elem_kind, id FROM tags WHERE attr IS NOT NULL AND stored IS NOT NULL) LEFT JOIN firsts USING (elem_kind, id) GROUP BY 1, 2"
)

_POSITIONS = """WITH stored AS (
  SELECT n.id, n.info_version AS v, coalesce(n.info_visible, true) AS vis, coalesce(b.lat_offset, 0) + coalesce(b.granularity, 100) * n.lat AS la, coalesce(b.lon_offset, 0) + coalesce(b.granularity, 100) * n.lon AS lo
  FROM dense_nodes n LEFT JOIN blobs b ON b.file_path = n.file_path AND b.blob_offset = n.blob_offset WHERE n.id IS NOT NULL),
 cur AS (SELECT id, la, lo, 1e-9 * la AS y, 1e-9 * lo AS x FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC NULLS LAST) AS rn FROM stored) WHERE rn = 1 AND vis AND la BETWEEN -90000000000 AND 90000000000 AND lo BETWEEN -180000000000 AND 180000000000)"""

ORACLES = {
    "p1_found": _ORPHANS + "SELECT DISTINCT r.* FROM refs r WHERE missing_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM present p WHERE p.id = r.missing_id)",
    "p1_report": _ORPHANS + "SELECT ref_table, month_key, count(*) AS n_refs, count(DISTINCT missing_id) AS n_missing FROM refs r WHERE missing_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM present p WHERE p.id = r.missing_id) GROUP BY 1, 2",
    "p1_versions": """WITH refs AS (SELECT id, info_version AS v, strftime(received_at, '%Y-%m') AS month_key FROM node_updates WHERE id IS NOT NULL OR info_version IS NOT NULL),
 orphan AS (SELECT * FROM refs r WHERE NOT EXISTS (SELECT 1 FROM dense_nodes n WHERE n.id = r.id AND n.info_version = r.v) AND id IS NOT NULL AND v IS NOT NULL
  UNION ALL SELECT * FROM refs r WHERE v IS NULL AND NOT EXISTS (SELECT 1 FROM dense_nodes n WHERE n.id = r.id)
  UNION ALL SELECT * FROM refs r WHERE id IS NULL AND NOT EXISTS (SELECT 1 FROM dense_nodes n WHERE n.info_version = r.v))
SELECT month_key, concat_ws('+', CASE WHEN id IS NOT NULL THEN 'id' END, CASE WHEN v IS NOT NULL THEN 'version' END) AS given, count(*) AS n_refs, count(DISTINCT (id, v)) AS n_missing FROM orphan GROUP BY 1, 2""",
    "p3_found": _POSITIONS
    + """,
 cells AS (SELECT *, CAST(floor(y / 0.0002) AS BIGINT) AS gy FROM cur),
 around AS (SELECT *, gy + d AS hy FROM cells, (SELECT unnest([-1, 0, 1]) AS d))
SELECT a.id AS id_a, b.id AS id_b FROM cells a JOIN around b ON a.gy = b.hy AND a.id < b.id
WHERE 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2)))) <= 20""",
    "p3_regions": _POSITIONS
    + """,
 placed AS (SELECT way_id, pos, node_ref FROM (SELECT *, row_number() OVER (PARTITION BY way_id, pos ORDER BY added_at DESC NULLS LAST, node_ref DESC NULLS LAST) AS rn FROM way_refs WHERE way_id IS NOT NULL AND pos IS NOT NULL) WHERE rn = 1),
 closed AS (SELECT way_id FROM placed GROUP BY 1 HAVING max(pos) >= min(pos) + 3 AND arg_min(coalesce(node_ref, -9e18), pos) = arg_max(coalesce(node_ref, 9e18), pos)),
 verts AS (SELECT p.way_id, p.pos, c.x, c.y FROM placed p JOIN closed USING (way_id) JOIN cur c ON c.id = p.node_ref),
 steps AS (SELECT way_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM verts WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
 edges AS (SELECT way_id, least(x, nx) AS x1, greatest(x, nx) AS x2, CASE WHEN x < nx THEN y ELSE ny END AS y1, CASE WHEN x < nx THEN ny ELSE y END AS y2 FROM steps WHERE nx <> x),
 inside AS (SELECT c.id, e.way_id FROM cur c JOIN edges e ON e.x1 <= c.x AND c.x < e.x2 WHERE e.y1 + (c.x - e.x1) * (e.y2 - e.y1) / (e.x2 - e.x1) > c.y GROUP BY 1, 2 HAVING count(*) % 2 = 1),
 boxes AS (SELECT way_id, (max(x) - min(x)) * (max(y) - min(y)) AS size FROM verts GROUP BY 1)
SELECT id, way_id FROM (SELECT i.id, i.way_id, row_number() OVER (PARTITION BY i.id ORDER BY b.size, i.way_id) AS rn FROM inside i JOIN boxes b USING (way_id)) WHERE rn = 1""",
    "p4_history": _VERSIONS + "SELECT * FROM hist",
    "p4_found": _VERSIONS + "SELECT id, info_version, valid_from, valid_to FROM hist WHERE is_visible AND (valid_to = -1 OR valid_to > valid_from)",
    "p4_runs": _VERSIONS
    + """, marked AS (SELECT *, CASE WHEN lag(is_visible) OVER w IS NOT DISTINCT FROM is_visible AND lag(info_version) OVER w IS NOT NULL THEN 0 ELSE 1 END AS opens FROM hist WINDOW w AS (PARTITION BY id ORDER BY info_version))
SELECT id, info_version AS first_version, valid_from, CAST(coalesce(lead(valid_from) OVER (PARTITION BY id ORDER BY info_version), -1) AS BIGINT) AS valid_to, is_visible FROM marked WHERE opens = 1""",
    "p6_text": _WIDE,
    "p6_found": _CELLS + "SELECT elem_kind, id, attr, attr_text FROM (SELECT *, row_number() OVER (PARTITION BY elem_kind, id, attr ORDER BY pos) AS rn FROM typed WHERE attr_text IS NOT NULL) WHERE rn = 1",
}
