"""Reference SQL of the queries that SQL can express."""

_NAMES = """WITH named AS (
  SELECT 'user' AS field_name, s.strings[u.info_user_sid + 1] AS item FROM node_updates u JOIN string_tables s ON s.file_path = u.file_path AND s.blob_offset = u.blob_offset WHERE u.info_user_sid > 0
  UNION ALL
  SELECT 'val', s.strings[w.sid + 1] FROM (SELECT file_path, blob_offset, unnest(val_indices[1:len(key_indices)]) AS sid FROM ways WHERE len(key_indices) > 0) w JOIN string_tables s ON s.file_path = w.file_path AND s.blob_offset = w.blob_offset),
 held AS (SELECT * FROM named WHERE item IS NOT NULL AND (field_name = 'user' OR item <> '')),
 top AS (SELECT field_name, item, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY field_name) AS BIGINT) AS n_group FROM held GROUP BY 1, 2)
"""

_SETS = """WITH both_kinds AS (
  SELECT 'node' AS elem_kind, id, info_version, info_visible, file_path, blob_offset, list_transform(range(0, len(keys_vals_indices) // 2), lambda i: keys_vals_indices[2 * i + 1]) AS ks FROM dense_nodes
  UNION ALL SELECT 'way', id, info_version, info_visible, file_path, blob_offset, key_indices[1:least(len(key_indices), len(val_indices))] FROM ways),
 cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY elem_kind, id ORDER BY info_version DESC NULLS LAST) AS rn FROM both_kinds WHERE id IS NOT NULL) WHERE rn = 1 AND coalesce(info_visible, true)),
 tags AS (SELECT DISTINCT c.elem_kind, c.id, lower(trim(s.strings[c.k + 1], chr(32) || chr(9))) AS item FROM (SELECT *, unnest(ks) AS k FROM cur) c JOIN string_tables s ON s.file_path = c.file_path AND s.blob_offset = c.blob_offset WHERE s.strings[c.k + 1] IS NOT NULL),
 total AS (SELECT count(*) AS n FROM (SELECT DISTINCT elem_kind, id FROM tags)),
 single AS (SELECT item, count(*) AS n FROM tags GROUP BY 1),
 pairs AS (SELECT a.item AS key_a, b.item AS key_b, count(*) AS n_ab FROM tags a JOIN tags b ON a.elem_kind = b.elem_kind AND a.id = b.id AND a.item < b.item GROUP BY 1, 2),
 measured AS (SELECT key_a, key_b, n_ab, a.n AS n_a, b.n AS n_b, t.n AS n FROM pairs JOIN single a ON a.item = key_a JOIN single b ON b.item = key_b, total t)
"""

ORACLES = {
    "p2_found": _NAMES + "SELECT field_name, item FROM top WHERE n >= 0.01 * n_group",
    "p2_top": _NAMES + "SELECT field_name, item, n, n_group FROM top WHERE n >= 0.01 * n_group",
    "p5_pairs": _SETS
    + """, g AS (SELECT *, CAST(n AS DOUBLE) AS t, CAST(n_ab AS DOUBLE) AS k11, CAST(n_a - n_ab AS DOUBLE) AS k12, CAST(n_b - n_ab AS DOUBLE) AS k21, CAST(n - n_a - n_b + n_ab AS DOUBLE) AS k22 FROM measured)
SELECT key_a, key_b, n_ab, n_a, n_b, n, round(k11 * t / (CAST(n_a AS DOUBLE) * n_b), 6) AS lift,
  round(2 * (CASE WHEN k11 > 0 THEN k11 * ln(k11 * t / (CAST(n_a AS DOUBLE) * n_b)) ELSE 0 END + CASE WHEN k12 > 0 THEN k12 * ln(k12 * t / (n_a * (t - n_b))) ELSE 0 END
   + CASE WHEN k21 > 0 THEN k21 * ln(k21 * t / ((t - n_a) * n_b)) ELSE 0 END + CASE WHEN k22 > 0 THEN k22 * ln(k22 * t / ((t - n_a) * (t - n_b))) ELSE 0 END), 6) AS llr FROM g""",
    "p5_found": _SETS + "SELECT key_a, key_b FROM measured WHERE n_ab >= 0.02 * n AND n_ab * n >= 3 * n_a * n_b",
}
