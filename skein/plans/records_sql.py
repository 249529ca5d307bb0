"""DuckDB SQL of the record queries, stated apart from the Spark code."""

P1 = """
WITH RECURSIVE m AS (
  SELECT DISTINCT msg_id, try_cast(message AS JSON) AS j FROM lsp_messages WHERE json_valid(message)
), roots AS (
  SELECT msg_id, r.name AS path, r.name AS parent,
         CASE WHEN json_type(r.v) = 'VARCHAR' THEN
           CASE WHEN json_valid(r.v ->> '$') THEN (r.v ->> '$')::JSON END ELSE r.v END AS v
  FROM m, LATERAL (SELECT 'params' AS name, j -> '$.params' AS v UNION ALL SELECT 'result', j -> '$.result') r
  WHERE json_type(j) = 'OBJECT'
), walk AS (
  SELECT msg_id, path, parent, v, false AS listed FROM roots WHERE json_type(v) IN ('OBJECT', 'ARRAY')
  UNION ALL
  SELECT w.msg_id, w.path || k.step,
         CASE WHEN w.listed AND json_type(w.v) = 'OBJECT' THEN w.path ELSE w.parent END,
         k.v, k.listed
  FROM walk w, LATERAL (
    SELECT '.' || e.k AS step, json_extract(w.v, '$."' || e.k || '"') AS v, false AS listed
    FROM (SELECT unnest(json_keys(w.v)) AS k WHERE json_type(w.v) = 'OBJECT') e
    UNION ALL
    SELECT '[' || i || ']', json_extract(w.v, '$[' || i || ']'), true
    FROM (SELECT unnest(range(CASE WHEN json_type(w.v) = 'ARRAY' THEN json_array_length(w.v)::BIGINT ELSE 0 END)) AS i) e
  ) k
  WHERE json_type(k.v) IN ('OBJECT', 'ARRAY')
)
SELECT DISTINCT 'message' AS record_type, msg_id AS record_id, path AS obj_path, parent AS parent_path
FROM walk WHERE listed AND json_type(v) = 'OBJECT'
UNION ALL
SELECT DISTINCT 'edge', id, 'evidence[' || (i - 1) || ']', 'evidence'
FROM (SELECT id, evidence, unnest(range(1, len(evidence) + 1)) AS i FROM edges)
WHERE evidence[i] IS NOT NULL
"""

_P1_LEAVES = """
WITH RECURSIVE m AS (
  SELECT DISTINCT msg_id, message AS text, try_cast(message AS JSON) AS j FROM lsp_messages WHERE json_valid(message)
), roots AS (
  SELECT msg_id, r.name AS obj, '' AS field,
         CASE WHEN json_type(r.v) = 'VARCHAR' AND json_valid(r.v ->> '$') THEN (r.v ->> '$')::JSON ELSE r.v END AS v
  FROM m, LATERAL (SELECT 'params' AS name, j -> '$.params' AS v UNION ALL SELECT 'result', j -> '$.result') r
  WHERE json_type(j) = 'OBJECT'
), walk AS (
  SELECT msg_id, obj, field, v, false AS listed FROM roots WHERE json_type(v) <> 'NULL'
  UNION ALL
  SELECT w.msg_id,
         CASE WHEN w.listed AND json_type(w.v) = 'OBJECT' THEN w.obj || CASE WHEN w.field = '' OR w.field LIKE '[%' THEN '' ELSE '.' END || w.field ELSE w.obj END,
         CASE WHEN w.listed AND json_type(w.v) = 'OBJECT' THEN '' ELSE w.field END || CASE WHEN k.listed OR ((w.field = '' OR (w.listed AND json_type(w.v) = 'OBJECT')) AND NOT k.listed) THEN '' ELSE '.' END || k.step,
         k.v, k.listed
  FROM walk w, LATERAL (
    SELECT e.k AS step, json_extract(w.v, '$."' || e.k || '"') AS v, false AS listed
    FROM (SELECT unnest(json_keys(w.v)) AS k WHERE json_type(w.v) = 'OBJECT') e
    UNION ALL
    SELECT '[' || i || ']', json_extract(w.v, '$[' || i || ']'), true
    FROM (SELECT unnest(range(CASE WHEN json_type(w.v) = 'ARRAY' THEN json_array_length(w.v)::BIGINT ELSE 0 END)) AS i) e
  ) k
  WHERE json_type(w.v) IN ('OBJECT', 'ARRAY')
), leaves AS (
  SELECT msg_id AS record_id, obj AS obj_path, field, CASE json_type(v) WHEN 'VARCHAR' THEN v ->> '$' WHEN 'NULL' THEN NULL ELSE v::VARCHAR END AS value
  FROM walk WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY')
)"""

P1_LEAVES = _P1_LEAVES + " SELECT record_id, obj_path, field, value FROM leaves"

_P1_VALUES = _P1_LEAVES + """, pieces AS (
  SELECT DISTINCT id, 'evidence[' || (i - 1) || ']' AS obj_path, evidence[i] AS v
  FROM (SELECT id, evidence, unnest(range(1, len(evidence) + 1)) AS i FROM edges)
), vals AS (
  SELECT 'message' AS record_type, record_id, obj_path, field, value FROM leaves
  UNION ALL SELECT 'edge', id, obj_path, 'kind', v.kind FROM pieces WHERE v.kind IS NOT NULL
  UNION ALL SELECT 'edge', id, obj_path, 'path', v.path FROM pieces WHERE v.path IS NOT NULL
  UNION ALL SELECT 'edge', id, obj_path, 'start_line', v.start_line::VARCHAR FROM pieces WHERE v.start_line IS NOT NULL
)"""

P1_VALUES = _P1_VALUES + " SELECT record_type, record_id, obj_path, field, value FROM vals"

P1_OBJECTS = _P1_VALUES + f""", found AS ({P1})
SELECT f.record_type, f.record_id, f.obj_path, f.parent_path, regexp_replace(f.obj_path, '\\[\\d+\\]', '[]', 'g') AS table_path, count(v.field)::INT AS n_fields,
  CASE WHEN count(v.field) > 0 THEN '{{' || string_agg(to_json(v.field)::VARCHAR || ':' || coalesce(to_json(v.value)::VARCHAR, 'null'), ',' ORDER BY v.field) || '}}' END AS fields
FROM found f LEFT JOIN vals v ON v.record_type = f.record_type AND v.record_id = f.record_id AND v.obj_path = f.obj_path GROUP BY ALL
"""

P2_COUNTS = """
SELECT target, kind, count(DISTINCT id)::BIGINT AS n_ids FROM edges GROUP BY target, kind
"""

P2 = """
SELECT target, kind FROM edges WHERE target IS NOT NULL GROUP BY target, kind
HAVING count(DISTINCT id) * 100 >= (SELECT count(DISTINCT id) FROM edges)
"""

_P3 = """
WITH RECURSIVE links AS (
  SELECT target AS child, min(source) AS parent FROM edges
  WHERE kind IN ('contains', 'defines') AND target IS NOT NULL AND source IS NOT NULL GROUP BY target
), ids AS (
  SELECT source AS node FROM edges WHERE kind IN ('contains', 'defines') AND source IS NOT NULL
  UNION SELECT target FROM edges WHERE kind IN ('contains', 'defines') AND target IS NOT NULL
), tree AS (
  SELECT node, node AS root, 0::BIGINT AS depth, node AS path FROM ids WHERE node NOT IN (SELECT child FROM links)
  UNION ALL
  SELECT l.child, t.root, t.depth + 1, t.path || ' > ' || l.child FROM tree t JOIN links l ON l.parent = t.node
)"""

P3_PATHS = _P3 + " SELECT node, root, depth, path FROM tree"

P3_DESCENDANTS = _P3 + """, up AS (
  SELECT l.parent AS ancestor, l.child AS descendant, 1::BIGINT AS distance FROM links l JOIN tree t ON t.node = l.child
  UNION ALL
  SELECT l.parent, u.descendant, u.distance + 1 FROM up u JOIN links l ON l.child = u.ancestor
) SELECT ancestor, descendant, distance FROM up"""

P3 = _P3 + """, lost AS (
  SELECT l.child AS node, l.parent FROM links l WHERE l.child NOT IN (SELECT node FROM tree)
), reach AS (
  SELECT node AS start, parent AS reached FROM lost
  UNION
  SELECT r.start, l.parent FROM reach r JOIN lost l ON l.node = r.reached
), ring AS (
  SELECT start AS node FROM reach WHERE start = reached
), ring_root AS (
  SELECT r.start AS node, min(r.reached) AS root FROM reach r WHERE r.start IN (SELECT node FROM ring) GROUP BY 1
), below AS (
  SELECT node, root, 0::BIGINT AS depth FROM ring_root
  UNION ALL
  SELECT l.node, b.root, b.depth + 1 FROM below b JOIN lost l ON l.parent = b.node WHERE l.node NOT IN (SELECT node FROM ring)
)
SELECT node, root, depth, 'tree' AS node_state FROM tree
UNION ALL SELECT node, root, depth, CASE WHEN depth = 0 THEN 'cycle' ELSE 'below_cycle' END FROM below"""


def _latest(entity: str, source: str, key: str, payload: str) -> str:
    return f"""
  SELECT '{entity}' AS entity, snapshot, k, (
    SELECT coalesce(string_agg(t.fullkey || '=' || t.type || ':' || CASE
             WHEN t.type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN (t.atom::VARCHAR)::DOUBLE::VARCHAR
             ELSE coalesce(t.atom::VARCHAR, '') END, chr(10) ORDER BY t.fullkey), '')
    FROM (SELECT fullkey, CASE WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'DOUBLE' ELSE type END AS type, atom
          FROM json_tree(p::JSON) WHERE type <> 'NULL' OR fullkey LIKE '%]') t) AS v
  FROM (SELECT snapshot, {key} AS k, arg_max({payload}, delivered_at) AS p FROM {source} GROUP BY ALL)"""


_P4 = (
    "WITH held AS ("
    + _latest("node", "node_identities", "stable_identity", "node_payload")
    + " UNION ALL "
    + _latest(
        "edge",
        "edge_identities",
        "source_identity || '|' || target_identity || '|' || edge_kind || '|' || coalesce(semantic_role, '')",
        "edge_payload",
    )
    + """
), names AS (SELECT entity, snapshot, row_number() OVER (PARTITION BY entity ORDER BY snapshot) AS i
             FROM (SELECT DISTINCT entity, snapshot FROM held)),
rows_ AS (SELECT h.*, i FROM held h JOIN names USING (entity, snapshot))"""
)

P4 = _P4 + """
SELECT n.entity, n.snapshot, coalesce(a.k, b.k) AS stable_key,
       CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change_type
FROM rows_ a FULL JOIN rows_ b ON a.entity = b.entity AND a.k = b.k AND b.i = a.i + 1
JOIN names n ON n.entity = coalesce(a.entity, b.entity) AND n.i = coalesce(b.i, a.i + 1)
WHERE n.i > 1 AND (a.k IS NULL OR b.k IS NULL OR a.v <> b.v)"""

_P5 = """
WITH refs AS (
  SELECT 'edges' AS referrer, id::VARCHAR AS record_key, 'source' AS ref_column, source AS fk, created_at AS used_at FROM edges
  UNION SELECT 'edges', id::VARCHAR, 'target', target, created_at FROM edges
  UNION SELECT 'semantic_facts', fact_id, 'node_id', node_id, created_at FROM semantic_facts
), lives AS (
  SELECT id, first_indexed_at AS since, retired_at AS until FROM nodes
  UNION SELECT id, first_indexed_at, NULL FROM external_nodes
), judged AS (
  SELECT r.referrer, r.record_key, r.ref_column, r.used_at,
         bool_or(l.since <= r.used_at AND (l.until IS NULL OR l.until > r.used_at)) AS live,
         count(l.id) AS n, min(l.since) AS born
  FROM refs r LEFT JOIN lives l ON l.id = r.fk WHERE r.fk IS NOT NULL
  GROUP BY r.referrer, r.record_key, r.ref_column, r.fk, r.used_at
), found AS (
  SELECT DISTINCT referrer, record_key, ref_column, used_at,
         CASE WHEN n = 0 THEN 'missing' WHEN born > used_at THEN 'late' ELSE 'deleted' END AS reason
  FROM judged WHERE n = 0 OR NOT live
)"""

P5 = _P5 + " SELECT DISTINCT referrer, record_key, ref_column, reason, strftime(used_at, '%Y-%m') AS ref_month FROM found"

P5_COUNTS = _P5 + """
SELECT referrer, ref_column, reason, strftime(used_at, '%Y-%m') AS ref_month, count(*)::BIGINT AS n_refs
FROM found GROUP BY ALL"""

P6 = """
WITH runs AS (
  SELECT run_no, cutoff_at, row_number() OVER (ORDER BY cutoff_at, run_no) AS i
  FROM index_builds WHERE run_status = 'success'
), clean AS (
  SELECT repo_id || ':' || regexp_replace(path, '^(\\./)+', '') AS k, lower(file_hash) AS h, scanned_at, arrived_at
  FROM files WHERE file_hash IS NOT NULL
), seen AS (
  SELECT r.i, r.run_no, k, arg_max(h, scanned_at) AS h FROM runs r JOIN clean c ON c.arrived_at <= r.cutoff_at GROUP BY ALL
)
SELECT a.run_no, 'file' AS record_type, a.k AS record_key
FROM seen a LEFT JOIN seen b ON b.k = a.k AND b.i = a.i - 1 WHERE b.k IS NULL OR a.h <> b.h
UNION ALL
SELECT arg_min(r.run_no, r.cutoff_at), 'fact', f.fact_id
FROM semantic_facts f JOIN runs r ON f.arrived_at <= r.cutoff_at GROUP BY f.fact_id
"""

_P7 = """
WITH lines AS (
  SELECT DISTINCT export_id, raw_record::JSON AS j FROM fact_exports
  WHERE json_valid(raw_record) AND json_type(raw_record) = 'OBJECT'
), listed AS (
  SELECT export_id, min(feed) AS feed, min(exported_at) AS sent_at FROM fact_exports GROUP BY 1
), chain AS (
  SELECT export_id, lag(export_id) OVER (PARTITION BY feed ORDER BY sent_at, export_id) AS previous FROM listed
), vals AS (
  SELECT export_id, j ->> '$.fact_id' AS fact_id, e.key AS field,
         CASE e.type WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean'
                     WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS t,
         CASE WHEN e.type <> 'NULL' THEN e.value::VARCHAR END AS v
  FROM lines, json_each(j) e
), cat AS (
  SELECT export_id, field, list_sort(list_distinct(list(t) FILTER (t IS NOT NULL))) AS ts FROM vals GROUP BY 1, 2
), both_ AS (
  SELECT c.export_id, c.previous, f.field,
         (SELECT ts FROM cat WHERE cat.export_id = c.export_id AND cat.field = f.field) AS now_ts,
         (SELECT ts FROM cat WHERE cat.export_id = c.previous AND cat.field = f.field) AS was_ts,
         EXISTS (SELECT 1 FROM cat WHERE cat.export_id = c.export_id AND cat.field = f.field) AS now_,
         EXISTS (SELECT 1 FROM cat WHERE cat.export_id = c.previous AND cat.field = f.field) AS was
  FROM chain c, (SELECT DISTINCT field FROM vals) f WHERE c.previous IS NOT NULL
), renamed AS (
  SELECT g.export_id, l.field AS old_field, g.field AS new_field
  FROM both_ g JOIN both_ l ON l.export_id = g.export_id AND l.was AND NOT l.now_
  JOIN vals nv ON nv.export_id = g.export_id AND nv.field = g.field AND nv.v IS NOT NULL
  JOIN vals ov ON ov.export_id = g.previous AND ov.field = l.field AND ov.v IS NOT NULL AND ov.fact_id = nv.fact_id
  WHERE g.now_ AND NOT g.was GROUP BY ALL HAVING bool_and(nv.v = ov.v)
)"""

P7 = _P7 + """
SELECT export_id, 'renamed' AS change_type, old_field, new_field FROM renamed
UNION ALL
SELECT export_id, 'added', '', field FROM both_ b WHERE now_ AND NOT was
  AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.export_id = b.export_id AND r.new_field = b.field)
UNION ALL
SELECT export_id, 'removed', field, '' FROM both_ b WHERE was AND NOT now_
  AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.export_id = b.export_id AND r.old_field = b.field)
UNION ALL
SELECT export_id, 'type_changed', field, field FROM both_ WHERE was AND now_ AND len(now_ts) > 0 AND len(was_ts) > 0 AND now_ts <> was_ts
"""


def p7_table(target: dict[str, str]) -> str:
    """The consistent table for a target schema, other names found by the renames."""
    fixed = ", ".join(f"('{c}', '{t}')" for c, t in target.items())
    number = "json_type(v) IN ('UBIGINT', 'BIGINT', 'DOUBLE')"
    columns = ", ".join(f"max(val) FILTER (field = '{c}'){'::DOUBLE' if t == 'double' else ''} AS {c}" for c, t in target.items())
    return (
        _P7.replace("WITH lines", "WITH RECURSIVE lines")
        + f""", fixed(field, kind) AS (VALUES {fixed}),
leads AS (
  SELECT field, field AS name FROM fixed
  UNION
  SELECT l.field, r.new_field FROM leads l JOIN renamed r ON r.old_field = l.name WHERE r.new_field NOT IN (SELECT field FROM fixed)
), names AS (
  SELECT field, field AS name, 0 AS o FROM fixed
  UNION ALL SELECT min(field), name, 1 FROM leads WHERE name <> field GROUP BY name HAVING count(DISTINCT field) = 1
), recs AS (
  SELECT row_number() OVER () AS rid, export_id, line_no, raw_record::JSON AS j FROM fact_exports
  WHERE json_valid(raw_record) AND json_type(raw_record) = 'OBJECT'
), cells AS (
  SELECT rid, n.field, n.o, n.name, f.kind, json_extract(j, '$."' || n.name || '"') AS v FROM recs, names n JOIN fixed f USING (field)
), casted AS (
  SELECT rid, field, o, name, CASE kind
    WHEN 'string' THEN CASE WHEN json_type(v) = 'VARCHAR' THEN v ->> '$' WHEN {number} THEN v::VARCHAR END
    WHEN 'bigint' THEN CASE WHEN json_type(v) IN ('UBIGINT', 'BIGINT') OR json_type(v) = 'VARCHAR' AND regexp_full_match(v ->> '$', '[+-]?\\d+') THEN v ->> '$'
                            WHEN json_type(v) = 'DOUBLE' AND v::DOUBLE = floor(v::DOUBLE) THEN v::DOUBLE::BIGINT::VARCHAR END
    WHEN 'double' THEN CASE WHEN {number} THEN v::VARCHAR WHEN json_type(v) = 'VARCHAR' THEN try_cast(v ->> '$' AS DOUBLE)::VARCHAR END
    WHEN 'boolean' THEN CASE WHEN json_type(v) = 'BOOLEAN' THEN v::VARCHAR WHEN json_type(v) = 'VARCHAR' AND (v ->> '$') IN ('true', 'false') THEN v ->> '$' END
    ELSE CASE WHEN json_type(v) = 'ARRAY' AND len(list_filter(json_transform(v, '["JSON"]'), lambda x: json_type(x) = 'VARCHAR')) = json_array_length(v)
              THEN array_to_string(json_transform(v, '["VARCHAR"]'), ',') END
  END AS val FROM cells WHERE v IS NOT NULL AND json_type(v) <> 'NULL'
), best AS (SELECT rid, field, arg_min(val, (o, name)) AS val FROM casted WHERE val IS NOT NULL GROUP BY rid, field)
SELECT r.export_id, r.line_no, {columns}, (len(json_keys(any_value(r.j))) - count(b.field))::INT AS n_rescued
FROM recs r LEFT JOIN best b ON b.rid = r.rid GROUP BY r.rid, r.export_id, r.line_no"""
    )


P4_INTERVALS = _P4 + """, islands AS (
  SELECT entity, k, v, i - row_number() OVER (PARTITION BY entity, k, v ORDER BY i) AS g, i FROM rows_
), spans AS (SELECT entity, k, v, g, min(i) - 1 AS first, count(*) AS n_held FROM islands GROUP BY ALL)
SELECT entity, first::INT AS first, n_held::INT AS n_held, count(*)::BIGINT AS n_versions FROM spans GROUP BY ALL"""

SQL = {
    "p4_intervals": P4_INTERVALS,
    "p1_found": P1,
    "p1_leaves": P1_LEAVES,
    "p1_values": P1_VALUES,
    "p1_objects": P1_OBJECTS,
    "p2_found": P2,
    "p2_counts": P2_COUNTS,
    "p3_found": P3,
    "p3_paths": P3_PATHS,
    "p3_descendants": P3_DESCENDANTS,
    "p4_found": P4,
    "p5_found": P5,
    "p5_counts": P5_COUNTS,
    "p6_found": P6,
    "p7_found": P7,
}
