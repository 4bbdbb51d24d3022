"""The queries of the data-processing operators, with SQL for DuckDB where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscape.operators import hierarchy, nested, orphans, schema_drift, snapshot_diff, tree_aggregate
from callscape.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.hierarchy_of(*hierarchy.path_step_ends(table(spark, folder, "path_steps")))


def p1_paths(spark: SparkSession, folder: str) -> DataFrame:
    h = hierarchy.hierarchy_of(*hierarchy.path_step_ends(table(spark, folder, "path_steps")), with_path=True)
    return h.select("trace_id", "node", "root", "depth", F.array_join("path", " > ").alias("path"))


def p1_descendants(spark: SparkSession, folder: str) -> DataFrame:
    h = hierarchy.hierarchy_of(*hierarchy.path_step_ends(table(spark, folder, "path_steps")), with_path=True)
    return hierarchy.descendants(h, ["trace_id"])


def p1_all_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.all_descendants(hierarchy.path_step_links(table(spark, folder, "path_steps")), ["trace_id"])


def p1_other_parents(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.other_parents(*hierarchy.path_step_ends(table(spark, folder, "path_steps")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.schema_changes(table(spark, folder, "extract_files"))


def p2_locations(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.consistent_locations(table(spark, folder, "extract_files"))


def p2_specs(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.consistent_specs(table(spark, folder, "extract_files"))


def p2_versions(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.fingerprint_versions(table(spark, folder, "extract_files"))


def p2_unlisted(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.unlisted_keys(table(spark, folder, "extract_files"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.record_places(table(spark, folder, "call_graphs"))


def p3_bridge(spark: SparkSession, folder: str) -> DataFrame:
    return nested.bridge_table(table(spark, folder, "call_graphs"))


def p3_objects(spark: SparkSession, folder: str) -> DataFrame:
    return nested.object_contents(table(spark, folder, "call_graphs"))


def p3_clauses(spark: SparkSession, folder: str) -> DataFrame:
    return nested.flat_table(table(spark, folder, "call_graphs"), "clause")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return tree_aggregate.heavy_pairs(table(spark, folder, "calls"))


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return tree_aggregate.pair_counts(table(spark, folder, "calls"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("call_id", "reason")


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_counts(_orphans(spark, folder), "calls")


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_calls(*(table(spark, folder, t) for t in ("calls", "function_locations", "library_functions")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_diff.snapshot_changes(table(spark, folder, "location_snapshots"))


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    c = snapshot_diff.snapshot_changes(table(spark, folder, "location_snapshots"))
    return c.groupBy("snapshot_no", "change_kind").agg(F.count(F.lit(1)).alias("n_clauses"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p1_all_descendants, p1_other_parents, p2_found, p2_locations, p2_specs, p2_versions, p2_unlisted, p3_found, p3_bridge, p3_objects, p3_clauses, p4_found, p4_pairs, p5_found, p5_counts, p6_found, p6_counts)}


def plain_sql(module: str) -> str:
    return rf"""regexp_replace(regexp_replace({module}, '^[\s\pZ]*(:")?(Elixir\.)?', ''), '"?[\s\pZ]*$', '')"""


def name_sql(name: str) -> str:
    return rf"""regexp_replace(regexp_replace({name}, '^[\s\pZ]+|[\s\pZ]+$', '', 'g'), '/[0-9]+$', '')"""


def hex_sql(digest: str) -> str:
    return rf"""regexp_replace(lower(regexp_replace(coalesce({digest}, ''), '^[\s\pZ]+|[\s\pZ]+$', '', 'g')), '^(0x)?0*', '')"""


_NODES = f"""
RECURSIVE link AS (
  SELECT trace_id, {plain_sql("callee_module")} || '.' || {name_sql("callee_function")} AS node,
         {plain_sql("caller_module")} || '.' || {name_sql("caller_function")} AS up FROM path_steps),
nodes AS (SELECT trace_id, node, min(up) AS up FROM (SELECT * FROM link UNION ALL SELECT trace_id, up, NULL FROM link) WHERE node IS NOT NULL GROUP BY ALL),
tree AS (
  SELECT trace_id, node, node AS root, 0::BIGINT AS depth, node AS path FROM nodes WHERE up IS NULL
  UNION ALL SELECT n.trace_id, n.node, t.root, t.depth + 1, t.path || ' > ' || n.node FROM nodes n JOIN tree t ON n.trace_id = t.trace_id AND n.up = t.node),
rest AS (SELECT n.* FROM nodes n ANTI JOIN tree t ON n.trace_id = t.trace_id AND n.node = t.node),
walk AS (SELECT trace_id, node, up AS at FROM rest UNION SELECT w.trace_id, w.node, r.up FROM walk w JOIN rest r ON w.trace_id = r.trace_id AND w.at = r.node),
looped AS (SELECT r.trace_id, r.node, w.node IS NOT NULL AS on_loop FROM rest r LEFT JOIN walk w ON w.trace_id = r.trace_id AND w.node = r.node AND w.at = r.node)
"""

_CALLS = f"""
c AS (SELECT DISTINCT ON (call_id) call_id, project, {plain_sql("callee_module")} AS callee_module, {name_sql("callee_function")} AS callee_function,
             coalesce(callee_arity, TRY_CAST(regexp_extract(callee_function, '/([0-9]+)\\s*$', 1) AS BIGINT)) AS arity, extracted_at
      FROM calls WHERE callee_module IS NOT NULL AND callee_function IS NOT NULL)
"""

_ORPHANS = f"""
WITH {_CALLS},
lib AS (SELECT DISTINCT {plain_sql("module")} AS module, {name_sql("name")} AS name, arity FROM library_functions),
loc AS (SELECT DISTINCT project, {plain_sql("module")} AS module, {name_sql("name")} AS name, arity, loaded_at, removed_at FROM function_locations),
r AS (SELECT * FROM c WHERE callee_function <> '%' AND NOT EXISTS (SELECT 1 FROM lib WHERE lib.module = callee_module AND lib.name = callee_function AND lib.arity = c.arity)),
j AS (SELECT r.call_id, any_value(r.extracted_at) AS called_at, count(loc.module) AS n,
             count(*) FILTER (WHERE loc.loaded_at <= r.extracted_at) AS n_before,
             count(*) FILTER (WHERE loc.loaded_at <= r.extracted_at AND (loc.removed_at IS NULL OR loc.removed_at > r.extracted_at)) AS n_now
      FROM r LEFT JOIN loc ON loc.project = r.project AND loc.module = r.callee_module AND loc.name = r.callee_function AND loc.arity = r.arity GROUP BY r.call_id),
o AS (SELECT call_id, called_at, CASE WHEN n_before > 0 THEN 'deleted' WHEN n > 0 THEN 'late' ELSE 'missing' END AS reason FROM j WHERE n_now = 0)
"""

_CHANGES = f"""
WITH s AS (
  SELECT DISTINCT ON (project, module, name, arity, clause_no, snapshot_no) snapshot_no, project, module, name, arity, clause_no, content FROM (
    SELECT snapshot_no, project, {plain_sql("module")} AS module, {name_sql("name")} AS name, arity, clause_no, loaded_at,
           {hex_sql("source_sha")} || '|' || {hex_sql("ast_sha")} || '|' || coalesce(start_line::VARCHAR, '') AS content FROM location_snapshots)
  ORDER BY project, module, name, arity, clause_no, snapshot_no, loaded_at DESC),
p AS (SELECT project, snapshot_no, lag(snapshot_no) OVER (PARTITION BY project ORDER BY snapshot_no) AS prev FROM (SELECT DISTINCT project, snapshot_no FROM s)),
cur AS (SELECT s.*, p.prev FROM s JOIN p USING (project, snapshot_no) WHERE p.prev IS NOT NULL),
old AS (SELECT s.project, p.snapshot_no, s.module, s.name, s.arity, s.clause_no, s.content FROM s JOIN p ON p.project = s.project AND p.prev = s.snapshot_no),
f AS (SELECT coalesce(cur.snapshot_no, old.snapshot_no) AS snapshot_no, coalesce(cur.project, old.project) AS project, coalesce(cur.module, old.module) AS module,
             coalesce(cur.name, old.name) AS name, coalesce(cur.arity, old.arity) AS arity, coalesce(cur.clause_no, old.clause_no) AS clause_no,
             CASE WHEN old.content IS NULL THEN 'added' WHEN cur.content IS NULL THEN 'removed' WHEN cur.content <> old.content THEN 'changed' END AS change_kind
      FROM cur FULL JOIN old ON cur.project = old.project AND cur.snapshot_no = old.snapshot_no AND cur.module = old.module AND cur.name = old.name AND cur.arity = old.arity AND cur.clause_no = old.clause_no)
"""

def listed_sql(value: str) -> str:
    return f"CASE WHEN json_type({value}) = 'ARRAY' THEN {value} WHEN {value} IS NULL OR json_type({value}) = 'NULL' THEN CAST('[]' AS JSON) ELSE json_array({value}) END"


#: Keys that a field was written under, newest first (fixed values).
_FIELD_KEYS = {
    "complexity": "'complexity', 'cyclomatic_complexity', 'cyclomatic', 'cc'",
    "file": "'file', 'source_file', 'sourceFile', 'path', 'src'",
    "max_nesting_depth": "'max_nesting_depth', 'maxNestingDepth', 'nesting_depth', 'deepest_block'",
    "specs": "'specs', 'typespecs', 'type_specs', 'contracts'",
}
_LOCATION_KEYS = ", ".join(_FIELD_KEYS[f] for f in ("file", "complexity", "max_nesting_depth"))

_FILES = """
f AS (SELECT DISTINCT ON (file_no) file_no, project, extracted_at, CAST(body AS JSON) AS b FROM extract_files WHERE json_valid(body) AND json_type(body) = 'OBJECT' ORDER BY file_no, received_at DESC, md5(body) DESC),
loc AS (SELECT file_no, project, extracted_at, m.key AS module, l.key AS location_key, l.value AS v FROM f, json_each(b, '$.function_locations') m, json_each(m.value) l WHERE l.type = 'OBJECT')
"""

_SIGNATURES = f"""
{_FILES},
raw AS (
  SELECT file_no, r.key AS k, r.type AS t FROM loc, json_each(v) r WHERE r.key IN ({_LOCATION_KEYS})
  UNION ALL SELECT file_no, r.key, r.type FROM f, json_each(b) r WHERE r.key IN ({_FIELD_KEYS["specs"]})),
sig AS (
  SELECT file_no, CASE {" ".join(f"WHEN k IN ({keys}) THEN '{f}'" for f, keys in _FIELD_KEYS.items())} END AS field, min(k) AS k,
    min(CASE WHEN t IN ('UBIGINT', 'BIGINT') THEN 'whole' WHEN t = 'VARCHAR' THEN 'string' WHEN t = 'DOUBLE' THEN 'fraction' WHEN t = 'ARRAY' THEN 'list' ELSE lower(t) END) AS t
  FROM raw WHERE t <> 'NULL' GROUP BY ALL)
"""

_DRIFT = f"""
WITH {_SIGNATURES},
o AS (SELECT file_no, lag(file_no) OVER (PARTITION BY project ORDER BY extracted_at) AS prev FROM f),
x AS (SELECT o.file_no, c.field, p.k AS pk, p.t AS pt, n.k, n.t FROM o CROSS JOIN (VALUES ('file'), ('complexity'), ('max_nesting_depth'), ('specs')) c(field)
      LEFT JOIN sig p ON p.file_no = o.prev AND p.field = c.field LEFT JOIN sig n ON n.file_no = o.file_no AND n.field = c.field WHERE o.prev IS NOT NULL)
SELECT file_no, field, 'added' AS change_kind FROM x WHERE pk IS NULL AND k IS NOT NULL
UNION ALL SELECT file_no, field, 'removed' FROM x WHERE pk IS NOT NULL AND k IS NULL
UNION ALL SELECT file_no, field, 'renamed' FROM x WHERE pk <> k
UNION ALL SELECT file_no, field, 'retyped' FROM x WHERE pt <> t
"""

_VERSIONS = f"""
WITH {_SIGNATURES},
chain AS (SELECT * FROM (VALUES {", ".join(f"('{f}', [{keys}])" for f, keys in _FIELD_KEYS.items())}) c(field, keys)),
casts AS (SELECT * FROM (VALUES
  ('complexity', 'object', ['cast complexity object string', 'cast complexity string fraction', 'cast complexity fraction whole']), ('complexity', 'string', ['cast complexity string fraction', 'cast complexity fraction whole']), ('complexity', 'fraction', ['cast complexity fraction whole']),
  ('max_nesting_depth', 'object', ['cast max_nesting_depth object string', 'cast max_nesting_depth string fraction', 'cast max_nesting_depth fraction whole']), ('max_nesting_depth', 'string', ['cast max_nesting_depth string fraction', 'cast max_nesting_depth fraction whole']), ('max_nesting_depth', 'fraction', ['cast max_nesting_depth fraction whole']),
  ('file', 'object', ['cast file object list', 'cast file list string']), ('file', 'list', ['cast file list string']), ('specs', 'list', ['cast specs list object'])) c(field, t, steps)),
defaults AS (SELECT * FROM (VALUES ('complexity', ['default complexity 1']), ('max_nesting_depth', ['default max_nesting_depth 0'])) d(field, steps)),
each AS (
  SELECT f.file_no, f.extracted_at, c.field, s.k, s.t,
    list_concat(list_concat(CASE WHEN s.k IS NULL THEN CAST([] AS VARCHAR[]) ELSE list_transform(range(list_position(c.keys, s.k) - 1, 0, -1), lambda x: 'rename ' || c.field || ' ' || c.keys[x + 1] || ' ' || c.keys[x]) END, coalesce(ct.steps, CAST([] AS VARCHAR[]))), coalesce(d.steps, CAST([] AS VARCHAR[]))) AS steps
  FROM f CROSS JOIN chain c LEFT JOIN sig s ON s.file_no = f.file_no AND s.field = c.field LEFT JOIN casts ct ON ct.field = c.field AND ct.t = s.t LEFT JOIN defaults d ON d.field = c.field),
v AS (SELECT file_no, extracted_at, '{{' || coalesce(string_agg('"' || field || '":{{"key":"' || k || '","kind":"' || t || '"}}', ',' ORDER BY field), '') || '}}' AS fingerprint, array_to_string(flatten(list(steps ORDER BY field)), '; ') AS steps FROM each GROUP BY ALL)
SELECT fingerprint, steps, count(*) AS n_files, min(extracted_at) AS first_at, max(extracted_at) AS last_at FROM v GROUP BY ALL
"""


def _first_of(value: str, keys: str) -> str:
    return "CAST(coalesce(" + ", ".join(f"nullif(CAST({value} -> {k} AS VARCHAR), 'null')" for k in keys.split(", ")) + ") AS JSON)"


def _number(value: str) -> str:
    return f"CAST(trunc(CAST(CASE WHEN json_type({value}) = 'OBJECT' THEN {value} ->> 'value' ELSE {value} ->> '$' END AS DOUBLE)) AS BIGINT)"


_LOCATIONS = f"""
WITH {_FILES},
x AS (SELECT *, {_first_of("v", _FIELD_KEYS["file"])} AS fv, {_first_of("v", _FIELD_KEYS["complexity"])} AS cv, {_first_of("v", _FIELD_KEYS["max_nesting_depth"])} AS nv FROM loc),
e AS (SELECT file_no, module, location_key, '{{' || string_agg('"' || r.key || '":' || coalesce(CAST(r.value AS VARCHAR), 'null'), ',' ORDER BY r.key) || '}}' AS extra FROM loc, json_each(v) r
      WHERE r.key NOT IN ({_LOCATION_KEYS}, 'name', 'arity', 'kind', 'line', 'start_line', 'end_line') GROUP BY ALL)
SELECT x.file_no, project, {plain_sql("x.module")} AS module, x.location_key, v ->> 'name' AS name, CAST(v ->> 'arity' AS BIGINT) AS arity, v ->> 'kind' AS kind, CAST(v ->> 'line' AS BIGINT) AS line,
  CAST(v ->> 'start_line' AS BIGINT) AS start_line, CAST(v ->> 'end_line' AS BIGINT) AS end_line,
  CASE json_type(fv) WHEN 'VARCHAR' THEN fv ->> '$' WHEN 'ARRAY' THEN array_to_string(from_json(fv, '["VARCHAR"]'), '/') WHEN 'OBJECT' THEN (fv ->> 'root') || '/' || (fv ->> 'rel') END AS file,
  coalesce({_number("cv")}, 1) AS complexity, coalesce({_number("nv")}, 0) AS max_nesting_depth, extra, CAST(NULL AS VARCHAR) AS uncast
FROM x LEFT JOIN e ON e.file_no = x.file_no AND e.module = x.module AND e.location_key = x.location_key
"""

_UNLISTED = f"""
WITH {_FILES}
SELECT project, r.key AS key, count(DISTINCT file_no) AS n_files, count(*) AS n_records, min(extracted_at) AS first_at, max(extracted_at) AS last_at FROM loc, json_each(v) r
WHERE r.type <> 'NULL' AND r.key NOT IN ({_LOCATION_KEYS}, 'name', 'arity', 'kind', 'line', 'start_line', 'end_line') GROUP BY project, r.key
"""


_SPECS = f"""
WITH {_FILES},
sv AS (SELECT file_no, project, {_first_of("b", _FIELD_KEYS["specs"])} AS s FROM f),
spec AS (
  SELECT file_no, project, m.key AS module, CAST(e.key AS BIGINT) AS spec_no, e.value AS v FROM sv, json_each(s) m, json_each({listed_sql("m.value")}) e WHERE json_type(s) = 'OBJECT' AND e.type = 'OBJECT'
  UNION ALL SELECT file_no, project, e.value ->> 'module', row_number() OVER (PARTITION BY file_no, e.value ->> 'module' ORDER BY CAST(e.key AS BIGINT)) - 1, e.value FROM sv, json_each(s) e WHERE json_type(s) = 'ARRAY' AND e.type = 'OBJECT'),
clause AS (SELECT file_no, module, spec_no, CAST(c.key AS BIGINT) AS clause_no, c.value AS c FROM spec, json_each({listed_sql("(v -> 'clauses')")}) c WHERE c.type = 'OBJECT')
SELECT spec.file_no, project, {plain_sql("spec.module")} AS module, spec.spec_no, v ->> 'name' AS name, CAST(v ->> 'arity' AS BIGINT) AS arity, v ->> 'kind' AS kind, CAST(v ->> 'line' AS BIGINT) AS line, coalesce(clause_no, -1) AS clause_no,
  coalesce(array_to_string(from_json({listed_sql("(c -> 'input_strings')")}, '["VARCHAR"]'), ', '), '') AS inputs, coalesce(array_to_string(from_json({listed_sql("(c -> 'return_strings')")}, '["VARCHAR"]'), ' | '), '') AS returns, c ->> 'full' AS full
FROM spec LEFT JOIN clause ON clause.file_no = spec.file_no AND clause.module = spec.module AND clause.spec_no = spec.spec_no
"""

NESTED = f"""
WITH w0 AS (SELECT graph_id, project, received_at, md5(body) AS body_md5, CAST(body AS JSON) AS d FROM call_graphs WHERE json_valid(body)),
w1 AS (SELECT graph_id, project, received_at, body_md5, CASE WHEN json_type(d) = 'VARCHAR' THEN TRY_CAST(d ->> '$' AS JSON) ELSE d END AS d FROM w0),
w2 AS (SELECT graph_id, project, received_at, body_md5, CASE WHEN json_type(d) = 'ARRAY' THEN d -> 0 ELSE d END AS d FROM w1 WHERE d IS NOT NULL),
w3 AS (SELECT graph_id, project, received_at, body_md5, CASE WHEN json_type(d -> 'graph') = 'OBJECT' THEN d -> 'graph' ELSE d END AS d FROM w2),
g AS (SELECT DISTINCT ON (graph_id) graph_id, project, d FROM w3 WHERE json_type(d) = 'OBJECT' ORDER BY graph_id, received_at DESC, body_md5 DESC),
struct AS (SELECT graph_id, m.key AS module, m.value AS v FROM g, json_each(d, '$.structs') m WHERE m.type = 'OBJECT'),
fields AS (SELECT graph_id, module, e.value ->> 'field' AS item, CAST(e.key AS BIGINT) AS item_no, e.value AS v FROM struct s, json_each({listed_sql("(s.v -> 'fields')")}) e WHERE e.type <> 'NULL'),
locations AS (SELECT graph_id, m.key AS module, e.key AS item, e.value AS v FROM g, json_each(d, '$.function_locations') m, json_each(m.value) e WHERE m.type = 'OBJECT' AND e.type <> 'NULL'),
spec AS (SELECT graph_id, m.key AS module, (e.value ->> 'name') || '/' || (e.value ->> 'arity') AS item, CAST(e.key AS BIGINT) AS item_no, e.value AS v FROM g, json_each(d, '$.specs') m, json_each({listed_sql("m.value")}) e WHERE e.type = 'OBJECT'),
clause AS (SELECT s.* EXCLUDE (v), CAST(c.key AS BIGINT) AS clause_no, c.value AS v FROM spec s, json_each({listed_sql("(s.v -> 'clauses')")}) c WHERE c.type <> 'NULL'),
typed AS (SELECT graph_id, m.key AS module, e.value ->> 'name' AS item, CAST(e.key AS BIGINT) AS item_no, e.value AS v FROM g, json_each(d, '$.types') m, json_each({listed_sql("m.value")}) e WHERE e.type = 'OBJECT'),
r AS (
  SELECT graph_id, 'struct_field' AS record_kind, module, item, item_no, -1 AS clause_no, -1 AS element_no, 'struct' AS parent_kind, v FROM fields
  UNION ALL SELECT graph_id, 'struct', module, '', -1, -1, -1, 'graph', v FROM struct
  UNION ALL SELECT graph_id, 'location', module, item, -1, -1, -1, 'graph', v FROM locations
  UNION ALL SELECT graph_id, 'spec', module, item, item_no, -1, -1, 'graph', v FROM spec
  UNION ALL SELECT graph_id, 'clause', module, item, item_no, clause_no, -1, 'spec', v FROM clause
  UNION ALL SELECT graph_id, 'input', module, item, item_no, clause_no, CAST(e.key AS BIGINT), 'clause', e.value FROM clause c, json_each({listed_sql("(c.v -> 'input_strings')")}) e WHERE e.type <> 'NULL'
  UNION ALL SELECT graph_id, 'result', module, item, item_no, clause_no, CAST(e.key AS BIGINT), 'clause', e.value FROM clause c, json_each({listed_sql("(c.v -> 'return_strings')")}) e WHERE e.type <> 'NULL'
  UNION ALL SELECT graph_id, 'type', module, item, item_no, -1, -1, 'graph', v FROM typed
  UNION ALL SELECT graph_id, 'param', module, item, item_no, -1, CAST(e.key AS BIGINT), 'type', e.value FROM typed t, json_each({listed_sql("(t.v -> 'params')")}) e WHERE e.type <> 'NULL'),
n AS (SELECT r.* EXCLUDE (v), row_number() OVER () AS rid, v FROM r),
own AS (SELECT rid, '{{' || string_agg('"' || k.key || '":' || coalesce(CAST(k.value AS VARCHAR), 'null'), ',' ORDER BY k.key) || '}}' AS c FROM n, json_each(v) k WHERE json_type(v) = 'OBJECT'
        AND NOT (record_kind = 'struct' AND k.key = 'fields' OR record_kind = 'spec' AND k.key = 'clauses' OR record_kind = 'clause' AND k.key IN ('input_strings', 'return_strings') OR record_kind = 'type' AND k.key = 'params') GROUP BY rid),
rec AS (SELECT n.* EXCLUDE (v), CASE WHEN json_type(v) = 'OBJECT' THEN coalesce(own.c, '{{}}') ELSE CAST(v AS VARCHAR) END AS content FROM n LEFT JOIN own USING (rid))
"""

_PLACES = f"{plain_sql('module')} AS module, item, CAST(item_no AS BIGINT) AS item_no, CAST(clause_no AS BIGINT) AS clause_no, CAST(element_no AS BIGINT) AS element_no"
_PARENTS = f"""parent_kind, CASE WHEN parent_kind = 'graph' THEN '' ELSE {plain_sql('module')} END AS parent_module, CASE WHEN parent_kind IN ('graph', 'struct') THEN '' ELSE item END AS parent_item,
  CAST(CASE WHEN parent_kind IN ('graph', 'struct') THEN -1 ELSE item_no END AS BIGINT) AS parent_item_no, CAST(CASE WHEN parent_kind = 'clause' THEN clause_no ELSE -1 END AS BIGINT) AS parent_clause_no"""

#: Equal subtrees have equal texts: a record's content, then those of its children with their ordinals.
_SUBTREES = """
leaf AS (SELECT *, content AS t FROM rec WHERE record_kind IN ('struct_field', 'location', 'input', 'result', 'param')),
clause_t AS (SELECT any_value(c.graph_id) AS graph_id, any_value(c.module) AS module, any_value(c.item_no) AS item_no, any_value(c.clause_no) AS clause_no, c.content, c.content || coalesce(string_agg(l.record_kind || l.element_no || l.t, '|' ORDER BY l.record_kind, l.element_no), '') AS t
  FROM rec c LEFT JOIN leaf l ON l.parent_kind = 'clause' AND l.graph_id = c.graph_id AND l.module = c.module AND l.item_no = c.item_no AND l.clause_no = c.clause_no WHERE c.record_kind = 'clause' GROUP BY c.rid, c.content),
whole AS (
  SELECT record_kind, content, t FROM leaf
  UNION ALL SELECT 'clause', content, t FROM clause_t
  UNION ALL SELECT 'spec', s.content, s.content || coalesce(string_agg(c.clause_no || c.t, '#' ORDER BY c.clause_no), '') FROM rec s LEFT JOIN clause_t c ON c.graph_id = s.graph_id AND c.module = s.module AND c.item_no = s.item_no WHERE s.record_kind = 'spec' GROUP BY s.rid, s.content
  UNION ALL SELECT 'type', s.content, s.content || coalesce(string_agg(l.element_no || l.t, '#' ORDER BY l.element_no), '') FROM rec s LEFT JOIN leaf l ON l.parent_kind = 'type' AND l.graph_id = s.graph_id AND l.module = s.module AND l.item_no = s.item_no WHERE s.record_kind = 'type' GROUP BY s.rid, s.content
  UNION ALL SELECT 'struct', s.content, s.content || coalesce(string_agg(l.item_no || l.t, '#' ORDER BY l.item_no), '') FROM rec s LEFT JOIN leaf l ON l.parent_kind = 'struct' AND l.graph_id = s.graph_id AND l.module = s.module WHERE s.record_kind = 'struct' GROUP BY s.rid, s.content)
"""

SQL: dict[str, str] = {
    "p2_found": _DRIFT,
    "p2_locations": _LOCATIONS,
    "p2_specs": _SPECS,
    "p2_versions": _VERSIONS,
    "p2_unlisted": _UNLISTED,
    "p3_found": f"{NESTED} SELECT graph_id, record_kind, {_PLACES} FROM rec WHERE record_kind <> 'struct'",
    "p3_bridge": f"{NESTED} SELECT graph_id, record_kind, {_PLACES}, {_PARENTS} FROM rec",
    "p3_clauses": f"{NESTED} SELECT graph_id, {_PLACES}, content, {_PARENTS} FROM rec WHERE record_kind = 'clause'",
    "p3_objects": f"{NESTED}, {_SUBTREES} SELECT record_kind, content, count(DISTINCT t) AS n_objects, count(*) AS n_occurrences FROM whole GROUP BY ALL",
    "p1_found": f"WITH {_NODES} SELECT trace_id, node, root, depth FROM tree UNION ALL SELECT trace_id, node, '', CASE WHEN on_loop THEN -1 ELSE -2 END FROM looped",
    "p1_paths": f"WITH {_NODES} SELECT trace_id, node, root, depth, path FROM tree UNION ALL SELECT trace_id, node, '', CASE WHEN on_loop THEN -1 ELSE -2 END, NULL FROM looped",
    "p1_descendants": f"WITH {_NODES}, below AS (SELECT n.trace_id, n.up AS node, n.node AS descendant, 1::BIGINT AS distance FROM nodes n JOIN tree t ON t.trace_id = n.trace_id AND t.node = n.node WHERE n.up IS NOT NULL UNION ALL SELECT b.trace_id, n.up, b.descendant, b.distance + 1 FROM below b JOIN nodes n ON n.trace_id = b.trace_id AND n.node = b.node WHERE n.up IS NOT NULL) SELECT * FROM below",
    "p1_other_parents": f"WITH {_NODES} SELECT DISTINCT l.trace_id, l.node, n.up AS followed, l.up AS other FROM link l JOIN nodes n ON n.trace_id = l.trace_id AND n.node = l.node WHERE l.up <> n.up",
    "p4_found": f"WITH {_CALLS}, n AS (SELECT project, callee_module, callee_function, count(*) AS n FROM c GROUP BY ALL) SELECT project, callee_module, callee_function FROM n QUALIFY n * 20 >= sum(n) OVER (PARTITION BY project)",
    "p4_pairs": f"WITH {_CALLS} SELECT project, callee_module, callee_function, count(*) AS n_calls, min(extracted_at) AS first_at, max(extracted_at) AS last_at FROM c GROUP BY ALL",
    "p5_found": f"{_ORPHANS} SELECT call_id, reason FROM o",
    "p5_counts": f"{_ORPHANS} SELECT 'calls' AS table_name, strftime(called_at, '%Y-%m') AS month, reason, count(*) AS n_rows FROM o GROUP BY ALL",
    "p6_found": f"{_CHANGES} SELECT * FROM f WHERE change_kind IS NOT NULL",
    "p6_counts": f"{_CHANGES} SELECT snapshot_no, change_kind, count(*) AS n_clauses FROM f WHERE change_kind IS NOT NULL GROUP BY ALL",
}
