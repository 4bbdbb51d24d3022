"""The queries of the code graph over the domain tables, each with SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callscape.functions.names import plain_arity, plain_function, plain_module
from callscape.operators import calls as calling
from callscape.operators import lookup, metrics, traverse
from callscape.plans.data_queries import name_sql, plain_sql
from callscape.schema import Graph
from callscape.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def latest_row(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key by `order`, nulls first.

    As an aggregate it combines before the shuffle, and where nothing but the key is asked for, nothing else is read.
    """
    values = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*key, "_v.*")


def domain_graph(spark: SparkSession, folder: str) -> Graph:
    """The relations from the domain tables, as the latest row of each key (a location only while it is present).

    The tables have no specs, types or fields; they are derived: a function's spec from its first clause, a type per
    module, and a struct's fields from the arguments of its literals.
    """
    loc = table(spark, folder, "function_locations")
    key = ["project", "module", "name", "arity", "line"]
    order = ["loaded_at", F.col("removed_at").isNull(), "removed_at", "clause_no", "end_line", "ast_sha", "source_sha"]
    loc = latest_row(loc, key, order).where("removed_at is null")
    texts = {c: F.coalesce(c, F.lit("")) for c in ("file", "source_file_absolute", "pattern", "guard", "source_sha", "ast_sha", "generated_by", "macro_source")}
    fl = loc.withColumns({**texts, "complexity": F.coalesce("complexity", F.lit(1).cast("bigint")), "max_nesting_depth": F.coalesce("max_nesting_depth", F.lit(0).cast("bigint"))}).withColumnRenamed("column_no", "column")
    c = table(spark, folder, "calls").where("callee_module is not null and callee_function is not null")
    zero = F.lit(0).cast("bigint")
    c = c.select(
        "project", plain_module("caller_module").alias("caller_module"), F.coalesce(F.trim("caller_function"), F.lit("<module>")).alias("caller_function"), plain_module("callee_module").alias("callee_module"),
        plain_function("callee_function").alias("callee_function"), F.coalesce(plain_arity("callee_arity", "callee_function"), zero).alias("callee_arity"), "file", F.coalesce("line", zero).alias("line"),
        F.coalesce("column_no", zero).alias("column"), "call_type", F.coalesce("caller_kind", F.lit("")).alias("caller_kind"), F.coalesce("callee_args", F.lit("")).alias("callee_args"), "received_at", "call_id",
    )
    key = ["project", "caller_module", "caller_function", "callee_module", "callee_function", "callee_arity", "file", "line", "column"]
    c = latest_row(c, key, ["received_at", "call_id"])
    firsts = Window.partitionBy("project", "module", "name", "arity").orderBy("clause_no", "line")
    first = fl.withColumn("_r", F.row_number().over(firsts)).where("_r = 1")
    specs = first.select("project", "module", "name", "arity", F.when(F.col("kind").startswith("defmacro"), "callback").otherwise("spec").alias("kind"), "line", F.col("pattern").alias("inputs_string"), F.when(F.col("guard") == "", "any()").otherwise(F.col("guard")).alias("return_string"), F.concat(F.lit("@spec "), "name", F.lit("("), "pattern", F.lit(")")).alias("full"))
    functions = specs.select("project", "module", "name", "arity", F.col("return_string").alias("return_type"), F.col("inputs_string").alias("args"), F.lit("").alias("source"))
    modules = fl.select("project", F.col("module").alias("name")).distinct().select("project", "name", F.lit("").alias("file"), F.lit("unknown").alias("source"))
    kinds = fl.groupBy("project", "module").agg(F.min("start_line").alias("line"))
    short = F.lower(F.element_at(F.split("module", "[.]"), -1))
    typed = kinds.select("project", "module", short.alias("name"), F.when(F.col("line") % 2 == 0, "type").otherwise("opaque").alias("kind"), F.lit("").alias("params"), "line", F.concat(F.lit("@type "), short, F.lit(" :: term()")).alias("definition"))
    fields = c.where("callee_function = '%' and callee_args <> ''").select("project", F.col("callee_module").alias("module"), F.explode(F.split("callee_args", ", ")).alias("field")).distinct()
    fields = fields.select("project", "module", "field", F.lit("nil").alias("default_value"), (F.length("field") > 4).alias("required"), F.lit("").alias("inferred_type"))
    return Graph(modules=modules, functions=functions, calls=c, struct_fields=fields, function_locations=fl, specs=specs, types=typed)


_BASE = rf"""
fl AS (SELECT project, module, name, arity, line, clause_no, coalesce(file, '') AS file, kind, start_line, end_line, coalesce(pattern, '') AS pattern, coalesce(guard, '') AS guard,
   coalesce(source_sha, '') AS source_sha, coalesce(ast_sha, '') AS ast_sha, coalesce(complexity, 1) AS complexity, coalesce(max_nesting_depth, 0) AS max_nesting_depth, coalesce(generated_by, '') AS generated_by
 FROM (SELECT * FROM function_locations QUALIFY row_number() OVER (PARTITION BY project, module, name, arity, line
         ORDER BY loaded_at DESC, removed_at DESC NULLS FIRST, clause_no DESC, end_line DESC, ast_sha DESC NULLS LAST, source_sha DESC NULLS LAST) = 1) WHERE removed_at IS NULL),
cl AS (SELECT * FROM (
   SELECT project, {plain_sql("caller_module")} AS caller_module, coalesce(trim(caller_function), '<module>') AS caller_function, {plain_sql("callee_module")} AS callee_module, {name_sql("callee_function")} AS callee_function,
     coalesce(callee_arity, TRY_CAST(regexp_extract(callee_function, '/([0-9]+)\s*$', 1) AS BIGINT), 0) AS callee_arity, file, coalesce(line, 0) AS line, coalesce(column_no, 0) AS column_no,
     call_type, coalesce(caller_kind, '') AS caller_kind, coalesce(callee_args, '') AS callee_args, received_at, call_id
   FROM calls WHERE callee_module IS NOT NULL AND callee_function IS NOT NULL)
 QUALIFY row_number() OVER (PARTITION BY project, caller_module, caller_function, callee_module, callee_function, callee_arity, file, line, column_no ORDER BY received_at DESC, call_id DESC) = 1),
sp AS (SELECT project, module, name, arity, CASE WHEN starts_with(kind, 'defmacro') THEN 'callback' ELSE 'spec' END AS kind, line, pattern AS inputs_string, CASE WHEN guard = '' THEN 'any()' ELSE guard END AS return_string,
   '@spec ' || name || '(' || pattern || ')' AS "full" FROM fl QUALIFY row_number() OVER (PARTITION BY project, module, name, arity ORDER BY clause_no, line) = 1),
ty AS (SELECT project, module, lower(string_split(module, '.')[-1]) AS name, CASE WHEN min(start_line) % 2 = 0 THEN 'type' ELSE 'opaque' END AS kind, '' AS params, min(start_line) AS line,
   '@type ' || lower(string_split(module, '.')[-1]) || ' :: term()' AS definition FROM fl GROUP BY project, module),
sf AS (SELECT project, module, field, 'nil' AS default_value, length(field) > 4 AS required, '' AS inferred_type FROM (
   SELECT DISTINCT project, callee_module AS module, unnest(string_split(callee_args, ', ')) AS field FROM cl WHERE callee_function = '%' AND callee_args <> '')),
resolved AS (SELECT cl.project, cl.caller_module, cl.caller_function, fl.name AS caller_name, fl.arity AS caller_arity, fl.kind AS caller_kind, fl.start_line AS caller_start_line, fl.end_line AS caller_end_line,
   callee_module, callee_function, callee_arity, cl.file, cl.line AS call_line, call_type, cl.caller_kind AS call_kind
 FROM cl JOIN fl ON cl.project = fl.project AND cl.caller_module = fl.module AND starts_with(cl.caller_function, fl.name) AND cl.line BETWEEN fl.start_line AND fl.end_line),
connected AS (
 WITH c AS (SELECT DISTINCT project, caller_module, caller_function, callee_module, callee_function FROM cl),
 i AS (SELECT project, callee_module AS module, callee_function AS function, count(*) AS incoming FROM c GROUP BY ALL),
 k AS (SELECT i.*, f.by_hand FROM i JOIN (SELECT project, module, name, max(generated_by = '') AS by_hand FROM fl GROUP BY ALL) f ON f.project = i.project AND f.module = i.module AND f.name = i.function),
 o AS (SELECT project, module, function, count(*) AS outgoing FROM (SELECT DISTINCT c.project, k.module, k.function, c.callee_module, c.callee_function FROM c JOIN k ON k.project = c.project AND k.module = c.caller_module
     AND (c.caller_function = k.function OR starts_with(c.caller_function, k.function || '/'))) GROUP BY ALL)
 SELECT k.project, k.module, k.function, k.by_hand, incoming, coalesce(outgoing, 0) AS outgoing, incoming + coalesce(outgoing, 0) AS total,
   CASE WHEN coalesce(outgoing, 0) = 0 THEN 9999.0::DOUBLE ELSE incoming::DOUBLE / outgoing END AS ratio
 FROM k LEFT JOIN o ON o.project = k.project AND o.module = k.module AND o.function = k.function),
pairs AS (SELECT DISTINCT project, caller_module AS a, callee_module AS b FROM cl WHERE caller_module <> callee_module),
spaces AS (SELECT *, array_to_string(string_split(a, '.')[1:2], '.') AS a_ns, array_to_string(string_split(b, '.')[1:2], '.') AS b_ns FROM pairs)
"""

_CALL = "project, caller_module, caller_name, caller_arity, {kind} AS caller_kind, caller_start_line, caller_end_line, callee_module, callee_function, callee_arity, file, call_line"
_TRACE_COLS = "project, caller_module, caller_name, caller_arity, caller_kind, caller_start_line, caller_end_line, callee_module, callee_function, callee_arity, file, call_line"

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, run: Callable[[Graph], DataFrame], sql: str | None, recursive: str = "") -> None:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return run(domain_graph(spark, folder))

    query.__name__ = name
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{_BASE}{',' + recursive if recursive else ''} {sql}"


_all = {"limit": None}
_LOC = "project, file, line, start_line, end_line, module, kind, name, arity, pattern, guard"
_add("location_exact", lambda g: lookup.find_locations(g, "fetch", **_all), f"SELECT DISTINCT {_LOC} FROM fl WHERE name = 'fetch'")
_add("location_regex", lambda g: lookup.find_locations(g, "^(get|fetch)_", r"\.Store$", regex=True, **_all), rf"SELECT DISTINCT {_LOC} FROM fl WHERE regexp_matches(name, '^(get|fetch)_') AND regexp_matches(module, '\.Store$')")
_add("function_sig", lambda g: lookup.find_functions(g, None, "user", regex=True, **_all), "SELECT project, module, name, arity, inputs_string AS args, return_string AS return_type FROM sp WHERE regexp_matches(name, 'user')")
_add("search_modules", lambda g: lookup.search_modules(g, "Webhook|Ledger", regex=True, **_all), "SELECT DISTINCT project, module AS name, 'unknown' AS source FROM fl WHERE regexp_matches(module, 'Webhook|Ledger')")
_add("search_functions", lambda g: lookup.search_functions(g, "^list", regex=True, **_all), "SELECT project, module, name, arity, return_string AS return_type FROM sp WHERE regexp_matches(name, '^list')")
_add("browse_functions", lambda g: lookup.find_functions_in_module(g, "Store", regex=True, **_all), "SELECT DISTINCT project, module, name, arity, kind, line, start_line, end_line, file, pattern, guard FROM fl WHERE regexp_matches(module, 'Store')")
_add("specs", lambda g: lookup.find_specs(g, None, kind="spec", **_all), "SELECT * FROM sp WHERE kind = 'spec'")
_add("types", lambda g: lookup.find_types(g, None, kind="opaque", **_all), "SELECT * FROM ty WHERE kind = 'opaque'")
_add("struct_fields", lambda g: lookup.find_struct_fields(g, None, **_all), "SELECT * FROM sf")
_add("struct_groups", lambda g: lookup.group_fields(lookup.find_struct_fields(g, None, **_all)).select("project", "module", F.size("fields").cast("bigint").alias("n_fields"), F.array_join(F.transform("fields", lambda f: f["field"]), ",").alias("names")), "SELECT project, module, count(*) AS n_fields, string_agg(field, ',' ORDER BY field) AS names FROM sf GROUP BY ALL")
_add("accepts", lambda g: lookup.find_accepts(g, "opts", regex=True, **_all), "SELECT project, module, name, arity, inputs_string, return_string, line FROM sp WHERE regexp_matches(inputs_string, 'opts')")
_add("returns", lambda g: lookup.find_returns(g, "any()", **_all), "SELECT project, module, name, arity, return_string, line FROM sp WHERE return_string = 'any()'")
_add("struct_usage", lambda g: lookup.find_struct_usage(g, "key", regex=True, **_all), "SELECT project, module, name, arity, inputs_string, return_string, line FROM sp WHERE regexp_matches(inputs_string, 'key') OR regexp_matches(return_string, 'key')")
_add("struct_usage_by_module", lambda g: lookup.struct_usage_by_module(lookup.find_struct_usage(g, "key", regex=True, **_all), "key"), "SELECT project, module, count(DISTINCT name || '/' || arity) FILTER (WHERE contains(inputs_string, 'key')) AS accepts_count, count(DISTINCT name || '/' || arity) FILTER (WHERE contains(return_string, 'key')) AS returns_count, count(DISTINCT name || '/' || arity) AS total FROM sp WHERE contains(inputs_string, 'key') OR contains(return_string, 'key') GROUP BY ALL")
_BROWSE = "project, module, type, name, arity, line, kind, file, start_line, end_line, pattern, guard, args, return_type, inputs, returns, \"full\", params, definition, fields"
_add(
    "browse_module",
    lambda g: lookup.browse_module(g, None, **_all).withColumn("fields", F.array_join(F.transform("fields", lambda f: F.concat(f["field"], F.lit("="), f["default_value"], F.lit(":"), f["required"].cast("string"))), ",")),
    f"""SELECT {_BROWSE} FROM (
 SELECT f.project, f.module, 'function' AS type, f.name, f.arity, f.line, f.kind, file, start_line, end_line, pattern, guard, inputs_string AS args, return_string AS return_type, NULL AS inputs, NULL AS returns, NULL AS "full", NULL AS params, NULL AS definition, NULL AS fields
   FROM (SELECT DISTINCT project, module, name, arity, kind, line, start_line, end_line, file, pattern, guard FROM fl) f LEFT JOIN (SELECT project, module, name, arity, inputs_string, return_string FROM sp) s ON s.project = f.project AND s.module = f.module AND s.name = f.name AND s.arity = f.arity
 UNION ALL SELECT project, module, 'spec', name, arity, line, kind, NULL, NULL, NULL, NULL, NULL, NULL, NULL, inputs_string, return_string, "full", NULL, NULL, NULL FROM sp
 UNION ALL SELECT project, module, 'type', name, NULL, line, kind, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, params, definition, NULL FROM ty
 UNION ALL SELECT project, module, 'struct', module, NULL, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, string_agg(field || '=' || default_value || ':' || required, ',' ORDER BY field) FROM sf GROUP BY project, module)""",
)
_add("complexity", lambda g: lookup.find_complexity(g, 5, 1, **_all), "SELECT DISTINCT project, module, name, arity, line, complexity, max_nesting_depth, start_line, end_line, end_line - start_line + 1 AS lines, generated_by FROM fl WHERE complexity >= 5 AND max_nesting_depth >= 1")
_add("large_functions", lambda g: lookup.find_large_functions(g, 20, **_all), "SELECT DISTINCT project, module, name, arity, start_line, end_line, end_line - start_line + 1 AS lines, file, generated_by FROM fl WHERE generated_by = '' AND end_line - start_line + 1 >= 20")
_add("calls_from", lambda g: calling.calls_from(g, None, "^(get|fetch)", regex=True, **_all), f"SELECT DISTINCT {_CALL.format(kind='call_kind')}, call_type FROM resolved WHERE callee_function <> '%' AND regexp_matches(caller_name, '^(get|fetch)')")
_add("calls_to", lambda g: calling.calls_to(g, None, None, 2, **_all), f"SELECT DISTINCT {_CALL.format(kind='call_kind')}, call_type FROM resolved WHERE callee_function <> '%' AND callee_arity = 2")
_add("calls_to_grouped", lambda g: calling.group_calls(calling.calls_to(g, None, **_all), "callee", "caller").select("project", "module", "name", "arity", F.size("calls").cast("bigint").alias("n_callers"), F.col("calls")[0]["call_line"].alias("first_line")), "SELECT project, callee_module AS module, callee_function AS name, callee_arity AS arity, count(DISTINCT caller_module || '|' || caller_name || '|' || caller_arity) AS n_callers, min(call_line) AS first_line FROM resolved WHERE callee_function <> '%' GROUP BY ALL")
_add("depends_on", lambda g: calling.depends_on(g, r"\.(Store|Client)$", regex=True, **_all), rf"SELECT DISTINCT {_CALL.format(kind='caller_kind')} FROM resolved WHERE callee_function <> '%' AND caller_module <> callee_module AND regexp_matches(caller_module, '\.(Store|Client)$')")
_add("depended_by", lambda g: calling.depended_by(g, "Textkit", **_all), f"SELECT DISTINCT {_CALL.format(kind='caller_kind')} FROM resolved WHERE callee_function <> '%' AND caller_module <> callee_module AND callee_module = 'Textkit'")
_add("module_calls", lambda g: calling.module_calls(g), "SELECT project, a AS caller_module, b AS callee_module FROM pairs")
_HOT = "SELECT project, module, function, incoming, outgoing, total, ratio FROM connected"
for _kind in ("incoming", "outgoing", "total", "ratio"):
    _add(f"hotspots_{_kind}", lambda g, k=_kind: metrics.hotspots(g, k, limit=100), f"{_HOT} ORDER BY {_kind} DESC, module, function, project, incoming, outgoing, total, ratio LIMIT 100")
_add("hotspots_all", lambda g: metrics.hotspots(g, "total", exclude_generated=True, **_all), f"{_HOT} WHERE by_hand")
_add("boundaries", lambda g: metrics.boundaries(g, limit=100), "SELECT project, module, incoming, outgoing, ratio FROM (SELECT * FROM connected WHERE outgoing > 0 ORDER BY ratio DESC, module, function, project LIMIT 100) WHERE incoming >= 1 AND ratio >= 2.0 QUALIFY row_number() OVER (PARTITION BY project, module ORDER BY ratio DESC, function) = 1")
_LOC_SQL = "SELECT project, module, sum(end_line - start_line + 1)::BIGINT AS loc FROM fl GROUP BY ALL"
_COUNT_SQL = "SELECT project, module, count(*) AS func_count FROM fl WHERE generated_by = '' GROUP BY ALL"
_CONN_SQL = "SELECT project, module, sum(incoming)::BIGINT AS incoming, sum(outgoing)::BIGINT AS outgoing FROM connected WHERE by_hand GROUP BY ALL"
_add("module_loc", lambda g: metrics.module_loc(g), _LOC_SQL)
_add("function_counts", lambda g: metrics.function_counts(g), _COUNT_SQL)
_add("module_connectivity", lambda g: metrics.module_connectivity(g), _CONN_SQL)
_add("god_modules", lambda g: metrics.god_modules(g, 10, 0, 10, limit=100), f"SELECT n.project, n.module, func_count AS function_count, coalesce(loc, 0) AS loc, coalesce(incoming, 0) AS incoming, coalesce(outgoing, 0) AS outgoing, coalesce(incoming, 0) + coalesce(outgoing, 0) AS total FROM ({_COUNT_SQL}) n LEFT JOIN ({_LOC_SQL}) l ON l.project = n.project AND l.module = n.module LEFT JOIN ({_CONN_SQL}) c ON c.project = n.project AND c.module = n.module WHERE func_count >= 10 AND coalesce(incoming, 0) + coalesce(outgoing, 0) >= 10 ORDER BY total DESC, module, project, function_count, loc, incoming, outgoing LIMIT 100")
_UNUSED = "SELECT DISTINCT project, module, name, arity, kind, file, start_line AS line FROM fl WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.project = fl.project AND callee_module = module AND callee_function = name AND callee_arity = arity)"
_add("unused", lambda g: metrics.unused(g, exclude_generated=True, **_all), f"{_UNUSED} AND NOT regexp_matches(name, '^(__struct__|__using__|__before_compile__|__after_compile__|__on_definition__|__impl__|__info__|__protocol__|__deriving__|__changeset__|__schema__|__meta__)')")
_add("unused_private", lambda g: metrics.unused(g, private_only=True, **_all), f"{_UNUSED} AND kind IN ('defp', 'defmacrop')")
_add("unused_public", lambda g: metrics.unused(g, public_only=True, **_all), f"{_UNUSED} AND kind IN ('def', 'defmacro')")
_add("many_clauses", lambda g: metrics.many_clauses(g, 3, **_all), "SELECT project, module, name, arity, file, generated_by, count(line) AS clauses, min(start_line) AS first_line, max(end_line) AS last_line FROM fl WHERE generated_by = '' GROUP BY ALL HAVING count(line) >= 3")
_DUP = "SELECT DISTINCT project, {h} AS hash, module, name, arity, line, file FROM fl WHERE {h} <> '' AND (project, {h}) IN (SELECT (project, {h}) FROM fl WHERE {h} <> '' GROUP BY project, {h} HAVING count(*) > 1)"
_add("duplicates_ast", lambda g: metrics.duplicates(g), _DUP.format(h="ast_sha"))
_add("duplicates_exact", lambda g: metrics.duplicates(g, exact=True), _DUP.format(h="source_sha"))
_add("duplicates_by_module", lambda g: metrics.duplicates_by_module(metrics.duplicates(g)), f"SELECT project, module, name, arity, count(*) AS copy_count, count(*) OVER (PARTITION BY project, module) AS duplicate_count FROM ({_DUP.format(h='ast_sha')}) GROUP BY project, module, name, arity")
_add("duplicate_groups", lambda g: metrics.duplicate_groups(metrics.duplicates(g)), f"SELECT project, hash, count(*) AS n_functions FROM ({_DUP.format(h='ast_sha')}) GROUP BY ALL")
_add("clusters", lambda g: metrics.clusters(g, 2), "SELECT project, namespace, count(DISTINCT m) AS module_count, sum(internal)::BIGINT AS internal_calls, sum(outgoing)::BIGINT AS outgoing_calls, sum(incoming)::BIGINT AS incoming_calls, CASE WHEN sum(internal + outgoing + incoming) > 0 THEN sum(internal)::DOUBLE / sum(internal + outgoing + incoming) ELSE 0.0::DOUBLE END AS cohesion, CASE WHEN sum(outgoing + incoming) > 0 THEN sum(outgoing)::DOUBLE / sum(outgoing + incoming) ELSE 0.0::DOUBLE END AS instability FROM (SELECT project, a_ns AS namespace, a AS m, (a_ns = b_ns)::INT AS internal, (a_ns <> b_ns)::INT AS outgoing, 0 AS incoming FROM spaces UNION ALL SELECT project, b_ns, b, 0, 0, (a_ns <> b_ns)::INT FROM spaces) GROUP BY project, namespace")
_add("cluster_cross_deps", lambda g: metrics.cluster_dependencies(g, 2), "SELECT project, a_ns AS from_namespace, b_ns AS to_namespace, count(*) AS call_count FROM spaces WHERE a_ns <> b_ns GROUP BY ALL")
_add("trace_d3", lambda g: traverse.trace_calls(g, None, "fetch", max_depth=3, **_all), f"SELECT DISTINCT depth, {_TRACE_COLS} FROM tr", f" e AS (SELECT DISTINCT {_TRACE_COLS}, caller_function FROM resolved WHERE callee_function <> '%'), tr AS (SELECT 1::BIGINT AS depth, * FROM e WHERE caller_name = 'fetch' UNION SELECT tr.depth + 1, e.* FROM tr JOIN e ON e.project = tr.project AND e.caller_module = tr.callee_module AND starts_with(e.caller_function, tr.callee_function) WHERE tr.depth < 3)")
_add("reverse_trace_d3", lambda g: traverse.reverse_trace_calls(g, None, "fetch", max_depth=3, **_all), f"SELECT DISTINCT depth, {_TRACE_COLS} FROM tr", f" e AS (SELECT DISTINCT {_TRACE_COLS} FROM resolved), tr AS (SELECT 1::BIGINT AS depth, * FROM e WHERE callee_function = 'fetch' UNION SELECT tr.depth + 1, e.* FROM tr JOIN e ON e.project = tr.project AND e.callee_module = tr.caller_module AND e.callee_function = tr.caller_name AND e.callee_arity = tr.caller_arity WHERE tr.depth < 3)")
_STEP = "caller_module || '.' || caller_function || '>' || callee_module || '.' || callee_function || '/' || callee_arity || '@' || file || ':' || line"
_add(
    "paths",
    lambda g: traverse.find_paths(g, None, "fetch", None, "handle", max_depth=3, **_all).select("project", "length", F.array_join(F.transform("steps", lambda s: F.concat(s["caller_module"], F.lit("."), s["caller_function"], F.lit(">"), s["callee_module"], F.lit("."), s["callee_function"], F.lit("/"), s["callee_arity"].cast("string"), F.lit("@"), s["file"], F.lit(":"), s["line"].cast("string"))), " ").alias("path")),
    "SELECT project, length, array_to_string(path, ' ') AS path FROM tr WHERE callee_function = 'handle'",
    f""" e AS (SELECT DISTINCT project, caller_module, caller_function, callee_module, callee_function, {_STEP} AS step FROM cl),
 tr AS (SELECT e.*, 1::BIGINT AS length, [step] AS path FROM e WHERE starts_with(caller_function, 'fetch') AND EXISTS (SELECT 1 FROM fl WHERE fl.project = e.project AND fl.module = e.caller_module AND starts_with(e.caller_function, fl.name))
   UNION ALL SELECT e.*, tr.length + 1, list_append(tr.path, e.step) FROM tr JOIN e ON e.project = tr.project AND e.caller_module = tr.callee_module AND starts_with(e.caller_function, tr.callee_function) WHERE tr.length < 3 AND NOT list_contains(tr.path, e.step))""",
)
_CLOSURE = " reach AS (SELECT project, a, b FROM pairs UNION SELECT r.project, r.a, p.b FROM reach r JOIN pairs p ON p.project = r.project AND p.a = r.b)"
_add("closure", lambda g: traverse.reachable(g), "SELECT * FROM reach", _CLOSURE)
_add("cycle_edges", lambda g: traverse.cycle_edges(g), "SELECT project, a AS from_module, b AS to_module FROM pairs p WHERE EXISTS (SELECT 1 FROM reach r WHERE r.project = p.project AND r.a = p.a AND r.b = p.a) AND EXISTS (SELECT 1 FROM reach r WHERE r.project = p.project AND r.a = p.b AND r.b = p.b)", _CLOSURE)
_add("cycles_len3", lambda g: traverse.simple_cycles(g, 3).select("project", "length", F.array_join("modules", ",").alias("modules")), "SELECT project, 2::BIGINT AS length, p.a || ',' || p.b AS modules FROM pairs p WHERE p.a < p.b AND EXISTS (SELECT 1 FROM pairs q WHERE q.project = p.project AND q.a = p.b AND q.b = p.a) UNION ALL SELECT project, 3, min(a || ',' || b || ',' || c) FROM (SELECT p.project, p.a, p.b, q.b AS c FROM pairs p JOIN pairs q ON q.project = p.project AND q.a = p.b JOIN pairs r ON r.project = p.project AND r.a = q.b AND r.b = p.a WHERE p.a < p.b AND p.a < q.b AND q.b <> p.b) GROUP BY project, a, least(b, c), greatest(b, c)")
_add("upsert_latest", lambda g: g.calls.select("project", "caller_module", "caller_function", "callee_module", "callee_function", "callee_arity", "file", "line", F.col("column").alias("column_no"), "call_type", "caller_kind", "callee_args"), "SELECT * EXCLUDE (received_at, call_id) FROM cl")
_ONE = "dusky_depot_00000"
_add("location_in_project", lambda g: lookup.find_locations(g, "get", project=_ONE, regex=True, limit=20), f"SELECT DISTINCT {_LOC} FROM fl WHERE project = '{_ONE}' AND contains(name, 'get') ORDER BY module, name, arity, line, {_LOC} LIMIT 20")
_add("complexity_first", lambda g: lookup.find_complexity(g, 2, project=_ONE, limit=30), f"SELECT DISTINCT project, module, name, arity, line, complexity, max_nesting_depth, start_line, end_line, end_line - start_line + 1 AS lines, generated_by FROM fl WHERE project = '{_ONE}' AND complexity >= 2 ORDER BY complexity DESC, module, name, arity, line, max_nesting_depth, start_line, end_line, lines, generated_by LIMIT 30")
_add("calls_to_first", lambda g: calling.calls_to(g, "Textkit", project=_ONE, limit=15), f"SELECT DISTINCT {_CALL.format(kind='call_kind')}, call_type FROM resolved WHERE project = '{_ONE}' AND callee_function <> '%' AND callee_module = 'Textkit' ORDER BY callee_module, callee_function, callee_arity, caller_module, caller_name, caller_arity, project, 5, caller_start_line, caller_end_line, file, call_line, call_type LIMIT 15")
_add("unused_first", lambda g: metrics.unused(g, exclude_generated=True, project=_ONE, limit=25), f"SELECT * FROM ({_UNUSED} AND project = '{_ONE}' ORDER BY module, name, arity, project, kind, file, line LIMIT 25) WHERE NOT regexp_matches(name, '^(__struct__|__using__|__before_compile__|__after_compile__|__on_definition__|__impl__|__info__|__protocol__|__deriving__|__changeset__|__schema__|__meta__)')")
_add("god_modules_first", lambda g: metrics.god_modules(g, 5, 0, 1, limit=7), f"SELECT n.project, n.module, func_count AS function_count, coalesce(loc, 0) AS loc, coalesce(incoming, 0) AS incoming, coalesce(outgoing, 0) AS outgoing, coalesce(incoming, 0) + coalesce(outgoing, 0) AS total FROM ({_COUNT_SQL}) n LEFT JOIN ({_LOC_SQL}) l ON l.project = n.project AND l.module = n.module LEFT JOIN ({_CONN_SQL}) c ON c.project = n.project AND c.module = n.module WHERE func_count >= 5 AND coalesce(incoming, 0) + coalesce(outgoing, 0) >= 1 ORDER BY total DESC, module, project, function_count, loc, incoming, outgoing LIMIT 7")
_add("modules", lambda g: g.modules, "SELECT DISTINCT project, module AS name, '' AS file, 'unknown' AS source FROM fl")
