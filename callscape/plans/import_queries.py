"""Queries over a store into which the graphs of call_graphs were imported, with SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscape.functions.cluster import delete_at_end, shared_folder
from callscape.operators import lookup, nested, traverse
from callscape.plans.data_queries import NESTED, listed_sql
from callscape.schema import RELATIONS
from callscape.sources import ingest
from callscape.sources.store import Store
from callscape.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def imported(spark: SparkSession, folder: str, *names: str) -> Store:
    """A new store with these relations of all graphs, each graph in its project; a later graph's rows stand over those of an earlier one."""
    texts = nested.plain_documents(table(spark, folder, "call_graphs"))
    docs = texts.select("project", F.format_string("%020d", "graph_id").alias("_file"), F.from_json("text", ingest.SCHEMA).alias("_d")).select("project", "_file", "_d.*")
    store = Store(spark, f"{shared_folder(spark).rstrip('/')}/callscape-store-{uuid.uuid4().hex}")
    delete_at_end(spark, store.folder)
    store.setup()
    store.import_graph(docs, F.col("project"), names)
    return store


def _of(name: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        df = imported(spark, folder, name).table(name)
        return df.withColumnRenamed("column", "column_no") if "column" in df.columns else df

    return query


def import_cleared(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of specs and types by project, after the first project is cleared."""
    store = imported(spark, folder, "specs", "types")
    store.clear(store.table("specs").agg(F.min("project")).first()[0])
    both = store.table("specs").select("project", F.lit("specs").alias("relation")).unionByName(store.table("types").select("project", F.lit("types").alias("relation")))
    return both.groupBy("project", "relation").agg(F.count(F.lit(1)).alias("n_rows"))


def import_repeated(spark: SparkSession, folder: str) -> DataFrame:
    """The specs after a second import of the first project's own, with another line: upserts replace rows and add none."""
    store = imported(spark, folder, "specs")
    first = store.table("specs").agg(F.min("project")).first()[0]
    store.upsert("specs", store.table("specs").where(F.col("project") == first).withColumn("line", -F.col("line")))
    return store.table("specs").select("project", "module", "name", "arity", "line")


def browse_specs(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten of the specs of the first project, in their order."""
    store = imported(spark, folder, "specs")
    return lookup.find_specs(store.graph(), ".", project=store.table("specs").agg(F.min("project")).first()[0], regex=True, limit=10)


def accepts_in_order(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.find_accepts(imported(spark, folder, "specs").graph(), "String", regex=True, limit=25)


def cycles_all(spark: SparkSession, folder: str) -> DataFrame:
    """All simple cycles, of any length, of the imported modules."""
    found = traverse.simple_cycles(imported(spark, folder, "calls").graph())
    return found.select("project", "length", F.array_join("modules", ",").alias("modules"))


QUERIES: dict[str, Query] = {
    **{f"import_{n}": _of(n) for n in RELATIONS},
    **{f.__name__: f for f in (import_cleared, import_repeated, browse_specs, accepts_in_order, cycles_all)},
}


def _joined(value: str, by: str) -> str:
    return f"""coalesce(array_to_string(from_json({listed_sql(f"({value})")}, '["VARCHAR"]'), '{by}'), '')"""


def _text(value: str, key: str) -> str:
    return f"coalesce({value} ->> '{key}', '')"


def _number(value: str, key: str, default: int = 0) -> str:
    return f"coalesce(CAST({value} ->> '{key}' AS BIGINT), {default})"


_SPECS = f"""
{NESTED},
c1 AS (SELECT * FROM clause WHERE json_type(v) = 'OBJECT' QUALIFY row_number() OVER (PARTITION BY graph_id, module, item_no ORDER BY clause_no) = 1),
specs AS (
  SELECT g.project, s.module, s.v ->> 'name' AS name, CAST(s.v ->> 'arity' AS BIGINT) AS arity, {_text("s.v", "kind")} AS kind, {_number("s.v", "line")} AS line,
    {_joined("c.v -> 'input_strings'", ", ")} AS inputs_string, {_joined("c.v -> 'return_strings'", " | ")} AS return_string, {_text("c.v", "full")} AS "full"
  FROM spec s JOIN g ON g.graph_id = s.graph_id LEFT JOIN c1 c ON c.graph_id = s.graph_id AND c.module = s.module AND c.item_no = s.item_no
  QUALIFY row_number() OVER (PARTITION BY g.project, s.module, s.v ->> 'name', CAST(s.v ->> 'arity' AS BIGINT) ORDER BY s.graph_id DESC, s.item_no DESC) = 1)
"""
_TYPES = f"""
types AS (SELECT g.project, module, t.v ->> 'name' AS name, {_text("t.v", "kind")} AS kind, {_joined("t.v -> 'params'", ", ")} AS params, {_number("t.v", "line")} AS line, {_text("t.v", "definition")} AS definition
  FROM typed t JOIN g ON g.graph_id = t.graph_id QUALIFY row_number() OVER (PARTITION BY g.project, module, t.v ->> 'name' ORDER BY t.graph_id DESC, t.item_no DESC) = 1)
"""
_L_TEXTS = ", ".join(f"{_text('l.v', c)} AS {c}" for c in ("source_file_absolute", "kind", "pattern", "guard", "source_sha", "ast_sha", "generated_by", "macro_source"))
_L_NUMBERS = ", ".join(f"{_number('l.v', c)} AS {c}" for c in ("arity", "line", "start_line", "end_line", "max_nesting_depth"))
_LOCATIONS = f"""
{NESTED}
SELECT g.project, module, l.v ->> 'name' AS name, {_L_TEXTS}, {_L_NUMBERS}, {_number("l.v", "column")} AS column_no, {_number("l.v", "complexity", 1)} AS complexity, coalesce(l.v ->> 'file', l.v ->> 'source_file', '') AS file
FROM locations l JOIN g ON g.graph_id = l.graph_id QUALIFY row_number() OVER (PARTITION BY g.project, module, l.v ->> 'name', {_number("l.v", "arity")}, {_number("l.v", "line")} ORDER BY l.graph_id DESC, l.item DESC) = 1
"""
_CALLS = f"""
{NESTED},
called AS (SELECT g.graph_id, g.project, CAST(c.key AS BIGINT) AS no, c.value -> 'caller' AS a, c.value -> 'callee' AS b, c.value ->> 'type' AS call_type FROM g, json_each({listed_sql("(g.d -> 'calls')")}) c WHERE c.type = 'OBJECT')
SELECT project, a ->> 'module' AS caller_module, coalesce(a ->> 'function', '<module>') AS caller_function, b ->> 'module' AS callee_module, b ->> 'function' AS callee_function, {_number("b", "arity")} AS callee_arity,
  {_text("a", "file")} AS file, {_number("a", "line")} AS line, {_number("a", "column")} AS column_no, coalesce(call_type, 'remote') AS call_type, {_text("a", "kind")} AS caller_kind, {_text("b", "args")} AS callee_args
FROM called WHERE json_type(a) = 'OBJECT' AND json_type(b) = 'OBJECT'
QUALIFY row_number() OVER (PARTITION BY project, a ->> 'module', coalesce(a ->> 'function', '<module>'), b ->> 'module', b ->> 'function', {_number("b", "arity")}, {_text("a", "file")}, {_number("a", "line")}, {_number("a", "column")} ORDER BY graph_id DESC, no DESC) = 1
"""
_FIELDS = f"""
{NESTED}
SELECT g.project, module, f.v ->> 'field' AS field, {_text("f.v", "default")} AS default_value, coalesce(CAST(f.v ->> 'required' AS BOOLEAN), false) AS required, {_text("f.v", "inferred_type")} AS inferred_type
FROM fields f JOIN g ON g.graph_id = f.graph_id WHERE json_type(f.v) = 'OBJECT' QUALIFY row_number() OVER (PARTITION BY g.project, module, f.v ->> 'field' ORDER BY f.graph_id DESC, f.item_no DESC) = 1
"""
_MODULES = f"""
{NESTED},
m AS (SELECT project, k.key AS name FROM g, json_each(d, '$.structs') k WHERE k.type = 'OBJECT' UNION SELECT project, k.key FROM g, json_each(d, '$.function_locations') k WHERE k.type = 'OBJECT'
      UNION SELECT project, k.key FROM g, json_each(d, '$.specs') k WHERE k.type <> 'NULL' UNION SELECT project, k.key FROM g, json_each(d, '$.types') k WHERE k.type <> 'NULL')
SELECT project, name, '' AS file, 'unknown' AS source FROM m
"""
_FIRST = "(SELECT min(project) FROM specs)"

SQL: dict[str, str] = {
    "import_modules": _MODULES,
    "import_functions": f"{_SPECS} SELECT project, module, name, arity, return_string AS return_type, inputs_string AS args, '' AS source FROM specs",
    "import_calls": _CALLS,
    "import_struct_fields": _FIELDS,
    "import_function_locations": _LOCATIONS,
    "import_specs": f"{_SPECS} SELECT * FROM specs",
    "import_types": f"{NESTED}, {_TYPES} SELECT * FROM types",
    "cycles_all": f"""{_CALLS.replace("WITH w0", "WITH RECURSIVE w0").replace("SELECT project, a ->> 'module' AS caller_module", ", cl AS (SELECT project, a ->> 'module' AS caller_module", 1)}),
e AS (SELECT DISTINCT project, caller_module AS a, callee_module AS b FROM cl WHERE caller_module <> callee_module),
walk AS (SELECT project, [a, b] AS path FROM e WHERE b > a UNION ALL SELECT w.project, list_append(w.path, e.b) FROM walk w JOIN e ON e.project = w.project AND e.a = w.path[-1] AND e.b > w.path[1] AND NOT list_contains(w.path, e.b)),
found AS (SELECT w.project, w.path FROM walk w JOIN e ON e.project = w.project AND e.a = w.path[-1] AND e.b = w.path[1])
SELECT project, CAST(len(min(path)) AS BIGINT) AS length, array_to_string(min(path), ',') AS modules FROM found GROUP BY project, list_sort(path)""",
    "import_cleared": f"{_SPECS}, {_TYPES} SELECT project, relation, count(*) AS n_rows FROM (SELECT project, 'specs' AS relation FROM specs UNION ALL SELECT project, 'types' FROM types) WHERE project <> {_FIRST} GROUP BY ALL",
    "import_repeated": f"{_SPECS} SELECT project, module, name, arity, CASE WHEN project = {_FIRST} THEN -line ELSE line END AS line FROM specs",
    "browse_specs": f"{_SPECS} SELECT * FROM specs WHERE project = {_FIRST} ORDER BY module, name, arity LIMIT 10",
    "accepts_in_order": f"{_SPECS} SELECT project, module, name, arity, inputs_string, return_string, line FROM specs WHERE contains(inputs_string, 'String') ORDER BY module, name, arity, project, inputs_string, return_string, line LIMIT 25",
}
