"""Extracted code graphs (JSON) as the seven relations."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscape.schema import RELATIONS, Graph

_LOCATION = "struct<name string, arity bigint, file string, source_file string, source_file_absolute string, column bigint, kind string, line bigint, start_line bigint, end_line bigint, pattern string, guard string, source_sha string, ast_sha string, complexity bigint, max_nesting_depth bigint, generated_by string, macro_source string>"
SCHEMA = (
    "structs map<string, struct<fields: array<struct<default: string, field: string, required: boolean, inferred_type: string>>>>, "
    f"function_locations map<string, map<string, {_LOCATION}>>, "
    "calls array<struct<caller: struct<module: string, function: string, file: string, line: bigint, column: bigint, kind: string>, callee: struct<module: string, function: string, arity: bigint, args: string>, type: string>>, "
    "specs map<string, array<struct<name: string, arity: bigint, line: bigint, kind: string, clauses: array<struct<full: string, input_strings: array<string>, return_strings: array<string>>>>>>, "
    "types map<string, array<struct<name: string, kind: string, line: bigint, params: array<string>, definition: string>>>"
)
REQUIRED = ("structs", "function_locations", "calls")


class FileReadFailed(OSError):
    """The file of a code graph is not there."""


class JsonParseFailed(ValueError):
    """A file is no JSON of a code graph."""


def read_graphs(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per JSON file, with the typed sections; unknown keys are passed over."""
    try:
        docs = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        raise FileReadFailed(str(e)) from None
    try:
        bad = docs.where(" or ".join(f"{c} is null" for c in REQUIRED)).limit(1).count()
    except Exception as e:
        raise JsonParseFailed(str(e).splitlines()[0]) from None
    if bad:
        raise JsonParseFailed(f"a file lacks one of {', '.join(REQUIRED)}")
    return docs.withColumn("_file", F.col("_metadata.file_path"))


def plain_document(d: dict) -> str:
    """A code graph, however loosely written, as JSON of the exact shape of SCHEMA.

    Single values in place of lists are lists of one, null elements and values of another kind are left out, and sections
    that are missing or null are empty.
    """
    listed = lambda v: [x for x in (v if isinstance(v, list) else [v]) if x is not None]
    dicts = lambda v: [x for x in listed(v) if isinstance(x, dict)]
    section = lambda name: d[name] if isinstance(d.get(name), dict) else {}

    def spec(s: dict) -> dict:
        return {**s, "clauses": [{**c, **{k: listed(c.get(k)) for k in ("input_strings", "return_strings")}} for c in dicts(s.get("clauses"))]}

    out: dict[str, Any] = {
        "structs": {m: {"fields": dicts(s.get("fields"))} for m, s in section("structs").items() if isinstance(s, dict)},
        "function_locations": {m: {k: r for k, r in rows.items() if isinstance(r, dict)} for m, rows in section("function_locations").items() if isinstance(rows, dict)},
        "calls": [c for c in dicts(d.get("calls")) if isinstance(c.get("caller"), dict) and isinstance(c.get("callee"), dict)],
        "specs": {m: [spec(s) for s in dicts(rows)] for m, rows in section("specs").items() if rows is not None},
        "types": {m: [{**t, "params": listed(t.get("params"))} for t in dicts(rows)] for m, rows in section("types").items() if rows is not None},
    }
    return json.dumps(out)


def _or(column: Column | str, default: object) -> Column:
    return F.coalesce(column, F.lit(default))


def _first_clause(field: str, by: str) -> Column:
    """The texts of a spec's first clause, joined; nothing without clauses."""
    return _or(F.array_join(F.try_element_at(F.col("s.clauses"), F.lit(1))[field], by), "")


def graph(docs: DataFrame, project: str | Column) -> Graph:
    """The relations of read_graphs() as one project; rows are as in the files, not yet one per key.

    A call outside any function is one of `<module>`; missing texts are empty, missing numbers 0, a missing complexity
    is 1. Functions and specs have the texts of the first clause. Modules come from all sections but the calls. project
    is a name for all files, or a column of docs. Each relation also has `_file`, the file (or what docs have in its
    place) of each row.
    """
    if "_file" not in docs.columns:
        docs = docs.withColumn("_file", F.lit(""))
    docs = docs.withColumn("project", F.lit(project) if isinstance(project, str) else project)
    p = F.col("project")
    zero = 0
    locations = docs.select(p, "_file", F.explode("function_locations").alias("module", "_rows")).select(p, "_file", "module", F.explode("_rows").alias("_key", "l"))
    file = _or(F.coalesce("l.file", "l.source_file"), "")
    texts = {c: _or(f"l.{c}", "") for c in ("source_file_absolute", "kind", "pattern", "guard", "source_sha", "ast_sha", "generated_by", "macro_source")}
    numbers = {c: _or(f"l.{c}", zero) for c in ("arity", "line", "column", "start_line", "end_line", "max_nesting_depth")}
    cols = {**texts, **numbers, "complexity": _or("l.complexity", 1), "file": file, "name": F.col("l.name")}
    fl = locations.select(p, "_file", "module", *[v.alias(k) for k, v in cols.items()]).select(*RELATIONS["function_locations"].columns, "_file")
    c = docs.select(p, "_file", F.explode("calls").alias("c")).select(
        p, "_file", F.col("c.caller.module").alias("caller_module"), _or("c.caller.function", "<module>").alias("caller_function"), F.col("c.callee.module").alias("callee_module"), F.col("c.callee.function").alias("callee_function"),
        _or("c.callee.arity", zero).alias("callee_arity"), _or("c.caller.file", "").alias("file"), _or("c.caller.line", zero).alias("line"), _or("c.caller.column", zero).alias("column"), _or("c.type", "remote").alias("call_type"),
        _or("c.caller.kind", "").alias("caller_kind"), _or("c.callee.args", "").alias("callee_args"),
    )
    fields = docs.select(p, "_file", F.explode("structs").alias("module", "s")).select(p, "_file", "module", F.explode("s.fields").alias("f"))
    sf = fields.select(p, "_file", "module", F.col("f.field").alias("field"), _or("f.default", "").alias("default_value"), _or("f.required", False).alias("required"), _or("f.inferred_type", "").alias("inferred_type"))
    specs = docs.select(p, "_file", F.explode("specs").alias("module", "_rows")).select(p, "_file", "module", F.explode("_rows").alias("s"))
    inputs, returns = _first_clause("input_strings", ", "), _first_clause("return_strings", " | ")
    full = _or(F.try_element_at(F.col("s.clauses"), F.lit(1))["full"], "")
    sp = specs.select(p, "_file", "module", F.col("s.name").alias("name"), F.col("s.arity").alias("arity"), _or("s.kind", "").alias("kind"), _or("s.line", zero).alias("line"), inputs.alias("inputs_string"), returns.alias("return_string"), full.alias("full"))
    fn = sp.select("project", "_file", "module", "name", "arity", F.col("return_string").alias("return_type"), F.col("inputs_string").alias("args"), F.lit("").alias("source"))
    types = docs.select(p, "_file", F.explode("types").alias("module", "_rows")).select(p, "_file", "module", F.explode("_rows").alias("t"))
    ty = types.select(p, "_file", "module", F.col("t.name").alias("name"), _or("t.kind", "").alias("kind"), _or(F.array_join("t.params", ", "), "").alias("params"), _or("t.line", zero).alias("line"), _or("t.definition", "").alias("definition"))
    keys = [docs.select(p, F.explode(F.map_keys(s)).alias("name")) for s in ("specs", "function_locations", "structs", "types")]
    names = keys[0]
    for k in keys[1:]:
        names = names.union(k)
    modules = names.distinct().select(p, "name", F.lit("").alias("file"), F.lit("unknown").alias("source"), F.lit("").alias("_file"))
    return Graph(modules=modules, functions=fn, calls=c, struct_fields=sf, function_locations=fl, specs=sp, types=ty)
