"""Lookups: a filter over one relation, in a fixed order, with a limit.

Patterns are exact unless regex is set; project None looks in all projects; limit None gives all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscape.functions.predicates import by_hand, equals, in_project, matches, ordered, validate
from callscape.schema import Graph

LIMIT = 100


def _find(df: DataFrame, project: str | None, regex: bool, patterns: dict[str, str | None], columns: list[str], by: list[str], limit: int | None, arity: int | None = None) -> DataFrame:
    validate(*patterns.values(), regex=regex)
    df = in_project(df, project)
    for column, pattern in patterns.items():
        df = df.where(matches(column, pattern, regex))
    if arity is not None:
        df = df.where(equals("arity", arity))
    return ordered(df.select(*columns).distinct(), by, limit)


def find_locations(g: Graph, function: str | None, module: str | None = None, arity: int | None = None, project: str | None = None, regex: bool = False, limit: int | None = LIMIT) -> DataFrame:
    cols = ["project", "file", "line", "start_line", "end_line", "module", "kind", "name", "arity", "pattern", "guard"]
    return _find(g.function_locations, project, regex, {"module": module, "name": function}, cols, ["module", "name", "arity", "line"], limit, arity)


def find_functions(g: Graph, module: str | None, function: str | None, arity: int | None = None, project: str | None = None, regex: bool = False, limit: int | None = LIMIT) -> DataFrame:
    cols = ["project", "module", "name", "arity", "args", "return_type"]
    return _find(g.functions, project, regex, {"module": module, "name": function}, cols, ["module", "name", "arity"], limit, arity)


def search_modules(g: Graph, pattern: str | None, project: str | None = None, regex: bool = False, limit: int | None = LIMIT) -> DataFrame:
    return _find(g.modules, project, regex, {"name": pattern}, ["project", "name", "source"], ["name"], limit)


def search_functions(g: Graph, pattern: str | None, project: str | None = None, regex: bool = False, limit: int | None = LIMIT) -> DataFrame:
    return _find(g.functions, project, regex, {"name": pattern}, ["project", "module", "name", "arity", "return_type"], ["module", "name", "arity"], limit)


def find_functions_in_module(g: Graph, module: str | None, project: str | None = None, regex: bool = False, limit: int | None = LIMIT) -> DataFrame:
    cols = ["project", "module", "name", "arity", "kind", "line", "start_line", "end_line", "file", "pattern", "guard"]
    return _find(g.function_locations, project, regex, {"module": module}, cols, ["module", "start_line", "name", "arity", "line"], limit)


_SPEC = ["project", "module", "name", "arity", "kind", "line", "inputs_string", "return_string", "full"]


def find_specs(g: Graph, module: str | None, function: str | None = None, kind: str | None = None, project: str | None = None, regex: bool = False, limit: int | None = LIMIT) -> DataFrame:
    validate(module, function, regex=regex)
    df = in_project(g.specs, project).where(matches("module", module, regex) & matches("name", function, regex) & equals("kind", kind))
    return ordered(df.select(*_SPEC).distinct(), ["module", "name", "arity"], limit)


def find_types(g: Graph, module: str | None, name: str | None = None, kind: str | None = None, project: str | None = None, regex: bool = False, limit: int | None = LIMIT) -> DataFrame:
    validate(module, name, regex=regex)
    df = in_project(g.types, project).where(matches("module", module, regex) & matches("name", name, regex) & equals("kind", kind))
    return ordered(df.select("project", "module", "name", "kind", "params", "line", "definition").distinct(), ["module", "name"], limit)


def find_struct_fields(g: Graph, module: str | None, project: str | None = None, regex: bool = False, limit: int | None = LIMIT) -> DataFrame:
    cols = ["project", "module", "field", "default_value", "required", "inferred_type"]
    return _find(g.struct_fields, project, regex, {"module": module}, cols, ["module", "field"], limit)


def group_fields(fields: DataFrame) -> DataFrame:
    """(project, module, fields): the fields of each struct, in their order by name."""
    one = F.struct("field", "default_value", "required", "inferred_type")
    return fields.groupBy("project", "module").agg(F.array_sort(F.collect_list(one)).alias("fields"))


def find_accepts(g: Graph, pattern: str | None, module: str | None = None, project: str | None = None, regex: bool = False, limit: int | None = LIMIT) -> DataFrame:
    return _find(g.specs, project, regex, {"inputs_string": pattern, "module": module}, ["project", "module", "name", "arity", "inputs_string", "return_string", "line"], ["module", "name", "arity"], limit)


def find_returns(g: Graph, pattern: str | None, module: str | None = None, project: str | None = None, regex: bool = False, limit: int | None = LIMIT) -> DataFrame:
    return _find(g.specs, project, regex, {"return_string": pattern, "module": module}, ["project", "module", "name", "arity", "return_string", "line"], ["module", "name", "arity"], limit)


def find_struct_usage(g: Graph, pattern: str, module: str | None = None, project: str | None = None, regex: bool = False, limit: int | None = LIMIT) -> DataFrame:
    """Functions that accept or return a type."""
    validate(pattern, module, regex=regex)
    used = matches("inputs_string", pattern, regex) | matches("return_string", pattern, regex)
    df = in_project(g.specs, project).where(used & matches("module", module, regex))
    return ordered(df.select("project", "module", "name", "arity", "inputs_string", "return_string", "line").distinct(), ["module", "name", "arity"], limit)


def struct_usage_by_module(usage: DataFrame, pattern: str) -> DataFrame:
    """(project, module, accepts_count, returns_count, total) of find_struct_usage(); the pattern counts as plain text here."""
    name = F.concat_ws("/", "name", F.col("arity").cast("string"))
    at = lambda c: F.when(F.col(c).contains(F.lit(pattern)), name)
    return usage.groupBy("project", "module").agg(F.countDistinct(at("inputs_string")).alias("accepts_count"), F.countDistinct(at("return_string")).alias("returns_count"), F.countDistinct(name).alias("total"))


def find_complexity(g: Graph, min_complexity: int = 1, min_depth: int = 0, module: str | None = None, exclude_generated: bool = False, project: str | None = None, regex: bool = False, limit: int | None = LIMIT) -> DataFrame:
    validate(module, regex=regex)
    df = in_project(g.function_locations, project).where(matches("module", module, regex) & by_hand(exclude_generated) & (F.col("complexity") >= min_complexity) & (F.col("max_nesting_depth") >= min_depth))
    df = df.withColumn("lines", F.col("end_line") - F.col("start_line") + 1)
    cols = ["project", "module", "name", "arity", "line", "complexity", "max_nesting_depth", "start_line", "end_line", "lines", "generated_by"]
    return ordered(df.select(*cols).distinct(), ["-complexity", "module", "name"], limit)


def find_large_functions(g: Graph, min_lines: int = 50, module: str | None = None, include_generated: bool = False, project: str | None = None, regex: bool = False, limit: int | None = LIMIT) -> DataFrame:
    validate(module, regex=regex)
    df = in_project(g.function_locations, project).where(matches("module", module, regex) & by_hand(not include_generated))
    df = df.withColumn("lines", F.col("end_line") - F.col("start_line") + 1).where(F.col("lines") >= min_lines)
    cols = ["project", "module", "name", "arity", "start_line", "end_line", "lines", "file", "generated_by"]
    return ordered(df.select(*cols).distinct(), ["-lines", "module", "name"], limit)


#: Columns of browse_module beside project, module, type, name, arity, line and kind, with their types.
_BROWSED = {
    "file": "string", "start_line": "bigint", "end_line": "bigint", "pattern": "string", "guard": "string", "args": "string", "return_type": "string",
    "inputs": "string", "returns": "string", "full": "string", "params": "string", "definition": "string", "fields": "array<struct<field: string, default_value: string, required: boolean, inferred_type: string>>",
}


def browse_module(g: Graph, module: str | None, kind: str | None = None, name: str | None = None, project: str | None = None, regex: bool = False, limit: int | None = LIMIT) -> DataFrame:
    """Functions, specs, types and structs of a module as one tagged table, by module and line.

    type is function, spec, type or struct; columns that a type does not have are null. A function has its clause's
    lines, pattern and guard, and the arguments and return type of its spec if it has one. Each category is looked
    up with the limit (structs by fields, before these are grouped), then all together are cut to it. The name is a part
    of a function's or struct's name, but a pattern as elsewhere for specs and types. A struct has line 0 and its
    fields in their order by name.
    """

    def shape(df: DataFrame, tag: str, **more: Column) -> DataFrame:
        head = [F.col("project"), F.col("module"), F.lit(tag).alias("type"), F.col("name"), *[more.get(c, F.lit(None)).cast(t).alias(c) for c, t in (("arity", "bigint"), ("line", "bigint"), ("kind", "string"))]]
        return df.select(*head, *[more.get(c, F.lit(None)).cast(t).alias(c) for c, t in _BROWSED.items()])

    def cols(df: DataFrame, *names: str) -> dict[str, Column]:
        return {n: df[n] for n in names}

    part = lambda df: df if name is None else df.where(F.col("name").contains(F.lit(name)))
    found = []
    if kind in (None, "functions"):
        f = part(find_functions_in_module(g, module, project, regex, limit))
        f = f.join(g.functions.select("project", "module", "name", "arity", "args", "return_type"), ["project", "module", "name", "arity"], "left")
        found.append(shape(f, "function", **cols(f, "arity", "line", "kind", "file", "start_line", "end_line", "pattern", "guard", "args", "return_type")))
    if kind in (None, "specs"):
        f = find_specs(g, module, name, None, project, regex, limit)
        found.append(shape(f, "spec", inputs=f["inputs_string"], returns=f["return_string"], **cols(f, "arity", "line", "kind", "full")))
    if kind in (None, "types"):
        f = find_types(g, module, name, None, project, regex, limit)
        found.append(shape(f, "type", **cols(f, "line", "kind", "params", "definition")))
    if kind in (None, "structs"):
        f = group_fields(find_struct_fields(g, module, project, regex, limit)).withColumn("name", F.col("module"))
        f = part(f)
        found.append(shape(f, "struct", line=F.lit(0), fields=f["fields"]))
    if not found:
        raise ValueError(f"no such kind: {kind}")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return ordered(out, ["module", "line"], limit)
