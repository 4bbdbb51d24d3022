"""Calls joined to the clauses they are made in, and what depends on what."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callscape.functions.predicates import equals, in_project, matches, ordered, validate
from callscape.operators.lookup import LIMIT
from callscape.schema import Graph


#: Lines of a bucket in which calls meet clauses, and the most buckets that a clause is repeated in; longer ones meet all calls of their module.
BUCKET, BUCKETS = 256, 1024


def resolved_calls(g: Graph, project: str | None = None, with_struct_literals: bool = False, among: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Each call with every clause of its module whose lines it lies in and with whose name its caller's begins.

    Module and bucket of lines are the keys of the join; prefix and interval are checked on its matches. A caller may be
    written with its arity or without, and `get` also takes calls of `get_user` that lie in its lines. among chooses
    the calls to resolve.
    """
    c = in_project(g.calls, project).select("project", "caller_module", "caller_function", "callee_module", "callee_function", "callee_arity", "file", F.col("line").alias("call_line"), "call_type", F.col("caller_kind").alias("call_kind"))
    if not with_struct_literals:
        c = c.where(F.col("callee_function") != "%")
    c = among(c) if among else c
    f = in_project(g.function_locations, project).select("project", F.col("module").alias("caller_module"), F.col("name").alias("caller_name"), F.col("arity").alias("caller_arity"), F.col("kind").alias("caller_kind"), F.col("start_line").alias("caller_start_line"), F.col("end_line").alias("caller_end_line"))
    bucket = lambda line: F.floor(F.col(line) / BUCKET)
    spans = bucket("caller_end_line") - bucket("caller_start_line")
    short = f.where(spans.between(0, BUCKETS)).withColumn("_b", F.explode(F.sequence(bucket("caller_start_line"), bucket("caller_end_line"))))
    cols = [*c.columns, *f.columns[2:]]

    def joined(c: DataFrame, f: DataFrame, *keys: str) -> DataFrame:
        at = F.startswith(c["caller_function"], f["caller_name"]) & c["call_line"].between(f["caller_start_line"], f["caller_end_line"])
        on = reduce(and_, [c[k] == f[k] for k in ("project", "caller_module", *keys)], at)
        return c.join(f, on).drop(f["project"], f["caller_module"], *([f["_b"]] if keys else [])).select(*cols)

    return joined(c.withColumn("_b", bucket("call_line")), short, "_b").unionByName(joined(c, f.where(spans > BUCKETS)))


_CALL = ["project", "caller_module", "caller_name", "caller_arity", "caller_kind", "caller_start_line", "caller_end_line", "callee_module", "callee_function", "callee_arity", "file", "call_line"]


def find_calls(g: Graph, direction: str, module: str | None, function: str | None = None, arity: int | None = None, project: str | None = None, regex: bool = False, limit: int | None = LIMIT) -> DataFrame:
    """Calls from (direction 'from') or to (direction 'to') the functions that match; the caller's kind is the call's own."""
    validate(module, function, regex=regex)
    m, f, a = ("caller_module", "caller_name", "caller_arity") if direction == "from" else ("callee_module", "callee_function", "callee_arity")
    r = resolved_calls(g, project).where(matches(m, module, regex) & matches(f, function, regex) & equals(a, arity)).withColumn("caller_kind", F.col("call_kind"))
    by = {"from": ["caller_module", "caller_name", "caller_arity", "call_line", "callee_module", "callee_function", "callee_arity"], "to": ["callee_module", "callee_function", "callee_arity", "caller_module", "caller_name", "caller_arity"]}
    return ordered(r.select(*_CALL, "call_type").distinct(), by[direction], limit)


def calls_from(g: Graph, module: str | None, function: str | None = None, arity: int | None = None, **kw: object) -> DataFrame:
    return find_calls(g, "from", module, function, arity, **kw)


def calls_to(g: Graph, module: str | None, function: str | None = None, arity: int | None = None, **kw: object) -> DataFrame:
    return find_calls(g, "to", module, function, arity, **kw)


def find_dependencies(g: Graph, direction: str, module: str | None, project: str | None = None, regex: bool = False, limit: int | None = LIMIT) -> DataFrame:
    """Calls between different modules, outgoing from the module or incoming to it."""
    validate(module, regex=regex)
    field = "caller_module" if direction == "outgoing" else "callee_module"
    r = resolved_calls(g, project).where(matches(field, module, regex) & (F.col("caller_module") != F.col("callee_module")))
    by = ["callee_module", "callee_function", "callee_arity", "caller_module", "caller_name", "caller_arity", "call_line"] if direction == "outgoing" else ["caller_module", "caller_name", "caller_arity", "callee_function", "callee_arity", "call_line"]
    return ordered(r.select(*_CALL).distinct(), by, limit)


def depends_on(g: Graph, module: str | None, **kw: object) -> DataFrame:
    return find_dependencies(g, "outgoing", module, **kw)


def depended_by(g: Graph, module: str | None, **kw: object) -> DataFrame:
    return find_dependencies(g, "incoming", module, **kw)


def group_calls(calls: DataFrame, side: str, other: str) -> DataFrame:
    """Calls by the module and function of one side, of equal other sides the first by line.

    (project, module, name, arity, calls): calls are structs in the order of their lines.
    """
    name = {"caller": "caller_name", "callee": "callee_function"}
    keys = ["project", f"{side}_module", name[side], f"{side}_arity"]
    per = Window.partitionBy(*keys, f"{other}_module", name[other], *([f"{other}_arity"] if other == "caller" else [])).orderBy("call_line", *[c for c in calls.columns if c != "call_line"])
    first = calls.withColumn("_r", F.row_number().over(per)).where("_r = 1")
    one = F.struct("call_line", F.col(f"{other}_module").alias("module"), F.col(name[other]).alias("name"), F.col(f"{other}_arity").alias("arity"), "file")
    grouped = first.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("calls"))
    return grouped.select("project", F.col(keys[1]).alias("module"), F.col(keys[2]).alias("name"), F.col(keys[3]).alias("arity"), "calls")


def module_calls(g: Graph, project: str | None = None) -> DataFrame:
    """Distinct pairs of different modules of which one calls the other."""
    c = in_project(g.calls, project)
    return c.where(F.col("caller_module") != F.col("callee_module")).select("project", "caller_module", "callee_module").distinct()
