"""Counts and rankings of functions and modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callscape.functions.predicates import by_hand, in_project, matches, ordered, validate
from callscape.operators.lookup import LIMIT
from callscape.schema import Graph

PRIVATE, PUBLIC = ("defp", "defmacrop"), ("def", "defmacro")
#: Beginnings of names that the compiler makes (fixed values).
GENERATED_PREFIXES = ("__struct__", "__using__", "__before_compile__", "__after_compile__", "__on_definition__", "__impl__", "__info__", "__protocol__", "__deriving__", "__changeset__", "__schema__", "__meta__")


def function_connectivity(g: Graph, exclude_generated: bool = False, project: str | None = None) -> DataFrame:
    """(project, module, function, incoming, outgoing) of every function that is defined and called at least once.

    incoming and outgoing count distinct callers and callees, recursion and struct literals included. A caller is
    written `name` or `name/arity`; both forms are tried as equal keys, so that no prefix join is needed.
    """
    c = in_project(g.calls, project).select("project", "caller_module", "caller_function", "callee_module", "callee_function").distinct()
    f = in_project(g.function_locations, project).where(by_hand(exclude_generated)).select("project", F.col("module"), F.col("name").alias("function")).distinct()
    called = c.groupBy("project", F.col("callee_module").alias("module"), F.col("callee_function").alias("function")).agg(F.count(F.lit(1)).alias("incoming"))
    canonical = called.join(f, ["project", "module", "function"], "left_semi")
    names = F.array_distinct(F.array("caller_function", F.regexp_replace("caller_function", "/.*$", ""), F.regexp_replace("caller_function", "/[^/]*$", "")))
    out = c.select("project", F.col("caller_module").alias("module"), F.explode(names).alias("function"), "callee_module", "callee_function").distinct()
    out = out.groupBy("project", "module", "function").agg(F.count(F.lit(1)).alias("outgoing"))
    return canonical.join(out, ["project", "module", "function"], "left").select("project", "module", "function", "incoming", F.coalesce("outgoing", F.lit(0).cast("bigint")).alias("outgoing"))


def hotspots(g: Graph, kind: str = "incoming", module: str | None = None, exclude_generated: bool = False, require_outgoing: bool = False, project: str | None = None, regex: bool = False, limit: int | None = LIMIT) -> DataFrame:
    """Functions by incoming, outgoing, total or ratio of their calls; the ratio without outgoing ones is 9999."""
    validate(module, regex=regex)
    if kind not in ("incoming", "outgoing", "total", "ratio"):
        raise ValueError(f"no such kind: {kind}")
    f = function_connectivity(g, exclude_generated, project).where(matches("module", module, regex))
    if require_outgoing:
        f = f.where("outgoing > 0")
    ratio = F.when(F.col("outgoing") == 0, F.lit(9999.0)).otherwise(F.col("incoming").cast("double") / F.when(F.col("outgoing") != 0, F.col("outgoing")))
    f = f.select("project", "module", "function", "incoming", "outgoing", (F.col("incoming") + F.col("outgoing")).alias("total"), ratio.alias("ratio"))
    return ordered(f, [f"-{kind}", "module", "function"], limit)


def boundaries(g: Graph, min_incoming: int = 1, min_ratio: float = 2.0, module: str | None = None, project: str | None = None, regex: bool = False, limit: int | None = LIMIT) -> DataFrame:
    """Modules by their function of the highest ratio: the limit cuts the functions, before any threshold."""
    h = hotspots(g, "ratio", module, False, True, project, regex, limit)
    w = Window.partitionBy("project", "module").orderBy(F.desc("ratio"), "function")
    h = h.where((F.col("incoming") >= min_incoming) & (F.col("ratio") >= min_ratio)).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return h.select("project", "module", "incoming", "outgoing", "ratio")


def module_loc(g: Graph, module: str | None = None, project: str | None = None, regex: bool = False) -> DataFrame:
    """(project, module, loc): lines of all clauses."""
    validate(module, regex=regex)
    f = in_project(g.function_locations, project).where(matches("module", module, regex))
    return f.groupBy("project", "module").agg(F.sum(F.col("end_line") - F.col("start_line") + 1).alias("loc"))


def function_counts(g: Graph, module: str | None = None, project: str | None = None, regex: bool = False) -> DataFrame:
    """(project, module, func_count): clauses of code that no macro generated."""
    validate(module, regex=regex)
    f = in_project(g.function_locations, project).where(matches("module", module, regex) & by_hand(True))
    return f.groupBy("project", "module").agg(F.count(F.lit(1)).alias("func_count"))


def module_connectivity(g: Graph, module: str | None = None, project: str | None = None, regex: bool = False) -> DataFrame:
    """(project, module, incoming, outgoing): sums over the functions that no macro generated."""
    validate(module, regex=regex)
    f = function_connectivity(g, True, project).where(matches("module", module, regex))
    return f.groupBy("project", "module").agg(F.sum("incoming").alias("incoming"), F.sum("outgoing").alias("outgoing"))


def god_modules(g: Graph, min_functions: int = 20, min_loc: int = 0, min_total: int = 10, module: str | None = None, project: str | None = None, regex: bool = False, limit: int | None = LIMIT) -> DataFrame:
    """Modules with many functions, lines and calls, by the latter."""
    n = function_counts(g, module, project, regex).where(F.col("func_count") >= min_functions)
    j = n.join(module_loc(g, module, project, regex), ["project", "module"], "left").join(module_connectivity(g, module, project, regex), ["project", "module"], "left").fillna(0, ["loc", "incoming", "outgoing"])
    j = j.select("project", "module", F.col("func_count").alias("function_count"), "loc", "incoming", "outgoing", (F.col("incoming") + F.col("outgoing")).alias("total"))
    return ordered(j.where((F.col("loc") >= min_loc) & (F.col("total") >= min_total)), ["-total", "module"], limit)


def unused(g: Graph, module: str | None = None, private_only: bool = False, public_only: bool = False, exclude_generated: bool = False, project: str | None = None, regex: bool = False, limit: int | None = LIMIT) -> DataFrame:
    """Clauses of functions that nothing calls; compiler-made names are left out after the limit."""
    validate(module, regex=regex)
    f = in_project(g.function_locations, project).where(matches("module", module, regex))
    if private_only or public_only:
        f = f.where(F.col("kind").isin(*(PRIVATE if private_only else PUBLIC)))
    f = f.select("project", "module", "name", "arity", "kind", "file", F.col("start_line").alias("line")).distinct()
    called = in_project(g.calls, project).select("project", F.col("callee_module").alias("module"), F.col("callee_function").alias("name"), F.col("callee_arity").alias("arity")).distinct()
    f = ordered(f.join(called, ["project", "module", "name", "arity"], "left_anti"), ["module", "name", "arity"], limit)
    return f.where(~F.col("name").rlike("^(" + "|".join(GENERATED_PREFIXES) + ")")) if exclude_generated else f


def many_clauses(g: Graph, min_clauses: int = 5, module: str | None = None, include_generated: bool = False, project: str | None = None, regex: bool = False, limit: int | None = LIMIT) -> DataFrame:
    validate(module, regex=regex)
    f = in_project(g.function_locations, project).where(matches("module", module, regex) & by_hand(not include_generated))
    f = f.groupBy("project", "module", "name", "arity", "file", "generated_by").agg(F.count("line").alias("clauses"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"))
    return ordered(f.where(F.col("clauses") >= min_clauses), ["-clauses", "module", "name"], limit)


def duplicates(g: Graph, exact: bool = False, module: str | None = None, exclude_generated: bool = False, project: str | None = None, regex: bool = False) -> DataFrame:
    """Clauses whose text (exact) or syntax tree another clause of the project has too.

    The module only chooses what comes out: the other clause may be anywhere. A hash of a third of all clauses stays
    spread, as clauses are joined to the few hashes that occur twice or more.
    """
    validate(module, regex=regex)
    f = in_project(g.function_locations, project).where(by_hand(exclude_generated)).withColumn("hash", F.col("source_sha" if exact else "ast_sha")).where("hash <> ''")
    twice = f.groupBy("project", "hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    f = f.where(matches("module", module, regex)).join(twice, ["project", "hash"], "left_semi")
    return f.select("project", "hash", "module", "name", "arity", "line", "file").distinct()


def duplicates_by_module(found: DataFrame) -> DataFrame:
    """(project, module, name, arity, copy_count, duplicate_count): copies of each function, functions of each module."""
    f = found.groupBy("project", "module", "name", "arity").agg(F.count(F.lit(1)).alias("copy_count"))
    return f.withColumn("duplicate_count", F.count(F.lit(1)).over(Window.partitionBy("project", "module")))


def duplicate_groups(found: DataFrame) -> DataFrame:
    """(project, hash, n_functions): groups of equal clauses."""
    return found.groupBy("project", "hash").agg(F.count(F.lit(1)).alias("n_functions"))


def duplicate_members(found: DataFrame) -> DataFrame:
    """(project, hash, n_functions, functions): the groups with their clauses as structs, by module, name, arity and line.

    A group is a list, so this is for results that are shown; duplicates() itself has a row per clause.
    """
    one = F.struct("module", "name", "arity", "line", "file")
    return found.groupBy("project", "hash").agg(F.count(F.lit(1)).alias("n_functions"), F.array_sort(F.collect_list(one)).alias("functions"))


def namespace(module: str, depth: int) -> Column:
    """The first `depth` segments of a module's name."""
    return F.array_join(F.slice(F.split(module, "[.]"), 1, depth), ".")


def clusters(g: Graph, depth: int = 2, module: str | None = None, project: str | None = None) -> DataFrame:
    """Namespaces (the first segments of modules) with their inner and outer calls between pairs of modules.

    module filters by a part of the name: a pair counts for its caller's or callee's namespace only if that module
    passes; within one namespace, a callee that does not pass makes the pair an outgoing one.
    """
    p = _pairs(g, depth, module, project)
    same = F.col("a_ns") == F.col("b_ns")
    out = p.where("a_in and not (a_ns = b_ns and b_in)").groupBy("project", F.col("a_ns").alias("namespace")).agg(F.count(F.lit(1)).alias("outgoing_calls"))
    within = p.where(same & F.col("a_in") & F.col("b_in")).groupBy("project", F.col("a_ns").alias("namespace")).agg(F.count(F.lit(1)).alias("internal_calls"))
    inc = p.where(~same & F.col("b_in")).groupBy("project", F.col("b_ns").alias("namespace")).agg(F.count(F.lit(1)).alias("incoming_calls"))
    ends = p.select("project", F.explode(F.array(F.struct(F.col("a").alias("m"), F.col("a_ns").alias("namespace"), F.col("a_in").alias("i")), F.struct(F.col("b").alias("m"), F.col("b_ns").alias("namespace"), F.col("b_in").alias("i")))).alias("e"))
    n = ends.where("e.i").groupBy("project", "e.namespace").agg(F.countDistinct("e.m").alias("module_count"))
    on = ["project", "namespace"]
    j = n.join(within, on, "left").join(out, on, "left").join(inc, on, "left").fillna(0, ["internal_calls", "outgoing_calls", "incoming_calls"])
    share = lambda x, total: F.when(total > 0, x.cast("double") / F.when(total > 0, total)).otherwise(F.lit(0.0))
    i, o, c = F.col("internal_calls"), F.col("outgoing_calls"), F.col("incoming_calls")
    return j.select(*on, "module_count", i, o, c, share(i, i + o + c).alias("cohesion"), share(o, o + c).alias("instability"))


def cluster_dependencies(g: Graph, depth: int = 2, module: str | None = None, project: str | None = None) -> DataFrame:
    """(project, from_namespace, to_namespace, call_count) of pairs of modules in different namespaces."""
    p = _pairs(g, depth, module, project).where("a_in and a_ns <> b_ns")
    return p.groupBy("project", F.col("a_ns").alias("from_namespace"), F.col("b_ns").alias("to_namespace")).agg(F.count(F.lit(1)).alias("call_count"))


def _pairs(g: Graph, depth: int, module: str | None, project: str | None) -> DataFrame:
    from callscape.operators.calls import module_calls

    passes = lambda c: F.lit(True) if module is None else F.col(c).contains(F.lit(module))
    p = module_calls(g, project).select("project", F.col("caller_module").alias("a"), F.col("callee_module").alias("b"))
    return p.select("project", "a", "b", namespace("a", depth).alias("a_ns"), namespace("b", depth).alias("b_ns"), passes("a").alias("a_in"), passes("b").alias("b_in"))
