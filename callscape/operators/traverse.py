"""Recursion over the call graph, by frontiers: each step joins the distinct nodes reached last to the edges.

The driver runs one job per level, to see whether the frontier is empty; rows never leave the cluster. Levels are
written to the shared folder, so that a level's plan doesn't contain all levels before it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callscape.functions.cluster import cut_lineage, let_go
from callscape.functions.predicates import equals, in_project, matches, ordered, validate
from callscape.operators.calls import module_calls, resolved_calls
from callscape.operators.lookup import LIMIT
from callscape.schema import Graph

TRACE_DEPTH, PATH_DEPTH, DEPTH_MOST = 5, 10, 20
_TRACE = ["caller_module", "caller_name", "caller_arity", "caller_kind", "caller_start_line", "caller_end_line", "callee_module", "callee_function", "callee_arity", "file", "call_line"]
_ORDER = ["depth", "caller_module", "caller_name", "caller_arity", "call_line", "callee_module", "callee_function", "callee_arity"]


def _depth(depth: int) -> int:
    if not 1 <= depth <= DEPTH_MOST:
        raise ValueError(f"depth must be from 1 to {DEPTH_MOST}")
    return depth


def _levels(resolve: Callable[[Callable[[DataFrame], DataFrame]], DataFrame], among: Column, start: Column, reached: list[str], nodes: list[str], step: Column, max_depth: int) -> DataFrame:
    """The calls at each depth: those of `start`, then those that `step` joins to the nodes reached at the depth before.

    resolve joins calls to their clauses; only those that may begin the trace (among) or that a frontier reaches are ever
    resolved. Calls have the alias `e`, the frontier the alias `f` with the columns nodes, which are the columns
    `reached` of the resolved calls. A node reached again at another depth is followed again, as depth is part of the
    result.
    """
    level = cut_lineage(resolve(lambda c: c.where(among)).where(start).withColumn("depth", F.lit(1).cast("bigint")))
    found = [level]
    for d in range(2, max_depth + 1):
        frontier = cut_lineage(level.select("project", *[F.col(r).alias(n) for r, n in zip(reached, nodes, strict=True)]).distinct())
        if frontier.isEmpty():
            break
        level = cut_lineage(resolve(lambda c, f=frontier: c.alias("e").join(f.alias("f"), (F.col("e.project") == F.col("f.project")) & step, "left_semi")).withColumn("depth", F.lit(d).cast("bigint")))
        found.append(level)
    return reduce(DataFrame.unionByName, found)


def trace_calls(g: Graph, module: str | None, function: str | None, arity: int | None = None, max_depth: int = TRACE_DEPTH, project: str | None = None, regex: bool = False, limit: int | None = LIMIT) -> DataFrame:
    """Calls reached from the functions that match, each at every depth at which it is reached."""
    validate(module, function, regex=regex)
    resolve = lambda among: resolved_calls(g, project, among=among).select("project", "caller_function", *_TRACE).distinct()
    start = matches("caller_name", function, regex) & equals("caller_arity", arity)
    step = (F.col("e.caller_module") == F.col("f.m")) & F.startswith(F.col("e.caller_function"), F.col("f.n"))
    rows = _levels(resolve, matches("caller_module", module, regex), start, ["callee_module", "callee_function"], ["m", "n"], step, _depth(max_depth))
    return ordered(rows.select("project", "depth", *_TRACE).distinct(), _ORDER, limit)


def reverse_trace_calls(g: Graph, module: str | None, function: str | None, arity: int | None = None, max_depth: int = TRACE_DEPTH, project: str | None = None, regex: bool = False, limit: int | None = LIMIT) -> DataFrame:
    """Calls that lead to the functions that match; struct literals count as calls here."""
    validate(module, function, regex=regex)
    resolve = lambda among: resolved_calls(g, project, True, among).select("project", *_TRACE).distinct()
    start = matches("callee_module", module, regex) & matches("callee_function", function, regex) & equals("callee_arity", arity)
    step = (F.col("e.callee_module") == F.col("f.m")) & (F.col("e.callee_function") == F.col("f.n")) & (F.col("e.callee_arity") == F.col("f.a"))
    rows = _levels(resolve, start, F.lit(True), ["caller_module", "caller_name", "caller_arity"], ["m", "n", "a"], step, _depth(max_depth))
    return ordered(rows.select("project", "depth", *_TRACE).distinct(), _ORDER, limit)


def _untold() -> list[Column]:
    return [F.lit("").alias("kind"), F.lit(0).cast("bigint").alias("start_line"), F.lit(0).cast("bigint").alias("end_line"), F.lit("").alias("file")]


def trace_entries(rows: DataFrame, module: str, function: str, max_depth: int = TRACE_DEPTH) -> DataFrame:
    """A trace as a list of entries (entry_index, module, function, arity, kind, start_line, end_line, file, depth, line, parent_index).

    A callee's kind, lines and file are empty, as a call tells nothing of its definition. Entry 0 is the start, with arity 0 and depth 0; depth-1 entries are its children. Of the rows of one callee at a
    depth the first in order counts whose caller is an entry of the depth before; rows without one are left out. No rows
    give no entries. rows come from trace_calls() with its limit, which bounds them.
    """
    order = [c for c in _ORDER[1:]]
    rows = cut_lineage(rows)
    key = ["callee_module", "callee_function", "callee_arity"]
    levels = []
    before = None
    for d in range(1, max_depth + 1):
        level = rows.where(F.col("depth") == d)
        if before is not None:
            has = (F.col("r.caller_module") == F.col("p.callee_module")) & (F.col("r.caller_name") == F.col("p.callee_function")) & (F.col("r.caller_arity") == F.col("p.callee_arity"))
            level = level.alias("r").join(before.select(*key).alias("p"), has, "left_semi")
        w = Window.partitionBy(*key).orderBy(*order)
        before = level.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
        levels.append(before)
    flat = reduce(DataFrame.unionByName, levels)
    flat = flat.withColumn("entry_index", F.row_number().over(Window.orderBy("depth", *order)).cast("bigint"))
    up = flat.select(F.col("depth").alias("_d"), *[F.col(k).alias(f"_{k}") for k in key], F.col("entry_index").alias("parent_index"))
    has = (F.col("_d") == F.col("depth") - 1) & (F.col("_callee_module") == F.col("caller_module")) & (F.col("_callee_function") == F.col("caller_name")) & (F.col("_callee_arity") == F.col("caller_arity"))
    out = flat.join(up, has, "left").select("entry_index", F.col("callee_module").alias("module"), F.col("callee_function").alias("function"), F.col("callee_arity").alias("arity"), *_untold(), "depth", F.col("call_line").alias("line"), F.when(F.col("depth") == 1, F.lit(0)).otherwise(F.col("parent_index")).cast("bigint").alias("parent_index"))
    root = flat.limit(1).select(F.lit(0).cast("bigint").alias("entry_index"), F.lit(module).alias("module"), F.lit(function).alias("function"), F.lit(0).cast("bigint").alias("arity"), *_untold(), F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("line"), F.lit(None).cast("bigint").alias("parent_index"))
    return root.unionByName(out)


def reverse_trace_entries(rows: DataFrame, max_depth: int = TRACE_DEPTH) -> DataFrame:
    """A reverse trace as entries: direct callers are roots, a caller of an entry's function is its child."""
    rows = cut_lineage(rows)
    key = ["caller_module", "caller_name", "caller_arity"]
    levels, before = [], None
    for d in range(1, max_depth + 1):
        level = rows.where(F.col("depth") == d)
        if before is not None:
            has = (F.col("r.callee_module") == F.col("p.caller_module")) & (F.col("r.callee_function") == F.col("p.caller_name")) & (F.col("r.callee_arity") == F.col("p.caller_arity"))
            level = level.alias("r").join(before.select(*key).alias("p"), has, "left_semi")
        before = level.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*_ORDER[1:]))).where("_r = 1").drop("_r")
        levels.append(before)
    flat = reduce(DataFrame.unionByName, levels)
    flat = flat.withColumn("entry_index", F.row_number().over(Window.orderBy("depth", *_ORDER[1:])).cast("bigint") - 1)
    up = flat.select(F.col("depth").alias("_d"), *[F.col(k).alias(f"_{k}") for k in key], F.col("entry_index").alias("parent_index"))
    has = (F.col("_d") == F.col("depth") - 1) & (F.col("_caller_module") == F.col("callee_module")) & (F.col("_caller_name") == F.col("callee_function")) & (F.col("_caller_arity") == F.col("callee_arity"))
    return flat.join(up, has, "left").select("entry_index", F.col("caller_module").alias("module"), F.col("caller_name").alias("function"), F.col("caller_arity").alias("arity"), F.col("caller_kind").alias("kind"), F.col("caller_start_line").alias("start_line"), F.col("caller_end_line").alias("end_line"), "file", "depth", F.col("call_line").alias("line"), "parent_index")


def find_paths(g: Graph, from_module: str | None, from_function: str | None, to_module: str | None, to_function: str | None, from_arity: int | None = None, to_arity: int | None = None, max_depth: int = PATH_DEPTH, project: str | None = None, limit: int | None = LIMIT) -> DataFrame:
    """Paths of calls from one function to another: (project, steps, length), no call twice in a path.

    The first call's caller begins with from_function and is made in a clause of a matching name (with from_arity, of
    that arity); every further caller begins with the callee before it; the last callee is to_function exactly. None
    stands for any. steps are structs (depth, caller_module, caller_function, callee_module, callee_function,
    callee_arity, file, line), depth being the place in the path. Paths have at most max_depth calls. Only edges
    that lie on the way are followed: at each level, calls whose target can't be reached in what is left are cut first.
    """
    _depth(max_depth)
    cols = ["project", "caller_module", "caller_function", "callee_module", "callee_function", "callee_arity", "file", "line"]
    edges = cut_lineage(in_project(g.calls, project).select(*cols).distinct())
    f = in_project(g.function_locations, project).where(equals("arity", from_arity)).select("project", F.col("module").alias("m"), F.col("name").alias("n")).distinct()
    begins = F.lit(True) if from_function is None else F.startswith(F.col("caller_function"), F.lit(from_function))
    first = edges.alias("e").join(f.alias("f"), (F.col("e.project") == F.col("f.project")) & (F.col("caller_module") == F.col("m")) & F.startswith(F.col("caller_function"), F.col("n")), "left_semi")
    first = first.where(equals("caller_module", from_module) & begins)
    ends = equals("callee_module", to_module) & equals("callee_function", to_function) & equals("callee_arity", to_arity)
    # what leads to the target in so many calls, from the target backwards
    useful, rows = [edges.where(ends)], -1
    for _ in range(max_depth - 1):
        if rows == (now := useful[-1].count()):
            useful += [useful[-1]] * (max_depth - len(useful))
            break
        rows = now
        heads = cut_lineage(useful[-1].select("project", F.col("caller_module").alias("m"), F.col("caller_function").alias("c")).distinct())
        back = edges.alias("e").join(heads.alias("h"), (F.col("e.project") == F.col("h.project")) & (F.col("callee_module") == F.col("m")) & F.startswith(F.col("c"), F.col("callee_function")), "left_semi")
        useful.append(cut_lineage(back.unionByName(edges.where(ends)).distinct()))
    step = F.struct(*cols[1:])
    paths = first.join(useful[max_depth - 1], cols, "left_semi").select("project", F.array(step).alias("steps"))
    found = []
    for d in range(1, max_depth + 1):
        last = F.element_at("steps", -1)
        hit = F.lit(True)
        for c, v in (("callee_module", to_module), ("callee_function", to_function), ("callee_arity", to_arity)):
            hit = hit & (F.lit(True) if v is None else last[c] == v)
        found.append(paths.where(hit))
        if d == max_depth:
            break
        more = useful[max_depth - d - 1].select("project", step.alias("s"))
        at = (F.col("p.project") == F.col("n.project")) & (F.col("s.caller_module") == F.element_at("p.steps", -1)["callee_module"]) & F.startswith(F.col("s.caller_function"), F.element_at("p.steps", -1)["callee_function"])
        paths = cut_lineage(paths.alias("p").join(more.alias("n"), at).where(~F.array_contains("p.steps", F.col("s"))).select("p.project", F.array_append("p.steps", F.col("s")).alias("steps")))
        if paths.isEmpty():
            break
    out = reduce(DataFrame.unionByName, found)
    numbered = F.transform("steps", lambda s, i: F.struct((i + 1).cast("bigint").alias("depth"), *[s[c].alias(c) for c in cols[1:]]))
    return ordered(out.select("project", numbered.alias("steps"), F.size("steps").cast("bigint").alias("length")), ["length", "steps"], limit)


def reachable(g: Graph, project: str | None = None, module: str | None = None) -> DataFrame:
    """(project, a, b): the transitive closure of calls between different modules, by doubling.

    module keeps only edges of which either end contains it. Each round joins the pairs found so far to themselves, so
    that the length of the paths they stand for doubles, until none is new.
    """
    known, pairs = cut_lineage(_module_edges(g, project, module)), -1
    while (now := known.count()) != pairs:
        pairs, before = now, known
        step = known.alias("f").join(known.alias("e"), (F.col("f.project") == F.col("e.project")) & (F.col("f.b") == F.col("e.a"))).select("f.project", "f.a", "e.b")
        known = cut_lineage(known.unionByName(step).distinct())
        let_go(before)
    return known


def components(edges: DataFrame) -> DataFrame:
    """(project, node, component): nodes on cycles of edges (project, a, b), a <> b, by the greatest node of their strong component.

    Nodes without an edge on either side are trimmed. Then each node takes the greatest node that leads to it as its
    colour, and those of a colour from which that node is reached back are its component; what is left goes round again.
    """
    on = lambda *k: [F.col(f"x.{c}") == F.col(f"y.{c}") for c in k]
    left, found = cut_lineage(edges.select("project", "a", "b")), None
    while True:
        rows, before = -1, left.count()
        while rows != before:
            rows = before
            inner = left.select("project", F.col("a").alias("node")).intersect(left.select("project", F.col("b").alias("node")))
            trimmed = cut_lineage(left.join(inner.withColumnRenamed("node", "a"), ["project", "a"], "left_semi").join(inner.withColumnRenamed("node", "b"), ["project", "b"], "left_semi").select("project", "a", "b"))
            let_go(left)
            left = trimmed
            before = left.count()
        if not before:
            break
        colours = cut_lineage(left.select("project", F.col("a").alias("node"), F.col("a").alias("colour")).distinct())
        while True:
            sent = left.alias("x").join(colours.withColumnRenamed("node", "a").alias("y"), on("project", "a")).groupBy("x.project", F.col("x.b").alias("node")).agg(F.max("y.colour").alias("sent"))
            grown = cut_lineage(colours.join(sent, ["project", "node"], "left").select("project", "node", F.greatest("colour", F.coalesce("sent", "colour")).alias("colour"), F.coalesce(F.col("sent") > F.col("colour"), F.lit(False)).alias("new")))
            let_go(colours)
            colours = grown
            if not colours.where("new").limit(1).count():
                break
        tint = lambda c: colours.select("project", F.col("node").alias(c), F.col("colour").alias(f"{c}_colour"))
        same = cut_lineage(left.join(tint("a"), ["project", "a"]).join(tint("b"), ["project", "b"]).where("a_colour = b_colour").select("project", "a", "b", F.col("a_colour").alias("colour")))
        members = fresh = cut_lineage(colours.where("node = colour").select("project", "node", "colour"))
        while fresh.limit(1).count():
            step = same.alias("x").join(fresh.withColumnRenamed("node", "b").alias("y"), on("project", "b", "colour")).select("x.project", F.col("x.a").alias("node"), "x.colour").distinct()
            fresh = cut_lineage(step.join(members, ["project", "node"], "left_anti"))
            members = members.unionByName(fresh)
        members = cut_lineage(members)
        several = members.groupBy("project", "colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        done = cut_lineage(members.join(several, ["project", "colour"], "left_semi").select("project", "node", F.col("colour").alias("component")))
        found = done if found is None else found.unionByName(done)
        gone = members.select("project", "node")
        left = cut_lineage(left.join(gone.withColumnRenamed("node", "a"), ["project", "a"], "left_anti").join(gone.withColumnRenamed("node", "b"), ["project", "b"], "left_anti").select("project", "a", "b"))
    return edges.sparkSession.createDataFrame([], "project string, node string, component string") if found is None else found


def _module_edges(g: Graph, project: str | None, module: str | None) -> DataFrame:
    e = module_calls(g, project).select("project", F.col("caller_module").alias("a"), F.col("callee_module").alias("b"))
    return e if module is None else e.where(F.col("a").contains(F.lit(module)) | F.col("b").contains(F.lit(module)))


def cycle_edges(g: Graph, project: str | None = None, module: str | None = None) -> DataFrame:
    """(project, from_module, to_module): edges both of whose modules can reach themselves."""
    e = cut_lineage(_module_edges(g, project, module))
    looped = components(e).select("project", F.col("node").alias("a"))
    return e.join(looped, ["project", "a"], "left_semi").join(looped.withColumnRenamed("a", "b"), ["project", "b"], "left_semi").select("project", F.col("a").alias("from_module"), F.col("b").alias("to_module"))


def simple_cycles(g: Graph, max_length: int | None = None, involving: str | None = None, project: str | None = None, module: str | None = None) -> DataFrame:
    """(project, length, modules): simple cycles of modules, one per set of modules; of any length unless bounded.

    A cycle begins at its smallest module; of several cycles over the same modules the lexicographically least one
    stands. Only edges within a strong component are walked, and a walk is cut as soon as it leaves the modules above
    its first. The number of cycles, and so the work, may grow exponentially with a component's size.
    """
    e = cut_lineage(_module_edges(g, project, module))
    c = components(e)
    at = lambda k: c.select("project", F.col("node").alias(k), F.col("component").alias(f"{k}_c"))
    edges = cut_lineage(e.join(at("a"), ["project", "a"]).join(at("b"), ["project", "b"]).where("a_c = b_c").select("project", "a", "b"))
    walks = edges.where("b > a").select("project", F.array("a", "b").alias("modules"))
    found, d = [], 2
    while max_length is None or max_length > 1:
        on = (F.col("w.project") == F.col("e.project")) & (F.element_at("w.modules", -1) == F.col("e.a"))
        nxt = walks.alias("w").join(edges.alias("e"), on).select("w.project", "w.modules", "e.b")
        found.append(nxt.where(F.col("b") == F.col("modules")[0]).select("project", "modules"))
        if d == max_length:
            break
        walks = cut_lineage(nxt.where((F.col("b") > F.col("modules")[0]) & ~F.array_contains("modules", F.col("b"))).select("project", F.array_append("modules", F.col("b")).alias("modules")))
        d += 1
        if walks.isEmpty():
            break
    c = reduce(DataFrame.unionByName, found) if found else edges.select("project", F.array("a").alias("modules")).limit(0)
    if involving is not None:
        c = c.where(F.exists("modules", lambda m: m.contains(F.lit(involving))))
    c = c.groupBy("project", F.array_sort("modules").alias("_set")).agg(F.min("modules").alias("modules"))
    return c.select("project", F.size("modules").cast("bigint").alias("length"), "modules")
