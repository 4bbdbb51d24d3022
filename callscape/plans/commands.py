"""The command line: each command is a query of the store, shaped by module and printed."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscape.operators import calls, lookup, metrics, traverse
from callscape.plans import render
from callscape.schema import Graph
from callscape.sources.store import Store, resolve

Shape = Callable[[list[dict], Any], dict]


@dataclass(frozen=True)
class Command:
    """What a command does; args are (flags, options) of argparse beside the common ones."""

    about: str
    run: Callable[[Graph, Any, dict], DataFrame]
    args: tuple = ()
    group: str = "module"
    category: str = "lookup"
    shape: Shape | None = None
    noun: str = "function"
    with_regex: bool = True



def _whole(low: int, high: int) -> Callable[[str], int]:
    def check(text: str) -> int:
        if not low <= (n := int(text)) <= high:
            raise argparse.ArgumentTypeError(f"not from {low} to {high}")
        return n

    return check


def _arg(*flags: str, **kw: Any) -> tuple:
    return flags, kw


_MODULE, _MAYBE_MODULE = _arg("module"), _arg("module", nargs="?")
_FUNCTION, _MAYBE_FUNCTION = _arg("function"), _arg("function", nargs="?")
_ARITY = _arg("-a", "--arity", type=int)
_DEPTH = _arg("--depth", type=_whole(1, traverse.DEPTH_MOST), default=traverse.TRACE_DEPTH)
_NO_GENERATED = _arg("--exclude-generated", action="store_true")
_GENERATED = _arg("--include-generated", action="store_true")


def _trace(rows: list[dict], a: Any) -> dict:
    items = [{"name": r["module"], "file": "", "entries": [{k: v for k, v in r.items() if k != "module"}]} for r in rows]
    return {"items": items, "entries": rows, "total_items": len([r for r in rows if r["depth"] > 0]), "max_depth": a.depth, "start_module": a.module, "start_function": a.function}


def _paths(rows: list[dict], a: Any) -> dict:
    items = [{"name": f"path of {r['length']}", "file": "", "entries": [{"name": f"{s['caller_module']}.{s['caller_function']} -> {s['callee_module']}.{s['callee_function']}/{s['callee_arity']}", "line": s["line"]} for s in r["steps"]]} for r in rows]
    return {"items": items, "paths": [{"steps": r["steps"]} for r in rows], "total_items": len(rows), "max_depth": a.depth}


def _cycles(rows: list[dict], a: Any) -> dict:
    return {"items": [{"name": " -> ".join(r["modules"]), "file": "", "entries": []} for r in rows], "cycles": rows, "total_cycles": len(rows), "total_items": len(rows), "modules_in_cycles": len({m for r in rows for m in r["modules"]})}


def _grouped(rows: list[dict], module: str, function: tuple[str, ...], inner: str, of: dict[str, str]) -> list[dict]:
    """Rows as modules with functions, each with a list `inner` of what of each row (new name: column) belongs under it; all in order of first appearance."""
    modules: dict[tuple, dict] = {}
    functions: dict[tuple, dict] = {}
    for r in rows:
        m = modules.setdefault((r["project"], r[module]), {"name": r[module], "file": "", "entries": []})
        key = (r["project"], r[module], *(r[c] for c in function))
        if key not in functions:
            functions[key] = {"name": r[function[0]], "arity": r[function[1]], **{c.removeprefix("caller_"): r[c] for c in function[2:]}, inner: []}
            m["entries"].append(functions[key])
        functions[key][inner].append({n: r[c] for n, c in of.items()})
    return list(modules.values())


_CALLER = {"module": "caller_module", "name": "caller_name", "arity": "caller_arity", "kind": "caller_kind", "start_line": "caller_start_line", "end_line": "caller_end_line", "file": "file", "line": "call_line"}
_CALLEE = {"module": "callee_module", "name": "callee_function", "arity": "callee_arity", "line": "call_line"}


def _depends_on(rows: list[dict], a: Any) -> dict:
    return {"items": _grouped(rows, "callee_module", ("callee_function", "callee_arity"), "callers", _CALLER), "total_items": len(rows), "module": a.module}


def _depended_by(rows: list[dict], a: Any) -> dict:
    return {"items": _grouped(rows, "caller_module", ("caller_name", "caller_arity", "caller_kind", "caller_start_line", "caller_end_line", "file"), "targets", _CALLEE), "total_items": len(rows), "module": a.module}


def _locations(rows: list[dict], a: Any) -> dict:
    clause = {c: c for c in ("line", "start_line", "end_line", "pattern", "guard")}
    items = _grouped(rows, "module", ("name", "arity", "kind", "file"), "clauses", clause)
    return {"items": items, "total_items": len(rows), "total_functions": sum(len(m["entries"]) for m in items), "function_pattern": a.function}


def _duplicates(rows: list[dict], a: Any) -> dict:
    if a.by_module:
        return {"items": render.by_module(rows), "total_items": len(rows)}
    groups = [{"hash": r["hash"], "functions": r["functions"]} for r in rows]
    items = [{"name": r["hash"], "file": "", "entries": [{**f, "name": f"{f['module']}.{f['name']}"} for f in r["functions"]]} for r in rows]
    return {"items": items, "groups": groups, "total_groups": len(rows), "total_duplicates": sum(r["n_functions"] for r in rows), "total_items": len(rows)}


def _clusters(rows: list[dict], a: Any) -> dict:
    spaces = [r for r in rows if r["to_namespace"] is None]
    crossing = [{k: r[k] for k in ("from_namespace", "to_namespace", "call_count")} for r in rows if r["to_namespace"] is not None]
    shown = [{k: v for k, v in r.items() if k not in ("project", "from_namespace", "to_namespace", "call_count")} for r in spaces]
    items = [{"name": r["namespace"], "file": "", "entries": [r]} for r in shown]
    more = {"cross_dependencies": crossing} if a.show_dependencies else {}
    return {"items": [*items, *({"name": f"{d['from_namespace']} -> {d['to_namespace']}", "file": "", "entries": [d]} for d in crossing)], "clusters": shown, **more, "total_items": len(spaces), "depth": a.depth}


def _with_crossing(g: Graph, a: Any, project: str | None) -> DataFrame:
    """The namespaces, and with --show-dependencies the calls between them besides."""
    null = F.lit(None).cast("string")
    spaces = metrics.clusters(g, a.depth, a.module, project).withColumns({"from_namespace": null, "to_namespace": null, "call_count": F.lit(None).cast("bigint")})
    if not a.show_dependencies:
        return spaces.orderBy("namespace")
    return spaces.unionByName(metrics.cluster_dependencies(g, a.depth, a.module, project), allowMissingColumns=True).orderBy("namespace", "from_namespace", "to_namespace")


COMMANDS: dict[str, Command] = {
    "browse-module": Command("Everything defined in a module", lambda g, a, kw: lookup.browse_module(g, a.module, a.kind, a.name, **kw), (_MODULE, _arg("-k", "--kind", choices=["functions", "specs", "types", "structs"]), _arg("-n", "--name")), noun="definition"),
    "search": Command("Modules or functions by name", lambda g, a, kw: lookup.search_functions(g, a.pattern, **kw) if a.kind == "functions" else lookup.search_modules(g, a.pattern, **kw).withColumnRenamed("name", "module"), (_arg("pattern"), _arg("-k", "--kind", choices=["modules", "functions"], default="modules"))),
    "location": Command("Where a function is defined", lambda g, a, kw: lookup.find_locations(g, a.function, a.module, a.arity, **kw), (_FUNCTION, _MAYBE_MODULE, _ARITY), shape=_locations, noun="clause"),
    "function": Command("Signatures", lambda g, a, kw: lookup.find_functions(g, a.module, a.function, a.arity, **kw), (_MODULE, _FUNCTION, _ARITY), category="types"),
    "accepts": Command("Functions that take a type", lambda g, a, kw: lookup.find_accepts(g, a.pattern, a.module, **kw), (_arg("pattern"), _MAYBE_MODULE), category="types"),
    "returns": Command("Functions that return a type", lambda g, a, kw: lookup.find_returns(g, a.pattern, a.module, **kw), (_arg("pattern"), _MAYBE_MODULE), category="types"),
    "struct-usage": Command("Functions that take or return a type", lambda g, a, kw: lookup.struct_usage_by_module(lookup.find_struct_usage(g, a.pattern, a.module, **kw), a.pattern) if a.by_module else lookup.find_struct_usage(g, a.pattern, a.module, **kw), (_arg("pattern"), _MAYBE_MODULE, _arg("--by-module", action="store_true")), category="types"),
    "calls-from": Command("What functions call", lambda g, a, kw: calls.group_calls(calls.calls_from(g, a.module, a.function, a.arity, **kw), "caller", "callee"), (_MODULE, _MAYBE_FUNCTION, _arg("arity", nargs="?", type=int)), category="calls"),
    "calls-to": Command("What calls functions", lambda g, a, kw: calls.group_calls(calls.calls_to(g, a.module, a.function, a.arity, **kw), "callee", "caller"), (_MODULE, _MAYBE_FUNCTION, _arg("arity", nargs="?", type=int)), category="calls"),
    "depends-on": Command("Modules that a module calls", lambda g, a, kw: calls.depends_on(g, a.module, **kw), (_MODULE,), category="calls", shape=_depends_on, noun="call"),
    "depended-by": Command("Modules that call a module", lambda g, a, kw: calls.depended_by(g, a.module, **kw), (_MODULE,), category="calls", shape=_depended_by, noun="call"),
    "trace": Command("Calls reached from a function", lambda g, a, kw: traverse.trace_entries(traverse.trace_calls(g, a.module, a.function, a.arity, a.depth, **kw), a.module, a.function, a.depth).orderBy("entry_index"), (_MODULE, _FUNCTION, _ARITY, _DEPTH), category="calls", shape=_trace),
    "reverse-trace": Command("Calls that lead to a function", lambda g, a, kw: traverse.reverse_trace_entries(traverse.reverse_trace_calls(g, a.module, a.function, a.arity, a.depth, **kw), a.depth).orderBy("entry_index"), (_MODULE, _FUNCTION, _ARITY, _DEPTH), category="calls", shape=_trace),
    "path": Command(
        "Call paths between two functions",
        lambda g, a, kw: traverse.find_paths(g, a.from_module, a.from_function, a.to_module, a.to_function, a.from_arity, a.to_arity, a.depth, kw["project"], kw["limit"]),
        (*(_arg(f"--{e}-{x}", required=True) for e in ("from", "to") for x in ("module", "function")), _arg("--from-arity", type=int), _arg("--to-arity", type=int), _arg("--depth", type=_whole(1, traverse.DEPTH_MOST), default=traverse.PATH_DEPTH)),
        category="calls", shape=_paths, noun="path", with_regex=False,
    ),
    "unused": Command("Functions that nothing calls", lambda g, a, kw: metrics.unused(g, a.module, a.private_only, a.public_only, a.exclude_generated, **kw), (_MAYBE_MODULE, _arg("-p", "--private-only", action="store_true"), _arg("-P", "--public-only", action="store_true"), _arg("-x", "--exclude-generated", action="store_true")), category="analysis"),
    "duplicates": Command("Functions of equal code", lambda g, a, kw: (metrics.duplicates_by_module if a.by_module else lambda d: metrics.duplicate_members(d).orderBy("hash"))(metrics.duplicates(g, a.exact, a.module, a.exclude_generated, kw["project"], kw["regex"])), (_MAYBE_MODULE, _arg("--by-module", action="store_true"), _arg("--exact", action="store_true"), _NO_GENERATED), category="analysis", shape=_duplicates, noun="group"),
    "hotspots": Command("Functions by their calls", lambda g, a, kw: metrics.hotspots(g, a.kind, a.module, a.exclude_generated, **kw), (_MAYBE_MODULE, _arg("-k", "--kind", choices=["incoming", "outgoing", "total", "ratio"], default="incoming"), _NO_GENERATED), category="analysis"),
    "boundaries": Command("Modules with many callers and few callees", lambda g, a, kw: metrics.boundaries(g, a.min_incoming, a.min_ratio, a.module, **kw), (_MAYBE_MODULE, _arg("--min-incoming", type=int, default=1), _arg("--min-ratio", type=float, default=2.0)), category="analysis"),
    "god-modules": Command("Large modules with many calls", lambda g, a, kw: metrics.god_modules(g, a.min_functions, a.min_loc, a.min_total, a.module, **kw), (_MAYBE_MODULE, _arg("--min-functions", type=int, default=20), _arg("--min-loc", type=int, default=0), _arg("--min-total", type=int, default=10)), category="analysis"),
    "large-functions": Command("Functions of many lines", lambda g, a, kw: lookup.find_large_functions(g, a.min_lines, a.module, a.include_generated, **kw), (_MAYBE_MODULE, _arg("--min-lines", type=int, default=50), _GENERATED), category="analysis"),
    "many-clauses": Command("Functions of many clauses", lambda g, a, kw: metrics.many_clauses(g, a.min_clauses, a.module, a.include_generated, **kw), (_MAYBE_MODULE, _arg("--min-clauses", type=int, default=5), _GENERATED), category="analysis"),
    "complexity": Command("Functions by complexity", lambda g, a, kw: lookup.find_complexity(g, a.min, a.min_depth, a.module, a.exclude_generated, **kw), (_MAYBE_MODULE, _arg("--min", type=int, default=1), _arg("--min-depth", type=int, default=0), _NO_GENERATED), category="analysis"),
    "clusters": Command("Namespaces and their calls", lambda g, a, kw: _with_crossing(g, a, kw["project"]), (_MAYBE_MODULE, _arg("--depth", type=int, default=2), _arg("--show-dependencies", action="store_true")), category="modules", shape=_clusters, noun="namespace", with_regex=False),
    "cycles": Command("Cycles of modules", lambda g, a, kw: traverse.simple_cycles(g, a.max_length, a.involving, kw["project"], a.module).orderBy("length", "modules"), (_MAYBE_MODULE, _arg("--max-length", type=_whole(2, 1000)), _arg("--involving")), category="modules", shape=_cycles, noun="cycle", with_regex=False),
}


def describe(names: list[str]) -> str:
    """All commands by category, or those named; an unknown one is an error."""
    if unknown := [n for n in names if n not in COMMANDS]:
        raise KeyError(f"Unknown command: {unknown[0]}")
    lines = []
    for category in dict.fromkeys(c.category for c in COMMANDS.values()):
        mine = {n: c for n, c in COMMANDS.items() if c.category == category and (not names or n in names)}
        lines += [category, *(f"  {n}: {c.about}" for n, c in mine.items())] if mine else []
    return "\n".join(lines)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("callscape")
    p.add_argument("--store", help="folder of the tables")
    p.add_argument("--format", choices=["table", "json", "toon"], default="table")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("setup")
    s.add_argument("--dry-run", action="store_true")
    s.add_argument("--force", action="store_true", help="accepted; tables are never dropped")
    s = sub.add_parser("import")
    s.add_argument("--file", required=True)
    s.add_argument("--project", default="default")
    s.add_argument("--clear", action="store_true")
    s = sub.add_parser("describe")
    s.add_argument("names", nargs="*")
    for name, c in COMMANDS.items():
        s = sub.add_parser(name, help=c.about)
        for flags, kw in c.args:
            s.add_argument(*flags, **kw)
        s.add_argument("--project", default="default")
        if c.with_regex:
            s.add_argument("-r", "--regex", action="store_true")
        s.add_argument("-l", "--limit", type=_whole(1, 1000), default=lookup.LIMIT)
    return p


def _nested(c: Command, rows: list[dict], a: Any) -> dict:
    if c.shape:
        return c.shape(rows, a)
    return {"items": render.by_module(rows, c.group), "total_items": len(rows), "module_pattern": getattr(a, "module", None) or "*"}


def _known(argv: list[str]) -> None:
    """An error if the first word that is no option is no command."""
    words = iter(argv)
    for w in words:
        if w in ("--store", "--format"):
            next(words, None)
        elif not w.startswith("-"):
            if w not in COMMANDS and w not in ("setup", "import", "describe"):
                raise KeyError(f"Unknown command: {w}")
            return


def execute(spark: SparkSession, argv: list[str]) -> str:
    """The output of a command line."""
    _known(argv)
    a = parser().parse_args(argv)
    if a.command == "describe":
        return describe(a.names)
    store = Store(spark, resolve(a.store))
    if a.command == "setup":
        return render.as_json(store.setup(a.dry_run))
    if a.command == "import":
        counts = store.import_json(a.file, a.project, a.clear)
        return render.as_json({f"{k}_imported": v for k, v in counts.items()} | {"cleared": a.clear})
    c = COMMANDS[a.command]
    kw = {"project": a.project, "regex": getattr(a, "regex", False), "limit": a.limit}
    nested = _nested(c, render.rows_of(c.run(store.graph(), a, kw)), a)
    if a.format != "table" and c.shape and len(nested.keys() & {"entries", "paths", "cycles", "groups", "clusters"}):
        nested.pop("items")
    return render.render(f"{a.command}: {c.about}", nested, a.format, c.noun)


def main() -> int:
    spark = SparkSession.builder.appName("callscape").getOrCreate()
    try:
        print(execute(spark, sys.argv[1:]))
    except (KeyError, ValueError, OSError, RuntimeError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0
