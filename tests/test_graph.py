"""The code graph's queries on a small graph with known answers."""

from __future__ import annotations

import json

import pytest

from callscape.functions.predicates import InvalidPattern, validate
from callscape.operators import calls, lookup, metrics, traverse
from callscape.plans import commands, render
from callscape.schema import RELATIONS, Graph
from callscape.sources.ingest import FileReadFailed, JsonParseFailed
from callscape.sources.store import NotSetUp, Store
from callscape.streaming.imports import call_windows, import_stream
from conftest import rows
from sample import CLOCK, CRANE, DOCK, GATE, LEDGER, harbor, yard


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("store")
    (base / "in").mkdir()
    (base / "in" / "g.json").write_text(json.dumps(harbor(), indent=1))
    (base / "in" / "s.json").write_text(json.dumps(yard()))
    s = Store(spark, str(base / "db"))
    assert set(s.setup(dry_run=True).values()) == {"would_create"}
    assert set(s.setup().values()) == {"created"} and set(s.setup().values()) == {"exists"}
    counts = s.import_json(str(base / "in" / "g.json"), "default")
    assert counts == {"modules": 5, "functions": 3, "calls": 14, "struct_fields": 0, "function_locations": 16, "specs": 3, "types": 2}
    assert s.import_json(str(base / "in" / "s.json"), "shop")["struct_fields"] == 5
    return s


@pytest.fixture(scope="module")
def g(store):
    return Graph(**{n: df.where("project = 'default'").persist() for n, df in store.graph().relations().items()})


def n(df):
    return df.count()


def test_calls(g):
    assert n(calls.calls_from(g, GATE)) == 4 and n(calls.calls_from(g, GATE, "admit")) == 2
    assert n(calls.calls_from(g, r"Harbor\..*", regex=True)) == 13 and n(calls.calls_from(g, r"Harbor\..*", regex=True, limit=1)) == 1
    assert [n(calls.calls_to(g, CLOCK, *a)) for a in ((), ("now",), ("now", 0), ("now", 9))] == [3, 2, 2, 0]
    assert n(calls.calls_to(g, CLOCK, "now|wait", regex=True)) == 3 and n(calls.calls_to(g, CLOCK, limit=2)) == 2
    assert {r.callee_module for r in calls.depends_on(g, GATE).collect()} == {DOCK, CLOCK} and n(calls.depends_on(g, CLOCK)) == 0
    assert sorted(r.caller_module for r in calls.depended_by(g, LEDGER).collect()) == [CRANE, CRANE, DOCK]
    grouped = {(r.name, r.arity): len(r.calls) for r in calls.group_calls(calls.calls_to(g, CLOCK), "callee", "caller").collect()}
    assert grouped == {("now", 0): 2, ("wait", 1): 1}
    assert n(calls.module_calls(g)) == 9


def test_traversal(g):
    for depth, total in ((1, 2), (2, 3), (3, 3)):
        t = traverse.trace_calls(g, GATE, "open_bay", max_depth=depth)
        assert n(t) == total
        e = traverse.trace_entries(t, GATE, "open_bay", depth).orderBy("entry_index").collect()
        assert [(x.parent_index, x.function) for x in e] == [(None, "open_bay"), (0, "berth_free?"), (0, "now"), (1, "total")][: total + 1]
        assert {(x.kind, x.start_line, x.file) for x in e} == {("", 0, "")}
    # `berth` also leads on to the calls of `berth_free?`
    assert [n(traverse.trace_calls(g, GATE, "admit", max_depth=d)) for d in (1, 2, 3, 5)] == [2, 5, 8, 9]
    assert n(traverse.trace_entries(traverse.trace_calls(g, "None", "x"), "None", "x")) == 0
    assert [n(traverse.reverse_trace_calls(g, CLOCK, "now", max_depth=d)) for d in (1, 2, 3, 5)] == [2, 4, 5, 6]
    r = traverse.reverse_trace_entries(traverse.reverse_trace_calls(g, CLOCK, "now", max_depth=2), 2).orderBy("entry_index").collect()
    assert [(x.function, x.parent_index, x.kind) for x in r] == [("open_bay", None, "def"), ("enter", None, "def"), ("lift", 1, "def"), ("lower", 1, "def")] or sorted(x.parent_index is None for x in r) == [False, False, True, True]
    path = lambda a, f, b, t, **k: sorted(r.length for r in traverse.find_paths(g, a, f, b, t, **k).collect())
    assert path(GATE, "open_bay", DOCK, "berth_free?") == [1]
    assert path(GATE, "open_bay", LEDGER, "total", max_depth=4) == [2] and path(GATE, "open_bay", LEDGER, "total", max_depth=1) == []
    assert path(GATE, "admit", CRANE, "jib", max_depth=5) == [3] and path(GATE, "admit", CLOCK, "now", max_depth=6) == [4]
    assert path(GATE, "admit", DOCK, "berth", from_arity=99, max_depth=2) == [] and path(CLOCK, "now", GATE, "admit", max_depth=3) == []
    assert {(r.from_module, r.to_module) for r in traverse.cycle_edges(g).collect()} == {(DOCK, CRANE), (DOCK, LEDGER), (CRANE, LEDGER), (LEDGER, DOCK)}
    assert {tuple(r.modules) for r in traverse.simple_cycles(g).collect()} == {(DOCK, LEDGER), (CRANE, LEDGER, DOCK)}
    assert {tuple(r.modules) for r in traverse.simple_cycles(g, involving="Crane").collect()} == {(CRANE, LEDGER, DOCK)}
    assert {tuple(r.modules) for r in traverse.simple_cycles(g, 2).collect()} == {(DOCK, LEDGER)} and n(traverse.simple_cycles(g, module="Crane")) == 0


def test_analysis(g):
    names = lambda df: sorted(f"{r.name}/{r.arity}" for r in df.collect())
    assert names(metrics.unused(g)) == ["admit/2", "admit/2", "audit/0", "lower/2", "open_bay/1", "spare/1"]
    assert n(metrics.unused(g, GATE)) == 3 and n(metrics.unused(g, "Gate")) == 0 and n(metrics.unused(g, ".*Gate", regex=True)) == 3
    assert names(metrics.unused(g, private_only=True)) == ["spare/1"] and n(metrics.unused(g, public_only=True)) == 5 and n(metrics.unused(g, limit=1)) == 1
    hot = {r.function: (r.incoming, r.outgoing, r.ratio) for r in metrics.hotspots(g).collect()}
    never = 9999.0
    assert hot == {
        "berth_free?": (2, 1, 2.0), "now": (2, 0, never), "berth": (1, 2, 0.5), "refuse": (1, 0, never), "moor": (1, 1, 1.0), "lift": (1, 2, 0.5), "total": (1, 0, never),
        "wait": (1, 0, never), "jib": (1, 0, never), "enter": (2, 2, 1.0),
    }
    assert {(r.module, r.ratio) for r in metrics.boundaries(g, min_ratio=1.0).collect()} == {(DOCK, 2.0), (LEDGER, 1.0)}
    found = metrics.duplicates(g)
    assert names(found) == ["lift/2", "lower/2"] and n(metrics.duplicates(g, exact=True)) == 0
    assert [(r.hash, r.n_functions, [f.name for f in r.functions]) for r in metrics.duplicate_members(found).collect()] == [("aa11", 2, ["lift", "lower"])]
    assert [[r.loc for r in metrics.module_loc(g, m).collect()] for m in (CLOCK, GATE)] == [[8], [31]]
    assert {(r.module, r.total) for r in metrics.god_modules(g, 3, 0, 1).collect()} == {(GATE, 1), (DOCK, 8), (CRANE, 4), (LEDGER, 5)}
    assert n(lookup.find_complexity(g)) == 16 and names(lookup.find_complexity(g, 10)) == ["audit/0"] and n(lookup.find_complexity(g, limit=5)) == 5
    c = {r.namespace: (r.module_count, r.internal_calls, r.outgoing_calls, r.incoming_calls, round(r.cohesion, 4)) for r in metrics.clusters(g, 1).collect()}
    assert c == {"Harbor": (5, 6, 3, 0, 0.6667), "Tools": (1, 0, 0, 3, 0.0)}
    assert [(r.namespace, r.internal_calls, r.outgoing_calls) for r in metrics.clusters(g, 1, "Gate").collect()] == [("Harbor", 0, 2)]


def test_lookup(g, store):
    assert [n(lookup.find_locations(g, *a)) for a in (("admit", GATE, 2), ("berth",))] == [2, 1]
    assert n(lookup.find_locations(g, ".*berth.*", regex=True)) == 2 and n(lookup.find_locations(g, ".*", arity=0, regex=True)) == 3
    assert [n(lookup.browse_module(g, GATE, k)) for k in ("functions", "specs", "types", None)] == [4, 2, 2, 8]
    assert n(lookup.browse_module(g, GATE, "functions", "admit")) == 2
    assert n(lookup.browse_module(g, r"Harbor\..*", "functions", regex=True)) == 14 and n(lookup.browse_module(g, r"Harbor\..*", "functions", regex=True, limit=5)) == 5
    open_bay = lookup.browse_module(g, GATE, "functions", "open").first()
    assert (open_bay.start_line, open_bay.end_line, open_bay.args, open_bay.return_type, open_bay.fields) == (3, 9, "bay()", ":ok | {:error, :full}", None)
    ship = lookup.browse_module(store.graph(), "Yard.Ship", project="shop").collect()
    assert [(r.type, r.line, [(f.field, f.default_value, f.required) for f in r.fields]) for r in ship] == [("struct", 0, [("flag", ":none", False), ("name", "nil", True), ("tonnage", "0", False)])]
    assert n(lookup.group_fields(lookup.find_struct_fields(store.graph(), "Yard.Ship"))) == 1
    assert [r.args for r in lookup.find_functions(g, GATE, "open_bay").collect()] == ["bay()"]
    assert n(lookup.find_struct_usage(g, "bay")) == 0 and n(lookup.find_struct_usage(g, "bay()")) == 1
    usage = lookup.struct_usage_by_module(lookup.find_struct_usage(g, "Ship", regex=True), "Ship").collect()
    assert {(r.module, r.accepts_count, r.returns_count, r.total) for r in usage} == {(GATE, 1, 0, 1), (LEDGER, 1, 0, 1)}
    assert n(lookup.search_modules(g, ".*Harbor.*", regex=True)) == 4 and n(lookup.search_modules(g, "Gate")) == 0
    assert n(lookup.search_functions(g, "open_bay", project="nowhere")) == 0 and n(lookup.search_functions(g, "open_bay", project="default")) == 1


def test_patterns(g):
    with pytest.raises(InvalidPattern, match=r"Invalid regex pattern '\[invalid'"):
        lookup.search_modules(g, "[invalid", regex=True)
    assert n(lookup.search_modules(g, "[invalid")) == 0
    for p in (r"(?=a)", r"(a)\1", r"(?<!a)b", "a++"):
        with pytest.raises(InvalidPattern):
            validate(p, regex=True)
    validate(None, "a+", r"\d{2,3}", "[+]", r"\p{L}+", r"(?<word>a)", regex=True)
    with pytest.raises(InvalidPattern):
        validate("(?P<word>a)", regex=True)


def test_prefix_and_cycles(spark):
    """`get` also takes calls of `get_user` within its lines; callers may carry their arity; two cycles of one set are one."""
    loc = [("p", "A", "get", 1, 1, "", "", 0, "def", 1, 20, "", "", "h", "h", 1, 0, "", ""), ("p", "A", "get_user", 2, 5, "", "", 0, "def", 5, 8, "", "", "h", "h", 1, 0, "", ""), ("p", "B", "run", 0, 1, "", "", 0, "def", 1, 9, "", "", "k", "k", 1, 0, "x", "")]
    call = [("p", "A", "get_user/2", "B", "run", 0, "f", 6, 1, "remote", "", ""), ("p", "A", "get_user", "S", "%", 0, "f", 6, 2, "remote", "", ""), ("p", "B", "run", "A", "get", 1, "f", 2, 1, "remote", "", ""), ("p", "B", "<module>", "C", "x", 1, "f", 2, 1, "remote", "", ""), ("p", "C", "x", "A", "get", 1, "f", 2, 1, "remote", "", ""), ("p", "A", "get", "C", "x", 1, "f", 2, 1, "remote", "", ""), ("p", "C", "x", "B", "run", 0, "f", 2, 1, "remote", "", "")]
    g = Graph.empty(spark)
    g.function_locations = spark.createDataFrame(loc, RELATIONS["function_locations"].struct)
    g.calls = spark.createDataFrame(call, RELATIONS["calls"].struct)
    assert rows(calls.calls_from(g, "A").select("caller_name", "callee_function")) == [("get", "run"), ("get", "x"), ("get_user", "run")]
    assert rows(metrics.duplicates(g).select("name")) == [("get",), ("get_user",)]
    assert rows(metrics.duplicates(g, module="B")) == []
    hot = {r.function: (r.incoming, r.outgoing) for r in metrics.hotspots(g).collect()}
    assert hot == {"get": (2, 1), "run": (2, 1)}
    assert {tuple(r.modules) for r in traverse.simple_cycles(g).collect()} == {("A", "B"), ("A", "C"), ("B", "C"), ("A", "B", "C")}
    assert n(traverse.reachable(g)) == 12  # S is reached only
    # a ring of nine modules beside a tail, and two rings that share a module: cycles of any length, each once
    ring = [(f"R{i}", f"R{(i + 1) % 9}") for i in range(9)] + [("R3", "T1"), ("T1", "T2"), ("X", "Y"), ("Y", "X"), ("Y", "Z"), ("Z", "Y"), ("T2", "X")]
    g.calls = spark.createDataFrame([("q", a, "f", b, "f", 0, "f", 1, 1, "remote", "", "") for a, b in ring], RELATIONS["calls"].struct)
    found = {tuple(r.modules) for r in traverse.simple_cycles(g).collect()}
    assert found == {tuple(f"R{i}" for i in range(9)), ("X", "Y"), ("Y", "Z")}
    assert {tuple(r.modules) for r in traverse.simple_cycles(g, 5).collect()} == {("X", "Y"), ("Y", "Z")}
    assert {r.node: r.component for r in traverse.components(traverse._module_edges(g, None, None)).collect()} == {**{f"R{i}": "R8" for i in range(9)}, "X": "Z", "Y": "Z", "Z": "Z"}
    assert n(traverse.cycle_edges(g)) == 13
    g.calls = g.calls.limit(0)
    assert n(traverse.simple_cycles(g)) == n(traverse.reachable(g)) == n(traverse.cycle_edges(g)) == 0
    g.calls = spark.createDataFrame(call, RELATIONS["calls"].struct)
    t = traverse.trace_calls(g, "A", "get_user", max_depth=3)
    assert n(t.where("depth = 1")) == 1


def test_clauses_of_any_length(spark):
    """Calls meet short clauses by bucket of lines and very long ones too, each once; clauses that end before they begin hold none."""
    ends = [(1, 3), (250, 260), (255, 256), (256, 256), (1, 700), (1, 300_000), (1, 2**40), (5, 4), (300_000, 2**62)]
    loc = [("p", "M", "f", i, a, "", "", 0, "def", a, z, "", "", "", "", 1, 0, "", "") for i, (a, z) in enumerate(ends)]
    lines = [0, 1, 4, 255, 256, 257, 511, 512, 299_999, 300_000, 2**41]
    g = Graph.empty(spark)
    g.function_locations = spark.createDataFrame(loc, RELATIONS["function_locations"].struct)
    g.calls = spark.createDataFrame([("p", "M", "f/1", "N", "g", 0, "x", line, 1, "remote", "", "") for line in lines], RELATIONS["calls"].struct)
    want = sorted((line, i) for line in lines for i, (a, z) in enumerate(ends) if a <= line <= z)
    assert sorted((r.call_line, r.caller_arity) for r in calls.resolved_calls(g).collect()) == want


def test_import_errors(spark, store, tmp_path):
    with pytest.raises(FileReadFailed):
        store.import_json(str(tmp_path / "none.json"))
    (tmp_path / "bad.json").write_text("{not json")
    with pytest.raises(JsonParseFailed):
        store.import_json(str(tmp_path / "bad.json"))
    (tmp_path / "part.json").write_text('{"structs": {}}')
    with pytest.raises(JsonParseFailed):
        store.import_json(str(tmp_path / "part.json"))
    with pytest.raises(NotSetUp):
        Store(spark, str(tmp_path / "new")).table("calls")


def test_upsert_clear_and_stream(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    (tmp_path / "in").mkdir()
    d = harbor()
    (tmp_path / "in" / "a.json").write_text(json.dumps(d))
    import_stream(spark, str(tmp_path / "in"), s, "p", str(tmp_path / "cp")).awaitTermination()
    assert s.table("calls").count() == 14
    d["calls"] = d["calls"][:1]
    d["calls"][0]["type"] = "local"
    (tmp_path / "in" / "b.json").write_text(json.dumps(d))
    import_stream(spark, str(tmp_path / "in"), s, "p", str(tmp_path / "cp")).awaitTermination()
    assert s.table("calls").count() == 14 and s.table("calls").where("call_type = 'local' and line = 5 and callee_function = 'berth_free?'").count() == 1
    # names that are no plain folder names, and none that leads elsewhere
    for odd in ("a:b", "x/../p", "50%", "q"):
        s.import_json(str(tmp_path / "in" / "b.json"), odd)
    for gone in ("p", "a:b", "x/../p", "50%", "nowhere"):
        s.clear(gone)
        assert gone not in {r.project for r in s.table("calls").collect()}
    assert {r.project for r in s.table("calls").collect()} == {"q"} and s.table("calls").count() == 1


def test_last_row_of_the_last_file_stays(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    s.setup()
    rows_ = [("p", "M", "f", 1, "spec", i, "", "", "", file) for i, file in enumerate(["b", "a", "b", "a"])]
    s.upsert("specs", spark.createDataFrame(rows_, "project string, module string, name string, arity long, kind string, line long, inputs_string string, return_string string, full string, _file string").repartition(3))
    assert [r.line for r in s.table("specs").collect()] in ([0], [2])
    one = spark.createDataFrame([r[:-1] for r in rows_], RELATIONS["specs"].struct).coalesce(1)
    s.upsert("specs", one)
    assert [r.line for r in s.table("specs").collect()] == [3]


def test_call_windows(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/calls.parquet")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = call_windows(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), late="400 days").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    calls_ = src.where("callee_module is not null and callee_function is not null").select("call_id").distinct().count()
    assert spark.sql("select sum(n_calls) from windows").first()[0] == calls_


def test_commands(spark, store):
    run = lambda *a: commands.execute(spark, ["--store", store.folder, *a])
    as_json = lambda *a: json.loads(run("--format", "json", *a))
    shown = run("calls-to", CLOCK)
    assert "Found 2 functions:" in shown and "→ @ L7 Harbor.Gate.open_bay/1" in shown
    d = as_json("calls-to", CLOCK)
    assert d["total_items"] == 2 and d["items"][0]["name"] == CLOCK
    assert "No functions found." in run("unused", "Nope")
    assert "total_items: 1" in run("--format", "toon", "search", ".*Ledger", "-r")
    assert "trace" in run("describe") and as_json("trace", GATE, "open_bay")["total_items"] == 3
    assert [len(p["steps"]) for p in as_json("path", "--from-module", GATE, "--from-function", "admit", "--to-module", CRANE, "--to-function", "jib", "--depth", "4")["paths"]] == [3]
    d = as_json("depends-on", GATE)
    assert d["total_items"] == 3 and {m["name"]: [(f["name"], [c["name"] for c in f["callers"]]) for f in m["entries"]] for m in d["items"]} == {DOCK: [("berth", ["admit"]), ("berth_free?", ["open_bay"])], CLOCK: [("now", ["open_bay"])]}
    d = as_json("depended-by", LEDGER)
    assert {m["name"]: [(f["name"], f["start_line"], [c["name"] for c in f["targets"]]) for f in m["entries"]] for m in d["items"]} == {CRANE: [("lift", 2, ["enter"]), ("lower", 16, ["enter"])], DOCK: [("berth_free?", 20, ["total"])]}
    assert "← @ L13 Harbor.Gate.admit/2" in run("depends-on", GATE)
    d = as_json("location", "admit")
    assert d["total_functions"] == 1 and [c["line"] for c in d["items"][0]["entries"][0]["clauses"]] == [11, 26]
    d = as_json("duplicates")
    assert (d["total_groups"], d["total_duplicates"]) == (1, 2) and [f["name"] for f in d["groups"][0]["functions"]] == ["lift", "lower"]
    assert as_json("duplicates", "--by-module")["items"][0]["name"] == CRANE
    d = as_json("clusters", "--depth", "1", "--show-dependencies")
    assert [c["namespace"] for c in d["clusters"]] == ["Harbor", "Tools"] and d["cross_dependencies"] == [{"from_namespace": "Harbor", "to_namespace": "Tools", "call_count": 3}]
    assert "cross_dependencies" not in as_json("clusters", "--depth", "1") and as_json("cycles")["total_cycles"] == 2
    assert [e["type"] for m in as_json("browse-module", GATE)["items"] for e in m["entries"]].count("function") == 4
    for c in ("hotspots", "boundaries", "god-modules", "large-functions", "many-clauses", "complexity", "clusters", "cycles", "duplicates", "unused"):
        assert run(c)
    for argv in (("describe", "x"), ("x",), ("x", "--what")):
        with pytest.raises(KeyError, match="Unknown command: x"):
            run(*argv)
    for argv in (("calls-to", "A", "-l", "1001"), ("path", "-r"), ("trace", "A", "b", "--depth", "21")):
        with pytest.raises(SystemExit):
            run(*argv)


def test_toon():
    x = {"items": [{"name": "M.A", "entries": [{"name": "get_user", "arity": 1, "args": "integer()", "return_type": "U.t() | nil"}]}], "total_items": 1, "empty": "", "odd": "a,b", "none": None, "list": ["a", "b"]}
    assert render.toon(x).split("\n") == ['empty: ""', "items[1]:", "  - entries[1]{args,arity,name,return_type}:", "    integer(),1,get_user,U.t() | nil", "    name: M.A", "list[2]: a,b", "none: null", 'odd: "a,b"', "total_items: 1"]
    assert render.simplify_structs("f(%{__struct__: A.B, id: integer()}) :: %{__struct__: C, x: t()}") == "f(%A.B{}) :: %C{}"
    assert render.simplify_structs("%{__struct__: A, b: %{__struct__: B, x: {1, 2}}} | %{plain: 1}") == "%A{} | %{plain: 1}"
    assert render.simplify_structs("%{__struct__: A, never closed") == "%{__struct__: A, never closed" and render.simplify_structs("%{}") == "%{}"


def test_presentation():
    f = {"module": "M.A", "name": "get", "arity": 2, "kind": "def", "file": "lib/a.ex", "start_line": 5, "end_line": 9}
    assert render.call_line(f, 7, True, "M.A", "lib/a.ex") == "→ @ L7 get/2 [def] (L5:9)"
    assert render.call_line(f, 7, False, "M.B", "lib/b.ex") == "← @ L7 M.A.get/2 [def] (a.ex:L5:9)"
    assert render.call_line({"module": "M", "name": "x", "arity": 0}, 1, True, "M") == "→ @ L1 x/0"
    assert render.pretty_type("@type t() :: %{__struct__: A.B, id: integer(), m: map(a(), b())}") == "@type t() :: %A.B{\n  id: integer(),\n  m: map(a(), b())\n}"
    assert render.pretty_type("@type t() :: %{__struct__: A}") == "@type t() :: %A{}" and render.pretty_type("@type t() :: map()") == "@type t() :: map()"
