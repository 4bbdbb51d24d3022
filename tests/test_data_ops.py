"""The data-processing operators: against brute force on the test tables, and on rows with nulls, ties and repeats."""

from __future__ import annotations

import json
import random
from collections import Counter, defaultdict
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callscape.functions import cluster
from callscape.functions.cluster import cut_lineage, lag_in_periods, let_go, shared_folder, split_lookup
from callscape.functions.names import plain_arity, plain_function, plain_hex, plain_module
from callscape.operators import doubling, hierarchy, nested, orphans, schema_drift, snapshot_diff, tree_aggregate
from callscape.plans import data_queries
from conftest import rows

DATA = "/root/testdata/sf0.001"


def test_names(spark):
    df = spark.createDataFrame([("  Elixir.A.B ", "f!/2 ", None, "a, b"), (':"Elixir.A"', "%", 3, ""), (":slate", None, None, None), ("\tElixir.X", "g", None, "a")], "m string, f string, a long, x string")
    got = df.select(plain_module("m"), plain_function("f"), plain_arity("a", "f", "x")).collect()
    assert [tuple(r) for r in got] == [("A.B", "f!", 2), ("A", "%", 3), (":slate", None, None), ("X", "g", 1)]
    h = spark.createDataFrame([("00AB",), ("ab",), ("0xAB",), ("",), (None,), ("0",), (" ",)], "h string")
    assert [r[0] for r in h.select(plain_hex("h")).collect()] == ["ab", "ab", "ab", None, None, "0", None]


def test_lag_and_lookup(spark):
    r = random.Random(1)
    data = [(g, f"2024-0{1 + r.randrange(3)}-{1 + r.randrange(28):02d} {r.randrange(24):02d}:{r.randrange(60):02d}:00", i) for i, g in enumerate([*"aab" * 30, None])]
    data = list({(g, t): (g, t, i) for g, t, i in data}.values())
    df = spark.createDataFrame(data, "g string, t string, v long").withColumn("t", F.to_timestamp("t"))
    got = {x.v: x.p for x in lag_in_periods(df, ["g"], "t", "v", "p").collect()}
    want, last = {}, {}
    for g, _, v in sorted(data, key=lambda x: x[1]):
        want[v], last[g] = last.get(g), v
    assert got == want


@pytest.mark.parametrize("share", [1000, 3, 1])
def test_split_lookup(spark, monkeypatch, share):
    """Hot keys by broadcast, the others by shuffle: the same rows as a plain join, null keys included."""
    monkeypatch.setattr(cluster, "HOT_SHARE", share)
    big = spark.createDataFrame([(k, i) for i, k in enumerate([*"aaaaaaab" * 20, "c", None, None])], "g string, v long")
    small = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("z", 4)], "g string, w long")
    want = {"a": 1, "b": 2, None: 3}
    got = rows(split_lookup(big, small, ["g"]))
    assert got == sorted(((r.g, r.v, want[r.g]) for r in big.collect() if r.g in want), key=repr)
    assert rows(split_lookup(big, small, ["g"], "left")) == sorted(((r.g, r.v, want.get(r.g)) for r in big.collect()), key=repr)
    assert split_lookup(big.limit(0), small, ["g"]).count() == 0 and split_lookup(big, small.limit(0), ["g"], "left").count() == big.count()


def test_tables_in_the_shared_folder(spark):
    t = cut_lineage(spark.range(5).toDF("id"))
    place = Path(t._callscape_path.removeprefix("file:"))
    assert t.count() == 5 and place.exists() and t._callscape_path.startswith(shared_folder(spark))
    let_go(t, spark.range(1))
    assert not place.exists()

    class Cluster:
        """A session on a cluster that names no folder."""

        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(dict)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Cluster)


# 1: hierarchies


def _brute_tree(edges):
    up, nodes = {}, set()
    for s, p, c in edges:
        if c is not None:
            nodes.add((s, c))
            if p is not None:
                up[s, c] = min(up.get((s, c), p), p)
        if p is not None:
            nodes.add((s, p))
    out = {}
    for s, v in nodes:
        path, at = [v], v
        while (s, at) in up and up[s, at] not in path:
            at = up[s, at]
            path.append(at)
        if (s, at) not in up:
            out[s, v] = (at, len(path) - 1)
        else:
            out[s, v] = ("", -1 if up[s, at] == v else -2)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_random(spark, seed):
    r = random.Random(seed)
    edges = []
    for s in (1, 2, None):
        order = [f"n{i}" for i in range(40)]
        edges += [(s, order[r.randrange(i)] if r.random() < 0.5 else order[i - 1], order[i]) for i in range(1, 40) if r.random() < 0.95]
        edges += [(s, "n39", "n30")]
        edges += [(s, "self", "self"), (s, "self", "under"), (s, "l2", "l1"), (s, "l1", "l2"), (s, "l2", "b1"), (s, "b1", "b2"), (s, None, "alone"), (s, "top", None), (s, None, None)]
        edges = [e for e in edges if e[2] != "n30" or e[1] == "n39"]
    edges += edges[:20]
    df = spark.createDataFrame(edges, "s long, p string, c string").withColumn("node", F.lit("x")).withColumn("anc", F.lit(1))
    links = hierarchy.links(df, ["s"], F.col("p"), F.col("c"))
    want = _brute_tree(edges)
    got = hierarchy.hierarchy(links, ["s"], with_path=True).collect()
    assert {(x.s, x.node): (x.root, x.depth) for x in got} == want and len(got) == len(want)
    for x in got:
        assert (x.path is None) == (x.depth < 0) and (x.path is None or (x.path[0] == x.root and x.path[-1] == x.node and len(x.path) == x.depth + 1))
    below = hierarchy.descendants(hierarchy.hierarchy(links, ["s"], with_path=True), ["s"]).collect()
    assert len(below) == sum(d for _, d in want.values() if d > 0)


def test_descendants_on_and_below_loops(spark):
    edges = [(s, p, c) for s in (1, None) for p, c in (
        ("top", "mid"), ("mid", "low"), ("z", "x"), ("x", "y"), ("y", "z"), ("x", "t1"), ("t1", "t2"), ("t1", "t3"), ("t3", "t4"), ("z", "u1"), ("a", "b"), ("b", "a"), ("self", "self"), ("self", "under"), ("under", "deep"), ("lone", "lone"))]
    edges += [(2, "n4", "n0"), *((2, f"n{i}", f"n{i + 1}") for i in range(4)), (2, "n2", "leaf")]
    want = set()
    for s, node in _brute_tree(edges):
        depth, level, seen, n = _brute_tree(edges)[s, node][1], {node}, {node}, 0
        while level := {c for e, p, c in edges if e == s and p in level} - seen:
            n += 1
            seen |= level
            want |= {(s, node, depth, c, n) for c in level}
    df = spark.createDataFrame(edges + edges[:5], "s long, p string, c string")
    links = hierarchy.links(df, ["s"], F.col("p"), F.col("c"))
    got = rows(hierarchy.all_descendants(links, ["s"]))
    assert got == sorted(want, key=repr)
    assert {("t1", -2, "t4", 2), ("y", -1, "t4", 5), ("self", -1, "deep", 2), ("a", -1, "b", 1)} <= {g[1:] for g in got} and "lone" not in {g[1] for g in got}
    # the trees' pairs are those of descendants(), and no rows give no rows
    trees = rows(hierarchy.descendants(hierarchy.hierarchy(links, ["s"], with_path=True), ["s"]))
    assert trees == sorted(((s, n, d, k) for s, n, at, d, k in got if at >= 0), key=repr)
    assert hierarchy.all_descendants(links.limit(0), ["s"]).count() == 0


def test_other_parents(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "b", "x"), (1, "c", "x"), (2, "b", "x"), (1, None, "x"), (1, "a", "y"), (None, "q", "z"), (None, "p", "z")], "s long, p string, c string")
    ends = df, ["s"], F.col("p"), F.col("c")
    assert rows(hierarchy.other_parents(*ends)) == sorted([(1, "x", "a", "b"), (1, "x", "a", "c"), (None, "z", "p", "q")], key=repr)
    assert {(r.s, r.node): r.root for r in hierarchy.hierarchy(hierarchy.links(*ends), ["s"]).collect()}[1, "x"] == "a"


def test_hierarchy_of_a_star_and_long_loop(spark):
    """Many children of one node, and a loop longer than the deepest tree."""
    star = [("hub", f"s{i}") for i in range(500)] + [(f"s{i}", f"t{i}") for i in range(50)]
    loop = [(f"l{i}", f"l{(i + 1) % 37}") for i in range(37)] + [("l3", "b0"), *((f"b{i}", f"b{i + 1}") for i in range(20))]
    df = spark.createDataFrame([(1, *e) for e in star + loop], "s long, p string, c string")
    got = {r.node: (r.root, r.depth) for r in hierarchy.hierarchy(hierarchy.links(df, ["s"], F.col("p"), F.col("c")), ["s"]).collect()}
    assert got == {n: v for (_, n), v in _brute_tree([(1, *e) for e in star + loop]).items()}


def test_hierarchy_deep_chain_and_empty(spark):
    chain = spark.range(300).select(F.lit(1).alias("s"), F.col("id").cast("string").alias("p"), (F.col("id") + 1).cast("string").alias("c"))
    got = hierarchy.hierarchy(hierarchy.links(chain, ["s"], F.col("p"), F.col("c")), ["s"], with_path=True)
    assert sorted((r.depth, len(r.path)) for r in got.collect()) == [(i, i + 1) for i in range(301)]
    none = hierarchy.hierarchy(hierarchy.links(chain.limit(0), ["s"], F.col("p"), F.col("c")), ["s"], with_path=True)
    assert none.count() == 0


def _forests(seed, scopes):
    """Rows (scope, parent, child) of random forests of different sizes, some with loops, some rows repeated or of one end."""
    r, edges = random.Random(seed), []
    for s in scopes:
        n = r.choice((1, 2, 5, 40))
        edges += [(s, f"n{r.choice((max(0, i - 1), r.randrange(i + 1)))}", f"n{i}") for i in range(r.randrange(2), n)]
        edges += [(s, f"n{r.randrange(n)}", f"é{i}") for i in range(r.randrange(3))] + [(s, f"l{i}", f"l{(i + 1) % 3}") for i in range(r.choice((0, 0, 3)))]
        edges += [(s, "l1", "under"), (s, "under", f"n{n}")] + [(s, None, "alone"), (s, "top", None), (s, None, None)][: r.randrange(4)]
    return edges + edges[::7]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_doubling_in_batches(monkeypatch, size):
    """Scopes that go on over batches, are swept in several chunks, and whose paths are written in pieces."""
    monkeypatch.setattr(doubling, "CHUNK_SQUARES", 50)
    monkeypatch.setattr(doubling, "PATH_ENTRIES", 3)
    edges = sorted(_forests(size, [None, *range(60)]), key=lambda e: -1 if e[0] is None else e[0])
    rows_ = pa.RecordBatch.from_pydict({"s": pa.array([e[0] for e in edges], pa.int64()), "up": pa.array([e[1] for e in edges]), "node": pa.array([e[2] for e in edges])})
    batches = [rows_.slice(i, size) for i in range(0, len(edges), size)] + [rows_.slice(0, 0)]
    got = [x for b in doubling.sweep(iter(batches), ["s", "node", "root", "depth", "path"], True, -1, -2) for x in b.to_pylist()]
    want = _brute_tree(edges)
    assert {(x["s"], x["node"]): (x["root"], x["depth"]) for x in got} == want and len(got) == len(want)
    up = {(s, c): min(p for t, p, d in edges if (t, d) == (s, c) and p is not None) for s, p, c in edges if p is not None and c is not None}
    for x in got:
        path = x["path"]
        assert (path is None) if x["depth"] < 0 else path[0] == x["root"] and path[-1] == x["node"] and len(path) == x["depth"] + 1 and all(up[x["s"], b] == a for a, b in zip(path, path[1:]))
    assert not list(doubling.sweep(iter([]), ["s"], False, -1, -2))


def test_hierarchy_of_small_and_large_scopes(spark, monkeypatch):
    """Scopes of few rows are doubled within a task, those of many by joins; both come out, each node once."""
    edges = _forests(5, [None, *range(12)])
    sizes = Counter(s for s, _, _ in edges)
    monkeypatch.setattr(hierarchy, "SCOPE_ROWS", 20)
    assert max(sizes.values()) > 20 >= min(sizes.values())
    df = spark.createDataFrame(edges, "s long, p string, c string")
    got = hierarchy.hierarchy_of(df, ["s"], F.col("p"), F.col("c"), with_path=True).collect()
    want = _brute_tree(edges)
    assert {(x.s, x.node): (x.root, x.depth) for x in got} == want and len(got) == len(want)
    for x in got:
        assert (x.path is None) if x.depth < 0 else (x.path[0] == x.root and x.path[-1] == x.node and len(x.path) == x.depth + 1)
    for size in (0, 4096):
        monkeypatch.setattr(hierarchy, "SCOPE_ROWS", size)
        assert {(x.s, x.node): (x.root, x.depth) for x in hierarchy.hierarchy_of(df, ["s"], F.col("p"), F.col("c")).collect()} == want


def test_paths_of_small_traces_stay_in_their_task(spark, monkeypatch):
    """No table of paths or of nodes is written between the rounds of traces that fit a task (F1 of round 2)."""
    written = []
    monkeypatch.setattr(hierarchy, "cut_lineage", lambda df, *apart: written.append(df) or cut_lineage(df, *apart))
    found = data_queries.p1_found(spark, DATA)
    assert found.count() > 0 and all(not {"path", "node", "anc"} & {*df.columns} for df in written)
    assert sum(df.count() for df in written) == 0


# 2: schema drift


def _file(no, project, day, body, received=0):
    return (no, project, f"p/{no}.json", "1", f"2024-01-{day:02d} 00:00:00", f"2024-02-01 00:00:{received:02d}", body if isinstance(body, str) or body is None else json.dumps(body))


def _files(spark, data):
    df = spark.createDataFrame(data, "file_no long, project string, file_name string, extractor_version string, extracted_at string, received_at string, body string")
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("extracted_at", "received_at")}).withColumn("sig", F.lit(0)).withColumn("key", F.lit("k"))


def _locations(**fields):
    return {"function_locations": {"M": {"a/1:1": {"name": "a", "arity": 1, **fields}, "b/1:2": {"name": "b", "arity": 1}, "c": None}}}


def test_drift(spark):
    data = [
        _file(1, "p", 1, _locations(file="x/a.ex", complexity=3)),
        _file(5, "p", 2, _locations(src=["x", "a.ex"], complexity="3", nesting_depth=0.0) | {"specs": None}),
        _file(3, "p", 3, _locations(src={"root": "x", "rel": "a.ex"}, cc={"value": 3}, nesting_depth=None) | {"typespecs": [{"module": "M", "name": "a", "arity": 1, "clauses": [{"input_strings": ["t()", "u()"], "return_strings": ["v()"]}]}]}),
        _file(3, "p", 3, _locations(src={"root": "x", "rel": "a.ex"}, cc={"value": 3}) | {"typespecs": [{"module": "M", "name": "a", "arity": 1, "clauses": [{"input_strings": ["t()", "u()"], "return_strings": ["v()"]}]}]}, 9),
        _file(4, "p", 4, '{"cut": '),
        _file(6, "p", 5, _locations(cc={"value": 4}, src={"root": "x", "rel": "a.ex"}) | {"specs": {"M": []}}),
        _file(7, "q", 1, "[]"), _file(8, "q", 2, None), _file(9, "q", 3, {}), _file(10, "q", 4, _locations(path="z")), _file(11, None, 4, _locations(path="z")),
    ]
    got = rows(schema_drift.schema_changes(_files(spark, data)))
    assert got == sorted(
        [(5, "complexity", "retyped"), (5, "file", "renamed"), (5, "file", "retyped"), (5, "max_nesting_depth", "added"), (3, "file", "retyped"), (3, "complexity", "renamed"), (3, "complexity", "retyped"), (3, "max_nesting_depth", "removed"), (3, "specs", "added"), (6, "specs", "renamed"), (6, "specs", "retyped"), (10, "file", "added")],
        key=repr,
    )
    table = {(r.file_no, r.name): (r.file, r.complexity, r.max_nesting_depth) for r in schema_drift.consistent_locations(_files(spark, data)).collect()}
    assert table[1, "a"] == table[5, "a"] == table[3, "a"] == ("x/a.ex", 3, 0)
    assert table[1, "b"] == (None, 1, 0) and table[10, "a"] == ("z", 1, 0)
    assert [(r.module, r.inputs, r.returns) for r in schema_drift.consistent_specs(_files(spark, data)).collect()] == [("M", "t(), u()", "v()")]
    assert schema_drift.schema_changes(_files(spark, data).limit(0)).count() == 0
    versions = schema_drift.fingerprint_versions(_files(spark, data)).collect()
    assert sum(r.n_files for r in versions) == 7
    assert any("rename file src path; rename file path sourceFile; rename file sourceFile source_file; rename file source_file file; cast file object list; cast file list string" in r.steps for r in versions)


def test_specs_of_several_clauses(spark):
    clause = lambda a, r: {"full": f"f({a}) :: {r}", "input_strings": [a], "return_strings": [r]}
    f = {"name": "f", "arity": 1, "line": 2, "clauses": [clause("a()", ":ok"), None, clause("b()", ":no"), clause("b()", ":no")]}
    other = f | {"clauses": [clause("a()", ":ok"), None, clause("c()", ":no")]}
    body = {"specs": {"Elixir.M": [f, other, f], "N": {"name": "g", "clauses": clause("x", "y")}, "O": [{"name": "h", "clauses": []}, None, 3]}}
    one = [("f", 0, 0, "a()"), ("f", 0, 2, "b()"), ("f", 0, 3, "b()")]
    want = [*one, ("f", 1, 0, "a()"), ("f", 1, 2, "c()"), *((n, 2, c, i) for n, _, c, i in one), ("g", 0, 0, "x"), ("h", 0, -1, "")]
    got = schema_drift.consistent_specs(_files(spark, [_file(1, "p", 1, body), _file(1, "p", 1, body, 5)])).collect()
    assert sorted((r.name, r.spec_no, r.clause_no, r.inputs) for r in got) == want and {r.module for r in got} == {"M", "N", "O"}
    # a list of specs that name their modules gives the same
    listed = {"contracts": [{**f, "module": "Elixir.M"}, {"name": "g", "module": "N", "clauses": clause("x", "y")}, {**other, "module": "Elixir.M"}, {**f, "module": "Elixir.M"}, {"name": "h", "module": "O"}, 7]}
    again = schema_drift.consistent_specs(_files(spark, [_file(1, "p", 1, listed)])).collect()
    assert sorted(again) == sorted(got)


def test_newest_delivery_decides(spark):
    old, new = _locations(complexity=3, file="old"), _locations(complexity=9, file="new")
    spec = lambda n: {"specs": {"M": [{"name": n, "clauses": [{"full": n}]}]}}
    for data in ([_file(1, "p", 1, old | spec("a"), 1), _file(1, "p", 1, new | spec("b"), 2)], [_file(1, "p", 1, new | spec("b"), 2), _file(1, "p", 1, old | spec("a"), 1), _file(1, "p", 1, '{"cut', 9)]):
        files = _files(spark, data)
        assert {r.name: (r.file, r.complexity) for r in schema_drift.consistent_locations(files).collect()} == {"a": ("new", 9), "b": (None, 1)}
        assert [(r.name, r.full) for r in schema_drift.consistent_specs(files).collect()] == [("b", "b")]


def test_values_that_cannot_be_cast(spark):
    """No number ends the job or is lost: what cannot be cast is reported, and its field has the default."""
    raw = '{"function_locations": {"Elixir.M": {"a": {"name": "a", "arity": 99999999999999999999, "line": "x", "complexity": %s, "loc_cc": 5, "file": [1, null, "é"]}}}}'
    bad = ["1e999", "Infinity", "NaN", '"abc"', "99999999999999999999", '"1e400"', '{"value": null}', '{"value": [1]}', "[1]", "true", "1" + "0" * 400]
    good = {'"7"': 7, '"7.9"': 7, "-7.9": -7, '{"value": "8"}': 8, '{"value": 8.5}': 8, str(2**63 - 1): 2**63 - 1, '" 3 "': 3}
    files = _files(spark, [_file(i, "p", 1, raw % v) for i, v in enumerate([*bad, *good])])
    got = {r.file_no: r for r in schema_drift.consistent_locations(files).collect()}
    assert len(got) == len(bad) + len(good)
    for i, v in enumerate([*bad, *good]):
        r = got[i]
        assert (r.module, r.file, r.extra, r.arity, r.line) == ("M", "1/é", '{"loc_cc":5}', None, None)
        assert r.complexity == good.get(v, 1) and (r.uncast is None) == (v in good), v
    assert [(r.key, r.n_files, r.n_records) for r in schema_drift.unlisted_keys(files).collect()] == [("loc_cc", len(got), len(got))]
    assert schema_drift.schema_changes(files).count() >= 0
    # an older key beside a newer one is kept, and a record of its own kind goes through a chain of its own
    mixed = _locations(file="new", src="old", cc="4") | {"function_locations": {"M": {"a": {"name": "a", "file": "new", "src": "old"}, "b": {"name": "b", "cc": {"value": "4"}, "path": ["x", "y"]}, "c": {"name": "c", "file": None, "src": None, "sourceFile": "z"}}}}
    got = {r.name: (r.file, r.complexity, r.extra) for r in schema_drift.consistent_locations(_files(spark, [_file(1, "p", 1, mixed)])).collect()}
    assert got == {"a": ("new", 1, '{"src":"old"}'), "b": ("x/y", 4, None), "c": ("z", 1, None)}


def test_drift_table_against_brute_force(spark):
    files = data_queries.table(spark, DATA, "extract_files")
    seen = {}
    for r in files.collect():
        seen[r.file_no] = (r.project, r.extracted_at, json.loads(r.body))
    by = defaultdict(list)
    for no, (p, at, d) in seen.items():
        by[p].append((at, no, d))
    fields = {"file": {"file", "path", "sourceFile", "source_file", "src"}, "complexity": {"complexity", "cc", "cyclomatic", "cyclomatic_complexity"}, "max_nesting_depth": {"max_nesting_depth", "deepest_block", "maxNestingDepth", "nesting_depth"}}
    want = set()
    for files_ in by.values():
        before = None
        for _, no, d in sorted(files_, key=lambda x: x[:2]):
            sig = {}
            for m in d["function_locations"].values():
                for loc in m.values():
                    for f, keys in fields.items():
                        for k in keys & loc.keys():
                            if loc[k] is not None:
                                sig[f] = (k, type(loc[k]))
            for k in {"specs", "typespecs", "type_specs", "contracts"} & d.keys():
                if d[k] is not None:
                    sig["specs"] = (k, type(d[k]))
            for f in {*sig, *(before or {})} if before is not None else ():
                a, b = before.get(f), sig.get(f)
                if a is None or b is None:
                    want.add((no, f, "added" if a is None else "removed"))
                else:
                    want |= {(no, f, "renamed")} if a[0] != b[0] else set()
                    want |= {(no, f, "retyped")} if a[1] is not b[1] else set()
            before = sig
    assert rows(data_queries.p2_found(spark, DATA)) == sorted(want, key=repr)


# 3: nested records


def _graphs(spark, bodies):
    return spark.createDataFrame([(i, "p", f"2024-01-01 00:00:{j:02d}", b) for j, (i, b) in enumerate(bodies)], "graph_id long, project string, received_at string, body string").withColumn("received_at", F.col("received_at").cast("timestamp_ntz"))


def test_nested(spark):
    d = {
        "structs": {"S": {"fields": [{"field": "x"}, None, {"field": "y"}]}, "N": None, "E": {}, "O": {"fields": {"field": "z"}}},
        "function_locations": {"Elixir.M": {"a/1:2": {"name": "a"}, "b/1:2": None}, "Z": None},
        "calls": [],
        "specs": {"M": [None, {"name": "a", "arity": 1, "clauses": [None, {"full": "f", "input_strings": ["i", None, "i"], "return_strings": "r"}]}], "K": {"name": "k", "arity": 0, "clauses": {"full": "f", "return_strings": ["r", "s"]}}},
        "types": {"T": {"name": "t", "params": "p"}, "U": [{"name": "u", "params": ["q", "p"]}]},
    }
    want = sorted(
        [
            ("struct_field", "S", "x", 0, -1, -1), ("struct_field", "S", "y", 2, -1, -1), ("struct_field", "O", "z", 0, -1, -1), ("location", "M", "a/1:2", -1, -1, -1),
            ("spec", "M", "a/1", 1, -1, -1), ("clause", "M", "a/1", 1, 1, -1), ("input", "M", "a/1", 1, 1, 0), ("input", "M", "a/1", 1, 1, 2), ("result", "M", "a/1", 1, 1, 0),
            ("spec", "K", "k/0", 0, -1, -1), ("clause", "K", "k/0", 0, 0, -1), ("result", "K", "k/0", 0, 0, 0), ("result", "K", "k/0", 0, 0, 1),
            ("type", "T", "t", 0, -1, -1), ("param", "T", "t", 0, -1, 0), ("type", "U", "u", 0, -1, -1), ("param", "U", "u", 0, -1, 0), ("param", "U", "u", 0, -1, 1),
        ],
        key=repr,
    )
    text = json.dumps(d)
    shapes = [text, json.dumps([d], indent=3), json.dumps({"meta": {"specs": 2}, "graph": d}), json.dumps(text)]
    df = _graphs(spark, [*enumerate(shapes), (0, json.dumps(d, indent=1)), (9, text[:-5]), (10, "null"), (11, None), (12, "{}"), (13, text), (13, text[:50]), (None, text)])
    got = defaultdict(list)
    for r in nested.record_places(df).collect():
        got[r.graph_id].append(tuple(r)[1:])
    assert set(got) == {0, 1, 2, 3, 13}
    for found in got.values():
        assert sorted(found, key=repr) == want
    # equal subtrees are stored once, every occurrence has a bridge row, and a parent is a row of its graph
    o, b = (x.collect() for x in nested.store(df))
    assert sum(x.n_occurrences for x in o) == len(b) and len({x.node_hash for x in o}) == len(o) < len(b)
    at = {(x.graph_id, x.occ_no): x for x in b}
    for x in b:
        assert x.parent_no == -1 or at[x.graph_id, x.parent_no].node_hash == x.parent_hash
    assert {x.parent_kind for x in nested.flat_table(df, "input").collect()} == {"clause"}
    assert nested.record_places(df.limit(0)).count() == 0 and nested.bridge_table(df.limit(0)).count() == 0


def test_identity_is_that_of_the_subtree(spark):
    """Equal subtrees have one identity wherever they stand, and subtrees that differ anywhere have two."""
    f = {"name": "f", "arity": 1, "clauses": [{"full": "x", "input_strings": ["a", "b"], "return_strings": ["c"]}]}
    g = {"name": "g", "arity": 0}
    turned = {"clauses": [{"return_strings": ["c"], "full": "x", "input_strings": ["a", "b"]}], "arity": 1, "name": "f"}
    bodies = [{"specs": {"M": [f, g, f], "N": [g, turned]}}, {"specs": {"K": [None, None, f]}}]
    digests = {n.digest for b in bodies for n in nested.tree(b).children if n.place[1] == "f/1"}
    assert len(digests) == 1
    swapped = [{**f, "clauses": [{**f["clauses"][0], **c}]} for c in ({"input_strings": ["b", "a"]}, {"input_strings": ["a"]}, {"input_strings": ["a", "b", "c"], "return_strings": []}, {"full": "y"}, {"input_strings": ["a", None, "b"]})]
    swapped += [{**f, "clauses": f["clauses"] * 2}, {**f, "clauses": [None, *f["clauses"]]}, {**f, "name": "h"}]
    others = {n.digest for s in swapped for n in nested.tree({"specs": {"M": [s]}}).children}
    assert len(others) == len(swapped) and not others & digests
    assert nested.tree({"specs": {"M": [f], "N": [g]}}).digest == nested.tree({"specs": {"N": [g], "M": [f]}}).digest != nested.tree({"specs": {"M": [g], "N": [f]}}).digest
    # one object for the three in the table, half surrogates and very deep bodies included
    df = _graphs(spark, [*enumerate(map(json.dumps, bodies)), (7, '{"specs": {"M": [{"name": "\\ud800"}]}}'), (8, "[" * 100_000)])
    o, b = nested.store(df)
    assert [r.n_occurrences for r in o.where("record_kind = 'spec' and content like '%\"f\"%'").collect()] == [4]
    assert {r.graph_id for r in b.collect()} == {0, 1, 7}


# 4: hot keys


def test_tree_aggregate(spark):
    r = random.Random(3)
    data = [(r.choice(["hot"] * 8 + ["a", "b", None]), r.choice([None, *range(9)]), "x") for _ in range(3000)]
    df = spark.createDataFrame(data, "k string, v long, n string").repartition(7)
    aggs = {"n": ("count", F.lit(1)), "nv": ("count", F.col("v")), "s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}
    want = defaultdict(list)
    for k, v, _ in data:
        want[k].append(v)
    for fan_in in (2, 8):
        got = {x.k: (x.n, x.nv, x.s, x.lo, x.hi) for x in tree_aggregate.tree_aggregate(df, ["k"], aggs, fan_in).collect()}
        assert got == {k: (len(v), len([x for x in v if x is not None]), sum(x or 0 for x in v), min(x for x in v if x is not None), 8) for k, v in want.items()}
        for chunks in (1, 3, 70):
            cut = df.withColumn("_chunk", F.monotonically_increasing_id() % chunks)
            assert {x.k: x.n for x in tree_aggregate.tree_aggregate(cut, ["k"], aggs, fan_in, chunks).collect()} == {k: len(v) for k, v in want.items()}
    assert tree_aggregate.tree_aggregate(df.limit(0), ["k"], aggs).count() == 0


def test_heavy_pairs_edges(spark):
    data = [(1, "p", "A", "f"), (1, "p", "Elixir.A", "f/1"), (2, "p", "A", "%"), (3, "p", None, "f"), (4, "p", "A", None), (None, "p", "B", "f"), (5, None, "A", "f")]
    df = spark.createDataFrame(data, "call_id long, project string, callee_module string, callee_function string")
    assert rows(tree_aggregate.heavy_pairs(df)) == [("p", "A", "%"), ("p", "A", "f"), (None, "A", "f")] or rows(tree_aggregate.heavy_pairs(df)) == [(None, "A", "f"), ("p", "A", "%"), ("p", "A", "f")]
    calls = data_queries.table(spark, DATA, "calls")
    assert rows(tree_aggregate.heavy_pairs(calls, fan_in=2, chunk_rows=100)) == rows(tree_aggregate.heavy_pairs(calls))


# 5: orphans


def test_orphans(spark):
    t = lambda d: f"2024-01-{d:02d}"
    call = [(1, "A", "f", 1, t(5)), (2, "A", "f/2", None, t(5)), (3, " Elixir.A", "f", 1, t(1)), (4, "A", "f", 1, t(20)), (5, "A", "f", 1, t(10)), (6, "L", "x", 0, t(1)), (7, "L", "x", 9, t(1)), (8, "A", "%", 0, t(1)), (9, None, "f", 0, t(1)), (10, "A", None, 0, t(1)), (11, "A", "f", None, t(5)), (12, "A", "f", 1, None), (1, "A", "f", 1, t(5)), (None, "A", "q", 1, t(5))]
    loc = [("p", "A", "f", 1, t(3), t(8)), ("p", "A", "f", 1, t(3), t(8)), ("p", "A", "f", 1, t(15), None), ("q", "A", "f", 2, t(1), None), ("p", "A", "f", 3, None, None)]
    c = spark.createDataFrame([(i, "p", m, f, a, None, d) for i, m, f, a, d in call], "call_id long, project string, callee_module string, callee_function string, callee_arity long, callee_args string, extracted_at string")
    c = c.withColumn("extracted_at", F.col("extracted_at").cast("timestamp_ntz")).withColumn("name", F.lit(1))
    f = spark.createDataFrame(loc, "project string, module string, name string, arity long, loaded_at string, removed_at string")
    f = f.withColumns({x: F.col(x).cast("timestamp_ntz") for x in ("loaded_at", "removed_at")})
    lib = spark.createDataFrame([("L", "x", 0)], "module string, name string, arity long")
    found = orphans.orphan_calls(c, f, lib)
    assert rows(found.select("call_id", "reason")) == sorted([(2, "missing"), (3, "late"), (5, "deleted"), (7, "missing"), (11, "missing"), (12, "late")], key=repr)
    assert {(r.month, r.reason, r.n_rows) for r in orphans.orphan_counts(found, "calls").collect()} == {("2024-01", "missing", 3), ("2024-01", "late", 1), ("2024-01", "deleted", 1), (None, "late", 1)}
    assert orphans.orphan_calls(c.limit(0), f, lib).count() == 0
    assert orphans.orphan_calls(c, f.limit(0), lib.limit(0)).count() == 9


# 6: snapshots


def _snapshots(spark, data):
    df = spark.createDataFrame(data, "snapshot_no long, project string, module string, name string, arity long, clause_no long, start_line long, source_sha string, ast_sha string, loaded_at string")
    return df.withColumn("loaded_at", F.col("loaded_at").cast("timestamp_ntz")).withColumn("khash", F.lit(1)).withColumn("pos", F.lit(1))


def test_snapshots_random(spark):
    r = random.Random(5)
    data = []
    for p in ("p", "q"):
        for s in (1, 2, 4, 7):
            if p == "q" and s == 2:
                continue
            for k in range(150):
                if r.random() < 0.93:
                    sha = r.choice(["ab", "AB", "00ab"]) if r.random() < 0.97 else r.choice(["cd", "", None])
                    data.append((s, p, r.choice(["M", "Elixir.M", "M "]), f"f{k}", None if k % 50 == 0 else k % 3, 1, 5 if r.random() < 0.99 else None, sha, r.choice(["", None]), "2024-01-02"))
                    if r.random() < 0.1:
                        data.append((*data[-1][:6], 99, "ff", None, "2024-01-01"))
                    if r.random() < 0.1:
                        data.append(data[-1])
    df = _snapshots(spark, data)
    want = rows(snapshot_diff.changes_by_window(df))
    assert len(want) > 100 and len({w[-1] for w in want}) == 3
    for chunk, most in ((64, 1024), (4, 8), (1, 1), (1000, 3)):
        assert rows(snapshot_diff.snapshot_changes(df, chunk, most)) == want
    assert snapshot_diff.snapshot_changes(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows_in_batch", [7])
def test_snapshots_batches(spark, rows_in_batch):
    """Chunks that go on over batches give the same changes."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_in_batch)
    try:
        df = data_queries.table(spark, DATA, "location_snapshots")
        assert rows(snapshot_diff.snapshot_changes(df)) == rows(snapshot_diff.changes_by_window(df))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
