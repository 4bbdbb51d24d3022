"""Parent-child links to full hierarchies, by pointer doubling.

Every node starts with a pointer to its parent and a path segment, itself; each round replaces the pointer by that of the
node it points to and puts that node's segment before its own, so that the distance covered doubles and a tree of
depth d is resolved in about log2(d) rounds. Once a round resolves nothing, what is left leads into loops. From there on
the pointers alone are doubled, until the set of nodes pointed at no longer shrinks: then it is the nodes *on* loops.

No path leaves its scope, so all rounds of a scope of few rows run within a task (doubling.py), after one shuffle of the
links; only scopes of more rows than that are doubled by rounds of joins, in which every path moves once a round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscape.functions.cluster import cut_lineage, let_go, parts_of
from callscape.functions.names import plain_function, plain_module
from callscape.operators.doubling import sweep

ON_LOOP, BELOW_LOOP = -1, -2
#: Scopes of more rows than this are doubled by joins; all paths of one of as many have 8 million entries at most.
SCOPE_ROWS = 4096


def links(df: DataFrame, scope: Sequence[str], parent: Column, child: Column) -> DataFrame:
    """One row (scope, node, up) per node; up is null for a root.

    A link with a null end only makes its other end a node. Repeated links count once; of several parents the
    smallest is followed, and other_parents() reports the others. Both ends come from one scan and one shuffle.
    """
    both = df.select(*scope, F.explode(F.array(F.struct(child.alias("node"), parent.alias("up")), F.struct(parent.alias("node"), F.lit(None).cast("string").alias("up")))).alias("_e"))
    return both.select(*scope, "_e.node", "_e.up").where(F.col("node").isNotNull()).groupBy(*scope, "node").agg(F.min("up").alias("up"))


def other_parents(df: DataFrame, scope: Sequence[str], parent: Column, child: Column) -> DataFrame:
    """(scope, node, followed, other): the links that links() does not follow, as their node has a smaller parent too."""
    pairs = df.select(*scope, child.alias("node"), parent.alias("other")).where("node is not null and other is not null").distinct()
    several = pairs.groupBy(*scope, "node").agg(F.min("other").alias("followed"), F.max("other").alias("_last")).where("followed <> _last").drop("_last")
    on = [F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*scope, "node"]]
    found = pairs.alias("p").join(several.alias("s"), on).where("p.other <> s.followed")
    return found.select(*[F.col(f"p.{s}") for s in scope], "p.node", "s.followed", "p.other")


def _resolve(nodes: DataFrame, scope: Sequence[str], names: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The nodes with an id each, and of these ids (id, root, path) in trees and (id, depth) on and below loops.

    A path consists of ids, or of names. Rows that are resolved stay in the table of their round and only serve as
    what others point to.
    """
    numbered = cut_lineage(nodes.select(*scope, "node", "up").withColumn("id", F.monotonically_increasing_id()))
    me, above = (F.col("a.node"), F.col("b.node")) if names else (F.col("a.id"), F.col("b.id"))
    is_root, under_root = F.col("a.up").isNull(), F.col("a.up").isNotNull() & F.col("b.up").isNull()
    up = numbered.alias("a").join(numbered.alias("b"), [*[F.col(f"a.{s}").eqNullSafe(F.col(f"b.{s}")) for s in scope], F.col("a.up") == F.col("b.node")], "left")
    last = cut_lineage(up.select(
        "a.id", F.coalesce("b.id", "a.id").alias("anc"), F.when(is_root, F.col("a.node")).when(under_root, F.col("b.node")).alias("root"),
        F.when(under_root, F.array(above, me)).otherwise(F.array(me)).alias("path"), (is_root | under_root).alias("done"),
    ), "done")
    done: list[DataFrame] = []
    while True:
        counts = {r["done"]: r["count"] for r in last.groupBy("done").count().collect()}
        if True in counts:
            done.append(last)
        if False not in counts or True not in counts:
            break
        open_ = parts_of([last], "done=false")
        known = parts_of(done, "done=true").withColumn("done", F.lit(True)).unionByName(open_.withColumn("done", F.lit(False)))
        step = open_.alias("a").join(known.alias("b"), F.col("a.anc") == F.col("b.id"))
        last = cut_lineage(step.select("a.id", "b.anc", "b.root", F.concat("b.path", "a.path").alias("path"), "b.done"), "done")
    trees = parts_of(done, "done=true").select("id", "root", "path") if done else last.where("done").select("id", "root", "path")
    return numbered, trees, _looped(parts_of([last], "done=false").select("id", "anc")) if False in counts else None


def _looped(left: DataFrame) -> DataFrame:
    """(id, depth) of nodes whose pointers (id, anc) never leave them: ON_LOOP or BELOW_LOOP.

    The nodes that pointers of a distance lead to are among those of any shorter one. If they are as many at the
    double distance, a further step keeps them all, so each of them is on a loop.
    """
    reached = left.select("anc").distinct().count()
    while True:
        further = cut_lineage(left.alias("a").join(left.alias("b"), F.col("a.anc") == F.col("b.id")).select("a.id", "b.anc"))
        now = further.select("anc").distinct().count()
        let_go(left)
        left = further
        if now == reached:
            break
        reached = now
    on = left.select(F.col("anc").alias("id"), F.lit(True).alias("on")).distinct()
    return left.join(on, "id", "left").select("id", F.when(F.col("on"), ON_LOOP).otherwise(BELOW_LOOP).cast("bigint").alias("depth"))


def hierarchy(nodes: DataFrame, scope: Sequence[str], with_path: bool = False) -> DataFrame:
    """(scope, node, root, depth) of every node of links(); with_path adds path, the nodes' names from the root down.

    A root has depth 0. A node on a loop (its own parent included) has root '' and depth -1, a node below a loop
    root '' and depth -2; their path is null. No rows give no rows. Paths are built either way, as the depth is
    their length; without with_path they hold ids.
    """
    return hierarchy_of(nodes, scope, F.col("up"), F.col("node"), with_path)


def hierarchy_of(df: DataFrame, scope: Sequence[str], parent: Column, child: Column, with_path: bool = False) -> DataFrame:
    """hierarchy() of the nodes that links() finds in df, which is read twice: first only its scopes, to count their rows."""
    rows = df.select(*scope, parent.alias("up"), child.alias("node"))
    if not scope:
        return _by_joins(links(rows, scope, F.col("up"), F.col("node")), scope, with_path)
    large = cut_lineage(rows.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SCOPE_ROWS).select(*scope))
    if large.isEmpty():
        return _by_scope(rows, scope, with_path)
    is_large = [F.col(f"r.{s}").eqNullSafe(F.col(f"l.{s}")) for s in scope]
    few, many = (rows.alias("r").join(F.broadcast(large.alias("l")), is_large, how) for how in ("left_anti", "left_semi"))
    return _by_scope(few, scope, with_path).unionByName(_by_joins(links(many, scope, F.col("up"), F.col("node")), scope, with_path))


def _by_scope(rows: DataFrame, scope: Sequence[str], with_path: bool) -> DataFrame:
    """hierarchy() of rows (scope, up, node), all of a scope in one task."""
    kinds = [("node", T.StringType()), ("root", T.StringType()), ("depth", T.LongType()), *([("path", T.ArrayType(T.StringType()))] if with_path else [])]
    shape = T.StructType([*[rows.schema[s] for s in scope], *[T.StructField(*k) for k in kinds]])
    names = shape.names
    return rows.repartition(*scope).sortWithinPartitions(*scope).mapInArrow(lambda batches: sweep(batches, names, with_path, ON_LOOP, BELOW_LOOP), shape)


def _by_joins(nodes: DataFrame, scope: Sequence[str], with_path: bool) -> DataFrame:
    """hierarchy() by rounds of joins."""
    numbered, trees, loops = _resolve(nodes, scope, with_path)
    found = trees.select("id", "root", (F.size("path") - 1).cast("bigint").alias("depth"), *(["path"] if with_path else []))
    if loops is not None:
        found = found.unionByName(loops.select("id", F.lit("").alias("root"), "depth", *([F.lit(None).cast("array<string>").alias("path")] if with_path else [])))
    return numbered.join(found, "id").select(*scope, "node", "root", "depth", *(["path"] if with_path else []))


def descendants(paths: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, node, descendant, distance): every pair of a node of a tree and one below it, from hierarchy(with_path=True).

    Nodes on and below loops are left out here; all_descendants() has them as well.
    """
    return _pairs(paths, scope).drop("at")


def _pairs(paths: DataFrame, scope: Sequence[str]) -> DataFrame:
    """descendants() with at, the depth of node."""
    up = paths.where(F.col("depth") > 0).select(*scope, F.col("node").alias("descendant"), "depth", F.posexplode(F.slice("path", 1, F.col("depth").cast("int"))).alias("at", "node"))
    return up.select(*scope, "node", "descendant", (F.col("depth") - F.col("at")).cast("bigint").alias("distance"), F.col("at").cast("bigint").alias("at"))


def all_descendants(nodes: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, node, depth, descendant, distance): every pair of a node of links() and one below it, loops included.

    depth is the node's in hierarchy(), so -1 and -2 tell nodes on and below loops apart. A node below a loop has the
    tree under it. A node on a loop has all other nodes of the loop and the trees under all of them, each once, at the
    fewest links that lead down to it; it is not its own descendant, so that a loop of one node without children has
    none.
    """
    nodes = cut_lineage(nodes)
    known = cut_lineage(hierarchy(nodes, scope, with_path=True))
    of = lambda a, b, *k: [F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{x}")) for x in [*scope, *k]]
    pairs = _pairs(known, scope).withColumnRenamed("at", "depth")
    rest = cut_lineage(nodes.alias("n").join(known.where("depth < 0").alias("k"), of("n", "k", "node")).select("n.*", "k.depth"))
    # every node of a loop is the root of what hangs under it alone
    trees = rest.select(*scope, "node", F.when(F.col("depth") == BELOW_LOOP, F.col("up")).alias("up"))
    trees = cut_lineage(hierarchy(trees, scope, with_path=True))
    under = _pairs(trees, scope).withColumn("at", F.when(F.col("at") == 0, ON_LOOP).otherwise(BELOW_LOOP).cast("bigint")).withColumnRenamed("at", "depth")
    # and what hangs under one is also below the loop's other nodes, farther by the way round to it
    place = _loop_places(rest.where(F.col("depth") == ON_LOOP), scope)
    below = trees.alias("t").join(place.alias("b"), [*of("t", "b"), F.col("t.root") == F.col("b.node")]).select(*[F.col(f"t.{x}") for x in scope], "b.loop", "b.place", F.col("t.node").alias("descendant"), F.col("t.depth").alias("under"))
    round_ = place.alias("a").join(below.alias("d"), [*of("a", "d", "loop"), F.col("a.place") != F.col("d.place")])
    round_ = round_.select(
        *[F.col(f"a.{x}") for x in scope], "a.node", "d.descendant", (F.pmod(F.col("d.place") - F.col("a.place"), F.col("a.size")) + F.col("d.under")).alias("distance"), F.lit(ON_LOOP).cast("bigint").alias("depth")
    )
    return pairs.unionByName(under).unionByName(round_).select(*scope, "node", "depth", "descendant", "distance")


def _loop_places(nodes: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, node, loop, place, size) of nodes (scope, node, up) that are all on loops.

    A loop is named by its smallest node, found by pointer doubling; opened there it is a chain, and a node's place is
    its depth in it.
    """
    state = cut_lineage(nodes.select(*scope, "node", F.col("up").alias("anc"), F.least("node", "up").alias("loop")))
    most = state.groupBy(*scope).count().agg(F.max("count")).first()[0] or 0
    seen = 1
    while seen < most:
        at = [F.col(f"a.{s}").eqNullSafe(F.col(f"b.{s}")) for s in scope]
        step = state.alias("a").join(state.alias("b"), [*at, F.col("a.anc") == F.col("b.node")])
        state = cut_lineage(step.select(*[F.col(f"a.{s}") for s in scope], "a.node", "b.anc", F.least("a.loop", "b.loop").alias("loop")))
        seen *= 2
    on = [F.col(f"n.{k}").eqNullSafe(F.col(f"l.{k}")) for k in [*scope, "node"]]
    chain = nodes.alias("n").join(state.alias("l"), on).select("n.*", "l.loop").select(*scope, "node", F.when(F.col("node") != F.col("loop"), F.col("up")).alias("up"))
    placed = cut_lineage(hierarchy(chain, scope)).select(*scope, "node", F.col("root").alias("loop"), F.col("depth").alias("place"))
    size = placed.groupBy(*scope, "loop").agg(F.count(F.lit(1)).alias("size"))
    on = [F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*scope, "loop"]]
    return placed.alias("p").join(size.alias("s"), on).select("p.*", "s.size")


def path_step_ends(steps: DataFrame) -> tuple[DataFrame, list[str], Column, Column]:
    """What links() takes, of PathStep rows: the callee hangs under the caller, and a node belongs to its trace."""
    parent = F.concat(plain_module("caller_module"), F.lit("."), plain_function("caller_function"))
    child = F.concat(plain_module("callee_module"), F.lit("."), plain_function("callee_function"))
    return steps, ["trace_id"], parent, child


def path_step_links(steps: DataFrame) -> DataFrame:
    """links() of PathStep rows."""
    return links(*path_step_ends(steps))
