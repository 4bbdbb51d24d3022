"""Filling fixed-capacity containers with items, by bulk-synchronous best fit.

Items of one size are alike, and so are containers with equal gaps; both are held as runs (value, first number, how many),
sorted by value and cut into ranges of values. In each round every gap takes at most one item, the largest that fits
and that no smaller gap has taken (its predecessor in the common order of items and gaps, once matched pairs are taken
out). Each range is swept for itself, in a task of its own. What a range leaves over is a row of gaps that found
nothing below them and a stack of items that nothing above them took; only how many of each is told to the driver, which
carries the stacks over the ranges' borders: ever so many units of one range's stack go to ever so many of a later
range's gaps, unit by unit in order of rank, and these transfers are again carried out in tasks of their own. Then
gaps are updated, and the next round begins. If a round matches nothing, new containers are opened, as gaps of the
whole capacity.

Runs are bounded by the capacity and the rounds, however many documents there are. The documents never move in rounds:
each finds its place in the end by its rank among the items of its size, ranked in parts of a size, so that a size that a
third of all texts share is spread as well.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callscape.functions.cluster import cut_lineage, parts_of

#: Items of one rank part, about; a part is ranked in one task.
PART_ROWS = 50_000
#: Ranges of values that are swept apart.
RANGES = 16
#: A run: tag (item, gap, gap that is new in this round, move), task, range, value, first rank or container, how many, and the place among what the range leaves over (of a move, its first container).
_RUN = "tag string, task bigint, part bigint, v bigint, start bigint, n bigint, at bigint"
_COLUMNS = [c.split()[0] for c in _RUN.split(", ")]


def _frame(rows: Iterable[tuple]) -> pd.DataFrame:
    rows = list(rows)
    df = pd.DataFrame(rows, columns=_COLUMNS)
    return df.astype({c: "int64" for c in _COLUMNS[1:]}) if rows else df.astype({c: "int64" for c in _COLUMNS[1:]} | {"tag": "object"})


def sweep(runs: Iterable[tuple]) -> list[tuple]:
    """One range after its sweep: (tag, v, start, n, at) of moves, new gaps, gaps and items left over.

    runs are (tag, v, start, n, at) of one task and range; moves among them are passed on. Gaps left over are placed
    in ascending order, items left over from the top of the stack (the largest) down.
    """
    out, stack, unmet, place = [], [], [], 0
    order = {"item": 0, "gap": 1, "new": 1, "move": 2}
    for tag, v, start, n, at in sorted(runs, key=lambda r: (r[1], order[r[0]], r[2])):
        if tag == "move":
            out.append((tag, v, start, n, at))
        elif tag == "item":
            stack.append([v, start, n])
        else:
            while n and stack:
                size, rank, have = top = stack[-1]
                k = min(n, have)
                out.append(("move", size, rank, k, start))
                if v > size:
                    out.append(("new", v - size, start, k, 0))
                start, n, top[1], top[2] = start + k, n - k, rank + k, have - k
                if not top[2]:
                    stack.pop()
            if n:
                unmet.append(("gap", v, start, n, place))
                place += n
    place = 0
    for v, start, n in reversed(stack):
        out.append(("item", v, start, n, place))
        place += n
    return out + unmet


def transfer(items: Iterable[tuple], gaps: Iterable[tuple]) -> list[tuple]:
    """The moves and new gaps (tag, v, start, n, at) of as many items as gaps, both (place, v, start, n): the k-th item goes to the k-th gap."""
    out, gaps = [], [list(g) for g in sorted(gaps, reverse=True)]
    for _, size, rank, n in sorted(items):
        while n:
            _, gap, box, have = top = gaps[-1]
            k = min(n, have)
            out.append(("move", size, rank, k, box))
            if gap > size:
                out.append(("new", gap - size, box, k, 0))
            rank, n, top[2], top[3] = rank + k, n - k, box + k, have - k
            if not top[3]:
                gaps.pop()
    return out


def carry(left: Sequence[tuple[int, int, int]]) -> tuple[list[tuple], int]:
    """Which stretches of the ranges' leftovers go together, and how many units they are.

    left: (range, items left over, gaps left over) of one task, by range. Out come (tag, range, from, to, number) of all
    stretches; the number is that of the transfer, or -1 for units that stay.
    """
    stack: list[list[int]] = []
    out, number, moved = [], 0, 0
    for part, items, gaps in left:
        done = 0
        while done < gaps and stack:
            below = stack[-1]
            k = min(gaps - done, below[2] - below[1])
            out += [("item", below[0], below[1], below[1] + k, number), ("gap", part, done, done + k, number)]
            number, moved, done, below[1] = number + 1, moved + k, done + k, below[1] + k
            if below[1] == below[2]:
                stack.pop()
        if done < gaps:
            out.append(("gap", part, done, gaps, -1))
        if items:
            stack.append([part, 0, items])
    return out + [("item", part, begin, end, -1) for part, begin, end in stack], moved


class _Rounds:
    """The rounds of all tasks together; capacities by number of the task."""

    def __init__(self, spark: SparkSession, capacities: Sequence[int], ranges: int) -> None:
        self.spark, self.capacities, self.ranges, self.opened = spark, capacities, ranges, [0] * len(capacities)

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _of_task(self, values: Sequence[int]) -> F.Column:
        return F.element_at(F.array(*[F.lit(v).cast("bigint") for v in values]), (F.col("task") + 1).cast("int"))

    def open(self, task: int, n: int) -> list[tuple]:
        """A run of n new containers."""
        first, self.opened[task] = self.opened[task], self.opened[task] + n
        return [("gap", task, 0, self.capacities[task], first, n, 0)] if n else []

    def swept(self, runs: DataFrame) -> DataFrame:
        """A round's first part, written down: every range swept for itself."""
        part = F.expr(f"v * {self.ranges}") / (self._of_task(self.capacities) + 1)
        ranged = runs.withColumn("part", F.floor(part).cast("bigint"))

        def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            rows = sweep(zip(*(pdf[c].tolist() for c in ("tag", "v", "start", "n", "at")), strict=True))
            return _frame((tag, int(key[0]), int(key[1]), *rest) for tag, *rest in rows)

        return cut_lineage(ranged.groupBy("task", "part").applyInPandas(one, _RUN), "tag")

    def carried(self, left: DataFrame, stretches: list[tuple], least: Sequence[int]) -> DataFrame:
        """A round's second part: the runs of the next one. Gaps below the least open item are of no more use."""
        some = F.broadcast(self._rows(stretches, "tag string, task bigint, part bigint, lo bigint, hi bigint, number bigint"))
        left = left.where((F.col("tag") == "item") | (F.col("v") >= self._of_task(least)))
        fresh = left.where("tag = 'new'").select(*_COLUMNS)
        cut = left.where("tag <> 'new'").join(some, ["tag", "task", "part"]).where("at < hi and at + n > lo")
        cut = cut.withColumns({"_lo": F.greatest("at", "lo"), "_hi": F.least(F.col("at") + F.col("n"), "hi")})
        cut = cut.select("tag", "task", "part", "v", (F.col("start") + F.col("_lo") - F.col("at")).alias("start"), (F.col("_hi") - F.col("_lo")).alias("n"), (F.col("_lo") - F.col("lo")).alias("at"), "number")
        stay = cut.where("number < 0").select(*_COLUMNS)

        def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            of = lambda tag: zip(*(pdf.loc[pdf["tag"] == tag, c].tolist() for c in ("at", "v", "start", "n")), strict=True)
            return _frame((tag, int(key[0]), 0, *rest) for tag, *rest in transfer(of("item"), of("gap")))

        return fresh.unionByName(stay).unionByName(cut.where("number >= 0").groupBy("task", "number").applyInPandas(one, _RUN))

    def run(self, counts: DataFrame) -> DataFrame:
        """(task, size, rank, n, container): items of a range of ranks go to containers of consecutive numbers. counts: (task, v, n)."""
        tasks = range(len(self.capacities))
        items = counts.select(F.lit("item").alias("tag"), "task", F.lit(0).cast("bigint").alias("part"), "v", F.lit(0).cast("bigint").alias("start"), "n", F.lit(0).cast("bigint").alias("at"))
        big = F.sum(F.when(F.col("v") * 2 > self._of_task(self.capacities), F.col("n")).otherwise(0))
        # no two items above half the capacity share a container; others come into what these leave, and then into new ones
        big = {r["task"]: r["big"] for r in counts.groupBy("task").agg(big.alias("big")).collect()}
        begin = [run for t, n in big.items() for run in self.open(t, n)]
        tables = [self.swept(items.unionByName(self._rows(begin, _RUN)) if begin else items)] if big else []
        matched = []
        while tables:
            table = tables[-1]
            left = table.where("tag <> 'move'")
            found = table.groupBy("tag", "task", "part").agg(F.sum("n").alias("n"), F.sum(F.col("v") * F.col("n")).alias("total"), F.min("v").alias("least")).collect()
            moves = {r["task"] for r in found if r["tag"] == "move"}
            if moves:
                matched.append(table)
            stretches, more, least = [], [], [2**62] * len(tasks)
            for t in tasks:
                items = {r["part"]: r for r in found if r["task"] == t and r["tag"] == "item"}
                gaps = {r["part"]: r["n"] for r in found if r["task"] == t and r["tag"] == "gap"}
                if not items:
                    continue
                least[t] = min(r["least"] for r in items.values())
                parts, moved = carry([(p, items[p]["n"] if p in items else 0, gaps.get(p, 0)) for p in sorted({*items, *gaps})])
                stretches += [(tag, t, *rest) for tag, *rest in parts]
                if not moved and t not in moves:
                    more += self.open(t, -(-sum(r["total"] for r in items.values()) // self.capacities[t]))
            if not stretches:
                break
            state = self.carried(left, stretches, least)
            tables.append(self.swept(state.unionByName(self._rows(more, _RUN)) if more else state))
        if not matched:
            return self._rows([], "task bigint, size bigint, rank bigint, n bigint, container bigint")
        return parts_of(matched, "tag=move").select("task", F.col("v").alias("size"), F.col("start").alias("rank"), "n", F.col("at").alias("container"))


def tasks_of(kinds: DataFrame) -> list[tuple[str, int]]:
    """(kind, capacity) of the short list of tasks, by kind; kinds without a name or a capacity are none."""
    tasks = kinds.where("kind is not null and capacity_tokens > 0").groupBy("kind").agg(F.max("capacity_tokens").cast("bigint").alias("capacity"))
    return sorted((r["kind"], r["capacity"]) for r in tasks.toLocalIterator())


def pieces(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """(kind, doc_id, part_no, text_offset, size, capacity): each text of each task, split only if it exceeds the capacity.

    Offsets and sizes are ByT5 tokens: UTF-8 bytes, and one for the end of the text. kinds is a short list of tasks.
    """
    sized = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length("text") + 1).cast("bigint").alias("_n"))
    rows = tasks_of(kinds)
    if not rows:
        return docs.sparkSession.createDataFrame([], "kind string, doc_id bigint, part_no bigint, text_offset bigint, size bigint, capacity bigint")
    each = sized.withColumn("_t", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in rows])))
    each = each.select("_t.kind", "_t.capacity", "doc_id", "_n")
    cut = each.withColumn("part_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(_n - 1) div capacity"))))
    return cut.select("kind", "doc_id", "part_no", (F.col("part_no") * F.col("capacity")).alias("text_offset"), F.least("capacity", F.col("_n") - F.col("part_no") * F.col("capacity")).alias("size"), "capacity")


def pack(docs: DataFrame, kinds: DataFrame, part_rows: int = PART_ROWS, ranges: int = RANGES) -> DataFrame:
    """(kind, doc_id, part_no, text_offset, n_tokens, container_id): the container of each text, or of each of its parts.

    kinds: (kind, capacity_tokens), each a task of its own over all documents (of repeated kinds the largest capacity).
    A text is split, into full containers and a rest, only if it exceeds the capacity; an empty text has one token;
    repeated rows of a document are items of their own; null texts are none. Containers are numbered from 0 in each
    kind.
    """
    tasks = tasks_of(kinds)
    rows = pieces(docs, kinds)
    parts = max(1, -(-docs.count() // part_rows))
    key = ["kind", "size", "_part"]
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    sized = cut_lineage(rows.groupBy("kind", "size", "_part").agg(F.count(F.lit(1)).alias("n")))
    number = F.array_position(F.array(*[F.lit(k) for k, _ in tasks]), F.col("kind")) - 1 if tasks else F.lit(0).cast("bigint")
    counts = sized.groupBy(number.cast("bigint").alias("task"), F.col("size").alias("v")).agg(F.sum("n").alias("n"))
    moves = _Rounds(docs.sparkSession, [c for _, c in tasks], ranges).run(counts)
    name = F.element_at(F.array(*[F.lit(k) for k, _ in tasks]), (F.col("task") + 1).cast("int")) if tasks else F.lit(None).cast("string")
    moves = moves.withColumn("kind", name)
    # each part of a size holds a range of ranks; ranges of moves are cut at the parts' limits
    first = F.sum("n").over(Window.partitionBy("kind", "size").orderBy("_part")) - F.col("n")
    limits = sized.select("kind", "size", first.alias("rank"), F.lit(None).cast("bigint").alias("container"), "_part")
    marks = moves.select("kind", "size", "rank", "container", F.lit(None).cast("bigint").alias("_part")).unionByName(limits.withColumn("_part", F.col("_part").cast("bigint")))
    # of equal ranks, a part's start and a move's start belong together: the frame takes in all rows of a rank
    upto = Window.partitionBy("kind", "size").orderBy("rank").rangeBetween(Window.unboundedPreceding, 0)
    last = lambda which: F.last(F.when(F.col(which).isNotNull(), F.struct("rank", which)), True).over(upto)
    seen = marks.select("kind", "size", "rank", last("_part").alias("_p"), last("container").alias("_m")).select("kind", "size", "_p._part", "rank", F.col("_p.rank").alias("_first"), F.col("_m.rank").alias("_from"), "_m.container")
    ranges = seen.select(*key, (F.col("rank") - F.col("_first")).alias("_at"), (F.col("container") + F.col("rank") - F.col("_from")).alias("_box")).dropDuplicates([*key, "_at"])
    items = rows.select(*key, "doc_id", "part_no", "text_offset", F.lit(None).cast("bigint").alias("_at"), F.lit(None).cast("bigint").alias("_box"))
    blank = [F.lit(None).cast("bigint").alias(c) for c in ("doc_id", "part_no", "text_offset")]
    numbered = items.withColumn("_at", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "part_no")).cast("bigint") - 1)
    both = numbered.unionByName(ranges.select(*key, *blank, "_at", "_box"))
    w = Window.partitionBy(*key).orderBy("_at", F.col("_box").isNull())
    start = F.last(F.when(F.col("_box").isNotNull(), F.struct("_at", "_box")), True).over(w)
    placed = both.withColumn("_s", start).where("doc_id is not null")
    return placed.select("kind", "doc_id", "part_no", "text_offset", F.col("size").alias("n_tokens"), (F.col("_s._box") + F.col("_at") - F.col("_s._at")).alias("container_id"))


def fill(packed: DataFrame, kinds: DataFrame) -> DataFrame:
    """(kind, n_items, n_containers, n_tokens, fullest, least_containers, filled): how well each task is packed."""
    boxes = packed.groupBy("kind", "container_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
    total = boxes.groupBy("kind").agg(F.sum("n").alias("n_items"), F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"))
    rows = tasks_of(kinds)
    tasks = packed.sparkSession.createDataFrame(rows, "kind string, capacity_tokens bigint")
    joined = total.join(F.broadcast(tasks), "kind")
    return joined.select("kind", "n_items", "n_containers", "n_tokens", "fullest", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"), F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("filled"))


def audit(packed: DataFrame, kinds: DataFrame, spare: float = 0.01) -> DataFrame:
    """(kind, n_texts, n_items, n_tokens, least_containers, n_overfull, n_wrong_splits, tight) of a packing.

    n_overfull counts containers beyond their capacity, n_wrong_splits texts in parts that fit whole or whose parts are not
    full and one after the other; tight tells whether there is at most one container more than 1 + spare times the
    least possible number.
    """
    tasks = F.broadcast(packed.sparkSession.createDataFrame(tasks_of(kinds), "kind string, capacity bigint"))
    rows = packed.join(tasks, "kind")
    boxes = rows.groupBy("kind", "capacity", "container_id").agg(F.sum("n_tokens").alias("t"))
    boxes = boxes.groupBy("kind", "capacity").agg(F.sum("t").alias("n_tokens"), F.count(F.lit(1)).alias("n"), F.sum((F.col("t") > F.col("capacity")).cast("bigint")).alias("n_overfull"))
    texts = rows.groupBy("kind", "capacity", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"), F.max("part_no").alias("last"), F.sum((F.col("text_offset") != F.col("part_no") * F.col("capacity")).cast("int")).alias("off"))
    wrong = (F.col("n") != F.ceil(F.col("t") / F.col("capacity"))) | (F.col("last") != F.col("n") - 1) | (F.col("off") > 0)
    texts = texts.groupBy("kind").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("n_items"), F.sum(wrong.cast("bigint")).alias("n_wrong_splits"))
    least = F.ceil(F.col("n_tokens") / F.col("capacity"))
    return texts.join(boxes, "kind").select("kind", "n_texts", "n_items", "n_tokens", least.alias("least_containers"), "n_overfull", "n_wrong_splits", (F.col("n") <= least * (1 + spare) + 1).alias("tight"))
