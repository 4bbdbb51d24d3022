"""Per-key results without a reducer that receives all partials of a hot key.

The input is cut into chunks of a fixed size: a chunk's rows of a key are combined where they lie, and the states are
merged in rounds of fan-in F: in round r the states of F^r neighbouring chunks meet. No task ever merges more than F
states of a key, however many rows the key has, and the number of rounds is logarithmic in the number of chunks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscape.functions.cluster import cut_lineage
from callscape.functions.names import plain_function, plain_module

#: How partial states of one kind are merged.
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
FAN_IN = 8
#: Rows of a chunk of calls.
CHUNK_ROWS = 1_000_000
_PAIR = ["project", "callee_module", "callee_function"]


def tree_aggregate(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, tuple[str, Column]], fan_in: int = FAN_IN, chunks: int | None = None) -> DataFrame:
    """df grouped by keys, with a column for each of aggs: name -> (count | sum | min | max, value).

    The chunk of a row is its column `_chunk`, from 0 to below chunks. Without chunks it is the row's input split, whose
    size spark.sql.files.maxPartitionBytes fixes; as Spark combines a split's rows before they move, the first merge then
    takes fan_in of them at once. Nulls in a key are a value of their own, nulls in a value are passed over (a count of
    nothing is 0, other results null). Without rows there are no groups. Keys and results may have any names but `_chunk`.
    """
    if chunks is None:
        chunks = -(-df.rdd.getNumPartitions() // fan_in)
        df = df.withColumn("_chunk", F.floor(F.spark_partition_id() / fan_in))
    state = df.groupBy(*keys, "_chunk").agg(*[(F.count(v) if kind == "count" else _MERGE[kind](v)).alias(name) for name, (kind, v) in aggs.items()])
    while chunks > 1:
        chunks = -(-chunks // fan_in)
        state = state.withColumn("_chunk", F.floor(F.col("_chunk") / fan_in)).groupBy(*keys, "_chunk").agg(*[_MERGE[kind](F.col(name)).alias(name) for name, (kind, _) in aggs.items()])
    return state.drop("_chunk")


def distinct_calls(calls: DataFrame, *more: Column, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, int]:
    """One row (call_id, project, callee_module, callee_function, _chunk, ...) per call with both names in plain form, and the number of chunks.

    Deliveries of a call are alike but for spelling, so any of them stands for all. Rows without a call_id, a callee
    module or a callee function are no such calls. The number of chunks follows the number of rows, and a call's chunk the
    hash of its id. Rows are laid out by pair and chunk: a task has a pair's calls of one chunk, all deliveries of
    them, and the combination of a chunk needs no further shuffle.
    """
    chunks = max(1, -(-calls.count() // chunk_rows))
    c = calls.where(F.col("callee_module").isNotNull() & F.col("callee_function").isNotNull() & F.col("call_id").isNotNull())
    c = c.select("call_id", "project", plain_module("callee_module").alias("callee_module"), plain_function("callee_function").alias("callee_function"), F.pmod(F.xxhash64("call_id"), F.lit(chunks)).alias("_chunk"), *more)
    return c.repartition(*_PAIR, "_chunk").dropDuplicates([*_PAIR, "_chunk", "call_id"]), chunks


def pair_counts(calls: DataFrame, fan_in: int = FAN_IN, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(project, callee_module, callee_function, n_calls, first_at, last_at) of the distinct calls."""
    c, chunks = distinct_calls(calls, F.col("extracted_at"), chunk_rows=chunk_rows)
    aggs = {"n_calls": ("count", F.lit(1)), "first_at": ("min", F.col("extracted_at")), "last_at": ("max", F.col("extracted_at"))}
    return tree_aggregate(c, _PAIR, aggs, fan_in, chunks)


def heavy_pairs(calls: DataFrame, share: int = 20, fan_in: int = FAN_IN, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(project, callee_module, callee_function) with at least 1/share of the project's calls.

    Calls without a callee module or function count nowhere; `%` counts as a function name. The pairs' counts are
    written once, and the projects' totals come from them by a tree of their own.
    """
    c, chunks = distinct_calls(calls, chunk_rows=chunk_rows)
    pairs = cut_lineage(tree_aggregate(c, _PAIR, {"n": ("count", F.lit(1))}, fan_in, chunks))
    totals = tree_aggregate(pairs, ["project"], {"total": ("sum", F.col("n"))}, fan_in)
    found = pairs.alias("p").join(totals.alias("t"), F.col("p.project").eqNullSafe(F.col("t.project")) & (F.col("p.n") * share >= F.col("t.total")))
    return found.select("p.project", "p.callee_module", "p.callee_function")
