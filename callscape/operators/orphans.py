"""References to records that do not exist (at the time of the reference)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscape.functions.cluster import cut_lineage, split_lookup
from callscape.functions.names import plain_arity, plain_function, plain_module

_KEY = ["project", "module", "name", "arity"]


def references(calls: DataFrame) -> DataFrame:
    """One row (call_id, project, module, name, arity, at) per delivery of a call that names a function; `%` names none."""
    name = plain_function("callee_function")
    c = calls.where(F.col("call_id").isNotNull() & F.col("callee_module").isNotNull() & F.col("callee_function").isNotNull())
    c = c.select("call_id", "project", plain_module("callee_module").alias("module"), name.alias("name"), plain_arity("callee_arity", "callee_function", "callee_args").alias("arity"), F.col("extracted_at").alias("at"))
    return c.where(F.col("name") != "%")


def orphan_keys(refs: DataFrame, locations: DataFrame, library: DataFrame) -> DataFrame:
    """(project, module, name, arity, _n, first_loaded, periods): the distinct foreign keys that may have orphans.

    Keys of the library are anti-joined. Of the others each gets the periods in which its function was present, as an
    array, and the first time of loading (null if it never was); a key whose calls all lie in one such period has no
    orphans and is left out. _n are the key's rows of refs.
    """
    lib = library.select(plain_module("module").alias("module"), plain_function("name").alias("name"), F.col("arity").cast("bigint").alias("arity")).distinct()
    keys = refs.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("_n"), F.count("at").alias("_timed"), F.min("at").alias("_from"), F.max("at").alias("_to"))
    keys = keys.join(lib, ["module", "name", "arity"], "left_anti")
    loc = locations.select("project", plain_module("module").alias("module"), plain_function("name").alias("name"), F.col("arity").cast("bigint").alias("arity"), "loaded_at", "removed_at").where(F.col("loaded_at").isNotNull())
    known = loc.groupBy(*_KEY).agg(F.min("loaded_at").alias("first_loaded"), F.collect_set(F.struct("loaded_at", "removed_at")).alias("periods"))
    within = F.exists("periods", lambda p: (p["loaded_at"] <= F.col("_from")) & (p["removed_at"].isNull() | (p["removed_at"] > F.col("_to"))))
    return keys.join(known, _KEY, "left").where(~F.coalesce(within & (F.col("_timed") == F.col("_n")), F.lit(False))).select(*_KEY, "_n", "first_loaded", "periods")


def orphan_calls(calls: DataFrame, locations: DataFrame, library: DataFrame) -> DataFrame:
    """(call_id, reason, at) of the calls whose callee is neither in library nor present in locations at that time.

    The distinct keys of the calls are anti-joined (see orphan_keys), and what is left is joined back to the calls,
    whose own time then decides. Calls are read once and written in narrow form; those of hot functions stay where they are,
    as their few keys are broadcast. reason: `deleted` if the function was there before, `late` if it came only later,
    else `missing`. A call whose arity cannot be had from its row matches nothing and is `missing`; a null time of the
    call lies in no period and before all. Repeated deliveries count once (of different ones the earliest).
    """
    refs = cut_lineage(references(calls))
    keys = cut_lineage(orphan_keys(refs, locations, library))
    back = split_lookup(refs, keys.drop("_n"), _KEY, counts=keys.select(*_KEY, "_n"))
    there = F.exists("periods", lambda p: (p["loaded_at"] <= F.col("at")) & (p["removed_at"].isNull() | (p["removed_at"] > F.col("at"))))
    reason = F.when(F.col("first_loaded").isNull(), "missing").when(F.col("first_loaded") <= F.col("at"), "deleted").otherwise("late")
    found = back.where(~F.coalesce(there, F.lit(False))).select("call_id", "at", reason.alias("reason"))
    return found.groupBy("call_id").agg(F.min(F.struct("at", "reason")).alias("_o")).select("call_id", "_o.reason", "_o.at")


def orphan_counts(orphans: DataFrame, table: str) -> DataFrame:
    """(table_name, month, reason, n_rows): orphan rows per referring table, month of the reference and reason."""
    return orphans.groupBy(F.date_format("at", "yyyy-MM").alias("month"), "reason").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(table).alias("table_name"), "month", "reason", "n_rows")
