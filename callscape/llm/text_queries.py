"""The queries of the text operators, with SQL for DuckDB where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callscape.llm import canonical, leaks, packing
from callscape.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), table(spark, folder, "container_kinds"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.audit(p7_containers(spark, folder), table(spark, folder, "container_kinds"))


def p7_containers_used(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill(p7_containers(spark, folder), table(spark, folder, "container_kinds"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_leaks(spark, folder).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "heldout_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.look_alike_pairs(table(spark, folder, "documents"))


def p9_classes(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.look_classes(table(spark, folder, "documents"))


def p9_texts(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.canonical_texts(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "canonical")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p7_containers, p7_fill, p7_containers_used, p8_found, p8_leaks, p9_found, p9_classes, p9_texts)}

#: What SQL can say of a packing: whole texts, none split that fits, no container too full, and hardly more containers than the least.
_FILL = """
WITH sized AS (SELECT kind, capacity_tokens AS c, octet_length(encode(text)) + 1 AS n FROM documents, container_kinds WHERE text IS NOT NULL)
SELECT kind, count(*) AS n_texts, CAST(sum((n + c - 1) // c) AS BIGINT) AS n_items, CAST(sum(n) AS BIGINT) AS n_tokens, CAST((sum(n) + c - 1) // c AS BIGINT) AS least_containers, 0 AS n_overfull, 0 AS n_wrong_splits, true AS tight FROM sized GROUP BY kind, c
"""

#: The other ones cannot be said in SQL; tests/llm holds them against brute force.
SQL: dict[str, str] = {"p7_fill": _FILL}
