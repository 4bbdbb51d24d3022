"""Every query with SQL gives what DuckDB gives for that SQL; every query gives the columns it always gives."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from callscape.plans import data_queries, graph_queries, import_queries
from compare import rows_of

DATA = "/root/testdata/sf0.001"
SQL = {**graph_queries.SQL, **import_queries.SQL, **data_queries.SQL}
FOUND = {
    "p1_found": ["trace_id", "node", "root", "depth"], "p2_found": ["file_no", "field", "change_kind"], "p3_found": ["graph_id", "record_kind", "module", "item", "item_no", "clause_no", "element_no"],
    "p4_found": ["project", "callee_module", "callee_function"], "p5_found": ["call_id", "reason"], "p6_found": ["snapshot_no", "project", "module", "name", "arity", "clause_no", "change_kind"],
}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_beside_sql(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    found = db.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted({**graph_queries.QUERIES, **data_queries.QUERIES}.keys() - SQL.keys()))
def test_query_without_sql(spark, name):
    assert entry.queries()[name](spark, DATA).limit(1).count() == 1


def test_columns(spark):
    for name, columns in FOUND.items():
        assert entry.queries()[name](spark, DATA).columns == columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and entry.oracle_sql().keys() <= entry.queries().keys()
