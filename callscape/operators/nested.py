"""Deeply nested records as related flat tables, by Merkle identities of their subtrees.

Each object of a document is canonicalised and hashed bottom-up: its hash covers its kind, its own scalar fields and
the hashes of its children, each with its name or ordinal within the object. So the hash is that of the subtree alone,
wherever it stands. An object that occurs many times is stored once (`objects`); every occurrence has a bridge row
with the hashes of itself and its parent, its ordinals and its place in the document. Bodies are parsed once; all
tables come from objects and bridge.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscape.functions import arrow
from callscape.functions.cluster import cut_lineage, split_lookup, spread
from callscape.functions.names import plain_module
from callscape.sources.ingest import plain_document

#: Kinds of records, parents first; `graph` and `struct` are only parents.
KINDS = ("graph", "struct", "struct_field", "location", "spec", "clause", "input", "result", "type", "param")
_RECORD = [
    *((n, arrow.WHOLE) for n in ("occ_no", "parent_no")), *((n, arrow.TEXT) for n in ("record_kind", "module", "item")), *((n, arrow.WHOLE) for n in ("item_no", "clause_no", "element_no")),
    ("node_hash", arrow.BYTES), ("content", arrow.TEXT),
]
_PLACE = ["module", "item", "item_no", "clause_no", "element_no"]


def document(body: str | None) -> dict | None:
    """The CallGraph of a body, out of its outer shape (text in JSON, list of one, `graph` beside `meta`).

    None if the body isn't complete JSON or holds no object.
    """
    d: Any = body
    for _ in range(4):
        if isinstance(d, str):
            try:
                d = json.loads(d)
            except (ValueError, RecursionError):
                return None
        elif isinstance(d, list) and len(d) == 1:
            d = d[0]
        elif isinstance(d, dict) and isinstance(d.get("graph"), dict):
            d = d["graph"]
    return d if isinstance(d, dict) else None


def listed(v: Any) -> list:
    """A list as it is, nothing as an empty list, a single value as a list of one."""
    return v if isinstance(v, list) else [] if v is None else [v]


def by_module(section: Any) -> Iterator[tuple[str, Any]]:
    for module, v in (section.items() if isinstance(section, dict) else ()):
        if v is not None:
            yield module, v


_canonical = json.JSONEncoder(sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


@lru_cache(maxsize=65536)
def _leaf(kind: str, content: str) -> bytes:
    return _digest(f"{kind}|{content}")


class _Node:
    """An object: its kind, its place in the document, its own scalars, its children and their names or ordinals in it."""

    __slots__ = ("children", "content", "digest", "edges", "kind", "place")

    def __init__(self, kind: str, place: tuple, scalars: Any) -> None:
        self.kind, self.place, self.content, self.children, self.edges, self.digest = kind, place, _canonical(scalars), [], [], b""

    def add(self, kind: str, edge: Any, place: tuple, scalars: Any) -> _Node:
        self.children.append(node := _Node(kind, place, scalars))
        self.edges.append(edge)
        return node

    def seal(self) -> bytes:
        if self.children:
            # children are taken in the order of their edges, so that the order of keys in the text does not matter
            inner = sorted((c.kind, _canonical(e), c.seal().hex()) for c, e in zip(self.children, self.edges, strict=True))
            self.digest = _digest(f"{self.kind}|{self.content}|{inner}")
        else:
            self.digest = _leaf(self.kind, self.content)
        return self.digest


def _own(d: Any, without: tuple[str, ...] = ()) -> Any:
    return {k: v for k, v in d.items() if k not in without} if isinstance(d, dict) else d


def tree(d: dict) -> _Node:
    """The records of a document; place is (module, item, item_no, clause_no, element_no). Null elements keep their number but are no records."""
    root = _Node("graph", ("", "", -1, -1, -1), {})
    for m, s in by_module(d.get("structs")):
        struct = root.add("struct", m, (m, "", -1, -1, -1), _own(s, ("fields",)) if isinstance(s, dict) else {})
        for i, f in enumerate(listed(s.get("fields") if isinstance(s, dict) else s)):
            if f is not None:
                struct.add("struct_field", i, (m, f.get("field") if isinstance(f, dict) else f, i, -1, -1), f)
    for m, rows in by_module(d.get("function_locations")):
        for key, row in (rows.items() if isinstance(rows, dict) else ()):
            if row is not None:
                root.add("location", (m, key), (m, key, -1, -1, -1), row)
    for m, rows in by_module(d.get("specs")):
        for i, s in enumerate(listed(rows)):
            if not isinstance(s, dict):
                continue
            item = f"{s.get('name')}/{s.get('arity')}"
            spec = root.add("spec", (m, i), (m, item, i, -1, -1), _own(s, ("clauses",)))
            for j, c in enumerate(listed(s.get("clauses"))):
                if c is None:
                    continue
                clause = spec.add("clause", j, (m, item, i, j, -1), _own(c, ("input_strings", "return_strings")))
                for kind, field in (("input", "input_strings"), ("result", "return_strings")):
                    for k, e in enumerate(listed(c.get(field) if isinstance(c, dict) else None)):
                        if e is not None:
                            clause.add(kind, k, (m, item, i, j, k), e)
    for m, rows in by_module(d.get("types")):
        for i, t in enumerate(listed(rows)):
            if not isinstance(t, dict):
                continue
            typed = root.add("type", (m, i), (m, t.get("name"), i, -1, -1), _own(t, ("params",)))
            for k, e in enumerate(listed(t.get("params"))):
                if e is not None:
                    typed.add("param", k, (m, t.get("name"), i, -1, k), e)
    root.seal()
    return root


def _flatten(node: _Node, out: list, parent: int = -1) -> None:
    no = len(out)
    m, item, *numbers = node.place
    out.append((no, parent, node.kind, m, item if isinstance(item, str) or item is None else json.dumps(item), *numbers, node.digest, node.content))
    for c in node.children:
        _flatten(c, out, no)


def deliveries(graphs: DataFrame) -> DataFrame:
    """(graph_id, project, received_at, _body, records) of each delivery whose body is complete; records are of all levels.

    Graphs without a number are left out. _body is the digest of the body.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts, rows = [], [], []
            for at, body in enumerate(batch.column(4).to_pylist()):
                if (d := document(body)) is not None:
                    flat: list[tuple] = []
                    _flatten(tree(d), flat)
                    kept.append(at), counts.append(len(flat))
                    rows += flat
            some = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns[:4], arrow.records(counts, rows, _RECORD)], ["graph_id", "project", "received_at", "_body", "records"])

    raw = graphs.select(F.col("graph_id").cast("bigint").alias("graph_id"), "project", F.col("received_at").cast("timestamp_ntz").alias("received_at"), F.md5("body").alias("_body"), "body")
    return spread(raw.where("graph_id is not null and body is not null"), "graph_id").mapInArrow(scan, f"graph_id bigint, project string, received_at timestamp_ntz, _body string, records {arrow.ddl(_RECORD)}")


def _newest() -> Column:
    return F.struct(F.coalesce("received_at", F.lit("1900-01-01").cast("timestamp_ntz")), "_body")


def store(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects and bridge: (node_hash, record_kind, content, n_occurrences) and (graph_id, project, occ_no, parent_no, module, item, item_no, clause_no, element_no, node_hash, parent_hash).

    Of each graph the delivery counts that was received last (a null time is before all; of equal times the one with the
    larger digest of its body). Both are tables in the shared folder.
    """
    newest = deliveries(graphs).groupBy("graph_id").agg(F.max_by(F.struct("project", "records"), _newest()).alias("_g"))
    # a parent's hash comes from its place in the list, so that it need not be moved with every child
    whole = F.transform("records", lambda r: F.struct(*[r[n].alias(n) for n, _ in _RECORD], F.when(r["parent_no"] >= 0, F.get("records", r["parent_no"].cast("int"))["node_hash"]).alias("parent_hash")))
    rows = cut_lineage(newest.select("graph_id", "_g.project", "_g.records").select("graph_id", "project", F.inline(whole)).withColumn("module", plain_module("module")))
    objects = cut_lineage(rows.groupBy("node_hash", "record_kind", "content").agg(F.count(F.lit(1)).alias("n_occurrences")))
    return objects, rows.drop("record_kind", "content")


def plain_documents(graphs: DataFrame) -> DataFrame:
    """(graph_id, project, text) of each graph's newest complete delivery, as JSON of the exact shape that ingestion reads."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [document(body) for body in batch.column(4).to_pylist()]
            kept = [i for i, d in enumerate(docs) if d is not None]
            texts = pa.array([plain_document(docs[i]) for i in kept], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(kept, pa.int64())).columns[:4], texts], ["graph_id", "project", "received_at", "_body", "text"])

    raw = graphs.select(F.col("graph_id").cast("bigint").alias("graph_id"), "project", F.col("received_at").cast("timestamp_ntz").alias("received_at"), F.md5("body").alias("_body"), "body")
    found = spread(raw.where("graph_id is not null and body is not null"), "graph_id").mapInArrow(scan, "graph_id bigint, project string, received_at timestamp_ntz, _body string, text string")
    return found.groupBy("graph_id").agg(F.max_by(F.struct("project", "text"), _newest()).alias("_g")).select("graph_id", "_g.*")


def placed(objects: DataFrame, bridge: DataFrame, *more: str) -> DataFrame:
    """The bridge with the record_kind (and more columns) of each occurrence's object; objects that occur all over are joined by broadcast."""
    return split_lookup(bridge, objects.select("node_hash", "record_kind", *more), ["node_hash"], counts=objects.select("node_hash", F.col("n_occurrences").alias("_n")))


def with_parents(rows: DataFrame) -> DataFrame:
    """placed() rows with the kind and place of each one's parent, by its number in the graph (null for a graph itself)."""
    up = rows.select("graph_id", F.col("occ_no").alias("parent_no"), *[F.col(c).alias(f"parent_{c.removeprefix('record_')}") for c in ("record_kind", *_PLACE[:4])])
    return split_lookup(rows, up, ["graph_id", "parent_no"], "left")


def bridge_table(graphs: DataFrame) -> DataFrame:
    """Every occurrence below graphs: its place and its parent's."""
    rows = cut_lineage(placed(*store(graphs)))
    cols = ["graph_id", "record_kind", *_PLACE, *[f"parent_{c}" for c in ("kind", *_PLACE[:4])]]
    return with_parents(rows).where("record_kind <> 'graph'").select(*cols)


def object_contents(graphs: DataFrame) -> DataFrame:
    """(record_kind, content, n_objects, n_occurrences): own scalars of the objects below graphs, how many subtrees have them, and how often these occur."""
    objects, _ = store(graphs)
    return objects.where("record_kind <> 'graph'").groupBy("record_kind", "content").agg(F.count(F.lit(1)).alias("n_objects"), F.sum("n_occurrences").alias("n_occurrences"))


def flat_table(graphs: DataFrame, kind: str) -> DataFrame:
    """(graph_id, place, content, parent's kind and place): all records of a kind, from the bridge and the objects stored once."""
    objects, bridge = store(graphs)
    rows = cut_lineage(with_parents(cut_lineage(placed(objects, bridge))).where(F.col("record_kind") == kind))
    mine = objects.where(F.col("record_kind") == kind)
    found = split_lookup(rows, mine.select("node_hash", "content"), ["node_hash"], counts=mine.select("node_hash", F.col("n_occurrences").alias("_n")))
    return found.select("graph_id", *_PLACE, "content", *[f"parent_{c}" for c in ("kind", *_PLACE[:4])])


def record_places(graphs: DataFrame) -> DataFrame:
    """(graph_id, record_kind, module, item, item_no, clause_no, element_no) of all records below graphs and structs."""
    return placed(*store(graphs)).where("record_kind not in ('graph', 'struct')").select("graph_id", "record_kind", *_PLACE)
