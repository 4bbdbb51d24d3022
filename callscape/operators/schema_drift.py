"""Files of one source whose schema drifts: one consistent table, and a list of every change.

A schema fingerprint is, for each tracked field, the key it is written under and its JSON type. Versions of a field form
a chain: each earlier key has one rename to the next newer one, each type one cast to a simpler one, and a field that is
missing gets its default. A fingerprint is turned once into the steps that lead through this chain to today's schema,
and the steps are the only way in which a record gets there. A file's fingerprint tells it from the file before; a
record that deviates from its file has a fingerprint, and so a chain, of its own.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscape.functions import arrow
from callscape.functions.cluster import lag_in_periods, spread
from callscape.functions.names import plain_module

#: Keys under which a field was written by any version so far (fixed values); the first is today's, each other one is renamed to the one before it.
LOCATION_FIELDS = {
    "file": ("file", "source_file", "sourceFile", "path", "src"),
    "complexity": ("complexity", "cyclomatic_complexity", "cyclomatic", "cc"),
    "max_nesting_depth": ("max_nesting_depth", "maxNestingDepth", "nesting_depth", "deepest_block"),
}
TOP_FIELDS = {"specs": ("specs", "typespecs", "type_specs", "contracts")}
_KEYS = {**LOCATION_FIELDS, **TOP_FIELDS}
FIELDS = tuple(_KEYS)
DEFAULTS = {"complexity": 1, "max_nesting_depth": 0}
#: Today's type of each field.
TODAY = {"file": "string", "complexity": "whole", "max_nesting_depth": "whole", "specs": "object"}
#: Other columns of a location, and their types.
_OTHER = {"name": "string", "arity": "whole", "kind": "string", "line": "whole", "start_line": "whole", "end_line": "whole"}

_JSON_TYPES = {str: "string", bool: "boolean", int: "whole", float: "fraction", dict: "object", list: "list"}
_Signature = Mapping[str, tuple[str, str]]


class Uncastable(ValueError):
    """A value that no rule brings to today's type."""


def parse(body: str | None) -> dict | None:
    """The JSON object of a body; None if it isn't a complete one."""
    try:
        d = json.loads(body) if body else None
    except (ValueError, RecursionError):
        return None
    return d if isinstance(d, dict) else None


def records(d: dict) -> Iterator[tuple[str, str, dict]]:
    """(module, key, record) of all locations of a file."""
    locations = d.get("function_locations")
    for module, rows in (locations.items() if isinstance(locations, dict) else ()):
        for key, row in (rows.items() if isinstance(rows, dict) else ()):
            if isinstance(row, dict):
                yield module, key, row


def _written(row: dict, fields: Mapping[str, tuple[str, ...]]) -> Iterator[tuple[str, str, str]]:
    """(field, key, JSON type) of the fields' non-null values, newer keys of a field first."""
    for field, keys in fields.items():
        for key in keys:
            if (v := row.get(key)) is not None:
                yield field, key, _JSON_TYPES[type(v)]


def record_fingerprint(row: dict) -> dict[str, tuple[str, str]]:
    """field -> (key, JSON type) of one location; of several keys of a field the newest."""
    sig: dict[str, tuple[str, str]] = {}
    for field, key, kind in _written(row, LOCATION_FIELDS):
        sig.setdefault(field, (key, kind))
    return sig


def fingerprint(d: dict) -> dict[str, tuple[str, str]]:
    """field -> (key, JSON type) of a file's tracked fields with a non-null value.

    Should a file mix keys or types of a field, the most frequent pair stands for it (of equally frequent ones the
    one of the newer key, then the first type by name).
    """
    seen: dict[str, Counter] = {}
    for _, _, row in records(d):
        for field, key, kind in _written(row, LOCATION_FIELDS):
            seen.setdefault(field, Counter())[(key, kind)] += 1
    for field, key, kind in _written(d, TOP_FIELDS):
        seen.setdefault(field, Counter())[(key, kind)] += 1
    return {f: min(c, key=lambda x: (-c[x], _KEYS[f].index(x[0]), x[1])) for f, c in seen.items()}


def _parsed(v: str) -> float | int:
    try:
        return int(v)
    except ValueError:
        pass
    try:
        return float(v)
    except ValueError:
        raise Uncastable from None


def _truncated(v: float) -> int:
    if not -(2**63) <= v < 2**63:  # not true of what is no number either
        raise Uncastable
    return int(v)


def _unwrapped(v: dict) -> str:
    v = v.get("value")
    if isinstance(v, bool) or not isinstance(v, (int, float, str)):
        raise Uncastable
    return str(v)


def _joined(v: list) -> str:
    return "/".join(x if isinstance(x, str) else json.dumps(x) for x in v if x is not None)


def _by_module(v: list) -> dict:
    out: dict = {}
    for s in v:
        if isinstance(s, dict):
            out.setdefault(s.get("module"), []).append(s)
    return out


#: (field's type today, type in the file) -> (type after the cast, the cast): one link of the chain each.
_CASTS: dict[tuple[str, str], tuple[str, Callable[[Any], Any]]] = {
    ("whole", "object"): ("string", _unwrapped),
    ("whole", "string"): ("fraction", _parsed),
    ("whole", "fraction"): ("whole", _truncated),
    ("string", "object"): ("list", lambda v: [v.get("root"), v.get("rel")]),
    ("string", "list"): ("string", _joined),
    ("string", "whole"): ("string", json.dumps),
    ("string", "fraction"): ("string", json.dumps),
    ("string", "boolean"): ("string", json.dumps),
    ("object", "list"): ("object", _by_module),
}


def migration(sig: _Signature, fields: Mapping[str, tuple[str, ...]] = _KEYS) -> list[tuple[str, str, str, str]]:
    """The steps from a fingerprint to today's schema: (rename | cast | drop | default, field, from, to), fields by name.

    Renames lead from key to next newer key, casts from type to simpler type; a type that no cast leads on from is
    dropped, and then counts as missing.
    """
    steps = []
    for field in sorted(fields):
        keys, kind = fields[field], TODAY[field]
        if field in sig:
            key, kind = sig[field]
            steps += [("rename", field, keys[i], keys[i - 1]) for i in range(keys.index(key), 0, -1)]
        while kind != TODAY[field]:
            if (TODAY[field], kind) not in _CASTS:
                steps.append(("drop", field, kind, ""))
                break
            after, _ = _CASTS[TODAY[field], kind]
            steps.append(("cast", field, kind, after))
            kind = after
        if field in DEFAULTS:
            steps.append(("default", field, "", str(DEFAULTS[field])))
    return steps


@lru_cache(maxsize=4096)
def _chain(sig: tuple) -> tuple:
    return tuple(migration(dict(sig), LOCATION_FIELDS))


def migrate(row: dict, steps: Iterator[tuple[str, str, str, str]] | tuple | list) -> tuple[dict, dict]:
    """A record after its steps, and the values (by field) that could not be cast, which are missing after it."""
    out, failed = dict(row), {}
    for step, field, before, after in steps:
        if step == "rename":
            if out.get(before) is not None:
                out[after] = out.pop(before)
        elif step == "cast" and out.get(field) is not None:
            try:
                out[field] = _CASTS[TODAY[field], before][1](out[field])
            except Uncastable:
                failed[field], out[field] = _original(row, field), None
        elif step == "drop":
            failed[field], out[field] = _original(row, field), None
        elif step == "default" and out.get(field) is None:
            out[field] = DEFAULTS[field]
    for field, kind in TODAY.items():
        if kind == "whole" and isinstance(v := out.get(field), int) and not -(2**63) <= v < 2**63:
            failed[field], out[field] = _original(row, field), DEFAULTS[field]
    return out, failed


def _original(row: dict, field: str) -> Any:
    return next((row[k] for k in _KEYS[field] if row.get(k) is not None), None)


def _whole(v: Any) -> int | None:
    """A value of another column as a whole number of 64 bits; null if it is none."""
    try:
        if isinstance(v, str):
            v = _parsed(v)
        return None if v is None or not isinstance(v, (int, float)) or isinstance(v, bool) else _truncated(v)
    except (Uncastable, OverflowError):
        return None


def _str(v: Any) -> str | None:
    return None if v is None else v if isinstance(v, str) else json.dumps(v)


_canonical = json.JSONEncoder(sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode
_LOCATION = [
    ("module", arrow.TEXT), ("location_key", arrow.TEXT), *((n, arrow.TEXT if t == "string" else arrow.WHOLE) for n, t in _OTHER.items()),
    ("file", arrow.TEXT), ("complexity", arrow.WHOLE), ("max_nesting_depth", arrow.WHOLE), ("extra", arrow.TEXT), ("uncast", arrow.TEXT),
]
_SPEC = [
    ("module", arrow.TEXT), ("spec_no", arrow.WHOLE), ("name", arrow.TEXT), ("arity", arrow.WHOLE), ("kind", arrow.TEXT), ("line", arrow.WHOLE),
    ("clause_no", arrow.WHOLE), ("inputs", arrow.TEXT), ("returns", arrow.TEXT), ("full", arrow.TEXT),
]
_FIELD = [("field", arrow.TEXT), ("key", arrow.TEXT), ("kind", arrow.TEXT)]


def _locations(d: dict) -> list[tuple]:
    rows = []
    for module, key, row in records(d):
        sig = record_fingerprint(row)
        r, failed = migrate(row, _chain(tuple(sig.items())))
        taken = {*_OTHER, *(k for k, _ in sig.values())}
        extra = {k: v for k, v in row.items() if k not in taken and not (v is None and any(k in keys for keys in LOCATION_FIELDS.values()))}
        rows.append((module, key, *(_str(r.get(n)) if t == "string" else _whole(r.get(n)) for n, t in _OTHER.items()), r.get("file"), r["complexity"], r["max_nesting_depth"], _canonical(extra) if extra else None, _canonical(failed) if failed else None))
    return rows


def _listed(v: Any) -> list:
    """A list as it is, a single value in place of one as a list of one, none as an empty one."""
    return v if isinstance(v, list) else [] if v is None else [v]


def _texts(values: list) -> list[str]:
    return [_str(v) for v in values if v is not None]


def _specs(d: dict) -> list[tuple]:
    out, _ = migrate(d, migration({f: s for f, s in fingerprint(d).items() if f in TOP_FIELDS}, TOP_FIELDS))
    specs, rows = out.get("specs"), []
    for module, mine in (specs.items() if isinstance(specs, dict) else ()):
        for no, row in enumerate(_listed(mine)):
            if not isinstance(row, dict):
                continue
            clauses = [(i, c) for i, c in enumerate(_listed(row.get("clauses"))) if isinstance(c, dict)]
            for at, clause in clauses or [(-1, {})]:
                inputs, returns = (_listed(clause.get(x)) for x in ("input_strings", "return_strings"))
                rows.append((module, no, _str(row.get("name")), _whole(row.get("arity")), _str(row.get("kind")), _whole(row.get("line")), at, ", ".join(_texts(inputs)), " | ".join(_texts(returns)), _str(clause.get("full"))))
    return rows


def _fields(d: dict) -> list[tuple]:
    return [(f, k, t) for f, (k, t) in sorted(fingerprint(d).items())]


def _newest(files: DataFrame, read: Callable[[dict], list[tuple]], fields: list) -> DataFrame:
    """(file_no, project, extracted_at, records): what read finds in the delivery of each file that was received last.

    Of equal times (a null time is that of extraction) the one with the larger digest of its body counts. Deliveries
    whose body is no complete JSON object are none; a file without a number is left out.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts, rows = [], [], []
            for at, body in enumerate(batch.column(5).to_pylist()):
                if (d := parse(body)) is not None:
                    found = read(d)
                    kept.append(at), counts.append(len(found))
                    rows += found
            some = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns[:5], arrow.records(counts, rows, fields)], [*head, "records"])

    head = ["file_no", "project", "extracted_at", "received_at", "_body"]
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("extracted_at", "received_at")]
    raw = files.select(F.col("file_no").cast("bigint").alias("file_no"), "project", *times, F.md5("body").alias("_body"), "body").where("file_no is not null and body is not null")
    found = spread(raw, "file_no").mapInArrow(scan, f"file_no bigint, project string, extracted_at timestamp_ntz, received_at timestamp_ntz, _body string, records {arrow.ddl(fields)}")
    order = F.struct(F.coalesce("received_at", "extracted_at", F.lit("1900-01-01").cast("timestamp_ntz")), "_body")
    return found.groupBy("file_no").agg(F.max_by(F.struct("project", "extracted_at", "records"), order).alias("_f")).select("file_no", "_f.*")


def file_fingerprints(files: DataFrame) -> DataFrame:
    """(file_no, project, extracted_at, records) per file; records are (field, key, kind), by field.

    A file without a time of extraction has no place among the others and is left out.
    """
    return _newest(files.where(F.col("extracted_at").isNotNull()), _fields, _FIELD)


def schema_changes(files: DataFrame) -> DataFrame:
    """(file_no, field, change_kind) of each tracked field against the project's preceding file by extracted_at.

    added, removed, else renamed (other key) and retyped (other JSON type), possibly both. A project's first file has
    no changes; a file without any tracked field still is a file.
    """
    f = file_fingerprints(files).select("file_no", "project", "extracted_at", F.to_json("records").alias("_s"))
    f = lag_in_periods(f, ["project"], "extracted_at", "_s", "_p").where("_p is not null and _p <> _s")
    as_list = arrow.ddl(_FIELD)
    of = lambda c: F.from_json(c, as_list)
    f = f.select("file_no", of("_s").alias("s"), of("_p").alias("p"), F.explode(F.array(*[F.lit(x) for x in FIELDS])).alias("field"))
    one = lambda c: F.try_element_at(F.filter(c, lambda x: x["field"] == F.col("field")), F.lit(1))
    f = f.select("file_no", "field", one("s").alias("s"), one("p").alias("p"))
    s, p = F.col("s"), F.col("p")
    kinds = F.when(p.isNull() & s.isNotNull(), F.array(F.lit("added"))).when(p.isNotNull() & s.isNull(), F.array(F.lit("removed"))).when(
        p.isNotNull(), F.filter(F.array(F.when(s["key"] != p["key"], F.lit("renamed")), F.when(s["kind"] != p["kind"], F.lit("retyped"))), lambda x: x.isNotNull())
    )
    return f.select("file_no", "field", F.explode(kinds).alias("change_kind"))


def consistent_locations(files: DataFrame) -> DataFrame:
    """All location records of each file's newest delivery in today's schema, one row per file and location key.

    Modules are in plain form. extra holds, as a JSON object, what the record has besides (unlisted keys, older keys
    beside a newer one), so that nothing is lost; uncast holds the values that could not be cast, whose field has
    its default. Both are null if there is nothing.
    """
    return _newest(files, _locations, _LOCATION).select("file_no", "project", F.inline("records")).withColumn("module", plain_module("module"))


def consistent_specs(files: DataFrame) -> DataFrame:
    """All clauses of all specs of each file's newest delivery.

    spec_no counts the specs of a module and clause_no the clauses of a spec, from 0; a single clause in place of a
    list is a list of one, a null one keeps its number but has no row. A spec without any clause has one row with
    clause_no -1, empty texts and a null full.
    """
    return _newest(files, _specs, _SPEC).select("file_no", "project", F.inline("records")).withColumn("module", plain_module("module"))


def unlisted_keys(files: DataFrame) -> DataFrame:
    """(project, key, n_files, n_records, first_at, last_at): keys of locations that no version of the schema lists.

    Such a key may be a field under a name not known yet: then the field counts as removed, and its values are in
    consistent_locations().extra.
    """

    def read(d: dict) -> list[tuple]:
        listed = {*_OTHER, *(k for keys in LOCATION_FIELDS.values() for k in keys)}
        return [(k, n) for k, n in sorted(Counter(k for _, _, row in records(d) for k, v in row.items() if v is not None and k not in listed).items())]

    f = _newest(files, read, [("key", arrow.TEXT), ("n", arrow.WHOLE)]).select("project", "extracted_at", F.inline("records"))
    return f.groupBy("project", "key").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_records"), F.min("extracted_at").alias("first_at"), F.max("extracted_at").alias("last_at"))


def fingerprint_versions(files: DataFrame) -> DataFrame:
    """(fingerprint, steps, n_files, first_at, last_at): each version of the schema with its chain of migration steps."""

    def read(d: dict) -> list[tuple]:
        sig = fingerprint(d)
        return [(_canonical({f: {"key": k, "kind": t} for f, (k, t) in sig.items()}), "; ".join(" ".join(filter(None, s)) for s in migration(sig)))]

    f = _newest(files.where(F.col("extracted_at").isNotNull()), read, [("fingerprint", arrow.TEXT), ("steps", arrow.TEXT)]).select("extracted_at", F.inline("records"))
    return f.groupBy("fingerprint", "steps").agg(F.count(F.lit(1)).alias("n_files"), F.min("extracted_at").alias("first_at"), F.max("extracted_at").alias("last_at"))
