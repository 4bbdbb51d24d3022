"""Arrow batches of rows that each hold a list of records, built column by column."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa

WHOLE, TEXT, BYTES = pa.int64(), pa.string(), pa.binary()


def valid(text: str | None) -> str | None:
    """The text as UTF-8 can hold it: a half of a surrogate pair, which JSON can escape, becomes U+FFFD."""
    if text is None or text.isascii():
        return text
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-8", "surrogatepass").decode("utf-8", "replace")
    return text


def _column(values: Sequence, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(values, kind)
    except (UnicodeEncodeError, pa.ArrowInvalid):
        if kind != TEXT:
            raise
        return pa.array([valid(v) for v in values], kind)


def records(counts: Sequence[int], rows: Sequence[tuple], fields: Sequence[tuple[str, pa.DataType]]) -> pa.ListArray:
    """A list of structs for each of counts, whose values come row by row from rows."""
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    flat = pa.StructArray.from_arrays([_column(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)], [n for n, _ in fields])
    offsets = [0]
    for n in counts:
        offsets.append(offsets[-1] + n)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def ddl(fields: Sequence[tuple[str, pa.DataType]]) -> str:
    """The Spark type of such a list."""
    names = {WHOLE: "bigint", TEXT: "string", BYTES: "binary"}
    return f"array<struct<{', '.join(f'{n}: {names[t]}' for n, t in fields)}>>"
