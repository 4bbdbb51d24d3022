"""Plain forms of the names of modules and functions, as JVM-side column expressions.

A module may be written with white space around it, with the `Elixir.` prefix, or quoted as an atom
(`:"Elixir.Foo"`); a function may carry its arity (`name/2`). Null stays null, and an atom module
such as `:slate` is a name of its own and keeps its colon. Most names are plain already, which one anchored
pattern tells; only the others are rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEAD = r'^[\s\p{Z}]*(:")?(Elixir\.)?'
_TAIL = r'"?[\s\p{Z}]*$'
_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
#: What needs no rewriting: modules, functions, hexadecimal numbers.
_MODULE, _NAME, _HEX = r"\A(?!Elixir\.)[A-Za-z0-9_.]+\z", r"\A[A-Za-z0-9_!?%]+\z", r"\A[1-9a-f][0-9a-f]*\z"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _unless(plain: str, c: Column, rewritten: Column) -> Column:
    return F.when(c.rlike(plain), c).otherwise(rewritten)


def plain_module(module: Column | str) -> Column:
    c = _column(module)
    return _unless(_MODULE, c, F.regexp_replace(F.regexp_replace(c, _HEAD, ""), _TAIL, ""))


def _trimmed(name: Column | str) -> Column:
    return F.regexp_replace(_column(name), _SPACE, "")


def plain_function(name: Column | str) -> Column:
    return _unless(_NAME, _column(name), F.regexp_replace(_trimmed(name), r"/[0-9]+$", ""))


def plain_arity(arity: Column | str, name: Column | str, args: Column | str | None = None) -> Column:
    """The arity of a row: its own column, else the suffix of its name, else the number of its arguments."""
    a = F.col(arity) if isinstance(arity, str) else arity
    suffix = F.regexp_extract(_trimmed(name), r"/([0-9]+)$", 1)
    found = [a.cast("bigint"), F.when(suffix != "", suffix).try_cast("bigint")]
    if args is not None:
        g = _trimmed(args)
        found.append(F.when(g == "", F.lit(0)).otherwise(F.size(F.split(g, ","))).cast("bigint") * F.when(g.isNotNull(), 1))
    return F.coalesce(*found)


def plain_hex(digest: Column | str) -> Column:
    """A hexadecimal number without case, prefix and leading zeros; null and empty are one value (null)."""
    c = F.regexp_replace(F.lower(_trimmed(digest)), r"^(0x)?0*", "")
    return _unless(_HEX, _column(digest), F.when((F.length(_trimmed(digest)) > 0), F.when(c == "", F.lit("0")).otherwise(c)))
