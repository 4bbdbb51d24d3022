"""Predicates over patterns: exact by default, else an unanchored regular expression."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class InvalidPattern(ValueError):
    """A pattern that is no regular expression of the supported kind."""


#: Look-around, back references, atomic groups and possessive quantifiers have no linear-time form and are refused.
_UNSUPPORTED = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k<|(?<!\\)[*+?]\+|[0-9,]}\+")


def validate(*patterns: str | None, regex: bool) -> None:
    """Raise InvalidPattern for the first bad pattern; without regex, and for None, anything goes.

    A pattern is good if the engine that will run it, Java's, takes it.
    """
    for p in patterns if regex else ():
        if p is None:
            continue
        try:
            SparkSession.active()._jvm.java.util.regex.Pattern.compile(p)
        except Exception as e:
            raise InvalidPattern(f"Invalid regex pattern '{p}': {str(getattr(e, 'java_exception', e)).splitlines()[0]}") from None
        if m := _UNSUPPORTED.search(p):
            raise InvalidPattern(f"Invalid regex pattern '{p}': {m[0]} is not supported")


def matches(column: str | Column, pattern: str | None, regex: bool = False) -> Column:
    """The column equals the pattern or holds a match of it; no pattern matches all."""
    c = F.col(column) if isinstance(column, str) else column
    return F.lit(True) if pattern is None else c.rlike(pattern) if regex else c == pattern


def equals(column: str, value: object | None) -> Column:
    return F.lit(True) if value is None else F.col(column) == value


def in_project(df: DataFrame, project: str | None) -> DataFrame:
    """The rows of a project (a partition where the store is partitioned by it), or of all projects."""
    return df if project is None else df.where(F.col("project") == project)


def by_hand(exclude_generated: bool) -> Column:
    """Rows of code that no macro generated, if these are to be left out."""
    return F.col("generated_by") == "" if exclude_generated else F.lit(True)


def ordered(df: DataFrame, by: list[str], limit: int | None) -> DataFrame:
    """df in the order of `by` (`-x` descending), ties by all other columns, and at most `limit` rows of it.

    Without a limit no order is made, as a sort of whole tables has no use for what reads them next.
    """
    if limit is None:
        return df
    keys = [F.col(b[1:]).desc() if b.startswith("-") else F.col(b).asc() for b in by]
    rest = [F.col(c) for c in df.columns if c not in {b.lstrip("-") for b in by}]
    return df.orderBy(*keys, *rest).limit(limit)
