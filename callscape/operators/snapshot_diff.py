"""What changed between consecutive full snapshots, by content-defined chunks.

The rows of all snapshots are sorted by key together, so that a range of keys lies in one task with all its
snapshots; that is the only shuffle of all rows. A chunk ends where the hash of a key says so: its limits depend on the
keys alone and fall on the same keys in every snapshot. Each snapshot has a digest of each chunk; where it equals that
of the snapshot with the next number, the chunk is discarded. Rows of the other chunks are joined to the next row of their
key, and only steps that are no plain continuation are then held against the list of the project's snapshots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callscape.functions.cluster import cut_lineage, split_lookup
from callscape.functions.names import plain_function, plain_hex, plain_module

KEY = ["project", "module", "name", "arity", "clause_no"]
#: A key ends a chunk if its hash is 0 modulo CHUNK; a chunk also ends after CHUNK_MOST keys, at whatever key that is.
CHUNK, CHUNK_MOST = 64, 1024
#: Stands for null in whole numbers of the key, which pandas would otherwise turn into floats.
_NULL = -(2**62)
_STEP = "project string, module string, name string, arity bigint, clause_no bigint, from_no bigint, to_no bigint, differs boolean"
#: Stands for the missing end of a step.
_NONE = -(2**61)


def normalized(snapshots: DataFrame) -> DataFrame:
    """The key in plain form and two hashes of what is compared (128 bits: equal only for equal content).

    Rows without project, snapshot number or load time cannot be placed and are left out.
    """
    content = [F.coalesce(plain_hex("source_sha"), F.lit("")), F.coalesce(plain_hex("ast_sha"), F.lit("")), F.coalesce(F.col("start_line").cast("string"), F.lit(""))]
    joined = F.concat_ws("|", *content)
    return snapshots.where(F.col("project").isNotNull() & F.col("snapshot_no").isNotNull() & F.col("loaded_at").isNotNull()).select(
        "project", plain_module("module").alias("module"), plain_function("name").alias("name"), *[F.coalesce(F.col(c).cast("bigint"), F.lit(_NULL)).alias(c) for c in ("arity", "clause_no")],
        F.col("snapshot_no").cast("bigint"), F.col("loaded_at").alias("loaded"),
        F.xxhash64(joined).alias("h1"), F.xxhash64(F.concat(F.lit("1|"), joined)).alias("h2"),
    )


def _mixed(a: np.ndarray, b: np.ndarray, odd: int) -> np.ndarray:
    """64 well mixed bits of a and b, so that sums of them are digests of sets of rows."""
    with np.errstate(over="ignore"):
        x = (a.astype("uint64") * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype("uint64") + np.uint64(odd))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _steps(pdf: pd.DataFrame) -> pd.DataFrame:
    """The steps in one or more whole chunks (rows sorted by key, snapshot and load time).

    A step leads from a row of a key to its next one; the first row of a key has a step from nothing, the last one a step
    to nothing. Steps to the very next number without a difference are left out, those of discarded chunks unseen.
    """
    # of several rows of a key in a snapshot the last stays
    key, no = pdf["_key"].to_numpy(), pdf["snapshot_no"].to_numpy()
    pdf = pdf[np.append((key[1:] != key[:-1]) | (no[1:] != no[:-1]), True)].reset_index(drop=True)
    key, no, chunk = pdf["_key"].to_numpy(), pdf["snapshot_no"].to_numpy(), pdf["_chunk"].to_numpy()
    # a digest of each chunk in each snapshot; `same`: it is that of the snapshot with the next number
    order = np.lexsort((no, chunk))
    c, p = chunk[order], no[order]
    starts = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (p[1:] != p[:-1])))
    of = np.empty(len(pdf), dtype="int64")
    of[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(pdf))))
    khash = pdf["khash"].to_numpy()
    d1, d2 = (np.add.reduceat(_mixed(khash, pdf[h].to_numpy(), odd)[order], starts) for h, odd in (("h1", 1), ("h2", 2)))
    c, p = c[starts], p[starts]
    same = np.append((c[1:] == c[:-1]) & (p[1:] == p[:-1] + 1) & (d1[1:] == d1[:-1]) & (d2[1:] == d2[:-1]), False)
    same_after, same_before = same[of], np.append(False, same)[of]
    # rows of the chunks left are joined to the next row of their key
    left = ~(same_after & same_before)
    pdf, key, no, same_after, same_before = pdf[left], key[left], no[left], same_after[left], same_before[left]
    h1, h2 = pdf["h1"].to_numpy(), pdf["h2"].to_numpy()
    # a row of a discarded chunk that is still here is the first or last before rows of another: its own side is known
    follows = np.append((key[1:] == key[:-1]), False) & ~same_after
    differs = follows & np.append((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]), False)
    after = np.append(no[1:], _NONE)
    step = (follows & (differs | (after != no + 1))) | (~follows & ~same_after)
    first = ~np.append(False, follows[:-1]) & ~same_before
    names = ["project", "module", "name", "arity", "clause_no"]
    return pd.concat([
        pdf.loc[step, names].assign(from_no=no[step], to_no=np.where(follows, after, _NONE)[step], differs=differs[step]),
        pdf.loc[first, names].assign(from_no=_NONE, to_no=no[first], differs=False),
    ])


def _sweep(batches: Iterator[pd.DataFrame], chunk: int, most: int) -> Iterator[pd.DataFrame]:
    rest: list[pd.DataFrame] = []
    key_no, chunk_no, in_chunk, before, ended = 0, 0, 0, None, True
    for pdf in batches:
        if not len(pdf):
            continue
        # a number for each key, going on over batches; a chunk ends at a key whose hash says so
        cols = [pdf[k].to_numpy(dtype=object) for k in KEY]
        new = np.append(tuple(x[0] for x in cols) != before, np.logical_or.reduce([(x[1:] != x[:-1]) for x in cols]))
        at = np.flatnonzero(new)
        project, hashes = cols[0], pdf["khash"].to_numpy()
        # a chunk begins after a key whose hash ends one, at another project, and after `most` keys
        ends, owner = hashes[at] % chunk == 0, project[at]
        begins = np.append(ended or not before, ends[:-1])[: len(at)] | (np.append(before[0] if before else None, owner[:-1])[: len(at)] != owner)
        chunks, in_chunk = _limited(begins, in_chunk, most)
        chunks = (chunk_no + chunks).tolist()
        if len(at):
            chunk_no, ended = chunks[-1], bool(ends[-1])
        first = rest[-1]["_chunk"].iloc[-1] if rest else 0
        which = np.cumsum(new)
        pdf = pdf.assign(_key=key_no + which, _chunk=np.array([first, *chunks], dtype="int64")[which])
        key_no += len(at)
        before = tuple(x[-1] for x in cols)
        whole = (pdf["_chunk"] < chunk_no).to_numpy()
        if whole.any() or (rest and first < chunk_no):
            yield _steps(pd.concat([*rest, pdf[whole]]))
            rest = []
        rest.append(pdf[~whole])
    if rest:
        yield _steps(pd.concat(rest))


def _limited(begins: np.ndarray, in_chunk: int, most: int) -> tuple[np.ndarray, int]:
    """The number (from 0 for the chunk that goes on, of in_chunk keys) of each key's chunk, none of more than `most` keys, and the keys of the last."""
    n = len(begins)
    if not n:
        return np.zeros(0, dtype="int64"), in_chunk
    place = np.arange(n)
    start = np.maximum.accumulate(np.where(begins, place, -1))
    nth = np.where(start < 0, place + in_chunk, place - start)
    new = begins | ((nth % most == 0) & (nth > 0))
    return np.cumsum(new), int(nth[-1] % most) + 1


def snapshot_changes(snapshots: DataFrame, chunk: int = CHUNK, most: int = CHUNK_MOST) -> DataFrame:
    """(snapshot_no, project, module, name, arity, clause_no, change_kind) against the project's snapshot before.

    change_kind is added, removed or changed (source_sha, ast_sha or start_line). Of several rows of a key in a
    snapshot the one loaded last counts (of equal times the one with the larger content hash). A project's first
    snapshot has no changes; null parts of a key are values. One task holds one chunk at a time: all snapshots of at
    most `most` keys of one project. The list of a project's snapshots is only joined to steps, of hot projects by
    broadcast.
    """
    n = normalized(snapshots)
    pairs = n.groupBy("project", "snapshot_no").agg(F.count(F.lit(1)).alias("n"))
    present = cut_lineage(pairs.groupBy("project").agg(F.sort_array(F.collect_list("snapshot_no")).alias("_snaps"), F.sum("n").alias("_n")))
    ordered = n.withColumn("khash", F.xxhash64(*KEY)).repartitionByRange(*KEY).sortWithinPartitions(*KEY, "snapshot_no", "loaded", "h1")
    steps = cut_lineage(ordered.mapInPandas(lambda batches: _sweep(batches, chunk, most), _STEP))
    rows = split_lookup(steps, present.drop("_n"), ["project"], counts=present.select("project", "_n"))
    at = lambda no: F.array_position("_snaps", F.col(no)).cast("int")
    next_no = F.when(F.col("from_no") != _NONE, F.try_element_at("_snaps", at("from_no") + 1))
    is_next = F.col("to_no") == next_no
    kinds = F.array(
        F.when(F.coalesce(is_next, F.lit(False)) & F.col("differs"), F.struct(F.col("to_no").alias("no"), F.lit("changed").alias("kind"))),
        F.when(next_no.isNotNull() & ~F.coalesce(is_next, F.lit(False)), F.struct(next_no.alias("no"), F.lit("removed").alias("kind"))),
        F.when((F.col("to_no") != _NONE) & (at("to_no") > 1) & ~F.coalesce(is_next, F.lit(False)), F.struct(F.col("to_no").alias("no"), F.lit("added").alias("kind"))),
    )
    found = rows.select(*KEY, F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("_k"))
    return _with_nulls(found.select(F.col("_k.no").alias("snapshot_no"), *KEY, F.col("_k.kind").alias("change_kind")))


def _with_nulls(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(_NULL)) for c in ("arity", "clause_no")})


def changes_by_window(snapshots: DataFrame) -> DataFrame:
    """The same changes from a window over each key: the plain way, for tests of snapshot_changes()."""
    n = normalized(snapshots)
    w = Window.partitionBy(*KEY, "snapshot_no").orderBy(F.desc("loaded"), F.desc("h1"))
    n = n.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    pairs = n.select("project", "snapshot_no").distinct()
    order = Window.partitionBy("project").orderBy("snapshot_no")
    pairs = pairs.select("project", "snapshot_no", F.lag("snapshot_no").over(order).alias("prev"))
    cur = n.join(pairs, ["project", "snapshot_no"]).where("prev is not null")
    old = n.join(pairs.select("project", F.col("prev").alias("snapshot_no"), F.col("snapshot_no").alias("next")).where("snapshot_no is not null"), ["project", "snapshot_no"])
    cond = [F.col(f"c.{k}").eqNullSafe(F.col(f"o.{k}")) for k in KEY] + [F.col("c.snapshot_no") == F.col("o.next")]
    j = cur.alias("c").join(old.alias("o"), cond, "full")
    kind = F.when(F.col("o.h1").isNull(), "added").when(F.col("c.h1").isNull(), "removed").when((F.col("c.h1") != F.col("o.h1")) | (F.col("c.h2") != F.col("o.h2")), "changed")
    return _with_nulls(j.select(F.coalesce("c.snapshot_no", "o.next").alias("snapshot_no"), *[F.coalesce(f"c.{k}", f"o.{k}").alias(k) for k in KEY], kind.alias("change_kind")).where("change_kind is not null"))
