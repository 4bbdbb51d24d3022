"""Pointer doubling over arrays, for scopes whose rows fit one batch: the rounds of hierarchy.py within a task.

Nodes are numbers 0, 1, ... of a chunk of whole scopes. Paths are ranges of one growing array: what a round makes of the
open nodes' segments is put behind it, so that resolved nodes keep theirs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scopes are taken together up to this sum of their squared row numbers, which their paths' entries cannot exceed.
CHUNK_SQUARES = 1 << 24
#: Entries of paths that are written at once.
PATH_ENTRIES = 1 << 18


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of the ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def resolve(up: np.ndarray, scope: np.ndarray, on_loop: int, below_loop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The root, depth, and start of the path in the array returned last, of each node; up is -1 for a root.

    Nodes on and below loops have the depths given, and neither root nor path.
    """
    me = np.arange(len(up))
    done = up < 0
    anc = np.where(done, me, up)
    start, length, paths = me.copy(), np.ones(len(up), dtype="int64"), me.astype("int32")
    open_, stuck = np.flatnonzero(~done), []
    while len(open_):
        to = anc[open_]
        longer = length[to] + length[open_]
        more = paths[_ranges(np.stack((start[to], start[open_]), 1).ravel(), np.stack((length[to], length[open_]), 1).ravel())]
        ends, is_done = len(paths) + np.cumsum(longer), done[to]
        anc[open_], done[open_], start[open_], length[open_] = anc[to], is_done, ends - longer, longer
        paths = np.concatenate((paths, more))
        # a round that resolves nothing of a scope leaves its loops
        went_on = np.zeros(scope[-1] + 1, dtype=bool)
        went_on[scope[open_[is_done]]] = True
        open_ = open_[~is_done]
        stuck.append(open_[~went_on[scope[open_]]])
        open_ = open_[went_on[scope[open_]]]
    depth = length - 1
    if stuck and len(left := np.concatenate(stuck)):
        place = np.full(len(up), -1)
        place[left] = np.arange(len(left))
        at = place[anc[left]]
        reached = len(np.unique(at))
        while True:
            at = at[at]
            now = len(np.unique(at))
            if now == reached:
                break
            reached = now
        depth[left] = below_loop
        depth[left[at]] = on_loop
        anc[left] = -1
    return anc, depth, start, paths


def _nodes(scope: np.ndarray, up: pa.Array, node: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """links() of the rows: the scope, name and parent (or -1) of each node, and the names, in their order."""
    names = pa.concat_arrays([node, up]).dictionary_encode()
    order = pc.sort_indices(names.dictionary).to_numpy()
    rank = np.empty(len(order) + 1, dtype="int64")
    rank[order], rank[-1] = np.arange(len(order)), -1
    rank = rank[names.indices.fill_null(-1).to_numpy()]
    there = rank >= 0
    keys, of = np.unique((np.concatenate((scope, scope)) * len(order) + rank)[there], return_inverse=True)
    number = np.full(len(rank), -1)
    number[there] = of
    child, parent = number[: len(scope)], number[len(scope) :]
    both = (child >= 0) & (parent >= 0)
    # nodes of a scope are in the order of their names, so the smallest number is that of the smallest parent
    first = np.full(len(keys), len(keys))
    np.minimum.at(first, child[both], parent[both])
    return keys // max(1, len(order)), keys % max(1, len(order)), np.where(first < len(keys), first, -1), names.dictionary.take(pa.array(order))


def _chunk(rows: pa.RecordBatch, begins: np.ndarray, columns: Sequence[str], with_path: bool, on_loop: int, below_loop: int) -> Iterator[pa.RecordBatch]:
    """hierarchy() of the rows (scope, up, node) of whole scopes, the first row of each of which is in begins."""
    *keys, parents, children = rows.columns
    scope, name, up, names = _nodes(np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(rows)))), parents, children)
    if not len(up):
        return
    root, depth, start, paths = resolve(up, scope, on_loop, below_loop)
    named = pa.concat_arrays([names, pa.array([""], names.type)])
    length = np.where(depth < 0, 0, depth + 1)
    pieces = np.cumsum(length) // PATH_ENTRIES if with_path else np.zeros(len(up), dtype="int64")
    cuts = np.append(np.flatnonzero(np.append(True, pieces[1:] != pieces[:-1])), len(up))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        at = slice(a, b)
        out = [k.take(pa.array(begins[scope[at]])) for k in keys]
        out += [names.take(pa.array(name[at])), named.take(pa.array(np.where(root[at] < 0, len(names), name[root[at]]))), pa.array(depth[at])]
        if with_path:
            values = names.take(pa.array(name[paths[_ranges(start[at], length[at])]]))
            out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length[at])), pa.int32()), values, mask=pa.array(depth[at] < 0)))
        yield pa.RecordBatch.from_arrays(out, list(columns))


def sweep(batches: Iterator[pa.RecordBatch], columns: Sequence[str], with_path: bool, on_loop: int, below_loop: int) -> Iterator[pa.RecordBatch]:
    """hierarchy() of rows (scope, up, node) in which those of each scope follow each other; columns names what comes out."""
    rest = None
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.concat_batches([rest, batch]) if rest is not None else batch
        begins = _begins(rows)
        yield from _chunks(rows.slice(0, begins[-1]), begins[:-1], columns, with_path, on_loop, below_loop)
        rest = rows.slice(begins[-1])
    if rest is not None:
        yield from _chunks(rest, _begins(rest), columns, with_path, on_loop, below_loop)


def _begins(rows: pa.RecordBatch) -> np.ndarray:
    """The first row of each scope; null is a value."""
    new = np.zeros(len(rows), dtype=bool)
    new[0] = True
    for key in rows.columns[:-2]:
        k = key.dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _chunks(rows: pa.RecordBatch, begins: np.ndarray, *how: object) -> Iterator[pa.RecordBatch]:
    sizes = np.diff(np.append(begins, len(rows)))
    number = np.cumsum(sizes * sizes) // CHUNK_SQUARES
    cuts = np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])), len(begins)) if len(begins) else np.zeros(1, dtype="int64")
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        end = begins[b] if b < len(begins) else len(rows)
        yield from _chunk(rows.slice(begins[a], end - begins[a]), begins[a:b] - begins[a], *how)
