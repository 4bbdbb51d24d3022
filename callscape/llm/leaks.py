"""Evaluation passages that stand, whole or in pieces, in documents.

One Aho-Corasick automaton over the normalised passages scans each document once. Its patterns are short runs of
letters across every word boundary of every passage, so a few misread letters leave most of them whole. The scanned
stream is the document in its own reading order (columns put right, set-in adverts taken out), reduced to folded
letters, with the places of its lines. Around the hits the passage is then aligned letter by letter, and its whole
words are counted: exactly, on whole texts.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscape.functions.cluster import spread
from callscape.llm.canonical import CYRILLIC, GREEK, OTHER

#: Letters in a pattern, of these at least so many on each side of the boundary. Every hit is aligned, be it the only one.
SEED, SIDE = 12, 2
#: Consecutive words that make a leak.
WORDS = 16
#: Letters by which a passage that stops at a line's end is found again at a later line's start: among the next NEAR_LINES lines a few, beyond them a whole pattern.
NEAR, NEAR_LINES = 6, 14
#: Columns begin so many pixels apart at least; a line set in by so many from its column's edge belongs to an advert; gaps of a line that are so many characters apart are one column's.
COLUMN_APART, SET_IN, GAP_APART = 250, 25, 8
#: Letters of passages whose automaton a worker may hold (about 11 nodes and 450 bytes each); more are scanned in further passes.
LETTERS = 500_000

#: Signs that are read one for the other, by the one that stands for both (fixed values).
_MISREAD = dict(zip("01i|5cbu", "olllsehn", strict=True))
_TWINS = {k.lower(): v.lower() for t in (CYRILLIC, GREEK, OTHER) for k, v in t.items()}
_FOLD = {**{k: _MISREAD.get(v, v) for k, v in _TWINS.items()}, **_MISREAD}
_NOT_LETTER = re.compile(r"(?:[^\w\n]|_)+")
_GAP = re.compile(r" {3,}")


def letters(text: str) -> str:
    """The text's letters and digits, folded: case, accents, width, look-alikes and usual misreadings don't count.

    Line breaks stay.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).casefold()
    else:
        text = text.lower()
    for c in _FOLD.keys() & set(text):
        text = text.replace(c, _FOLD[c])
    return _NOT_LETTER.sub("", text)


def cells(text: str, x: Sequence[int], y: Sequence[int]) -> list[tuple[int, int]]:
    """The pieces (start, end) of the text in reading order: column by column, from the top down.

    The k-th line has the k-th box. Lines that run across columns are parted at their gaps of three or more spaces
    and go to the column that begins there. Lines set in from their column's edge are adverts inside an article
    and come after everything else. Without a box for each line, lines stay in their order.
    """
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, line))
        at += len(line) + 1
    n = len(lines)
    if not n or len(x) < n or len(y) < n or None in x or None in y:
        return [(a, a + len(s)) for a, s in lines]
    edges = []
    for v in sorted(set(x[:n])):
        if not edges or v - edges[-1] > COLUMN_APART:
            edges.append(v)
    found = []
    if "   " in text and len(edges) == 1:
        gaps = [m.end() for _, s in lines for m in _GAP.finditer(s.rstrip())]
        cuts: list[int] = []
        for g in sorted(gaps):
            if not cuts or g - cuts[-1] > GAP_APART:
                cuts.append(g)
        for k, (a, s) in enumerate(lines):
            start = 0
            for m in _GAP.finditer(s.rstrip()):
                found.append((bisect_right(cuts, start), 0, y[k], k, a + start, a + m.start()))
                start = m.end()
            found.append((bisect_right(cuts, start), 0, y[k], k, a + start, a + len(s)))
        found.sort(key=lambda c: (c[0], c[2], c[3]))
    else:
        for k, (a, s) in enumerate(lines):
            col = bisect_right(edges, x[k]) - 1
            found.append((col, x[k] - edges[col] >= SET_IN, y[k], k, a, a + len(s)))
        found.sort(key=lambda c: (c[1], c[0], c[2], c[3]))
    return [(c[4], c[5]) for c in found]


class _Passages:
    """The passages' letters and word limits, and the automaton over their seeds."""

    def __init__(self, items: Sequence[tuple[int, str]]) -> None:
        import ahocorasick

        self.ids, self.texts, self.starts = [], [], []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for item, passage in items:
            parts = [w for w in map(letters, (passage or "").split()) if w]
            if len(parts) < WORDS:
                continue
            k, text = len(self.ids), "".join(parts)
            starts = np.cumsum([0, *map(len, parts)]).tolist()
            self.ids.append(item), self.texts.append(text), self.starts.append(starts)
            places = {b - SEED + i for b in starts[1:-1] for i in range(SIDE, SEED - SIDE + 1)}
            for p in places:
                if 0 <= p <= len(text) - SEED:
                    seeds.setdefault(text[p : p + SEED], []).append((k, p))
        self.automaton = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.automaton.add_word(seed, places)
        if seeds:
            self.automaton.make_automaton()
        self.any = bool(seeds)


class _Run(NamedTuple):
    """A stretch [begin, end) of a passage, where in the stream it stands and is anchored, and its misread places."""

    begin: int
    end: int
    d_begin: int
    d_end: int
    anchor: int
    bad: list[int]


def _close_misreads(p_text: str, d_text: str, p: int, d: int) -> list[int]:
    """The places, from p on, of single misread letters that stand too close for three equal letters between them.

    They end before three equal letters, or the rest of the passage; none if two adjacent letters differ first.
    """
    bad = [0]
    for i in range(1, min(len(p_text) - p, len(d_text) - d)):
        if p_text[p + i] != d_text[d + i]:
            if bad[-1] == i - 1:
                return []
            bad.append(i)
        elif i - bad[-1] == min(3, len(p_text) - p - 1 - bad[-1]):
            return [p + b for b in bad]
    return [p + b for b in bad] if bad[-1] == len(p_text) - p - 1 else []


class _Lines:
    """A stream with the starts of its lines, and these by the letters that follow."""

    def __init__(self, text: str, starts: list[int]) -> None:
        self.text, self.starts, self._by = text, starts, {}

    def later(self, letters: str, after: int) -> int | None:
        """The first line start beyond `after` that these letters follow."""
        n = len(letters)
        if n not in self._by:
            by: dict[str, list[int]] = {}
            for s in self.starts:
                by.setdefault(self.text[s : s + n], []).append(s)
            self._by[n] = by
        found = self._by[n].get(letters, ())
        at = bisect_right(found, after)
        return found[at] if at < len(found) else None


def _walk(p_text: str, lines: _Lines, p: int, d: int) -> tuple[int, int, list[int]]:
    """How far passage and stream go on together from (p, d), and where the passage is misread.

    A misread place has up to two letters on either side and three equal letters after it; single misread letters may
    follow each other more closely. At the end of a line any number of lines may be left out, if the passage goes on
    at the start of a later one.
    """
    d_text, limits = lines.text, lines.starts
    bad: list[int] = []
    n, m = len(p_text), len(d_text)
    while p < n and d < m:
        if p_text[p] == d_text[d]:
            p, d = p + 1, d + 1
            continue
        step = None
        tail = n - p
        for i, j in ((1, 1), (1, 2), (2, 1), (2, 2), (1, 0), (0, 1)):
            k = min(3, tail - i)
            if k < 0 or d + j > m:
                continue
            if (k > 0 or (i == tail and j > 0)) and p_text[p + i : p + i + k] == d_text[d + j : d + j + k]:
                step = (i, j)
                break
        # a line ends here: what follows may be an advert's lines, after which the article goes on
        at = bisect_left(limits, d - 2)
        if at < len(limits) and limits[at] <= d + 1 and tail > 3:
            near = limits[min(at + NEAR_LINES, len(limits)) - 1]
            for back in (0, -1, 1, -2):
                begin = max(0, p + back)
                jump = lines.later(p_text[begin : begin + NEAR], d - 3) if begin < n else None
                if jump is not None and jump > near:
                    jump = lines.later(p_text[begin : begin + SEED], d - 3) if n - begin >= SEED else None
                if jump is not None:
                    # prefer reading on in the same line if that reads as well
                    if step is None or jump - d < 3:
                        p, d = begin, jump
                        step = (0, 0)
                    break
        if step is None:
            if close := _close_misreads(p_text, d_text, p, d):
                bad += close
                p, d = close[-1] + 1, d + close[-1] + 1 - p
                continue
            break
        if step != (0, 0):
            bad.append(min(p, n - 1))
            p, d = p + step[0], d + step[1]
    return p, d, bad


def _whole_words(text: str, starts: list[int], stream: str, run: tuple[int, int, int, int], bad: list[int]) -> tuple[int, int, int, int]:
    """A run (begin, end, d_begin, d_end) with the words at its ends that but one misread letter cut off; its place goes into bad.

    Such a word has at least four letters: where the passage does not go on, nothing behind the letter can confirm it.
    """
    begin, end, d_begin, d_end = run
    if end < len(text):
        w = bisect_right(starts, end) - 1
        n = starts[w + 1] - end
        wrong = [end + i for i in range(n) if d_end + i >= len(stream) or text[end + i] != stream[d_end + i]]
        if len(wrong) == 1 and starts[w + 1] - starts[w] >= 4 and not any(starts[w] <= b < starts[w + 1] for b in bad):
            bad += wrong
            end, d_end = end + n, d_end + n
    if begin > 0:
        w = bisect_left(starts, begin) - 1
        n = begin - starts[w]
        wrong = [begin - i for i in range(1, n + 1) if d_begin < i or text[begin - i] != stream[d_begin - i]]
        if len(wrong) == 1 and starts[w + 1] - starts[w] >= 4 and not any(starts[w] <= b < starts[w + 1] for b in bad):
            bad += wrong
            begin, d_begin = begin - n, d_begin - n
    return begin, end, d_begin, d_end


def longest_run(passages: _Passages, k: int, hits: list[tuple[int, int]], lines: _Lines, back: _Lines) -> tuple[int, int]:
    """The most consecutive words of passage k that the stream of lines holds, and where in it they are anchored; back is the stream read backwards."""
    text, starts, limits = passages.texts[k], passages.starts[k], lines.starts
    back_text, size_of_stream = text[::-1], len(lines.text)
    # the stretches of the passage that walks along a diagonal covered; beyond them a hit begins a walk of its own
    done: dict[int, list[tuple[int, int]]] = {}
    runs: list[_Run] = []
    for p, d in hits:
        if any(a <= p < b for a, b in done.get(p - d, ())):
            continue
        end, d_end, bad = _walk(text, lines, p, d)
        begin, d_begin, bad_back = _walk(back_text, back, len(text) - p, size_of_stream - d)
        begin, d_begin = len(text) - begin, size_of_stream - d_begin
        bad += [len(text) - 1 - b for b in bad_back]
        begin, end, d_begin, d_end = _whole_words(text, starts, lines.text, (begin, end, d_begin, d_end), bad)
        for near in range(p - d - 1, p - d + 2):
            done.setdefault(near, []).append((begin, end))
        runs.append(_Run(begin, end, d_begin, d_end, d, bad))
    best, where = 0, -1
    for r in [*runs, *_joined(runs, limits)]:
        wrong = [bisect_right(starts, b) - 1 for b in r.bad]
        first, last = bisect_left(starts, r.begin), bisect_right(starts, r.end) - 1
        run = 0
        for w in range(first, last):
            size = starts[w + 1] - starts[w]
            run = run + 1 if wrong.count(w) <= max(1, size // 5) else 0
            if run > best:
                best, where = run, r.anchor
    return best, where


def _joined(runs: list[_Run], limits: list[int]) -> list[_Run]:
    """The runs that go on where another one ends, after a gap of whole lines of any number, joined with it.

    The one ends at a line's end and the other begins at a later line's start, give or take three letters that are misread
    or agree by chance; there the passage goes on, up to two letters apart. Each part has a hit of its own.
    """

    def edge(d: int) -> int | None:
        at = bisect_left(limits, d)
        return min((s for s in limits[max(0, at - 1) : at + 1] if abs(s - d) <= 3), key=lambda s: abs(s - d), default=None)

    chains: list[_Run] = []
    out = []
    for b in sorted(runs, key=lambda r: (r.d_begin, r.begin)):
        found = b
        if (start := edge(b.d_begin)) is not None:
            goes_on = b.begin + start - b.d_begin
            for a in chains:
                stop = edge(a.d_end)
                if stop is None or stop >= start or a.begin >= found.begin:
                    continue
                ended = a.end + stop - a.d_end
                if abs(ended - goes_on) <= 2 and a.end < b.end:
                    bad = [*(x for x in a.bad if x < ended), *range(ended, goes_on), *(x for x in b.bad if x >= goes_on)]
                    found = _Run(a.begin, b.end, a.d_begin, b.d_end, a.anchor, bad)
        chains.append(found)
        if found is not b:
            out.append(found)
    return out


def _rows(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _lists(batch: pa.RecordBatch, name: str) -> list[list[int]]:
    col = batch.column(batch.schema.get_field_index(name))
    flat, offsets = col.values.to_pylist(), col.offsets.to_pylist()
    return [flat[a:b] for a, b in zip(offsets, offsets[1:])]


def scan_text(passages: _Passages, text: str, x: Sequence[int], y: Sequence[int], words: int = WORDS) -> list[tuple[int, int, int]]:
    """(passage number, longest run, offset of the run's anchor in the text) of all passages that text leaks."""
    order = cells(text, x, y)
    folded = letters("\n".join([text[a:b] for a, b in order]))
    stream = folded.replace("\n", "")
    hits: dict[int, list[tuple[int, int]]] = {}
    for end, places in passages.automaton.iter(stream):
        for k, p in places:
            hits.setdefault(k, []).append((p, end - SEED + 1))
    out = []
    if hits:
        limits = np.cumsum([0, *map(len, folded.split("\n"))])[:-1].tolist()
        lines, back = _Lines(stream, limits), _Lines(stream[::-1], sorted(len(stream) - s for s in limits))
        for k, at in hits.items():
            run, where = longest_run(passages, k, at, lines, back)
            if run >= words:
                cell = bisect_right(limits, where) - 1
                out.append((k, run, _original(text, *order[cell], where - limits[cell])))
    return out


def _original(text: str, start: int, end: int, letter: int) -> int:
    """The offset in the text of the letter-th folded letter of text[start:end]."""
    seen = 0
    for i in range(start, end):
        seen += len(letters(text[i]))
        if seen > letter:
            return i
    return start


@lru_cache(maxsize=2)
def _built(items: tuple[tuple[int, str], ...]) -> _Passages:
    return _Passages(items)


def leaks(docs: DataFrame, items: DataFrame, words: int = WORDS, letters_held: int = LETTERS) -> DataFrame:
    """(doc_id, item_id, n_words, text_offset): documents with at least `words` consecutive words of a passage.

    items are a fixed evaluation set. A worker holds the automaton of about letters_held letters of passages (counted) and
    no more; a larger set is cut into such parts by item_id, and the documents are scanned once for each. Null or empty texts and
    passages of fewer words leak nothing; repeated rows of a document give one row. n_words is the longest run.
    """
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), "passage").where("item_id is not null and passage is not null").distinct()
    parts = max(1, -(-(rows.agg(F.sum(F.length("passage"))).first()[0] or 0) // letters_held))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(F.col("page_lines.x0"), F.array().cast("array<int>")).alias("x"), F.coalesce(F.col("page_lines.y0"), F.array().cast("array<int>")).alias("y"))
    docs = spread(docs.where("doc_id is not null and length(text) > 0"), "doc_id")
    found = None
    for part in range(parts):
        mine = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        held = docs.sparkSession.sparkContext.broadcast(tuple(sorted((r["item_id"], r["passage"]) for r in mine.toLocalIterator())))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            p = _built(held.value)
            for batch in batches:
                out: list[tuple[int, int, int, int]] = []
                if p.any:
                    for doc, text, x, y in zip(_rows(batch, "doc_id"), _rows(batch, "text"), _lists(batch, "x"), _lists(batch, "y"), strict=True):
                        out += [(doc, p.ids[k], run, at) for k, run, at in scan_text(p, text, x, y, words)]
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["doc_id", "item_id", "n_words", "text_offset"], dtype="int64"), preserve_index=False)

        one = docs.mapInArrow(scan, "doc_id bigint, item_id bigint, n_words bigint, text_offset bigint")
        found = one if found is None else found.unionByName(one)
    best = F.max(F.struct("n_words", (-F.col("text_offset")).alias("_o"))).alias("_b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "_b.n_words", (-F.col("_b._o")).alias("text_offset"))
