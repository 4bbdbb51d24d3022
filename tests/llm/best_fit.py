"""Best fit over counts per size on one machine: what the distributed rounds are held against."""

from __future__ import annotations

from collections.abc import Iterator


class _Ranks:
    """Ranks of like things, as a stack of ranges (start, count)."""

    __slots__ = ("n", "ranges")

    def __init__(self, start: int = 0, n: int = 0) -> None:
        self.ranges, self.n = ([[start, n]] if n else []), n

    def take(self, n: int) -> Iterator[tuple[int, int]]:
        self.n -= n
        while n:
            start, have = self.ranges[-1]
            got = min(n, have)
            if got == have:
                self.ranges.pop()
            else:
                self.ranges[-1] = [start + got, have - got]
            n -= got
            yield start, got

    def put(self, start: int, n: int) -> None:
        if self.ranges and self.ranges[-1][0] + self.ranges[-1][1] == start:
            self.ranges[-1][1] += n
        else:
            self.ranges.append([start, n])
        self.n += n


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Where items go: (size, first rank, number of items, first container), and the number of containers.

    Items of a range go to containers of consecutive numbers. counts: items of each size, all of 1 to capacity.
    """
    left = {s: _Ranks(0, n) for s, n in counts.items() if n > 0}
    sizes = sorted(left)
    gaps: dict[int, _Ranks] = {}
    moves: list[tuple[int, int, int, int]] = []
    opened = 0

    def place(size: int, into: _Ranks, n: int, gap: int, after: dict[int, _Ranks]) -> None:
        """n items of a size into n containers with that gap, by rank on both sides."""
        boxes = [list(x) for x in into.take(n)]
        for start, have in left[size].take(n):
            while have:
                box = boxes[0]
                k = min(have, box[1])
                moves.append((size, start, k, box[0]))
                if gap > size:
                    after.setdefault(gap - size, _Ranks()).put(box[0], k)
                start, have, box[0], box[1] = start + k, have - k, box[0] + k, box[1] - k
                if not box[1]:
                    boxes.pop(0)

    # no two items above half the capacity share a container
    after: dict[int, _Ranks] = {}
    for s in reversed(sizes):
        if 2 * s <= capacity:
            break
        n = left[s].n
        place(s, _Ranks(opened, n), n, capacity, after)
        opened += n
    gaps = after
    while True:
        # one sweep in ascending order: open items are stacked, each gap takes from the top of the stack
        sizes = [s for s in sizes if left[s].n]
        if not sizes:
            break
        stack: list[list[int]] = []
        after, matched, i = {}, False, 0
        for g in sorted(gaps):
            while i < len(sizes) and sizes[i] <= g:
                stack.append([sizes[i], left[sizes[i]].n])
                i += 1
            here = gaps[g]
            while here.n and stack:
                k = min(here.n, stack[-1][1])
                place(stack[-1][0], here, k, g, after)
                matched = True
                stack[-1][1] -= k
                if not stack[-1][1]:
                    stack.pop()
            if here.n:
                mine = after.setdefault(g, _Ranks())
                for start, n in here.ranges:
                    mine.put(start, n)
        gaps = after
        if matched:
            continue
        # nothing fits: new containers for the largest items, as many as the open items need at least
        total = sum(s * left[s].n for s in sizes)
        new = -(-total // capacity)
        for s in reversed(sizes):
            if new <= 0:
                break
            n = min(new, left[s].n)
            place(s, _Ranks(opened, n), n, capacity, gaps)
            opened, new = opened + n, new - n
    return moves, opened
