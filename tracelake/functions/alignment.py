"""Edits between two long sequences: rows of the edit table as bits of whole numbers, with checkpoints for the way back."""

from __future__ import annotations

from collections.abc import Hashable, Sequence

#: Bytes of rows that are kept for the way back at a time, and checkpoints of a part of the table that is larger.
KEPT_BYTES, PARTS = 32 << 20, 16
#: Units of which so many have their positions as bits all the time; others' are made when a row asks for them.
FREQUENT = 256


class _Table:
    """Rows over the units of x, bits over those of y. A row is (up, down): where the next column costs one more, or one less."""

    def __init__(self, x: Sequence[Hashable], y: Sequence[Hashable]):
        self.x, self.y = x, y
        self.places: dict[Hashable, list[int]] = {}
        for j, u in enumerate(y):
            self.places.setdefault(u, []).append(j)
        often = sorted(self.places, key=lambda u: -len(self.places[u]))[:FREQUENT]
        self.bits = {u: self._bits(self.places[u]) for u in often}

    def _bits(self, places: list[int]) -> int:
        out = bytearray(places[-1] // 8 + 1)
        for j in places:
            out[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(out, "little")

    def equal(self, u: Hashable) -> int:
        found = self.bits.get(u)
        return found if found is not None else self._bits(p) if (p := self.places.get(u)) else 0

    def row(self, i: int, up: int, down: int, mask: int) -> tuple[int, int, int, int]:
        """Row i (from 1) after the row before it: (up, down, free, more).

        free: the diagonal costs nothing; more: the row before costs one less in the same column.
        """
        same = self.equal(self.x[i - 1]) & mask
        free = ((((same & up) + up) ^ up) | same | down) & mask
        more = down | (mask ^ ((free | up) & mask))
        less = free & up
        shifted = ((more << 1) | 1) & mask
        return ((less << 1) & mask) | (mask ^ (free | shifted)), free & shifted, free, more


def edit_counts(x: Sequence[Hashable], y: Sequence[Hashable]) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) of a best alignment; of equal ways back from the end it takes a substitution or match, then a deletion.

    Rows are kept for the way back as long as they fit KEPT_BYTES; a larger part of the table
    is run through once for PARTS checkpoints, and its parts are walked from the last to the first.
    Time is that of a few operations on whole numbers of len(y) bits for each row and level of parts.
    """
    table = _Table(x, y)
    at, counts = [len(x), len(y)], [0, 0, 0]
    full = (1 << len(y)) - 1

    def walk(low: int, high: int, up: int, down: int) -> None:
        """Goes back from row high to row low, whose bits are given; columns after the one reached no longer matter."""
        mask = (1 << at[1]) - 1
        up, down = up & mask, down & mask
        if (high - low) * max(at[1], 8) // 4 > KEPT_BYTES and high - low > 1:
            step = -(-(high - low) // PARTS)
            starts = [(low, up, down)]
            for i in range(low + 1, high):
                up, down, _, _ = table.row(i, up, down, mask)
                if (i - low) % step == 0:
                    starts.append((i, up, down))
            while starts:
                start = starts.pop()
                if at[0] > start[0] and at[1]:
                    walk(start[0], at[0], start[1], start[2])
            return
        size = at[1] // 8 + 1
        rows = []
        for i in range(low + 1, high + 1):
            up, down, free, more = table.row(i, up, down, mask)
            rows.append((free.to_bytes(size, "little"), more.to_bytes(size, "little")))
        i, j = at
        s, d, n = counts
        while i > low and j:
            free, more = rows[i - low - 1]
            byte, bit = (j - 1) >> 3, 1 << ((j - 1) & 7)
            if x[i - 1] == y[j - 1]:
                i, j = i - 1, j - 1
            elif not free[byte] & bit:
                s, i, j = s + 1, i - 1, j - 1
            elif more[byte] & bit:
                d, i = d + 1, i - 1
            else:
                n, j = n + 1, j - 1
        at[:], counts[:] = (i, j), (s, d, n)

    if x and y:
        walk(0, len(x), full, 0)
    return counts[0], counts[1] + at[0], counts[2] + at[1]
