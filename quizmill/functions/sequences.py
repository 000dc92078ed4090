"""The Ratcliff-Obershelp ratio of long strings: exact blocks from an index of rare runs, behind a bound from the longest common subsequence.

Blocks are those of `difflib.SequenceMatcher(None, a, b)`: in a second string of 200 symbols and more, symbols that make up
over a hundredth of it do not begin a block, though blocks grow over them. So a block is looked for among runs of rare
symbols: short ones by an index of what stands where, longer ones by growing each maximal match once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher

import numpy as np

GRAM = 4  # matches of so many rare symbols are grown one by one
LONG = 200  # fixed value: from here on the second string has popular symbols


def _common(a: str, i: int, b: str, j: int, most: int, back: bool = False) -> int:
    """How many symbols from two places on (or before them) are equal, at most so many; by pieces that double, then halve."""
    n, step = 0, 16
    while n < most:
        k = min(step, most - n)
        same = a[i - n - k : i - n] == b[j - n - k : j - n] if back else a[i + n : i + n + k] == b[j + n : j + n + k]
        if same:
            n, step = n + k, step * 2
        elif k == 1:
            return n
        else:
            most, step = n + k, k // 2  # the end lies within this piece
    return n


class _Index:
    """Where runs of rare symbols of b stand, by their first 1 to GRAM symbols."""

    def __init__(self, a: str, b: str):
        self.a, self.b = a, b
        x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype="<u4") for s in (a, b))
        n = np.bincount(y, minlength=int(max(x.max(initial=0), y.max(initial=0))) + 1)
        popular = n > len(b) // 100 + 1
        self.end_a, self.end_b = self._ends(popular[x]), self._ends(popular[y])
        self.starts = np.flatnonzero(~popular[x]).tolist()
        self.at: list[dict[str, list[int]]] = [{} for _ in range(GRAM + 1)]
        for j in np.flatnonzero(~popular[y]).tolist():  # few: symbols above a hundredth are left out
            for n in range(1, min(GRAM, self.end_b[j] - j) + 1):
                self.at[n].setdefault(b[j : j + n], []).append(j)

    @staticmethod
    def _ends(popular: np.ndarray) -> list[int]:
        """For each place the end of the run of rare symbols that it is in (the place itself if it is in none)."""
        places = np.append(np.flatnonzero(popular), len(popular))
        return places[np.searchsorted(places, np.arange(len(popular)))].tolist()

    def longest(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        """The first longest run of rare symbols in both ranges, grown over whatever is equal around it: (place in a, place in b, size)."""
        a, b, i0, j0, size = self.a, self.b, alo, blo, 0
        for k in range(bisect_left(self.starts, alo), bisect_left(self.starts, ahi)):
            i = self.starts[k]
            top = min(ahi, self.end_a[i])
            while size < GRAM and i + size < top:
                n = size + 1
                places = self.at[n].get(a[i : i + n], ())
                p = bisect_left(places, blo)
                if p == len(places) or places[p] + n > bhi:
                    break
                i0, j0, size = i, places[p], n
            if size < GRAM or i + size > top:
                continue
            places = self.at[GRAM].get(a[i : i + GRAM], ())
            for p in range(bisect_left(places, blo), len(places)):
                j = places[p]
                if j + size > bhi:
                    break
                if i > alo and j > blo and self.end_a[i - 1] > i - 1 and a[i - 1] == b[j - 1]:
                    continue  # part of a match that began before
                stop = min(top - i, min(bhi, self.end_b[j]) - j)
                n = GRAM + _common(a, i + GRAM, b, j + GRAM, stop - GRAM)
                if n > size:
                    i0, j0, size = i, j, n
        back = _common(a, i0, b, j0, min(i0 - alo, j0 - blo), back=True)
        i0, j0, size = i0 - back, j0 - back, size + back
        return i0, j0, size + _common(a, i0 + size, b, j0 + size, min(ahi - i0, bhi - j0) - size)


def matched(a: str, b: str) -> int:
    """How many symbols the matching blocks of a and b hold."""
    if len(b) < LONG:
        return sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())
    if a == b:
        return len(a)
    index, total, todo = _Index(a, b), 0, [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        i, j, n = index.longest(alo, ahi, blo, bhi)
        if n:
            total += n
            if alo < i and blo < j:
                todo.append((alo, i, blo, j))
            if i + n < ahi and j + n < bhi:
                todo.append((i + n, ahi, j + n, bhi))
    return total


def ratio(a: str, b: str) -> float:
    """2 * matched / all symbols; 1 for two empty strings."""
    return 2.0 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


def can_reach(a: str, b: str, least: float) -> bool:
    """Whether the ratio can be at least so much. Never false where it is.

    Blocks are a common subsequence. Lengths bound it, then counts of symbols, then its true length, bit-parallel in rows of
    the second string's size, which ends as soon as even equal rest symbols would not do.
    """
    need = least * (len(a) + len(b)) / 2 - 1e-9
    if min(len(a), len(b)) < need or (Counter(a) & Counter(b)).total() < need:
        return False
    where: dict[str, int] = {}
    for j, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << j
    full = (1 << len(b)) - 1
    s = full
    for i, c in enumerate(a):
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & full
        if i % 256 == 255 and len(b) - s.bit_count() + len(a) - i - 1 < need:
            return False
    return len(b) - s.bit_count() >= need


def _alike(a: str, b: str, q: int = 6) -> bool:
    """Whether half the runs of q symbols of the shorter string stand in the other: then blocks are long and soon found."""
    one, two = ({s[i : i + q] for i in range(len(s) - q + 1)} for s in (a, b))
    return 2 * len(one & two) >= min(len(one), len(two)) > 0


def _shares(a: str, b: str, pieces: int = 16, size: int = 24) -> bool:
    """Whether half of some pieces spread over the shorter string stand in the other: found without a look at each symbol."""
    a, b = sorted((a, b), key=len)
    return len(a) > pieces * size and 2 * sum(a[k : k + size] in b for k in range(0, len(a) - size, len(a) // pieces)) >= pieces


def reached(a: str, b: str, least: float) -> float | None:
    """The ratio where it is at least so much, else None. Strings that are not alike by short runs are held against the bound first."""
    if a == b:
        return 1.0
    if 2 * min(len(a), len(b)) < least * (len(a) + len(b)) - 1e-9 or (not _shares(a, b) and not _alike(a, b) and not can_reach(a, b, least)):
        return None
    r = ratio(a, b)
    return r if r >= least else None
