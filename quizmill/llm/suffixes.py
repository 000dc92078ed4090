"""Suffix arrays by induced sorting and common prefixes in text order, with numpy."""

from __future__ import annotations

import numpy as np


def _place(ch: np.ndarray, ptr: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where elements go that are put one by one at the pointers of their buckets; also the buckets and how far each pointer moves."""
    order = np.argsort(ch, kind="stable")
    c, n = ch[order], len(ch)
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(c[1:], c[:-1], out=first[1:])
    start = first.nonzero()[0]
    size = np.empty(len(start), np.int64)
    size[:-1] = start[1:]
    size[-1] = n
    size -= start
    buckets = c[start]
    at = np.arange(n)
    at -= start.repeat(size)
    dest = np.empty(n, np.int64)
    dest[order] = ptr[c] + (at if step == 1 else -at)
    return dest, buckets, step * size


def _sweep(text: np.ndarray, sa: np.ndarray, ptr: np.ndarray, wanted: np.ndarray, step: int) -> None:
    """One pass of induction over sa, upwards (step 1) or downwards (-1): the predecessor of each suffix met, if of the wanted type, goes to its bucket's pointer.

    Stretches are handled at once: what a stretch puts lies behind it in the direction of the pass, and if some of it
    lies within the stretch, the stretch is cut there. Where cuts come after a few places (periodic texts), the next
    places are taken one by one, more of them each time.
    """
    n = len(sa)
    p, m, slow = (0 if step == 1 else n - 1), 64, 0
    while 0 <= p < n:
        end = min(n, p + m) if step == 1 else max(-1, p - m)
        span = sa[p:end] if step == 1 else sa[p : end if end >= 0 else None : -1]
        at = np.flatnonzero(span > 0)
        j = span[at] - 1
        ok = wanted[j]
        at, j = at[ok], j[ok]
        if not len(j):
            p, m = end, m * 2
            continue
        dest, buckets, moves = _place(text[j], ptr, step)
        inside = (dest < end) if step == 1 else (dest > end)
        if inside.any():
            cut = int(dest[inside].min() if step == 1 else dest[inside].max())
            if abs(cut - p) < 48:
                slow = min(slow + 1, 10)
                for _ in range(64 << slow):
                    if not 0 <= p < n:
                        break
                    e = sa.item(p)
                    p += step
                    if e > 0 and wanted.item(e - 1):
                        c = text.item(e - 1)
                        to = ptr.item(c)
                        sa[to] = e - 1
                        ptr[c] = to + step
                m = 64
                continue
            k = int(np.searchsorted(at, abs(cut - p)))  # elements before the cut
            at, j = at[:k], j[:k]
            dest, buckets, moves = _place(text[j], ptr, step)
            m, end = max(64, 2 * abs(cut - p)), cut
        else:
            m, slow = min(2 * m, 1 << 18), max(0, slow - 1)
        sa[dest] = j
        ptr[buckets] += moves
        p = end


def _induce(text: np.ndarray, small: np.ndarray, heads: np.ndarray, tails: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Sorts all suffixes from leftmost-smaller ones in the order given."""
    sa = np.full(len(text), -1, np.int64)
    dest, _, _ = _place(text[lms[::-1]], tails.copy(), -1)
    sa[dest] = lms[::-1]
    _sweep(text, sa, heads.copy(), ~small, 1)
    sa[sa >= 0] = np.where(small[sa[sa >= 0]], -1, sa[sa >= 0])
    sa[0] = len(text) - 1
    _sweep(text, sa, tails.copy(), small, -1)
    return sa


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of integers from 0; the last element must be the only 0.

    Induced sorting: suffixes are smaller (S) or larger (L) than the next; substrings between leftmost smaller ones are
    sorted by induction and named; if names repeat, the string of names is sorted recursively; its order induces all.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    alphabet = int(text.max()) + 1
    differs = np.flatnonzero(text[1:] != text[:-1])
    nxt = differs[np.searchsorted(differs, np.arange(n - 1))]
    small = np.ones(n, bool)
    small[:-1] = text[nxt] < text[nxt + 1]
    count = np.bincount(text, minlength=alphabet)
    ends = np.cumsum(count)
    heads, tails = ends - count, ends - 1
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sa = _induce(text, small, heads, tails, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by_sub = sa[is_lms[sa]]
    # names: equal for equal substrings (next leftmost smaller one included)
    length = np.zeros(n, np.int64)
    length[lms] = np.diff(np.concatenate([lms, [n - 1]])) + 1
    a, b = by_sub[:-1], by_sub[1:]
    same = (length[a] == length[b]) & (b != n - 1) & (a != n - 1)
    live, k = np.flatnonzero(same), 0
    while len(live):
        x, y = a[live], b[live]
        eq = text[x + k] == text[y + k]
        same[live[~eq]] = False
        k += 1
        live = live[eq & (k < length[x])]
    name = np.empty(n, np.int64)
    name[by_sub] = np.concatenate([[0], np.cumsum(~same)])
    reduced = name[lms]
    if int(reduced.max()) + 1 == len(lms):
        order = np.empty(len(lms), np.int64)
        order[reduced] = np.arange(len(lms))
    else:
        order = suffix_array(reduced)
    return _induce(text, small, heads, tails, lms[order])


def common_prefixes(data: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phi, plcp) in text order: the suffix before each one in the array, and how many bytes they share.

    If the bytes before both agree, the length is that of the position before, less one; only the other positions are
    compared, eight bytes at once. The last byte of data must occur once.
    """
    n = len(data)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data
    wide = np.zeros(n + 1, np.uint64)
    for k in range(8):
        wide |= padded[k : k + n + 1] << np.uint64(8 * k)
    at = np.arange(n)
    own = (at == 0) | (phi <= 0)
    rest = np.flatnonzero(~own)
    own[rest[data[rest - 1] != data[phi[rest] - 1]]] = True
    own |= np.concatenate([[True], phi[:-1] < 0])
    heads = np.flatnonzero(own & (phi >= 0))
    length = np.zeros(n, np.int64)
    live = heads
    while len(live):
        x, y = live + length[live], phi[live] + length[live]
        z = wide[np.minimum(x, n)] ^ wide[np.minimum(y, n)]
        same = z == 0
        low = z[~same]
        low &= ~low + np.uint64(1)
        length[live[~same]] += np.log2(low.astype(np.float64)).astype(np.int64) >> 3
        live = live[same]
        length[live] += 8
    last = np.maximum.accumulate(np.where(own, at, 0))
    return phi, np.where(phi >= 0, np.maximum(length[last] - (at - last), 0), 0)
