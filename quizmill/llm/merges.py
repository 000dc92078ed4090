"""Byte-pair merges: exact merging, the test whether two tokens may stand side by side, and splitting into words."""

from __future__ import annotations

import heapq
import json
from functools import cached_property

import numpy as np
import regex

WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else the next from U+0100."""
    out, free = [], 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


CHARS = byte_chars()
AS_CHARS = {b: c for b, c in enumerate(CHARS)}


def spelled(text: str) -> str:
    """The UTF-8 bytes of a text, each as its character."""
    return text.encode().decode("latin-1").translate(AS_CHARS)


FAR = np.int64(1) << 40


class Lookup:
    """Whole numbers to their places in a list, by open addressing; arrays are looked up at once."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(4 * max(1, len(keys))).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.key, self.place = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.place[slot] < 0
            one, which = np.unique(slot[free], return_index=True)
            put = todo[free][which]
            self.key[one], self.place[one] = keys[put], put
            left = np.ones(len(todo), bool)
            left[np.flatnonzero(free)[which]] = False
            todo, slot = todo[left], (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys (from 0 on), -1 for those that are not there."""
        slot = self._slot(keys)
        out = np.where(self.key[slot] == keys, self.place[slot], -1).astype(np.int64)
        at = np.flatnonzero((out < 0) & (self.place[slot] >= 0))
        slot = slot[at]
        while len(at):
            slot = (slot + 1) & (len(self.key) - 1)
            hit = self.key[slot] == keys[at]
            out[at[hit]] = self.place[slot[hit]]
            more = ~hit & (self.place[slot] >= 0)
            at, slot = at[more], slot[more]
        return out


class Tables:
    """A merge table and its vocabulary in arrays: parts and ranks of tokens, pairs, and a tree of the tokens' symbols.

    Symbols are the 256 bytes, and END for the end of a word.
    """

    def __init__(self, m: Merges):
        size = max(m.names) + 1
        self.left, self.right, self.rank = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for t, (a, b, r) in m.parts.items():
            self.left[t], self.right[t], self.rank[t] = a, b, r
        pairs = np.fromiter((x for (a, b), (r, t) in m.pair.items() for x in (a << 20 | b, r, t)), np.int64, 3 * len(m.pair)).reshape(-1, 3)
        self.pairs, self.pair_rank, self.pair_made = Lookup(pairs[:, 0]), pairs[:, 1], pairs[:, 2]
        byte = {c: b for b, c in enumerate(CHARS)}
        edge, self.accept = {}, [-1]
        for s, t in m.vocab.items():
            ended = bool(m.suffix) and s.endswith(m.suffix)
            node = 0
            for c in [*map(byte.get, s.removesuffix(m.suffix) if ended else s), *([END] if ended else [])]:
                if c is None:
                    break
                key = node << 9 | c
                if key not in edge:
                    edge[key] = len(self.accept)
                    self.accept.append(-1)
                node = edge[key]
            else:
                self.accept[node] = t
        self.accept = np.array(self.accept, np.int64)
        self.edges, self.child = Lookup(np.fromiter(edge, np.int64, len(edge))), np.fromiter(edge.values(), np.int64, len(edge))
        self.ended = bool(m.suffix)
        self.in_order = all(r > max(self.rank[a], self.rank[b]) for (a, b), (r, _) in m.pair.items())
        self.byte = np.array([m.vocab.get(c, -1) for c in CHARS], np.int64)
        self.last_byte = np.array([m.vocab.get(c + m.suffix, -1) for c in CHARS], np.int64)

    def longest(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches from the left of the words data[start:end], each followed by an END: (tokens, tokens a word)."""
        tokens, words = [], []
        live, at = np.arange(len(start)), start.copy()
        while len(live):
            token, far = np.full(len(live), -1, np.int64), at.copy()
            act, p, stop, node = np.arange(len(live)), at, end[live], np.zeros(len(live), np.int64)
            while len(act):
                symbol = np.where(p < stop, data[np.minimum(p, len(data) - 1)].astype(np.int64), END)
                k = self.edges.get(node << 9 | symbol)
                go = k >= 0
                act, p, stop, node = act[go], p[go] + 1, stop[go], self.child[k[go]]
                t = self.accept[node]
                good = (t >= 0) & ((p != stop) | (not self.ended))  # what takes the last byte must take the end too
                token[act[good]], far[act[good]] = t[good], p[good]
                more = p <= stop
                act, p, stop, node = act[more], p[more], stop[more], node[more]
            if (token < 0).any():
                raise ValueError("the vocabulary lacks a byte")
            tokens.append(token)
            words.append(live)
            more = far < end[live] + self.ended
            live, at = live[more], far[more]
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        home = np.concatenate(words)
        return np.concatenate(tokens)[np.argsort(home, kind="stable")], np.bincount(home, minlength=len(start))


END = 256


class Merges:
    """The merge table of a tokenizer file.

    parts[t] is (left, right, rank) of the merge that makes token t; single symbols have none. A token's left (right)
    edge is the chain of its leftmost (rightmost) parts, down to a symbol.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        merges = model.pop("merges")
        merges.reverse()  # taken from the end, so that what is read is not held twice
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank in range(len(merges)):
            m = merges.pop()
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.pair[left, right] = rank, made
            self.parts[made] = left, right, rank
        self.longest = max(map(len, self.vocab))
        self._edges: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        self.known_fits: dict[int, bool] = {}

    @cached_property
    def tables(self) -> Tables:
        return Tables(self)

    def edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """(part, its own rank or -1, rank at which it is merged into the next larger part) along one edge, the whole token first."""
        key = token, side
        if key not in self._edges:
            out, t, above = [], token, 1 << 30
            while True:
                p = self.parts.get(t)
                out.append((t, p[2] if p else -1, above))
                if not p:
                    break
                t, above = p[side], p[2]
            self._edges[key] = out
        return self._edges[key]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the symbols of a and b together leaves exactly a and b.

        A merge over their border happens if it comes when its left part is there (made before, and not yet part of
        something larger) and so is its right part; of equal ranks the leftmost goes first.
        """
        key = a << 20 | b
        known = self.known_fits.get(key)
        if known is None:
            known, pair = True, self.pair
            for x, made_x, gone_x in self.edge(a, 1):
                for y, made_y, gone_y in self.edge(b, 0):
                    m = pair.get((x, y))
                    if m and made_x < m[0] < gone_x and made_y < m[0] <= gone_y:
                        known = False
                        break
                if not known:
                    break
            if len(self.known_fits) < 1_000_000:
                self.known_fits[key] = known
        return known

    def fits_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`fits` for arrays of pairs: every part of a's right edge against every part of b's left edge, walked in step."""
        t = self.tables
        pairs, back = np.unique(a.astype(np.int64) << 20 | b, return_inverse=True)
        good = np.ones(len(pairs), bool)
        at, x = np.arange(len(pairs)), pairs >> 20
        gone_x = np.full(len(pairs), FAR)
        while len(at):
            k, y, gone_y = np.arange(len(at)), pairs[at] & ((1 << 20) - 1), np.full(len(at), FAR)
            while len(k):
                m = t.pairs.get(x[k] << 20 | y)
                r = np.where(m >= 0, t.pair_rank[m], -1)
                clash = (m >= 0) & (t.rank[x[k]] < r) & (r < gone_x[k]) & (t.rank[y] < r) & (r <= gone_y)
                good[at[k[clash]]] = False
                more = ~clash & (t.left[y] >= 0)
                k, y = k[more], y[more]
                y, gone_y = t.left[y], t.rank[y]
            more = good[at] & (t.right[x] >= 0)
            at, x = at[more], x[more]
            x, gone_x = t.right[x], t.rank[x]
        return good[back]

    def merge_all(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words at once, their symbols one after the other: (tokens, tokens a word).

        In each round every word merges the pair of its lowest rank, wherever it stands, from the left. That is what
        merging one by one gives if no merge that takes a token comes before the one that makes it (`in_order`).
        """
        t = self.tables
        made, where = [], []
        home = np.repeat(np.arange(len(size)), size)
        ids = ids.astype(np.int64)

        def ranks(k: np.ndarray) -> np.ndarray:
            """Of the pairs that begin at k."""
            inside = np.flatnonzero(k + 1 < len(ids))
            inside = inside[home[k[inside]] == home[k[inside] + 1]]
            m = t.pairs.get(ids[k[inside]] << 20 | ids[k[inside] + 1])
            out = np.full(len(k), FAR)
            out[inside] = np.where(m >= 0, t.pair_rank[m], FAR)
            return out

        rank = ranks(np.arange(len(ids)))
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]]))
            each = np.diff(np.append(first, len(home)))
            least = np.minimum.reduceat(rank, first)
            done = np.repeat(least == FAR, each)
            if done.any():
                made.append(ids[done])
                where.append(home[done])
                ids, home, rank = ids[~done], home[~done], rank[~done]
                live = least < FAR
                least, each = least[live], each[live]
                if not len(ids):
                    break
            low = rank == np.repeat(least, each)
            at = np.flatnonzero(low)
            run = np.concatenate([[True], at[1:] != at[:-1] + 1])  # of a run of places each second one merges
            if not run.all():
                begin = np.flatnonzero(run)
                at = at[(np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))) % 2 == 0]
            ids[at] = t.pair_made[t.pairs.get(ids[at] << 20 | ids[at + 1])]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            new = (np.cumsum(keep) - 1)[at]
            ids, home, rank = ids[keep], home[keep], rank[keep]
            near = np.zeros(len(ids), bool)
            near[new] = True
            near[new[new > 0] - 1] = True
            fresh = np.flatnonzero(near)
            rank[fresh] = ranks(fresh)
        if not made:
            return ids, np.zeros(len(size), np.int64)
        tokens, home = np.concatenate(made), np.concatenate(where)
        order = np.argsort(home, kind="stable")
        return tokens[order], np.bincount(home, minlength=len(size))

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging: always the pair of lowest rank, the leftmost of equals."""
        n = len(ids)
        ids, nxt, prv = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            m = self.pair.get((ids[i], ids[i + 1]))
            if m:
                heap.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for k in (prv[i], i):
                if k >= 0 and nxt[k] < n:
                    m = self.pair.get((ids[k], ids[nxt[k]]))
                    if m:
                        heapq.heappush(heap, (m[0], k, ids[k], ids[nxt[k]], m[1]))
        return [t for t in ids if t >= 0]


def load(path: str) -> Merges:
    """The table of a file."""
    return Merges(path)
