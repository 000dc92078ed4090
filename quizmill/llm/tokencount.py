"""Token counts by dynamic programming over prefixes.

The encoding of a prefix is the encoding of a shorter prefix and one more token: of the vocabulary's tokens that end
at a place, exactly one can stand after the last token of the prefix before it (`Merges.fits`). So one pass over a
word gives the exact token count at every one of its prefixes, and the count of a text at every prefix is the sum of
the words before and the count within the word at the cut. The counts at all prefixes of a word are kept, and questions
about truncation and budgets are look-ups: a cut only splits the words next to it anew.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.llm.merges import WORDS, Merges, load, spelled
from quizmill.llm.textkit import only, small_batches, text_array

LIMIT = 1024
KEPT_BYTES = 256  # longer words are worked out each time
NEAR = 16  # characters after a word's start where a cut can split the text with fewer tokens than the word's own prefix has
KEPT_WORDS, KEPT_PIECES = 600_000, 600_000  # remembered by a worker, about 250 bytes each; those of one batch come on top
ANEW = regex.compile(r"[^\S ]|\s |'").search  # where a cut can change the words before it, special strings aside
WIDE = regex.compile(r"\s ").search  # white space before a space


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PrefixCounts:
    """Exact token counts of texts and of all their prefixes for one byte-level vocabulary."""

    def __init__(self, path: str):
        self.m: Merges = load(path)
        self.words: dict[str, bytes | array] = {}
        self.pieces: dict[str, int] = {"": 1}

    def _extend(self, s: str, counts: list[int], last: list[int]) -> None:
        """Appends what is missing of the counts and last tokens at the prefixes of a spelled word."""
        vocab, fits, known, longest = self.m.vocab, self.m.fits, self.m.known_fits, self.m.longest
        for i in range(len(counts), len(s) + 1):
            for j in range(i - 1, max(0, i - longest) - 1, -1):
                t = vocab.get(s[j:i])
                if t is not None:
                    a = last[j]
                    if a >= 0:
                        ok = known.get(a << 20 | t)
                        if ok is None:
                            ok = fits(a, t)
                        if not ok:
                            continue
                    counts.append(counts[j] + 1)
                    last.append(t)
                    break
            else:
                raise ValueError("no token ends here; the vocabulary lacks a byte")

    def word(self, word: str) -> list[int]:
        """counts[i]: tokens of the first i bytes of a word, on their own."""
        counts, last = [0], [-1]
        self._extend(spelled(word), counts, last)
        return counts

    def _keep(self, word: str, counts: list[int]) -> bytes | array:
        c = bytes(counts) if max(counts) < 256 else array("I", counts)
        if len(c) <= KEPT_BYTES:
            self.words[word] = c
        return c

    def _learn(self, words: set[str]) -> None:
        """`word` of many words, remembered: in sorted order the prefix that a word shares with the one before is not gone over again."""
        counts, last, before = [0], [-1], ""
        for s, word in sorted([(spelled(w), w) for w in words]):
            k, most = 0, min(len(s), len(before))
            while k < most and s[k] == before[k]:
                k += 1
            del counts[k + 1 :], last[k + 1 :]
            self._extend(s, counts, last)
            self._keep(word, counts)
            before = s

    def _counts(self, word: str) -> bytes | array:
        """`word`, remembered for short words: a byte a count if that is enough."""
        c = self.words.get(word)
        if c is None:
            c = self._keep(word, self.word(word))
        return c

    def _word_total(self, word: str) -> int:
        return self._counts(word)[-1]

    def _plain(self, text: str) -> int:
        return sum(map(self._word_total, WORDS.findall(text)))

    def _run(self, text: str) -> int:
        if self.m.split_special is None:
            return self._plain(text)
        return sum(1 if k % 2 else self._plain(x) for k, x in enumerate(self.m.split_special.split(text)))

    def _learn_pieces(self, new: set[str]) -> None:
        """Counts of pieces, remembered; all new words of theirs are worked out together."""
        odd = [p for p in new if p[-1].isspace() or any(x in p for x in self.m.special)]
        plain = list(new.difference(odd))
        if plain:
            found, words = WORDS.findall(" " + " ".join(plain)), self.words
            self._learn({w for w in found if w not in words and len(w) <= KEPT_BYTES})
            n = []
            for w in found:
                c = words.get(w)
                c = self._word_total(w) if c is None else c[-1]
                if w[0] == " ":
                    n.append(c)
                else:
                    n[-1] += c
            self.pieces.update(zip(plain, n, strict=True))
        for p in odd:
            self.pieces[p] = self._run(" " + p)

    def totals(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts.

        A text falls into pieces, each a space and what follows up to the next space. No word of the splitting rule
        goes over the start of a piece unless white space stands before it, so pieces are counted once and remembered.
        Beyond KEPT_PIECES only those stay that came again in these texts, beyond KEPT_WORDS no word does, so that what
        later texts repeat is remembered as well.
        """
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        split = [None if WIDE(t) else t.split(" ") for t in texts]
        seen: set[str] = set()
        for x in split:
            if x is not None:
                seen.update(x[1:])
        new = seen.difference(self.pieces.keys())
        if new:
            self._learn_pieces(new)
        count = self.pieces.__getitem__
        out = [self._run(t) if x is None else self._run(x[0]) + sum(map(count, x[1:])) for t, x in zip(texts, split, strict=True)]
        if len(self.pieces) > KEPT_PIECES:
            self.pieces = {p: count(p) for p in seen.difference(new)} | {"": 1}
        return out

    def total(self, text: str) -> int:
        return self.totals([text])[0]

    def table(self, text: str, budget: int | None = None) -> tuple[np.ndarray, np.ndarray, list[bytes | array | None]]:
        """(ends, counts, within): after each word the bytes and tokens so far, and the counts at the prefixes of each word (None: a special string).

        With a budget the table ends three words after the one that exceeds it.
        """
        ends, counts, within, more = [0], [0], [], 3
        for k, x in enumerate(self.m.split_special.split(text) if self.m.split_special else [text]):
            for w in (x,) if k % 2 else (m[0] for m in WORDS.finditer(x)):
                c = None if k % 2 else self._counts(w)
                ends.append(ends[-1] + len(w.encode()))
                counts.append(counts[-1] + (1 if c is None else c[-1]))
                within.append(c)
                if budget is not None and counts[-1] > budget:
                    more -= 1
                    if more < 0:
                        return np.array(ends), np.array(counts), within
        return np.array(ends), np.array(counts), within

    def _at(self, raw: bytes, n_bytes: int, table: tuple[np.ndarray, np.ndarray, list[bytes | array | None]]) -> int:
        ends, counts, within = table
        k = int(np.searchsorted(ends, n_bytes, "right")) - 1
        k = max(0, k - 2)
        while k and raw[ends[k] - 1 : ends[k]].isspace():
            k -= 1
        n, at, text = int(counts[k]), int(ends[k]), raw[ends[k] : n_bytes].decode()
        for i, x in enumerate(self.m.split_special.split(text) if self.m.split_special else [text]):
            for w in (x,) if i % 2 else (m[0] for m in WORDS.finditer(x)):
                size = len(w.encode())
                while k < len(within) and ends[k] < at:
                    k += 1
                c = within[k] if k < len(within) and ends[k] == at else None
                n += 1 if i % 2 else c[size] if c is not None and size < len(c) else self._word_total(w)
                at += size
        return n

    def at(self, text: str, n_bytes: int, table: tuple[np.ndarray, np.ndarray, list[bytes | array | None]] | None = None) -> int:
        """Tokens of the first n_bytes bytes of a text (cut between characters).

        What the cut can change is only the word that it goes through and a run of white space or a special string
        before it; that stretch is split anew and its words are looked up as prefixes of the text's words.
        """
        return self._at(text.encode(), n_bytes, table or self.table(text))

    def fit(self, text: str, budget: int) -> int:
        """Bytes of the longest start of a text, cut between characters, whose tokens do not exceed the budget.

        Whole pieces are passed over by their counts up to two before the one that exceeds the budget.
        """
        if WIDE(text):
            return self._fit(text, budget)
        first, *rest = text.split(" ", budget + 2)[: budget + 2]  # each piece but the first has a token at least
        new = {p for p in rest if p not in self.pieces}
        if new:
            self._learn_pieces(new)
        sums = list(accumulate(map(self.pieces.__getitem__, rest), initial=self._run(first)))
        k = bisect_right(sums, budget) - 2
        if k <= 0:
            return self._fit(text, budget)
        start = " ".join([first, *rest[: k - 1]])
        near = "".join([" " + p for p in rest[k - 1 : k + 9]]) if k + 9 < len(rest) else text[len(start) :]  # a table ends three words after the one that exceeds
        return len(start.encode()) + self._fit(near, budget - sums[k - 1])

    def _fit(self, text: str, budget: int) -> int:
        t = ends, counts, within = self.table(text, budget)
        if counts[-1] <= budget:
            return int(ends[-1])
        raw = text.encode()
        whole = lambda p: p == len(raw) or raw[p] & 0xC0 != 0x80
        k = int(np.searchsorted(counts, budget, "right")) - 1  # the word that exceeds the budget
        if None not in within[max(0, k - 1) :] and not ANEW(raw[ends[max(0, k - 1)] : ends[-1]].decode()):
            c, left = within[k], budget - int(counts[k])  # no cut from here on splits what stands before it anew
            return next(int(ends[k]) + i for i in range(len(c) - 1, -1, -1) if c[i] <= left and whole(int(ends[k]) + i))
        # a cut that splits anew can have fewer tokens than the look-up says: just after the start of this word or the next ones
        for p in sorted({p for e in ends[k : k + 3] for p in range(e, min(int(ends[-1]), e + 4 * NEAR) + 1)}, reverse=True):
            if whole(p) and self._at(raw, p, t) <= budget:
                near = p
                break
        else:
            near = 0
        c, left = within[k], budget - int(counts[k])
        for i in range(len(c) - 1 if c is not None else 0, max(0, near - int(ends[k])), -1):
            if c[i] <= left and whole(int(ends[k]) + i) and self._at(raw, int(ends[k]) + i, t) <= budget:
                return int(ends[k]) + i
        for p in range(int(ends[k]), near, -1):
            if whole(p) and self._at(raw, p, t) <= budget:
                return p
        return near


def counter(path: str) -> PrefixCounts:
    return only("counter", path, PrefixCounts)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, find: Callable[[], str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_bytes (the longest start within the limit, cut between characters).

    Null and empty texts have 0 bytes and 0 tokens. Each row is counted for itself: repeated rows give repeated rows, an
    empty table none. A text of any length is counted whole, by one task; no other column is read.
    """

    def run(batches):
        c = counter(find() if find else path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            _, offs = text_array(batch)
            size = np.diff(offs)
            n = np.array(c.totals([t or "" for t in texts]), np.int64)
            over = n > limit
            fit = [c.fit(t, limit) if o else int(b) for t, o, b in zip(texts, over, size, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(over), pa.array(fit, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_bytes"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), "", find=vocabulary)
