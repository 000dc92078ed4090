"""Byte-pair encoding and decoding: speculate and verify.

Texts are worked on a run of some hundred kilobytes at a time, in arrays: split into words, equal words found, and each different
word encoded once. Greedy longest match over a tree of the vocabulary proposes tokens; whether two tokens may stand side
by side is tested for every adjacent pair at once; a word whose pairs all pass has its exact encoding. Only the words
that fail undergo exact merging. Nothing is remembered from one run to the next, so a worker's memory does not grow with
the number of different words.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.llm.merges import Merges, load
from quizmill.llm.textkit import CHUNK, give_back, only, prefix_hash, small_batches, span_hash, text_array

RUN = CHUNK >> 2  # characters of text worked on at once; one longer text is a run of its own. A run's arrays take some 100 bytes a character
LONG = 512  # bytes of a word that is merged by itself, if it fails
SPACE, OTHER, LETTER, NUMBER, MARK = range(5)  # kinds of characters; a mark stands for a special string
MARKS = 0xD800  # first code point of marks: surrogates are in no text


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def lowered(text: str) -> str:
    """NFC, then each character in lower case by itself (no rule for a final sigma)."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def kinds() -> np.ndarray:
    """The kind of every code point."""
    every = np.concatenate([np.arange(MARKS), np.arange(0xE000, 0x110000)]).astype("<u4").tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = (x if x <= MARKS else x + 0x800 for x in m.span())
            out[a:b] = kind
    out[MARKS:0xE000] = MARK
    return out


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first[k], first[k] + 1, ... (size[k] of them) of each k, one after the other."""
    ends = np.cumsum(size)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if n < 1 << 30 and (not len(first) or first.max() < 1 << 30) else np.int64
    out = np.repeat((first - (ends - size)).astype(kind), size)
    out += np.arange(n, dtype=kind)
    return out


class Codec:
    """Encodes and decodes for a vocabulary with word ends, lower case and white space dropped."""

    def __init__(self, path: str):
        self.m: Merges = load(path)
        self.kind = kinds()
        self.special = list(self.m.special.items())
        self.proposed = self.failed = 0

    def prepared(self, text: str) -> str:
        """Lower-cased, special strings as marks."""
        split = self.m.split_special
        if split is None or not any(s in text for s, _ in self.special):
            return lowered(text)
        mark = {s: chr(MARKS + k) for k, (s, _) in enumerate(self.special)}
        return "".join([mark[x] if k % 2 else lowered(x) for k, x in enumerate(split.split(text))])

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends, words a text) of the words of prepared texts: letters, other characters, one number, one mark, or an apostrophe with an ending."""
        whole = "".join(texts)
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        data = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
        n = len(code)
        offs = np.cumsum([0, *map(len, texts)])
        kind = self.kind[code]
        border = np.zeros(n + 3, bool)
        border[offs] = True
        begin = border[:n].copy()
        begin[1:] |= kind[1:] != kind[:-1]
        begin |= kind >= NUMBER
        begin &= kind != SPACE
        at = np.flatnonzero((code == 0x27) & begin)
        if len(at):  # an apostrophe that begins a word takes one of a few endings
            far = np.concatenate([code, np.zeros(2, code.dtype)])
            a, b = far[at + 1], far[at + 2]
            one = np.isin(a, list(map(ord, "stmd"))) & ~border[at + 1]
            two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & ~border[at + 1] & ~border[at + 2]
            begin[at[one | two] + 1] = False
            rest = np.concatenate([at[one] + 2, at[two] + 3])
            rest = rest[rest < n]
            begin[rest[kind[rest] != SPACE]] = True
        last = np.zeros(n, bool)
        if n:
            last[:-1] = begin[1:] | (kind[1:] == SPACE)
            last[-1] = True
            last &= kind != SPACE
        s, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
        count = np.diff(np.searchsorted(s, offs))
        if len(data) > n:
            byte = np.zeros(n + 1, np.int64)
            np.cumsum(1 + (code >= 0x80).astype(np.int8) + (code >= 0x800) + (code >= 0x10000), out=byte[1:])
            s, e = byte[s], byte[e]
        return data, s, e, count

    def tokens(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, tokens a word) of words of bytes, each by itself."""
        t = self.m.tables
        ids, size = t.longest(data, s, e)
        home = np.repeat(np.arange(len(s)), size)
        inner = np.flatnonzero(home[1:] == home[:-1])
        wrong = np.zeros(len(s), bool)
        wrong[home[inner[~self.m.fits_all(ids[inner], ids[inner + 1])]]] = True
        self.proposed += len(s)
        self.failed += int(wrong.sum())
        if not wrong.any():
            return ids, size
        many = wrong & (e - s <= LONG) & t.in_order
        k = np.flatnonzero(many)
        width = e[k] - s[k]
        symbols = t.byte[data[spread(s[k], width)]]
        symbols[np.cumsum(width) - 1] = t.last_byte[data[e[k] - 1]]
        parts = [(k, *self.m.merge_all(symbols, width))]
        for j in np.flatnonzero(wrong & ~many):
            one = self.m.merge([*t.byte[data[s[j] : e[j] - 1]].tolist(), int(t.last_byte[data[e[j] - 1]])])
            parts.append((np.array([j]), np.array(one, np.int64), np.array([len(one)])))
        good = np.flatnonzero(~wrong)
        parts.append((good, ids[~wrong[home]], size[good]))
        word, flat, each = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(word)
        first = np.cumsum(each) - each
        return flat[spread(first[order], each[order])], each[order]

    def encode_run(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """Ids and decoded string of each text of a run."""
        data, s, e, count = self.words([self.prepared(t) for t in texts])
        if not len(s):
            return [(np.zeros(0, "<u4"), "")] * len(texts)
        h = span_hash(prefix_hash(data), s, e)
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        size, rep = e - s, first[back]
        if (size != size[rep]).any() or (data[spread(s, size)] != data[spread(s[rep], size)]).any():  # two words of one hash
            first = back = np.arange(len(s))
        u, v = s[first], e[first]
        marks = np.flatnonzero((data[u] == 0xED) & (v - u == 3))
        marks = marks[data[u[marks] + 1] >= 0xA0]  # a surrogate, so a special string
        plain = np.ones(len(u), bool)
        plain[marks] = False
        ids, n = self.tokens(data, u[plain], v[plain])
        each = np.ones(len(u), np.int64)
        each[plain] = n
        begin = np.cumsum(each) - each
        flat = np.empty(int(each.sum()), np.int64)
        flat[spread(begin[plain], n)] = ids
        for k in marks:
            flat[begin[k]] = self.special[ord(data[u[k] : v[k]].tobytes().decode("utf-8", "surrogatepass")) - MARKS][1]
        names, step = self.m.names, flat.tolist()
        said = [names[step[b]] if c == 1 else " ".join([names[t] for t in step[b : b + c]]) for b, c in zip(begin.tolist(), each.tolist(), strict=True)]
        all_ids = flat[spread(begin[back], each[back])].astype("<u4")
        ends = np.concatenate([[0], np.cumsum(count)])
        cuts = np.concatenate([[0], np.cumsum(each[back])])[ends].tolist()
        words, ends = list(map(said.__getitem__, back.tolist())), ends.tolist()
        return [(all_ids[cuts[k] : cuts[k + 1]], " ".join(words[ends[k] : ends[k + 1]])) for k in range(len(texts))]

    def encode_texts(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """Ids and decoded string of each text."""
        out, k = [], 0
        while k < len(texts):
            j, size = k, 0
            while j < len(texts) and (j == k or size + len(texts[j]) <= RUN):
                size += len(texts[j])
                j += 1
            out += self.encode_run(texts[k:j])
            k = j
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_run([text])[0][0]

    def decode(self, ids) -> str:
        """The strings of the tokens with a space between; this kind of file has no decoder that would drop word ends."""
        names = self.m.names
        return " ".join([names[int(t)] for t in ids])


def codec(path: str) -> Codec:
    return only("codec", path, Codec)


def encode(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and ids (array) if asked for; a row for each row of docs.

    Null and empty texts and texts of white space have no tokens. Repeated rows give repeated rows; an empty table gives
    none; columns other than doc_id and text are not read. A text of any length is encoded whole, by one task.
    """

    def run(batches):
        c = codec(vocabulary())
        for batch in batches:
            at, (_, offs) = 0, text_array(batch)
            while at < batch.num_rows:
                k = max(at + 1, int(np.searchsorted(offs, offs[at] + RUN, "right")) - 1)
                both = c.encode_run([t or "" for t in batch.column(1).slice(at, k - at).to_pylist()])
                cols = [batch.column(0).slice(at, k - at), pa.array([len(a) for a, _ in both], pa.int64()), pa.array([hashlib.sha256(a.tobytes()).hexdigest() for a, _ in both]), pa.array([hashlib.sha256(b.encode()).hexdigest() for _, b in both])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ends = np.cumsum([0, *(len(a) for a, _ in both)])
                    cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([a for a, _ in both]).astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
                at = k
            both = cols = None
            give_back()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: token ids of every document that is left, as `encode` gives them; null and empty texts have none."""
    return encode(docs, with_ids=True)
