"""Document fingerprints by I-Match.

The lexicon holds the terms whose document frequency lies in a band (a band of inverse document frequency), counted
over all documents. A document's distinct lexicon terms, sorted, are hashed once for each of SUBSETS randomised parts
of the lexicon, which keep a term with probability 2**-level; the level follows the number of terms, and two levels are
hashed, so that documents of like size share one. The likeness of two fingerprints is the share of equal hashes among
the subsets that are not empty in both.

A lexicon has at most (terms a document) / LOW terms, whatever the number of documents: each is in LOW of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.llm.textkit import LOWER, U, distinct_in_rows, find_words, mix, prefix_hash, small_batches, span_hash, text_chunks

LOW, HIGH = 0.001, 0.2  # band of document frequency, as shares of all documents
SUBSETS = 24
STRETCH = 2_000_000
TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SEEDS = mix(np.arange(1, SUBSETS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, term), sorted and distinct."""
    low = LOWER[data]
    s, e, row = find_words(low, offs, TERM)
    h = span_hash(prefix_hash(low), s, e)
    return distinct_in_rows(row, h)


def _frequencies(share: float, only: np.ndarray | None):
    """(term, n): documents of each stretch of rows with the term; only terms in at least `share` of them, or only those given."""

    def run(batches):
        held, docs = [], 0

        def flush():
            v, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c >= share * docs
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v[keep].view(np.int64)), pa.array(c[keep].astype(np.int64))], names=["term", "n"])

        for batch in batches:
            for i, j, data, offs in text_chunks(batch):
                _, h = terms(data, offs)
                if only is not None:
                    h = h[_find(only, h) >= 0]
                held.append(h)
                docs += j - i
                if sum(map(len, held)) > STRETCH:
                    yield flush()
                    docs = 0
        if held:
            yield flush()

    return run


def _find(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.full(len(h), -1)
    k = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[k] == h, k, -1)


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH, most: int = 4_000_000) -> np.ndarray:
    """Terms in between low * N and high * N of the N documents, and in two at least; sorted hashes.

    A term in low * N documents is in that share of some stretch of rows, so only terms that are get counted exactly,
    in a second pass. If those were over `most`, all terms are counted by a shuffle instead.
    """
    small_batches(docs.sparkSession)
    n = docs.count()
    text, kind = docs.select("text"), "term long, n long"
    some = text.mapInArrow(_frequencies(low, None), kind).select("term").distinct()
    if some.count() <= most:
        only = np.sort(some.toPandas()["term"].to_numpy(np.int64).view(U))
        counted = text.mapInArrow(_frequencies(0.0, only), kind)
    else:
        counted = text.mapInArrow(_frequencies(0.0, None), kind)
    band = counted.groupBy("term").agg(F.sum("n").alias("n")).where((F.col("n") >= max(2.0, low * n)) & (F.col("n") <= max(2.0, high * n)))
    return np.sort(band.select("term").toPandas()["term"].to_numpy(np.int64).view(U))


def zeros(lex: np.ndarray) -> np.ndarray:
    """(terms, SUBSETS) leading zero bits of each term's number in each subset: it is kept with probability 2**-level where there are `level` of them."""
    out = np.empty((len(lex), SUBSETS), np.uint8)
    for k in range(0, len(lex), 1 << 16):
        u = mix(lex[k : k + (1 << 16), None] ^ SEEDS[None, :])
        high, low = (u >> U(32)).astype(np.float64), (u & U(0xFFFFFFFF)).astype(np.float64)
        out[k : k + (1 << 16)] = 64 - np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])
    return out


class Prints:
    """Fingerprints of a run of texts: level, hashes (texts, 2, SUBSETS) with 0 for an empty subset, and a hash of all terms where none is in the lexicon."""

    def __init__(self, lex: np.ndarray, texts: list[str], lead: np.ndarray | None = None):
        lead = zeros(lex) if lead is None else lead
        raw = [t.encode() for t in texts]
        offs = np.cumsum([0, *map(len, raw)])
        row, h = terms(np.frombuffer(b"".join(raw), np.uint8), offs)
        n = len(texts)
        total = np.zeros(len(h) + 1, U)
        np.cumsum(mix(h), out=total[1:])
        ends = np.searchsorted(row, np.arange(n), "right")
        starts = np.searchsorted(row, np.arange(n), "left")
        self.all = total[ends] - total[starts]
        term = _find(lex, h)
        inside = term >= 0
        row, h, term = row[inside], h[inside], term[inside]
        count = np.bincount(row, minlength=n)
        self.none = count == 0
        self.level = np.where(self.none, -9, np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1)
        self.hash = np.zeros((n, 2, SUBSETS), np.int64)
        if len(row):
            # of a text's terms each subset keeps about one: only those are hashed
            at, subset = np.nonzero(lead[term] >= self.level[row].astype(np.uint8)[:, None])
            one = mix(mix(h[at] ^ SEEDS[subset]) + U(1))
            deeper = lead[term[at], subset] > self.level[row[at]]
            for k, (x, cell) in enumerate(((one, row[at] * SUBSETS + subset), (one[deeper], (row[at] * SUBSETS + subset)[deeper]))):
                part = np.zeros(n * SUBSETS, U)
                np.add.at(part, cell, x)
                some = np.bincount(cell, minlength=n * SUBSETS) > 0
                self.hash[:, k] = np.where(some, (mix(part) >> U(40)).astype(np.int64) | 1, 0).reshape(n, SUBSETS)

    def name(self, i: int) -> str:
        if self.none[i]:
            return f"all:{int(self.all[i]):016x}"
        return f"{self.level[i]}:" + "".join([f"{x:06x}" for x in self.hash[i].ravel().tolist()])

    def like(self, i: np.ndarray, other: Prints, j: np.ndarray) -> np.ndarray:
        """Likeness of fingerprints i to fingerprints j of the other run, 0 to 1."""
        a, b = self.hash[i], other.hash[j]
        step = other.level[j] - self.level[i]
        equal, either = np.zeros(len(i)), np.zeros(len(i))
        for x in (0, 1):
            for y in (0, 1):
                same_level = step == x - y
                equal += same_level * ((a[:, x] == b[:, y]) & (a[:, x] > 0)).sum(1)
                either += same_level * ((a[:, x] > 0) | (b[:, y] > 0)).sum(1)
        both_none = self.none[i] & other.none[j]
        whole = both_none & (self.all[i] == other.all[j])
        same = (a == b).all((1, 2)) & (step == 0) & ~both_none
        return np.where(whole | same, 1.0, np.where(both_none | self.none[i] | other.none[j] | (either == 0), 0.0, equal / np.maximum(either, 1)))


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by as much of the start of the next one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
ROWS = 300


def _compare(lex: np.ndarray):
    """Of rows in order (part, head, id), each with the next; a head is the first row after a part and is not given itself."""

    lead = None

    def solve(rows: list[tuple], after: tuple):
        rows_ = [*rows, after]
        texts = [r[2] for r in rows_]
        new = [edited(t, x) for t, x in zip(texts, texts[1:], strict=False)]
        own, other = Prints(lex, texts, lead), Prints(lex, new, lead)
        at = np.flatnonzero([not r[1] for r in rows])
        cols = [[rows[k][3] for k in at], [len(texts[k]) for k in at], [hashlib.sha256(new[k].encode()).hexdigest() for k in at], [own.name(k) for k in at], [other.name(k) for k in at], own.like(at, other, at), own.like(at, own, at + 1)]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in OUT.split(", ")])

    def run(batches):
        nonlocal lead
        held: list[tuple] = []
        lead = zeros(lex)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "head", "text", "doc_id")), strict=True):
                held.append((row[0], row[1], row[2] or "", row[3]))
                if len(held) > ROWS or sum(map(len, (held[0][2], held[-1][2]))) > 1 << 20:
                    if len(held) > 1:
                        yield solve(held[:-1], held[-1])
                        del held[:-1]
        if held:
            yield solve(held, held[-1])  # a head ends each part, so the last row is one

    return run


def fingerprints(docs: DataFrame, lex: np.ndarray) -> DataFrame:
    """The columns of OUT for each document row.

    Null texts are empty; a text of any length is held whole by one task, with the one after it. Rows follow each other by doc_id, then text; null ids come first; after the last comes the
    first. Texts with no term of the lexicon are told apart by all their terms; a table of one row follows itself.
    """
    spark = docs.sparkSession
    small_batches(spark)
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(x.agg(F.percentile_approx("key", [k / parts for k in range(1, parts)], 100 * parts)).first()[0] or []))
    # constants of one expression each, however many parts there are
    part = F.expr(f"size(filter(cast(split('{','.join(map(str, cuts))}', ',') as array<bigint>), c -> c < key))") if cuts else F.lit(0)
    x = x.withColumn("part", part)
    firsts = sorted((r["part"], r["key"]) for r in x.groupBy("part").agg(F.min("key").alias("key")).collect())  # one row a part
    if not firsts:
        return x.select(F.lit(0).alias("part"), F.lit(True).alias("head"), "text", "doc_id").mapInArrow(_compare(lex), OUT)
    before = {firsts[(k + 1) % len(firsts)][1]: p for k, (p, _) in enumerate(firsts)}  # the part that a first row follows
    named = f"str_to_map('{','.join(f'{k}:{p}' for k, p in before.items())}')"
    extra = x.withColumn("part", F.expr(f"cast({named}[cast(key as string)] as int)")).where("part is not null")
    both = x.withColumn("head", F.lit(False)).unionByName(extra.withColumn("head", F.lit(True)))
    return both.repartition(parts, "part").sortWithinPartitions("part", "head", "key", "text").select("part", "head", "text", "doc_id").mapInArrow(_compare(lex), OUT)


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fingerprints(docs, lexicon(docs))
