"""Benchmark decontamination with a distributed positional inverted index.

Words are the runs `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. A window is `width`
consecutive words of a benchmark item; an item of fewer words, but not none, is one window.

1. The index: each document row's postings (term -> positions in order), written once to the shared folder, for terms
   that may be of the benchmark. What tells them is a bitmap of 2**BITS bits, the same size whatever the benchmark.
2. Items become passages: their terms, in pieces of bounded length that overlap so that each window is in one. Equal
   passages of several items are searched once.
3. The lengths of the posting lists, summed over all documents, tell how rare each term is. The rarest term of each
   window is looked up in the index: a join on the term gives the documents that a passage may be in.
4. Passages travel to those documents' postings; the index is dealt out once, by document, at every size. There the list of each window's rarest term, less the
   term's offset, gives the possible starts, and the offset-adjusted lists of its other terms, from the next rarest to
   the most frequent, are intersected with them. What is left are exact phrase matches.

Proximity matches: of a window's NEAR_TERMS rarest terms all but some (`misses`: none in short windows, one in long
ones) stand within a slop of where the phrase would have them, seen from one of them. Up to one more term than may be
missing is looked up, so every match by this rule is found.

Neither the benchmark nor matches are collected or broadcast by this module; the plan is the same at every size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.llm.textkit import LOWER, find_words, prefix_hash, small_batches, span_hash, stage, text_chunks

WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
WIDTH, SLOP, NEAR_TERMS = 13, 3, 5
PIECE = 256  # words of an item in one passage, about
BITS = 22  # the bitmap of the benchmark's terms has 2**BITS bits
PASSAGES, TOGETHER = 4096, 256  # passages whose ranks a task remembers; that are searched at once
SALT = 8  # parts that the documents of one term or one passage are dealt to


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term, row) of each word: 64-bit hashes."""
    low = LOWER[data]
    s, e, row = find_words(low, offs, WORD)
    return span_hash(prefix_hash(low), s, e).view(np.int64), row


def _pieces(width: int, piece: int):
    """(item_id, terms): an item's terms, a long one's in overlapping pieces."""
    step = max(1, piece - width + 1)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, data, offs in text_chunks(batch):
                term, row = _words(data, offs)
                first = np.searchsorted(row, np.arange(j - i + 1))
                names, parts = [], []
                for k in range(j - i):
                    t = term[first[k] : first[k + 1]]
                    for p in range(0, max(1, len(t) - width + 1), step) if len(t) else ():
                        names.append(ids[i + k])
                        parts.append(t[p : p + step + width - 1])
                if parts:
                    ends = np.cumsum([0, *map(len, parts)])
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts)))], names=["item_id", "terms"])

    return run


def passages(benchmark: DataFrame, width: int = WIDTH, piece: int = PIECE) -> DataFrame:
    """(passage, item_id, terms): a row for each piece of each item with words; equal sequences of terms share a passage (64-bit hash)."""
    x = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.octet_length("text") > 0)
    return x.mapInArrow(_pieces(width, piece), "item_id string, terms array<long>").select(F.xxhash64("terms").alias("passage"), "item_id", "terms")


def bitmap(terms: DataFrame, bits: int = BITS) -> np.ndarray:
    """A bitmap of 2**bits bits with those of the values of column `term` set."""
    low = f"term & {(1 << bits) - 1}"
    words = terms.groupBy(F.expr(f"shiftright({low}, 5)").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast(term & 31 as int)))").alias("v")).toPandas()
    out = np.zeros(1 << bits - 5, "<u4")
    out[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64)
    return out.view(np.uint8)


INDEX = "doc_id long, text_key long, n_words long, terms array<long>, counts array<int>, positions array<int>"


def _index(known: np.ndarray, bits: int):
    """One row per document row: its terms that may be of the benchmark, how often each stands there, and the positions, term by term."""

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            keys = batch.column(batch.schema.get_field_index("text_key"))
            for i, j, data, offs in text_chunks(batch):
                term, row = _words(data, offs)
                bit = term & ((1 << bits) - 1)
                at = np.flatnonzero((known[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                order = at[np.lexsort((term[at], row[at]))]
                home, t = row[order], term[order]
                first = np.flatnonzero(np.concatenate([[True], (home[1:] != home[:-1]) | (t[1:] != t[:-1])])) if len(order) else order
                place = order - np.searchsorted(row, home)
                rows = np.arange(j - i + 1)
                by_term, by_place = pa.array(np.searchsorted(home[first], rows), pa.int32()), pa.array(np.searchsorted(home, rows), pa.int32())
                lists = [(by_term, pa.array(t[first])), (by_term, pa.array(np.diff(np.append(first, len(order))), pa.int32())), (by_place, pa.array(place, pa.int32()))]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), keys.slice(i, j - i), pa.array(np.bincount(row, minlength=j - i), pa.int64()), *(pa.ListArray.from_arrays(o, v) for o, v in lists)],
                    names=["doc_id", "text_key", "n_words", "terms", "counts", "positions"],
                )

    return run


def index(docs: DataFrame, known: np.ndarray, bits: int = BITS) -> DataFrame:
    """The stored postings, with a number `uid` for each document row."""
    small_batches(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return stage(keyed.mapInArrow(_index(known, bits), INDEX).withColumn("uid", F.monotonically_increasing_id()), "postings")


def misses(width: int) -> int:
    """How many of the rarest terms of a window of so many words a proximity match may lack."""
    return min(1, width // 5)


def _rarest(width: int, slop: int, near_terms: int):
    """(passage, term) of the terms to look up: of each window that can match, the rarest that stands in any document; with a slop, one more than may be missing."""

    def run(batches):
        for batch in batches:
            out = []
            for name, terms, often in zip(*(batch.column(c).to_pylist() for c in ("passage", "terms", "often")), strict=True):
                w, n = min(width, len(terms)), np.array(often, np.int64)
                windows = np.lib.stride_tricks.sliding_window_view(np.where(n > 0, n, np.iinfo(np.int64).max), w)
                there = np.lib.stride_tricks.sliding_window_view(n > 0, w).sum(1)
                lack = misses(w) if slop else 0
                ok = np.flatnonzero(there >= (min(near_terms, w) - lack if slop else w))
                rank = np.argsort(windows[ok], axis=1, kind="stable")[:, : lack + 1]
                at = (ok[:, None] + rank).ravel()
                out += [(name, terms[k]) for k in np.unique(at[n[at] > 0]).tolist()]
            cols = list(zip(*out, strict=True)) or [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["passage", "term"])

    return run


def ranks(often: np.ndarray, w: int) -> np.ndarray:
    """For each window of w terms their places in it, the rarest first, those in no document last."""
    return np.argsort(np.lib.stride_tricks.sliding_window_view(np.where(often > 0, often, np.iinfo(np.int64).max), w), axis=1, kind="stable")


class Postings:
    """The lists of one document."""

    def __init__(self, n_words: int, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray):
        self.n, self.terms = n_words, terms  # sorted
        begin = np.cumsum(counts) - counts
        self.count, self.begin, self.position = counts, begin, positions
        self.key = np.repeat(np.arange(len(terms)), counts) << 40 | positions  # term number and position, sorted
        self.cover = np.zeros(n_words + 1, np.int64)

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """The numbers of terms in this document, -1 where it has none."""
        k = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[k] == terms, k, -1)

    def search(self, terms: np.ndarray, often: np.ndarray, width: int, rank: np.ndarray | None = None) -> tuple[np.ndarray, int]:
        """Starts of the windows of a passage that stand in this document as exact phrases, and the windows' length."""
        w, none = min(width, len(terms)), np.zeros(0, np.int64)
        if not len(self.terms):
            return none, w
        number = self.numbers(terms)
        rank = ranks(often, w) if rank is None else rank
        asked = number[np.arange(len(rank))[:, None] + rank]
        live = np.flatnonzero((asked >= 0).all(1))
        win, start = self._starts(asked, rank, live, 0)
        ok = (start >= 0) & (start + w <= self.n)
        win, start = win[ok], start[ok]
        for j in range(1, rank.shape[1]):
            if not len(win):
                break
            ok = self._stands(asked[win, j], start + rank[win, j], 0)
            win, start = win[ok], start[ok]
        return start, w

    def _starts(self, asked: np.ndarray, rank: np.ndarray, live: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) for each place of the term of rank j of the live windows."""
        t = asked[live, j]
        c = self.count[t]
        win = np.repeat(live, c)
        return win, self.position[np.repeat(self.begin[t] - (np.cumsum(c) - c), c) + np.arange(c.sum())] - rank[win, j]

    def _stands(self, number: np.ndarray, spot: np.ndarray, slop: int) -> np.ndarray:
        """Whether the terms of these numbers (-1: none) stand within slop words of the spots."""
        low = number << 40
        at = np.searchsorted(self.key, low + np.maximum(spot - slop, 0))
        ok = (number >= 0) & (spot + slop >= 0) & (at < len(self.key))
        ok[ok] = self.key[at[ok]] <= (low + spot + slop)[ok]
        return ok

    def near(self, asked: list[tuple[np.ndarray, np.ndarray]], width: int, slop: int, near_terms: int = NEAR_TERMS) -> np.ndarray:
        """Which of several passages (terms, ranks of their windows) have a proximity match in this document.

        A window matches if of its `near_terms` rarest terms, of all documents, all but `misses` stand at most `slop` words
        from where the phrase would have them, seen from one of the rarest. All windows of the passages go together.
        """
        if not len(self.terms):
            return np.zeros(0, np.int64)
        sizes = [len(t) for t, _ in asked]
        number = np.append(self.numbers(np.concatenate([t for t, _ in asked])), -1)
        base, many = np.cumsum([0, *sizes[:-1]]), np.array([len(r) for _, r in asked])
        owner = np.repeat(np.arange(len(asked)), many)
        place = np.full((len(owner), near_terms), -1)  # of each term in its window; -1 where windows are shorter
        for k, (at, (_, r)) in enumerate(zip(np.cumsum(many) - many, asked, strict=True)):
            place[at : at + many[k], : min(near_terms, r.shape[1])] = r[:, :near_terms]
        begin = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + base[owner]
        there = number[np.where(place < 0, -1, begin[:, None] + place)]
        lack = np.array([misses(min(width, n)) for n in sizes])[owner]
        need = (place >= 0).sum(1) - lack
        live = (there >= 0).sum(1) >= need
        win, start = [], []
        for j in range(near_terms):
            some = np.flatnonzero(live & (there[:, j] >= 0) & (j <= lack))
            if len(some):
                w, s = self._starts(there, place, some, j)
                win.append(w)
                start.append(s)
        if not win:
            return np.zeros(0, np.int64)
        win, start = np.concatenate(win), np.concatenate(start)
        count = np.zeros(len(win), np.int64)
        for i in range(near_terms):
            count += (place[win, i] >= 0) & self._stands(there[win, i], start + place[win, i], slop)
            ok = count + near_terms - 1 - i >= need[win]
            win, start, count = win[ok], start[ok], count[ok]
        return np.unique(owner[win])


FOUND = "uid long, passage long, exact boolean, n_hit long"


def _search(width: int, slop: int):
    """Of rows sorted by document, its postings first and then the passages to search, those that match; and n_hit of each document."""

    def run(batches):
        doc, uid, held = None, None, []  # held: passages to search for proximity, (passage, terms, often, ranks)
        known: dict[int, np.ndarray] = {}  # the ranks of passages met before, PASSAGES at most

        def exact(passage, terms, often, rank, out):
            start, w = doc.search(terms, often, width, rank)
            np.add.at(doc.cover, start, 1)
            np.add.at(doc.cover, start + w, -1)
            if len(start):
                out.append((uid, passage, True, None))
            return len(start) > 0

        def together(out):
            for k in doc.near([(t, r) for _, t, _, r in held], width, slop).tolist() if held else ():
                if not exact(*held[k], out):
                    out.append((uid, held[k][0], False, None))
            held.clear()

        def done(out):
            together(out)
            hit = int((np.cumsum(doc.cover[:-1]) > 0).sum())
            if hit:
                out.append((uid, None, True, hit))

        for batch in batches:
            out = []
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in ("uid", "kind", "passage", "n_words", "terms", "counts", "positions")}
            lists = {c: (cols[c].offsets.to_numpy(), cols[c].values.to_numpy(zero_copy_only=False)) for c in ("terms", "counts", "positions")}
            cut = lambda c, i: lists[c][1][lists[c][0][i] : lists[c][0][i + 1]].astype(np.int64)  # noqa: E731, B023
            for i, (u, kind, passage, n) in enumerate(zip(*(cols[c].to_pylist() for c in ("uid", "kind", "passage", "n_words")), strict=True)):
                if kind == 0:
                    if doc is not None:
                        done(out)
                    doc, uid = Postings(n, cut("terms", i), cut("counts", i), cut("positions", i)), u
                    continue
                terms, often = cut("terms", i), cut("counts", i)
                rank = known.get(passage)
                if rank is None:
                    if len(known) >= PASSAGES:
                        known.clear()
                    rank = known[passage] = ranks(often, min(width, len(terms)))
                if not slop:
                    exact(passage, terms, often, rank, out)
                    continue
                held.append((passage, terms, often, rank))
                if len(held) == TOGETHER:
                    together(out)
            yield _found(out)
        if doc is not None:
            out = []
            done(out)
            yield _found(out)

    return run


def _found(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], names=["uid", "passage", "exact", "n_hit"])


def match(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int = SLOP, block_words: int = PIECE) -> DataFrame:
    """One row per document row: doc_id, text_key, n_words, n_hit, items (exact phrase matches), near (proximity matches, exact ones among them).

    Null and empty texts have no words and no items; so have all if the benchmark is empty. Items without words match
    nothing; items that repeat an item_id count once; a null item_id takes part in n_hit and has no name in items.
    Repeated document rows are rows of their own. Texts and items of any length are searched whole; other columns are
    not read. block_words: words of an item in one passage.
    """
    pieces = passages(benchmark, width, block_words)
    known = bitmap(pieces.select(F.explode("terms").alias("term")))
    idx = index(docs, known)
    pieces = stage(pieces, "passages")
    one = pieces.groupBy("passage").agg(F.first("terms").alias("terms"))
    total = idx.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("n"))
    often = one.select("passage", F.posexplode("terms").alias("at", "term")).join(total, "term", "left").groupBy("passage").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n")))), lambda x: x["n"]).alias("often"))
    asked = stage(one.join(often, "passage"), "asked")
    wanted = asked.mapInArrow(_rarest(width, slop, NEAR_TERMS), "passage long, term long").distinct()
    salt, every = F.pmod("uid", F.lit(SALT)).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    places = idx.select("uid", salt, F.explode("terms").alias("term"))
    may = stage(places.join(wanted.select("*", every), ["term", "salt"]).select("uid", "passage", "salt").distinct(), "candidates")
    ask = may.join(asked.select("*", every), ["passage", "salt"]).select("uid", F.lit(1).alias("kind"), "passage", F.lit(0).cast("long").alias("n_words"), "terms", F.col("often").alias("counts"), F.lit(None).cast("array<int>").alias("positions"))
    lists = idx.select("uid", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("passage"), "n_words", "terms", F.col("counts").cast("array<long>").alias("counts"), "positions")
    found = stage(lists.unionByName(ask).repartition("uid").sortWithinPartitions("uid", "kind", "passage").mapInArrow(_search(width, slop), FOUND), "found")
    hits = found.where("n_hit is not null").select("uid", "n_hit")
    named = found.where("passage is not null").join(pieces.select("passage", "item_id"), "passage")
    ids = lambda c: F.array_sort(F.collect_set(c))
    items = named.groupBy("uid").agg(ids(F.when(F.col("exact"), F.col("item_id"))).alias("items"), ids("item_id").alias("near"))
    none = F.array().cast("array<string>")
    x = idx.select("uid", "doc_id", "text_key", "n_words").join(hits, "uid", "left").join(items, "uid", "left")
    return x.select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near", none).alias("near"))


def postings(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The stored index, a row for each term and document row: term (64-bit hash), doc_id, text_key, positions in order, for the terms of the benchmark."""
    terms = passages(benchmark, width).select(F.explode("terms").alias("term"))
    before = "aggregate(slice(counts, 1, i), 0, (a, x) -> a + x)"
    x = index(docs, bitmap(terms)).selectExpr("*", "posexplode(terms) AS (i, term)").selectExpr("term", "doc_id", "text_key", f"transform(slice(positions, {before} + 1, counts[i]), x -> CAST(x AS BIGINT)) AS positions")
    return x.join(terms.distinct(), "term", "left_semi")


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = match(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=0)
    return m.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op10_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proximity matches of each document: items that stand in it exactly, or by four of the five rarest terms of a window within SLOP words of their places.

    So a window with a word put in, left out or replaced is found wherever the change is; windows of fewer than five words
    may lack none (`misses`).
    """
    m = match(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return m.select("doc_id", F.size("items").cast("long").alias("n_items"), F.size("near").cast("long").alias("n_near"), "near")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are not contaminated, with the columns they came with.

    Rows are told apart by doc_id and text, so repeated rows share their fate; null and empty texts have no words and
    stay; an empty table stays empty, and without a benchmark all stay.
    """
    m = match(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=0)
    bad = m.where(contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_key"]), "left_anti")


SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows
), hits AS (
  SELECT d.doc_id, d.p, d.n, windows.item_id
  FROM (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS phrase
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM words, sizes WHERE len(w) >= n)) d
  JOIN windows ON windows.phrase = d.phrase AND windows.n = d.n
), spots AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN spots USING (doc_id) LEFT JOIN named USING (doc_id)
"""
