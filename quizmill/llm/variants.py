"""Spelling variants: words grouped with their more frequent neighbours at one edit.

Words and their counts come from built-in functions. Each word then gives its full neighbourhood over the alphabet that
the words use: all distinct deletions, replacements and insertions of one code point. Candidates meet the vocabulary in
a hash join on the string itself, so nothing is left to verify. Nearness is mutual, so a candidate carries the word that
gave it, and candidates are summed up per string before they meet the vocabulary: one shuffle of what is summed.

A word has about 180 times its length in candidates, nearly all of them no words. Before they are shuffled, candidates
that are no words are told by a Bloom filter of fixed size (`FILTER_BITS`); what passes it wrongly falls out in the join.
The filter is exact in what it lets through at any size of the vocabulary: beyond some 20 million words it only saves
less, and a larger one is then the better parameter.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.llm.textkit import BASE, U, drop, mix, powers, release, stage

LEAST_LENGTH, LEAST_N, MISSPELT = 5, 3, 97
RUN = r"[a-zÀ-ÿ]+"
FILTER_BITS = 1 << 27  # 16 MB, collected and broadcast whatever the size of the vocabulary
CELLS = 1 << 19  # candidates worked out at once


def occurrences(docs: DataFrame) -> DataFrame:
    """Column word: each run of letters of each text with A-Z in lower case; where 97 divides the crc32 of `doc_id:run`, without one code point.

    Null texts have no runs; a null doc_id counts as an empty one; repeated rows count again.
    """
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    x = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("w"))
    x = x.where(F.length("w") >= LEAST_LENGTH).withColumn("h", F.crc32(F.concat("d", F.lit(":"), "w").cast("binary")))
    at = F.expr("cast(h % length(w) as int)")
    cut = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))
    return x.select(F.when(F.col("h") % MISSPELT == 0, cut).otherwise(F.col("w")).alias("word"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of words of five code points and more that occur three times and more."""
    return occurrences(docs).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_N)


def _by_length(words: pa.ChunkedArray | pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, code points as a matrix) for each length; all code points are below 256."""
    raw = np.array([w.encode("latin-1") for w in words.to_pylist()], dtype=bytes)
    size = np.char.str_len(raw)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield rows, np.frombuffer(raw[rows].astype(f"S{n}").tobytes(), np.uint8).reshape(len(rows), n)


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a filter of so many bits (a power of two)."""
    h = mix(h)
    return h & U(bits - 1), (h >> U(32)) & U(bits - 1)


def _hashes(m: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the rows."""
    return ((m.astype(U) + U(1)) * powers(m.shape[1])[0][: m.shape[1]]).sum(axis=1, dtype=U)


def filter_of(words: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """The Bloom filter of column word as bytes. What the driver collects is the filter's own non-zero numbers, bits/64 at most."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, m in _by_length(b.column(0)):
                at = np.unique(np.concatenate(_slots(_hashes(m), bits)))
                slot, first = np.unique(at >> U(6), return_index=True)
                value = np.bitwise_or.reduceat(U(1) << (at & U(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(value.view(np.int64))], names=["slot", "value"])

    found = words.select("word").mapInArrow(places, "slot long, value long").groupBy("slot").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found["slot"].to_numpy()] = found["value"].to_numpy()
    return out.view(np.uint8)


def _edited(m: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(hashes, whether to count, change of length) by row, place and, but for deletions, letter, for every edit of the rows of m.

    A deletion within a stretch of one letter counts at its first, an insertion of a letter counts unless that letter
    stands before: so each neighbour counts once.
    """
    k, n = m.shape
    up, down = (x[: n + 2] for x in powers(n + 2))
    part = np.zeros((k, n + 1), U)
    np.cumsum((m.astype(U) + U(1)) * up[:n], axis=1, out=part[:, 1:])
    rest = part[:, -1:] - part  # of what stands from a place on
    new = np.ones((k, n), bool)
    new[:, 1:] = m[:, 1:] != m[:, :-1]
    yield part[:, :-1] + rest[:, 1:] * down[1], new, -1
    letters = alphabet.astype(U) + U(1)
    put = letters[None, :] * up[: n + 1, None]
    other = m[:, :, None] != alphabet
    yield (part[:, :-1] + rest[:, 1:])[:, :, None] + put[None, :n], other, 0
    fresh = np.ones((k, n + 1, len(alphabet)), bool)
    fresh[:, 1:] = other
    yield (part + rest * up[1])[:, :, None] + put[None], fresh, 1


def _spelt(m: np.ndarray, alphabet: np.ndarray, at: tuple[np.ndarray, ...], change: int) -> list[str]:
    """The strings of the chosen edits."""
    row, place = at[0], at[1]
    base, n = m[row], m.shape[1]
    col = np.arange(n + change)
    if change < 0:
        out = np.take_along_axis(base, col[None] + (col[None] >= place[:, None]), axis=1)
    elif change == 0:
        out = base.copy()
        out[np.arange(len(row)), place] = alphabet[at[2]]
    else:
        out = np.take_along_axis(base, np.clip(col[None] - (col[None] > place[:, None]), 0, n - 1), axis=1)
        out[np.arange(len(row)), place] = alphabet[at[2]]
    text = out.tobytes().decode("latin-1")
    w = n + change
    return [text[i : i + w] for i in range(0, len(text), w)]


def neighbourhood(words: DataFrame, alphabet: str, bloom=None, bits: int = FILTER_BITS) -> DataFrame:
    """(candidate, word, n): all strings at one edit of each word, each once; with a filter (a broadcast), those that pass it."""
    letters = np.frombuffer(alphabet.encode("latin-1"), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None if bloom is None else np.frombuffer(bloom.value, np.uint8)
        for b in batches:
            names, counts = b.column(0), b.column(1).to_numpy()
            for rows, m in _by_length(names):
                step = max(1, CELLS // ((m.shape[1] + 1) * max(1, len(letters))))
                for i in range(0, len(rows), step):
                    some = m[i : i + step]
                    for h, ok, change in _edited(some, letters):
                        at = np.flatnonzero(ok)
                        if kept is not None:
                            a, z = _slots(h.ravel(), bits)
                            hit = lambda s: (kept[s >> U(3)] >> (s & U(7)).astype(np.uint8)) & 1
                            at = np.flatnonzero(ok.ravel() & (hit(a) == 1))
                            at = at[hit(z[at]) == 1]
                        if not len(at):
                            continue
                        where = np.unravel_index(at, ok.shape)
                        source = rows[i + where[0]]
                        yield pa.RecordBatch.from_arrays([pa.array(_spelt(some, letters, where, change), pa.string()), names.take(pa.array(source)), pa.array(counts[source])], names=["candidate", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "candidate string, word string, n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where following forms ends. Each round joins each word's goal with that goal's own; counts double at each step, so there are few."""
    now = stage(forms.select("word", F.col("form").alias("root")), "goals")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = stage(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "goals")
        drop(now)
        now = new
        if new.where("moved").isEmpty():
            return new.select("word", "root")


def variants(docs: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """word, form, root, n, n_near, form_n for the vocabulary of docs (doc_id, text).

    Ties of count go to the smallest word in code-point order. Null and empty texts have no words, repeated rows count
    again, an empty table gives no rows, columns beside doc_id and text are not read; one text of any length is taken whole.
    """
    spark = docs.sparkSession
    words = stage(vocabulary(docs.select("doc_id", "text")), "words")
    release(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    alphabet = "".join(sorted(r[0] for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()))  # 90 letters at most
    bloom = spark.sparkContext.broadcast(filter_of(words, bits).tobytes())
    found = neighbourhood(words.repartition(parts, "word"), alphabet, bloom, bits)
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("word").alias("form")))
    per = found.groupBy("candidate").agg(F.count("*").alias("n_near"), best.alias("best"))
    x = words.join(per, words["word"] == per["candidate"], "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    better = F.col("form_n") >= 2 * F.col("n")
    x = stage(x.withColumn("form", F.when(better, F.col("form"))).withColumn("form_n", F.when(better, F.col("form_n"))), "near")
    drop(words)
    ends = roots(x.where("form is not null"))
    return x.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: crc32 byte by byte over a table that is made by the rule; neighbours meet by what is left and right of the edit.
SQL = r"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c FROM range(256) r(b))),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents),
hexed AS (SELECT w, lower(hex(encode(d || ':' || w))) AS x, count(*) AS k FROM runs WHERE length(w) >= 5 GROUP BY ALL),
bytes AS (SELECT w, k, list_transform(range(0, length(x) // 2), lambda i: (instr('0123456789abcdef', x[2 * i + 1]) - 1) * 16 + instr('0123456789abcdef', x[2 * i + 2]) - 1) AS b FROM hexed),
sums AS (SELECT w, k, xor(list_reduce(b, lambda c, v: xor(c >> 8, t[1 + (xor(c, v) & 255)]), 4294967295), 4294967295) AS h FROM bytes, tab),
made AS (SELECT CASE WHEN h % 97 = 0 THEN w[1 : h % length(w)] || w[h % length(w) + 2 :] ELSE w END AS word, k FROM sums),
vocab AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
holes AS MATERIALIZED (SELECT DISTINCT word, n, word[1 : i - 1] AS l, word[i + 1 :] AS r FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
gone AS MATERIALIZED (SELECT DISTINCT word, n, l || r AS less FROM holes),
pairs AS (SELECT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION ALL SELECT v.word, g.word, g.n FROM gone g JOIN vocab v ON v.word = g.less UNION ALL SELECT g.word, v.word, v.n FROM gone g JOIN vocab v ON v.word = g.less),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(k := -n, w := other)) AS b FROM pairs GROUP BY word),
formed AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.k >= 2 * v.n THEN b.w END AS form, CASE WHEN -b.k >= 2 * v.n THEN -b.k END AS form_n FROM vocab v LEFT JOIN best USING (word)),
walk(word, goal) AS (SELECT word, word FROM formed UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.goal WHERE f.form IS NOT NULL)
SELECT f.word, f.form, goal AS root, n, n_near, form_n FROM formed f JOIN (SELECT walk.word, goal FROM walk JOIN formed g ON g.word = walk.goal WHERE g.form IS NULL) e ON e.word = f.word"""
