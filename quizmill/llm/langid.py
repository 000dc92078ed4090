"""Language identification by prediction by partial matching.

For each language a context tree of variable order (up to ORDER bytes) is counted on a bounded sample of labelled texts.
A context gives a byte it has seen c times out of n, with d different bytes, the probability c / (n + d), and leaves
d / (n + d) to the escape into the next shorter context; below all contexts each byte has 1/256. The statistics are
frozen, so the code length of a byte depends on the ORDER bytes before it alone: it is kept in sorted tables of the
runs and contexts that were seen, over all 256 byte values, and looked up once for every different run of ORDER + 1
bytes of a chunk. The whole text is scored; the language with the shortest code wins. Every label is learned: the model
grows with the number of languages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizmill.llm.textkit import LOWER, small_batches, text_array, text_chunks

ORDER = 3
SAMPLE = 400  # texts a language that the model is fitted on, about: those with the smallest hashes of doc_id
SAMPLE_BYTES = 2 << 20  # of which at most so many bytes of whole texts (one text at least), so that a language's tables have at most (ORDER + 1) * SAMPLE_BYTES entries of 16 bytes
SYMBOLS = 256  # byte values, each a symbol
LETTER = regex.compile(r"\p{L}")


def held_in(df: DataFrame) -> DataFrame:
    return df.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def _grams(batches):
    """(lang, gram, n): counts of runs of ORDER + 1 bytes, texts led in by ORDER zero bytes."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for i, j, data, offs in text_chunks(batch):
            for lang in set(langs[i:j]):
                rows = np.flatnonzero(langs[i:j] == lang)
                parts = [p for r in rows for p in (np.zeros(ORDER, np.uint8), LOWER[data[offs[r] : offs[r + 1]]])]
                x = np.concatenate(parts).astype(np.int64)
                if len(x) <= ORDER:
                    continue
                g = sum(x[k : len(x) - ORDER + k] << 8 * (ORDER - k) for k in range(ORDER + 1))
                own = np.concatenate([np.arange(ORDER + offs[r + 1] - offs[r]) >= ORDER for r in rows])[ORDER:]  # runs that end in a text, not in what leads the next one in
                v, c = np.unique(g[own], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(v), pa.string()), pa.array(v), pa.array(c.astype(np.int64))], names=["lang", "gram", "n"])


@dataclass
class Tables:
    """Of one language, for each order: the runs of order + 1 bytes seen and their bits, the contexts and the bits of their escape."""

    runs: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escape: list[np.ndarray]

    def look_up(self, g: np.ndarray, order: int) -> np.ndarray:
        """Bits of the last byte of each run, in contexts of at most `order` bytes."""
        out = np.zeros(len(g))
        at = np.arange(len(g))
        for k in range(order, -1, -1):
            x = g[at] & ((1 << 8 * (k + 1)) - 1)
            i = np.minimum(np.searchsorted(self.runs[k], x), len(self.runs[k]) - 1)
            seen = self.runs[k][i] == x if len(self.runs[k]) else np.zeros(len(x), bool)
            out[at[seen]] += self.bits[k][i[seen]]
            at, x = at[~seen], x[~seen] >> 8
            if len(self.contexts[k]):
                i = np.minimum(np.searchsorted(self.contexts[k], x), len(self.contexts[k]) - 1)
                out[at] += np.where(self.contexts[k][i] == x, self.escape[k][i], 0)
        out[at] += 8  # below all contexts each byte alike
        return out


@dataclass
class Model:
    """langs[k] and its tables."""

    langs: list[str]
    tables: list[Tables]

    @property
    def symbol(self) -> np.ndarray:
        return np.arange(SYMBOLS)

    @property
    def cost(self) -> list[np.ndarray]:
        """For each language, the bits of all bytes in all its contexts, written out."""
        every = lambda c: (c[:, None] << 8 | np.arange(SYMBOLS)).ravel()
        return [np.concatenate([t.look_up(every(c), k) for k, c in enumerate(t.contexts)]) for t in self.tables]


def _learn(g: np.ndarray, n: np.ndarray) -> Tables:
    t = Tables([], [], [], [])
    for order in range(ORDER + 1):
        run, where = np.unique(g & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
        c = np.bincount(where, weights=n, minlength=len(run))
        ctx, node = np.unique(run >> 8, return_inverse=True)
        total, kinds = np.bincount(node, weights=c), np.bincount(node)
        # with exclusion: what the context has seen cannot be meant by an escape
        below = np.exp2(-t.look_up(run, order - 1))
        rest = np.maximum(1 - np.bincount(node, weights=below), 1e-12)
        full = kinds == SYMBOLS
        t.runs.append(run)
        t.bits.append(-np.log2(c / np.where(full, total, total + kinds)[node]))
        t.contexts.append(ctx)
        t.escape.append(np.where(full, 40, -np.log2(kinds / (total + kinds) / rest)))
    return t


def fit(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learns from text and lang of about `sample` held-in texts a language (all of them if there are fewer), of `sample_bytes` in all at most."""
    small_batches(docs.sparkSession)
    usable = held_in(docs).select("doc_id", "lang", "text")
    share = usable.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample)) / F.count("*")).alias("share"))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    drawn = usable.join(F.broadcast(share), "lang").where(draw <= F.col("share"))
    ahead = Window.partitionBy("lang").orderBy(F.octet_length("text") > sample_bytes, F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "text")  # a few hundred rows a language
    drawn = drawn.withColumn("bytes", F.sum(F.octet_length("text").cast("long")).over(ahead)).withColumn("place", F.row_number().over(ahead)).where((F.col("bytes") <= sample_bytes) | (F.col("place") == 1))
    grams = drawn.select("lang", "text").mapInArrow(_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    parts = {lang: part for lang, part in grams.groupby("lang")}
    langs = sorted(parts)
    return Model(langs, [_learn(parts[x]["gram"].to_numpy(np.int64), parts[x]["n"].to_numpy(np.int64)) for x in langs])


def code_lengths(model: Model, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bits of each text under each language: (texts, languages)."""
    n, rows = len(offs) - 1, np.diff(offs)
    out = np.zeros((n, len(model.langs)))
    if not len(data) or not model.langs:
        return out
    s = LOWER[data].astype(np.uint32)
    at = np.arange(len(data)) - np.repeat(offs[:-1], rows)
    g = s.copy()
    for k in range(1, ORDER + 1):
        back = np.zeros(len(data), np.uint32)
        back[k:] = s[:-k] << np.uint32(8 * k)
        back[at < k] = 0
        g |= back
    run, where = np.unique(g, return_inverse=True)
    run = run.astype(np.int64)
    full = np.flatnonzero(rows)
    for k, t in enumerate(model.tables):
        out[full, k] = np.add.reduceat(t.look_up(run, ORDER)[where], offs[:-1][full])
    return out


def judge(bits: np.ndarray, langs: list[str], letters: np.ndarray, size: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Prediction (of languages with equal code lengths the first by name) and score: the share of the best language if each weighs 2 ** -bits, the bits of long texts scaled to those of 64 bytes."""
    if not langs:
        return ["und"] * len(bits), np.zeros(len(bits))
    scaled = bits * np.minimum(1, 64 / np.maximum(size, 1))[:, None]
    weight = np.exp2(scaled.min(1, keepdims=True) - scaled)
    best = bits.argmin(1)
    score = weight[np.arange(len(bits)), best] / weight.sum(1)
    return [langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, np.clip(score, 0, 1), 0.0)


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """doc_id and lang_pred, score for each row; repeated rows give repeated rows, an empty table none.

    Texts that are null or have no letter are `und` with score 0; so is all if nothing could be learned. A text of any
    length is scored whole; of languages with equal code lengths the first by name is predicted. No other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the runs of the sample; grows with the number of languages

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column(1)
            for i, j, data, offs in text_chunks(batch):
                bits = code_lengths(m, data, offs)
                letters = np.array([bool(t) and LETTER.search(t) is not None for t in texts.slice(i, j - i).to_pylist()], bool)
                lang, score = judge(bits, m.langs, letters, np.diff(offs))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    p = predict(docs, fit(docs))
    return p.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"), "lang_pred", "score")


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language can be told (not `und`), with their columns; a missing lang becomes the prediction.

    Null and empty texts and texts without letters go; repeated rows stay repeated; an empty table stays empty, and so
    is the result if no document has a lang to learn from.
    """
    model = fit(docs)
    shared = spark.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches):
        m = shared.value
        for batch in batches:
            _, whole = text_array(batch)
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            lang: list[str] = []
            for i, j, data, offs in text_chunks(batch):
                letters = np.array([bool(t) and LETTER.search(t) is not None for t in texts[i:j]], bool)
                lang += judge(code_lengths(m, data, offs), m.langs, letters, np.diff(offs))[0]
            at = batch.schema.get_field_index("lang")
            cols = [pc.coalesce(batch.column(k), pa.array(lang, pa.string())) if k == at else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names).filter(pa.array([x != "und" for x in lang], pa.bool_()))

    return docs.mapInArrow(run, schema)
