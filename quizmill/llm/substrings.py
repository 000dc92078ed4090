"""Removal of repeated byte strings with suffix arrays over shards.

A byte goes if a string of `length` bytes that covers it also starts somewhere else, in any document.

1. Each string of `length` bytes has an anchor: the smallest hash among its runs of GRAM bytes. Equal strings have equal
   anchors, so all strings with one anchor form a shard, and no repeat is split between shards. Neighbouring strings
   of a document with one anchor are one segment, so a document's strings are dealt out once, in segments.
2. Segments that are alike are counted, with partial sums before the shuffle, and all strings in a segment that occurs
   twice are repeats. Alike means equal in anchor and in a hash of the content, 128 bits together; bytes are not
   compared here. Only one copy of each goes on, and only to shards that hold different segments: copies, however many,
   cost one segment.
3. Shards are joined to runs of about RUN bytes in one task. There the suffix array is built by induced sorting and the
   common prefixes of neighbours are computed in text order; a string is repeated if it shares `length` bytes with a
   neighbour. These matches are decided on bytes.
4. A shard of over HOT different segments is split by another anchor, the smallest of the hashes in another order, and
   so on for LEVELS times: equal strings stay together each time. What is still large then has hardly any different
   grams; it is sorted whole, by one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.llm.suffixes import common_prefixes, suffix_array
from quizmill.llm.textkit import U, mix, powers, prefix_hash, small_batches, span_hash, stage, text_chunks

LENGTH, GRAM = 400, 32
RUN = 1 << 20
HOT, LEVELS = 4_000, 4


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, from block minima in both directions."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(data: np.ndarray, offs: np.ndarray, length: int, gram: int, level: int = 0) -> tuple[np.ndarray, ...]:
    """(row, anchor, content, lo, hi, inner) of each segment; strings start at lo..hi within the text. Each level has an order of the hashes of its own.

    inner: the anchor occurs more than once in the segment, so that a string of it may repeat within.
    """
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, U, U, np.int64, np.int64, bool))
    cum = prefix_hash(data)
    _, inv = powers(len(cum))
    h = mix((cum[gram:] - cum[:-gram]) * inv[: len(cum) - gram])
    if level:
        h = mix(h ^ U(level * 0x9FB21C651E98DF25 % (1 << 64)))
    least = sliding_min(h, length - gram + 1)
    ends = np.repeat(offs[1:], np.diff(offs))
    ok = np.arange(len(least)) + length <= ends[: len(least)]
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(least)]
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    lo = np.flatnonzero(new)
    stop = ok.copy()
    stop[:-1] &= ~ok[1:] | new[1:]
    hi = np.flatnonzero(stop)
    row = owner[lo]
    width = length - gram + 1
    runs = np.lib.stride_tricks.sliding_window_view(h, width)
    inner = np.zeros(len(lo), bool)
    for k in range(0, len(lo), 2000):  # the first place of the anchor in the first string, the last in the last
        a, b, anchor = lo[k : k + 2000], hi[k : k + 2000], least[lo[k : k + 2000], None]
        inner[k : k + 2000] = a + (runs[a] == anchor).argmax(1) != b + width - 1 - (runs[b] == anchor)[:, ::-1].argmax(1)
    return row, least[lo], span_hash(cum, lo, hi + length), lo - offs[row], hi - offs[row], inner


def _segment_rows(length: int, gram: int):
    def run(batches):
        for batch in batches:
            for i, _, data, offs in text_chunks(batch):
                row, anchor, content, lo, hi, inner = segments(data, offs, length, gram)
                if len(row):
                    at = pa.array(row + i)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(lo), pa.array(hi), pa.array(inner)], names=["doc_id", "text_key", "anchor", "content", "lo", "hi", "inner"])

    return run


def _cut(length: int):
    """Rows with a list of segments (anchor, times, size, lo, hi) and the text: the bytes of each segment."""

    def run(batches):
        for batch in batches:
            for d, k, text, segs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text", "segs")), strict=True):
                raw = (text or "").encode()
                n = len(segs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d] * n, pa.int64()), pa.array([k] * n, pa.int64()), pa.array([s["anchor"] for s in segs], pa.int64()), pa.array([s["times"] for s in segs], pa.int64()), pa.array([s["size"] for s in segs], pa.int64()), pa.array([s["lo"] for s in segs], pa.int64()), pa.array([raw[s["lo"] : s["hi"] + length] for s in segs], pa.binary())],
                    names=["doc_id", "text_key", "anchor", "times", "size", "lo", "bytes"],
                )

    return run


CUT = "doc_id long, text_key long, anchor long, times long, size long, lo long, bytes binary"
SPAN = "doc_id long, text_key long, s long, e long"


def repeated(parts: list[bytes], length: int) -> list[np.ndarray]:
    """Of each byte string, the places where a repeated string of `length` bytes starts."""
    data = np.frombuffer(b"\xff".join(parts) + b"\xfe", np.uint8)  # neither byte is in UTF-8
    text = data.astype(np.int64) + 1
    text[-1] = 0
    sa = suffix_array(text)
    phi, plcp = common_prefixes(data, sa)
    hit = np.zeros(len(data), bool)
    at = np.flatnonzero(plcp >= length)
    hit[at] = True
    hit[phi[at]] = True
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = ends - [len(p) + 1 for p in parts]
    return [np.flatnonzero(hit[a : b - length]) for a, b in zip(starts, ends, strict=True)]


def spans_of(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by strings of `length` bytes at these sorted starts."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + length]))
    return starts[new], starts[np.concatenate([new[1:] - 1, [len(starts) - 1]])] + length


def _sorted_shards(length: int):
    """Of rows by anchor, the covered spans of segments that occur once; whole shards are put together up to RUN bytes."""

    def run(batches):
        held: list[tuple] = []
        size, last = 0, None

        def solve():
            out: list[tuple] = []
            for (d, k, times, lo, _), at in zip(held, repeated([h[4] for h in held], length), strict=True):
                if times == 1:
                    out += [(d, k, a + lo, b + lo) for a, b in zip(*(x.tolist() for x in spans_of(at, length)), strict=True)]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "text_key", "s", "e"])

        for batch in batches:
            for d, k, anchor, times, lo, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "anchor", "times", "lo", "bytes")), strict=True):
                if size > RUN and anchor != last:
                    yield solve()
                    held.clear()
                    size = 0
                held.append((d, k, times, lo, raw))
                size, last = size + len(raw), anchor
        if held:
            yield solve()

    return run


AGAIN = "doc_id long, text_key long, anchor long, content long, inner boolean, times long, lo long, bytes binary"


def _again(length: int, gram: int, level: int):
    """Segments of rows of large shards by the anchors of another level."""

    def run(batches):
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index("bytes")).to_pylist()
            own = batch.column(batch.schema.get_field_index("anchor")).to_numpy(zero_copy_only=False).view(U)
            start = batch.column(batch.schema.get_field_index("lo")).to_numpy(zero_copy_only=False)
            size = np.cumsum([0, *map(len, raw)])
            i = 0
            while i < len(raw):
                j = max(i + 1, int(np.searchsorted(size, size[i] + RUN, "right")) - 1)
                row, anchor, content, lo, hi, inner = segments(np.frombuffer(b"".join(raw[i:j]), np.uint8), size[i : j + 1] - size[i], length, gram, level)
                at = pa.array(row + i)
                part = [raw[i + r][a : b + length] for r, a, b in zip(row.tolist(), lo.tolist(), hi.tolist(), strict=True)]
                keep = {c: batch.column(batch.schema.get_field_index(c)).take(at) for c in ("doc_id", "text_key", "times")}
                yield pa.RecordBatch.from_arrays(
                    [keep["doc_id"], keep["text_key"], pa.array(mix(own[row + i] ^ anchor).view(np.int64)), pa.array(content.view(np.int64)), pa.array(inner), keep["times"], pa.array(lo + start[row + i]), pa.array(part, pa.binary())],
                    names=["doc_id", "text_key", "anchor", "content", "inner", "times", "lo", "bytes"],
                )
                i = j

    return run


def _same(x, y):
    return x["doc_id"].eqNullSafe(y["doc_id"]) & (x["text_key"] == y["text_key"])


def repeat_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, text_key, s, e): byte spans that repeated strings cover; they may overlap. keyed: doc_id, text, text_key."""
    segs = stage(keyed.where(F.octet_length("text") >= length).select("doc_id", "text_key", "text").mapInArrow(_segment_rows(length, gram), "doc_id long, text_key long, anchor long, content long, lo long, hi long, inner boolean"), "segments")
    kinds = segs.groupBy("anchor", "content").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "text_key", "lo", "hi")).alias("one"), F.max("inner").alias("inner"))
    copied = kinds.where("times > 1").select("anchor", "content")
    whole = segs.join(copied, ["anchor", "content"], "left_semi").select("doc_id", "text_key", F.col("lo").alias("s"), (F.col("hi") + length).alias("e"))
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("size"), F.max("inner").alias("any")).where("size > 1 or any").drop("any")
    todo = kinds.join(mixed, "anchor").select("one.*", "anchor", "times", "size").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "times", "size", "lo", "hi")).alias("segs"))
    cut = keyed.join(todo, _same(keyed, todo)).select(keyed["doc_id"], keyed["text_key"], "text", "segs").mapInArrow(_cut(length), CUT)
    cut = stage(cut, "cut")
    out, level = whole, 0
    while True:
        level += 1
        last = level > LEVELS or cut.where(F.col("size") > hot).isEmpty()
        small = cut if last else cut.where(F.col("size") <= hot)
        out = out.unionByName(small.select("doc_id", "text_key", "anchor", "times", "lo", "bytes").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_shards(length), SPAN))
        if last:
            return out
        cut, spans = _split(cut.where(F.col("size") > hot), length, gram, level)
        out = out.unionByName(spans)


def _split(large: DataFrame, length: int, gram: int, level: int) -> tuple[DataFrame, DataFrame]:
    """Rows of large shards dealt out anew, one of each kind, and the spans of those that turn out alike."""
    parts = stage(large.mapInArrow(_again(length, gram, level), AGAIN), "again")
    kinds = parts.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.sum("times").alias("times"), F.min(F.struct("doc_id", "text_key", "lo")).alias("one"), F.max("inner").alias("inner"))
    alike = parts.where("times = 1").join(kinds.where("n > 1").select("anchor", "content"), ["anchor", "content"], "left_semi")
    spans = alike.select("doc_id", "text_key", F.col("lo").alias("s"), (F.col("lo") + F.octet_length("bytes")).alias("e"))
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("size"), F.max("inner").alias("any")).where("size > 1 or any").drop("any")
    some = kinds.join(mixed, "anchor").select("anchor", "content", F.col("one.doc_id").alias("d"), F.col("one.text_key").alias("k"), F.col("one.lo").alias("l"), F.col("times").alias("t"), "size")
    chosen = parts.join(some, ["anchor", "content"]).where(F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")) & (F.col("lo") == F.col("l")))
    return stage(chosen.select("doc_id", "text_key", "anchor", F.col("t").alias("times"), "size", "lo", "bytes").dropDuplicates(["anchor", "doc_id", "text_key", "lo"]), "cut"), spans


def _remove(keep_text: bool):
    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for d, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                raw = (text or "").encode()
                kept, removed, n = raw, 0, 0
                if spans:
                    pieces, end = [], 0
                    for s, e in sorted((x["s"], x["e"]) for x in spans):
                        if s > end or n == 0:
                            pieces.append(raw[end:s])
                            n, removed = n + 1, removed + e - s
                        else:
                            removed += max(0, e - end)
                        end = max(end, e)
                    kept = b"".join(pieces) + raw[end:]
                out.append((d, len(raw), removed, n, hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else [])))
            cols = list(zip(*out, strict=True)) or [[]] * (5 + keep_text)
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_text])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = False, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per document row, and with keep_text the bytes that are left.

    Null and empty texts have 0 bytes and lose none. Texts shorter than `length` lose none. Rows that repeat a text are
    places of their own: each copy is repeated by the other. What is left may be cut within a character, so it is bytes.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_key"))
    spans = repeat_spans(keyed, length, gram, hot).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    both = keyed.join(spans, _same(keyed, spans), "left").select(keyed["doc_id"], "text", "spans")
    return both.mapInArrow(_remove(keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
