"""Personal data in text: base patterns, and beside them a character-level bidirectional LSTM with CRF transitions.

The base patterns give emails, addresses, card and phone numbers; each is written so that a string of any length is
walked once. The model (`taggers`, trained from labelled spans that are made) reads windows of `WINDOW` code points that
overlap by half. Each window is decoded for itself; then all spans of a text's windows are reconciled together: pieces
cut by the edges of windows are joined where they overlap, and of what is left the set of disjoint spans with the
greatest total gain over `outside` stays.

What the model adds holds a digit, an @ or a [, ends at no place within a word, shares no code point with a base span, and none with a match of the base
pattern of its own kind (which has been judged). So a window without such a mark can add nothing, and is not read by the
model; all windows with one are. Added spans are named `email_like`, `ip_like`, `card_like`, `phone_like`, `id_like`.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from quizmill.llm.taggers import KINDS as MODEL_KINDS
from quizmill.llm.taggers import PAD, WINDOW, Model, decode, symbols, trained
from quizmill.llm.textkit import give_back, small_batches, text_array

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, *(f"{k}_like" for k in MODEL_KINDS)]
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: Fixed patterns. Possessive, and the first run of digits is passed over whole if nothing can follow it: the same matches, each character seen once.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"[0-9]++(?:(\.[0-9]++)(\.[0-9]++)(\.[0-9]++))?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TELLING = np.zeros(256, bool)
TELLING[[*range(48, 58), ord("@"), ord("[")]] = True
AT_ONCE = 256  # windows decoded together


def luhn(digits: str) -> bool:
    back = [int(c) for c in reversed(digits)]
    return (sum(back[::2]) + sum(v * 2 - 9 * (v > 4) for v in back[1::2])) % 10 == 0


def matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, end, kind, whether it holds) of the matches of the base patterns, kind by kind."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:  # whatever begins in a run of local characters reaches its end, or does not match
        a = at
        while a > free and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at) if a < at else None
        if m:
            out.append((a, m.end(), 0, True))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    for m in IP.finditer(text):
        if m.group(1):
            out.append((m.start(), m.end(), 1, all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m.group().split("."))))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        out.append((m.start(), m.end(), 2, 14 <= len(digits) <= 19 and luhn(digits)))
    for m in PHONE.finditer(text):
        out.append((m.start(), m.end(), 3, 10 <= sum(c.isdigit() for c in m.group()) <= 15))
    return out


# ---------------------------------------------------------------- the model's spans


def windows(ids: np.ndarray, told: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Starts of the windows to read: every half window, as long as text is left; those with a telling mark."""
    half = size // 2
    starts = np.arange(0, max(1, len(ids) - half), half)
    seen = np.concatenate([[0], np.cumsum(told)])
    return starts[seen[np.minimum(starts + size, len(ids))] > seen[starts]]


def window_spans(tags: np.ndarray, gain: np.ndarray, start: int, length: int) -> list[tuple[int, int, int, float, bool]]:
    """(start, end, kind, gain, cut) of one decoded window; cut: it touches an edge of the window within the text."""
    out, size = [], len(tags)
    inside = np.flatnonzero(tags)
    if not len(inside):
        return out
    first = inside[(tags[inside] % 2 == 1) | (inside == 0) | (tags[inside - 1] == 0)]
    for a in first:
        b = a + 1
        while b < size and tags[b] and tags[b] % 2 == 0:
            b += 1
        end = min(start + b, length)
        if start + a < end:
            out.append((start + int(a), end, int(tags[a] - 1) // 2, float(gain[a:b].sum()), bool((a == 0 and start > 0) or (b == size and start + size < length))))
    return out


def reconciled(spans: list[tuple[int, int, int, float, bool]]) -> list[tuple[int, int, int]]:
    """Disjoint (start, end, kind) from the spans of all windows of a text.

    Cut pieces of a kind from several windows that overlap or touch are one span; a cut piece alone goes, as the window
    beside it has seen its place whole. Equal spans count once, with the best gain. Of these the disjoint set with most gain stays, found over ends in order; ties take
    the earlier end.
    """
    merged: list[list] = []
    for s in sorted(x for x in spans if x[4]):
        last = next((m for m in reversed(merged) if m[2] == s[2] and m[1] >= s[0]), None)
        if last is None:
            merged.append([*s, 1])
        else:
            last[5] += 1
            last[3] = max(last[3], s[3]) if s[1] <= last[1] else last[3] + s[3] * (s[1] - last[1]) / (s[1] - s[0])
            last[1] = max(last[1], s[1])
    best: dict[tuple[int, int, int], float] = {}
    for a, b, k, g, *_ in [x for x in spans if not x[4]] + [m for m in merged if m[5] > 1]:
        best[a, b, k] = max(g, best.get((a, b, k), g))
    rows = sorted(((a, b, k, g) for (a, b, k), g in best.items() if g > 0), key=lambda r: (r[1], r[0], r[2]))
    ends = [r[1] for r in rows]
    total, take = [0.0], []
    for i, (a, _, _, g) in enumerate(rows):
        before = bisect.bisect_right(ends, a, 0, i)
        take.append(before if total[before] + g > total[i] else -1)
        total.append(max(total[i], total[before] + g))
    out, i = [], len(rows)
    while i:
        if take[i - 1] >= 0:
            out.append(rows[i - 1][:3])
            i = take[i - 1]
        else:
            i -= 1
    return out[::-1]


def model_spans(texts: list[str], model: Model) -> list[list[tuple[int, int, int]]]:
    """Reconciled spans of each text."""
    found: list[list] = [[] for _ in texts]
    pending: list[tuple[int, int, int, np.ndarray]] = []

    def flush() -> None:
        tags, gain = decode(model, np.stack([p[3] for p in pending]))
        for (t, start, length, _), row, g in zip(pending, tags, gain, strict=True):
            found[t] += window_spans(row, g, start, length)
        pending.clear()

    for t, text in enumerate(texts):
        ids = symbols(text)
        for start in windows(ids, TELLING[ids]):
            one = ids[start : start + WINDOW]
            pending.append((t, int(start), len(ids), np.concatenate([one, np.full(WINDOW - len(one), PAD, np.uint8)]) if len(one) < WINDOW else one))
            if len(pending) == AT_ONCE:
                flush()
    if pending:
        flush()
    return [reconciled(f) for f in found]


def added(text: str, judged: list[tuple[int, int, int, bool]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What the model's spans add to the base: trimmed, whole words, with a telling mark, clear of base spans and of matches of their own kind."""
    shut = sorted((a, b, k) for a, b, k, ok in judged if ok)
    reach, far = [], 0
    for _, b, _ in shut:
        far = max(far, b)
        reach.append(far)
    own: dict[int, list] = {}
    for a, b, k, _ in judged:
        own.setdefault(k, []).append((a, b))
    out = []
    for a, b, k in spans:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        i = bisect.bisect_left(shut, (b,)) - 1
        if i >= 0 and reach[i] > a:
            continue
        mine = own.get(k, [])  # disjoint and in order
        i = bisect.bisect_left(mine, (b,)) - 1
        if i >= 0 and mine[i][1] > a:
            continue
        inside = (a and text[a - 1].isalnum() and text[a].isalnum()) or (b < len(text) and text[b].isalnum() and text[b - 1].isalnum())  # part of a longer word
        if a < b and not inside and any(c in "@[" or "0" <= c <= "9" for c in text[a:b]):
            out.append((a, b, k))
    return out


def spans_of(texts: list[str], model: Model) -> list[list[tuple[int, int, int]]]:
    """All spans (start, kind, end) of each text in code points, by start, then kind as listed."""
    out = []
    for text, more in zip(texts, model_spans(texts, model), strict=True):
        judged = matches(text)
        spans = {(a, k, b) for a, b, k, ok in judged if ok} | {(a, k + len(BASE), b) for a, b, k in added(text, judged, more)}
        out.append(sorted(spans))
    return out


SPANS = ArrayType(StructType([StructField(c, IntegerType()) for c in ("start", "kind", "end")]))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Each row of docs as a struct `row`, with pii_spans: all spans (start, kind, end; kind is a place in KINDS), by start, then kind.

    Null is like an empty text: no spans. Repeated rows give repeated rows, an empty table none; docs may have columns of
    any name. Texts are read whole: rows without any telling mark have no span, whatever their length.
    """
    small_batches(docs.sparkSession)
    weights = trained() if model is None else model
    x = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["text"].alias("scanned"))
    kind = pa.list_(pa.struct([pa.field("start", pa.int32()), pa.field("kind", pa.int32()), pa.field("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = text_array(b, "scanned")
            rows = np.unique(np.searchsorted(offs, np.flatnonzero(TELLING[data[offs[0] : offs[-1]]]) + offs[0], "right") - 1)
            texts = b.column(1).take(pa.array(rows)).to_pylist()
            found: list = [[]] * b.num_rows
            for i, s in zip(rows.tolist(), spans_of(texts, weights), strict=True):
                found[i] = [{"start": a, "kind": k, "end": e} for a, k, e in s]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["row", "pii_spans"])
            give_back()

    return x.mapInArrow(run, x.select("row").schema.add("pii_spans", SPANS))


def named(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(element_at(array({names}), x.kind + 1), ':', x.start, ':', x.end)), ',')")


def masked(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with each run of overlapping spans in text replaced by its first kind in brackets; other columns as they are."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    x = scan(docs, model)
    parts = f"""aggregate(pii_spans, named_struct('at', 0, 'out', cast(array() as array<string>)),
        (acc, x) -> if(x.start >= acc.at, named_struct('at', x.end, 'out', concat(acc.out, array(substring(row.text, acc.at + 1, x.start - acc.at), concat('[', element_at(array({names}), x.kind + 1), ']')))),
            named_struct('at', greatest(acc.at, x.end), 'out', acc.out)),
        acc -> concat(array_join(acc.out, ''), substring(row.text, acc.at + 1)))"""
    text = F.expr(f"case when size(pii_spans) > 0 then {parts} else row.text end")
    return x.select(*(text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the digest are of the base spans; spans holds the added ones too."""
    x = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.expr(f"cast(size(filter(pii_spans, x -> x.kind = {k})) as bigint)").alias(f"n_{BASE[k]}")
    base = named(f"filter(pii_spans, x -> x.kind < {len(BASE)})")
    return x.select(F.col("row.doc_id").cast("long").alias("doc_id"), *(count(k) for k in range(len(BASE))), F.sha2(base.cast("binary"), 256).alias("base_sha256"), named("pii_spans").alias("spans"))
