"""Vectorised helpers shared by the text operators: Arrow text as byte arrays, word hashes, memory of workers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException

from quizmill.sources.staging import drop, shared_folder, stage, stage_by  # noqa: F401  operators take them from here

BATCH = 8 << 20  # bytes of a batch of rows that goes to Python
with contextlib.suppress(OSError, AttributeError):
    ctypes.CDLL("libc.so.6").mallopt(-3, 4 << 20)  # arrays of 4 MB and more go back to the system when they are dropped

CHUNK = 1 << 20  # bytes of text worked on at once; one longer text is a chunk of its own
U = np.uint64
BASE = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (the base is odd, so it has an inverse)."""
    have = _tables.get(f"p{base}")
    if have is None or have.shape[1] < n:
        size = 1 << max(20, int(n).bit_length())
        have = np.ones((2, size), U)
        for row, b in enumerate((base, pow(base, -1, 1 << 64))):
            step, m = b, 1
            while m < size:
                have[row, m : 2 * m] = have[row, :m] * U(step)
                step, m = step * step % (1 << 64), 2 * m
        _tables[f"p{base}"] = have
    return have[0], have[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix_hash(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """Cumulative sums from which `span_hash` gets the hash of any span."""
    pw, _ = powers(len(data) + 1, base)
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * pw[: len(data)], out=out[1:])
    return out


def span_hash(cum: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes give equal hashes wherever they stand."""
    _, inv = powers(len(cum), base)
    return mix((cum[end] - cum[start]) * inv[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def text_array(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null rows are empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole, offs


def text_chunks(batch: pa.RecordBatch, name: str = "text", limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows [i, j) with about `limit` bytes: (i, j, their bytes, offsets from 0). Texts are never cut.

    Whoever works in this way needs no vocabulary, so what the worker has kept of one is dropped.
    """
    if _held:
        clear()
    whole, offs = text_array(batch, name)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, whole[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
    give_back()


def find_words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes for which inside[byte] holds, within each text."""
    is_in = np.zeros(len(data) + 2, np.int8)
    is_in[1:-1] = inside[data]
    edge = np.diff(is_in)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = offs[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    if len(cuts):  # a run over the border of two texts is two words
        cuts = cuts[(is_in[cuts] == 1) & (is_in[cuts + 1] == 1)]
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def distinct_in_rows(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, h) sorted and distinct, for rows below 2**20."""
    key = (row.astype(U) << U(44)) | (h >> U(20))
    order = np.argsort(key)
    key, r, x = key[order], row[order], h[order]
    same = key[1:] == key[:-1]
    if (same & (x[1:] != x[:-1])).any():  # two hashes alike in 44 bits in one row: sort by all bits
        order = np.lexsort((h, row))
        r, x = row[order], h[order]
    new = np.ones(len(x), bool)
    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    return r[new], x[new]


_held: dict[str, tuple[str, object]] = {}


def only(kind: str, name: str, make):
    """make(name), kept by a Python worker until it needs something of another kind or name.

    Spark uses its workers again in later stages; without this they would hold the tables of every stage before.
    """
    have = _held.get(kind)
    if have is None or have[0] != name:
        clear()
        _held[kind] = have = name, make(name)
        trim()
    return have[1]


def trim() -> None:
    gc.collect()
    give_back()


def give_back() -> None:
    """Gives memory that is free in this process back to the system: workers wait for their next task with little."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def clear() -> None:
    """Drops what earlier tasks of a Python worker have kept."""
    if _held:
        _held.clear()
        trim()


def small_batches(spark) -> None:
    """Limits the batches that this session sends to Python to BATCH bytes, unless its own limit is lower or not the default."""
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
    with contextlib.suppress(PySparkException):  # versions before 4.1 count rows alone
        if spark.conf.get(name).rstrip("b") == str(default):
            spark.conf.set(name, str(BATCH))


def release(spark) -> None:
    """Lets the driver's JVM collect its garbage, and with it the shuffle files of steps whose results are staged."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
