"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.scratch import cut, discard, settled  # noqa: F401

#: Text bytes that a task turns into numpy arrays at once; a longer document makes a chunk of its own.
CHUNK_BYTES = 1_000_000

_MASK = (1 << 64) - 1


#: Rows and bytes of a batch that goes to a task's Python worker, by Spark's setting: its default, and what takes the default's place.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b")}


def small_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for the session, where its settings are Spark's defaults; a size that a user has set stays.

    Spark reads these settings when a result is computed, so they can't be put back when an operator returns.
    """
    for name, (default, ours) in _BATCH.items():
        if spark.conf.get(name) in (default, default.removesuffix("b"), "64MB", "64m"):
            spark.conf.set(name, ours)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow in batches that stay small where texts are long; see small_batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def plus(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of df with further columns, by name and type."""
    more = [T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in columns.items()]
    return T.StructType([*df.schema.fields, *more])


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed odd 64-bit constants."""
    base = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt & _MASK)
    return mix64(base) | np.uint64(1)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end and the n + 1 offsets of its rows; null counts as empty."""
    column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about `limit` text bytes; no row is split or dropped."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(text).fill_null("").cast(pa.large_string())
        ends = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTES = seeds(256, 11)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs of bytes other than space and 0x09-0x0D, within a row.

    Returns each word's 64-bit hash, its first byte and its end, and the n + 1 offsets of the rows' words.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before[edge], after[edge - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up, out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


_ORDER = seeds(16, 23)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The rows' k-word shingles in text order, as 64-bit hashes, and the offsets of the rows.

    A row with fewer than k words, but any, has one shingle of all its words; a row without words has none.
    """
    n = np.diff(rows)
    many = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_rows = np.zeros(len(rows), np.int64)
    np.cumsum(many, out=out_rows[1:])
    out = np.zeros(out_rows[-1], np.uint64)
    row = np.repeat(np.arange(len(n)), n)
    if len(words) >= k:
        last = len(words) - k + 1
        whole = row[:last] == row[k - 1 :]
        h = np.zeros(last, np.uint64)
        for j in range(k):
            h += words[j : j + last] * _ORDER[j]
        at = np.flatnonzero(whole)
        out[out_rows[row[at]] + at - rows[row[at]]] = mix64(h[at])
    for c in range(1, k):
        short = np.flatnonzero(n == c)
        if len(short):
            h = np.full(len(short), c, np.uint64) * np.uint64(0xA0761D6478BD642F)
            for j in range(c):
                h += words[rows[short] + j] * _ORDER[j]
            out[out_rows[short]] = mix64(h)
    return out, out_rows
