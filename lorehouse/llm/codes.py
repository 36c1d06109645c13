"""Compressed vectors: a code a part from codebooks that Lloyd's rounds move, with Hamerly's two bounds a part."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, in_arrow

#: Parts of a vector, entries of a part's codebook, rounds, and rows whose distances to all entries a task holds at once.
PARTS, ENTRIES, ROUNDS, CHUNK_ROWS = 4, 256, 4, 4096
#: Sums by label go to all tasks up to so many labels; beyond that they are joined by shuffling, each in SALTS copies.
BROADCAST_LABELS, SALTS = 100_000, 32
#: Bounds give way by so much, as they are rounded.
SLACK = 1e-9

#: One codebook a part: entries in rows, integers.
Books = list[np.ndarray]


def cuts(dims: int, parts: int = PARTS) -> list[slice]:
    """Equal consecutive parts; where dims isn't a multiple of parts, the first ones have a component more."""
    ends = np.cumsum([dims // parts + (p < dims % parts) for p in range(parts)]).tolist()
    return [slice(a, b) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows and entries, as integers."""
    most = 2 * max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if x.shape[1] * most**2 >= 2**62:
        raise ValueError("components are too large: a squared distance doesn't fit a long")
    if x.shape[1] * most**2 < 2**51:  # all sums are whole numbers below 2**53, so floating point is exact
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], 1)


def spread(entries: np.ndarray) -> np.ndarray:
    """Half of each entry's distance to the nearest other entry, rounded down."""
    away = squared(entries, entries).astype(np.float64)
    np.fill_diagonal(away, np.inf)
    return np.sqrt(away.min(axis=1, initial=np.inf)) / 2 * (1 - SLACK)


def assign(x: np.ndarray, entries: np.ndarray, code: np.ndarray | None = None, upper: np.ndarray | None = None, lower: np.ndarray | None = None, moved: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest entry of each row, ties to the lower index, with an upper bound of its distance and a lower one of the second nearest.

    code, upper and lower are those of the round before, and moved is how far each entry has gone since. A row keeps its
    entry where its upper bound is strictly below both the lower bound and half of the entry's distance to the next
    entry: no other entry can then be as near. The upper bound is made exact before a row is scanned. The last result is
    the number of rows scanned in full.
    """
    n = len(x)
    if code is None:
        code, upper, lower, todo = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.arange(n)
    else:
        first = int(moved.argmax()) if len(moved) else 0
        rest = np.full(len(moved), moved.max(initial=0.0))
        if len(moved) > 1:
            rest[first] = np.partition(moved, -2)[-2]
        upper = (upper + moved[code]) * (1 + SLACK)
        lower = np.maximum(lower - rest[code], 0) * (1 - SLACK)
        safe = np.maximum(lower, spread(entries)[code])
        todo = np.flatnonzero(~(upper < safe))
        upper[todo] = np.sqrt(((x[todo] - entries[code[todo]]) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK)
        todo = todo[~(upper[todo] < safe[todo])]
        code = code.copy()
    for at in range(0, len(todo), CHUNK_ROWS):
        rows = todo[at : at + CHUNK_ROWS]
        away = squared(x[rows], entries)
        code[rows] = away.argmin(axis=1)  # the first of equals
        near = np.partition(away, 1, axis=1)[:, :2] if away.shape[1] > 1 else np.column_stack([away[:, 0], np.full(len(rows), np.iinfo(np.int64).max)])
        upper[rows] = np.sqrt(near[:, 0].astype(np.float64)) * (1 + SLACK)
        lower[rows] = np.sqrt(near[:, 1].astype(np.float64)) * (1 - SLACK)
    return code, upper, lower, len(todo)


def by_dims(batch: pa.RecordBatch, column: str = "v") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch that have vectors of equal length, and these vectors."""
    lists = batch.column(column)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for dims in np.unique(sizes).tolist():
        on = np.flatnonzero(sizes == dims)
        yield on, values[starts[on, None] + np.arange(dims)].reshape(len(on), dims)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1), kind))


def _step(rows: DataFrame, books: dict[int, Books], moved: dict[int, Books] | None, parts: int) -> DataFrame:
    """rows with code, upper and lower of this round; moved: by dimension and part, how far the entries went, None in the first round."""
    bounds = "code array<int>, upper array<double>, lower array<double>"
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields if f.name not in ('code', 'upper', 'lower'))}, {bounds}"
    names = [f.name for f in rows.schema.fields if f.name not in ("code", "upper", "lower")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, upper, lower = np.zeros((batch.num_rows, parts), np.int64), np.zeros((batch.num_rows, parts)), np.zeros((batch.num_rows, parts))
            before = [np.asarray(batch.column(c).flatten()).reshape(-1, parts) for c in ("code", "upper", "lower")] if moved is not None else None
            for on, x in by_dims(batch):
                for p, part in enumerate(cuts(x.shape[1], parts)):
                    known = () if before is None else (before[0][on, p].astype(np.int64), before[1][on, p], before[2][on, p], moved[x.shape[1]][p])
                    code[on, p], upper[on, p], lower[on, p], _ = assign(x[:, part], books[x.shape[1]][p], *known)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), _lists(code, pa.int32()), _lists(upper, pa.float64()), _lists(lower, pa.float64())], [*names, "code", "upper", "lower"])

    return in_arrow(rows, run, schema)


def _sums(rows: DataFrame, books: dict[int, Books], parts: int) -> DataFrame:
    """By dimension, part, entry and place, at place 0 the number of assigned parts, then their sums by component; a task adds up its rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            codes = np.asarray(batch.column("code").flatten()).reshape(-1, parts)
            for on, x in by_dims(batch):
                for p, part in enumerate(cuts(x.shape[1], parts)):
                    key = x.shape[1], p
                    if key not in total:
                        total[key] = np.zeros((len(books[x.shape[1]][p]), part.stop - part.start + 1), np.int64)
                    np.add.at(total[key], codes[on, p], np.column_stack([np.ones(len(on), np.int64), x[:, part]]))
        for (dims, p), sums in total.items():
            used = np.flatnonzero(sums[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), dims), pa.int32()), pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()), _lists(sums[used], pa.int64())], ["dims", "part", "entry", "sums"])

    partial = in_arrow(rows.select("v", "code"), run, "dims int, part int, entry int, sums array<long>")
    place = partial.select("dims", "part", "entry", F.posexplode("sums").alias("place", "x"))
    return place.groupBy("dims", "part", "entry", "place").agg(F.sum("x").alias("x"))


def _move(books: dict[int, Books], sums: DataFrame) -> tuple[dict[int, Books], dict[int, Books]]:
    """Codebooks whose used entries are the floors of their parts' means, and how far each entry went; as many numbers as the codebooks hold come to the driver."""
    new = {dims: [b.copy() for b in book] for dims, book in books.items()}
    total = {(r["dims"], r["part"], r["entry"], r["place"]): r["x"] for r in sums.collect()}
    for (dims, part, entry, place), x in total.items():
        if place:  # at 0 is the number of parts
            new[dims][part][entry, place - 1] = x // total[dims, part, entry, 0]
    far = {dims: [np.sqrt(((a - b).astype(np.float64) ** 2).sum(axis=1)) * (1 + SLACK) for a, b in zip(book, books[dims], strict=True)] for dims, book in new.items()}
    return new, far


def _errors(rows: DataFrame, books: dict[int, Books], parts: int) -> DataFrame:
    """rows with their final codes as hex digits and the exact squared distances summed over the parts."""
    names = [f.name for f in rows.schema.fields if f.name not in ("v", "code", "upper", "lower")]
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields if f.name in names)}, code string, error long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, error = np.asarray(batch.column("code").flatten()).reshape(-1, parts), np.zeros(batch.num_rows, np.int64)
            for on, x in by_dims(batch):
                for p, part in enumerate(cuts(x.shape[1], parts)):
                    error[on] += ((x[:, part] - books[x.shape[1]][p][codes[on, p]]) ** 2).sum(axis=1)
            text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(text, pa.string()), pa.array(error)], [*names, "code", "error"])

    return in_arrow(rows, run, schema)


def digest(books: dict[int, Books]) -> str:
    """SHA-256 of all entries' decimal components, by dimension, part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for _, book in sorted(books.items()) for entries in book for x in entries.reshape(-1).tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, dict[int, Books]]:
    """Codes of all vectors, and the codebooks by dimension.

    vectors has vec_id, v array<long> and any other columns but code, upper, lower and error. The rows with the smallest
    vec_ids, `entries` of them, are the first codebooks; ties go by the vector, null ids come last, and with fewer rows
    the codebooks are smaller. Each round assigns every part to its nearest entry, ties to the lower index, and moves
    each used entry to the floor of its parts' mean. Between rounds each row keeps two bounds a part, in a written table
    that takes the place of the one before; a part is compared with all entries only where its bounds don't settle it.
    The driver holds the codebooks alone, and their sums of a round.

    Null vectors are left out. Vectors of each length have codebooks of their own. Repeated rows count as often as they
    occur. An empty table gives an empty one and no codebooks.

    Returns the rows without v, with code string (two hex digits a part) and error long.
    """
    rows = cut(vectors.where("v is not null"))
    books: dict[int, Books] = {}
    for (dims,) in rows.select(F.size("v")).distinct().collect():
        first = rows.where(F.size("v") == dims).orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
        start = np.array([r["v"] for r in first], np.int64).reshape(len(first), dims)
        books[dims] = [start[:, part].copy() for part in cuts(dims, parts)]
    moved = None
    for _ in range(rounds):
        state = cut(_step(rows, books, moved, parts))
        discard(rows)
        rows = state
        books, moved = _move(books, _sums(rows, books, parts))
    out = cut(_errors(_step(rows, books, moved, parts), books, parts))
    discard(rows)
    return out, books


def with_label_errors(codes: DataFrame, label: str = "label") -> DataFrame:
    """codes with label_error: the sum of error over all rows of the same label, null labels together."""
    key = ["label_none", "label_some"]
    keyed = codes.withColumns({key[0]: F.col(label).isNull(), key[1]: F.coalesce(F.col(label).cast("string"), F.lit(""))})
    sums = cut(keyed.groupBy(key).agg(F.sum("error").cast("long").alias("label_error")))
    if sums.count() <= BROADCAST_LABELS:
        return keyed.join(F.broadcast(sums), key).drop(*key)
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return salted.join(sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*key, "salt"]).drop(*key, "salt")
