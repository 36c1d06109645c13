"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, in_arrow, mix64, plus, seeds

#: n-grams of one to three letters are hashed into 2 ** GRAM_BITS buckets; a bucket stands for an n-gram.
GRAM_BITS = 20
PROFILE, TOP = 400, 300
UNKNOWN = "und"
#: Code points and texts turned into n-grams at once.
CHUNK, CHUNK_ROWS = 250_000, 500
#: Languages whose counts a training task holds before it sends them on.
HELD = 32

_END = "\U0010ffff"
_MULTS = seeds(3, 37)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every n-gram: 1 to 3 letters of a lower-cased word, whose ends count as a letter of their own."""
    joined = _END.join(t.replace(_END, " ") for t in texts).lower() + _END
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.cumsum(points == ord(_END)) - (points == ord(_END))
    inside = _letters()[points]
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # the first mark after a letter stays, as the word's end
    s = np.where(inside, points, 0)[keep].astype(np.uint64)
    row = row[keep]
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.concatenate([np.zeros(1, np.uint64), s])
    row = np.concatenate([row[:1], row])
    a, b, c = s * _MULTS[0], s * _MULTS[1], s * _MULTS[2]
    letter = s != 0
    out = []
    for n, h, at in (
        (1, a, letter),
        (2, a[:-1] + b[1:], letter[:-1] | letter[1:]),
        (3, a[:-2] + b[1:-1] + c[2:], letter[1:-1] & (letter[:-2] | letter[2:])),
    ):
        owner = row if n == 1 else np.where(letter[:-1], row[:-1], row[1:]) if n == 2 else row[1:-1]
        out.append(((mix64(h[at] + np.uint64(n)) >> np.uint64(64 - GRAM_BITS)).astype(np.int64), owner[at]))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _runs(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The texts in runs of about CHUNK code points and CHUNK_ROWS texts at most, each with its first index."""
    first, run, size = 0, [], 0
    for i, t in enumerate(texts):
        if run and (size + len(t) > CHUNK or len(run) == CHUNK_ROWS):
            yield first, run
            first, run, size = i, [], 0
        run.append(t)
        size += len(t)
    if run:
        yield first, run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["lang", "gram", "n"])
        held.clear()

    for batch in chunks(batches, "text"):
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            if lang not in held and len(held) >= HELD:
                yield from flush()
            counts = held.setdefault(lang, np.zeros(1 << GRAM_BITS, np.int64))
            for _, run in _runs([t for t, x in zip(texts, langs, strict=True) if x == lang and t]):
                counts += np.bincount(grams(run)[0], minlength=1 << GRAM_BITS)
    yield from flush()


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", profile: int = PROFILE) -> list[tuple[str, int, int]]:
    """(lang, gram, rank from 0) of each language's most frequent n-grams over all rows with text and language.

    Tasks count by language in tables of fixed size, partial sums are shuffled by n-gram, and what the driver gets is
    bounded by the number of languages times profile. Ties go to the smaller bucket. Null texts or languages teach
    nothing; without any, the profile is empty.
    """
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    sums = in_arrow(labelled, _count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")  # 2 ** GRAM_BITS rows a language at most
    top = sums.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < profile)
    return sorted((r["lang"], r["gram"], r["rank"]) for r in top.select("lang", "gram", "rank").collect())


def predict(docs: DataFrame, model: list[tuple[str, int, int]], text_col: str = "text", profile: int = PROFILE, top: int = TOP) -> DataFrame:
    """Add lang_pred string and score double to docs.

    A text's most frequent n-grams (those in some profile, `top` at most, ties to the smaller bucket) have ranks; for
    each language the distance sums how far each is out of place, or profile if the language lacks it. The nearest
    language wins, ties to the smaller name; score is 1 - distance / (profile * n-grams). A null text, one without
    letters, or an empty model gives `und` and 0; a text whose n-grams no profile has gives the first language and 0.
    Columns of docs named lang_pred or score are replaced.
    """
    langs = sorted({x for x, _, _ in model})
    vocab = np.array(sorted({g for _, g, _ in model}), np.int64)
    ranks = np.full((len(langs), len(vocab)), -1, np.int64)
    for lang, gram, rank in model:
        ranks[langs.index(lang), np.searchsorted(vocab, gram)] = rank
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    place = names.index(text_col)

    def guess(texts: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray]:
        found, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for first, run in _runs(texts):
            gram, row = grams(run)
            letters = np.bincount(row, minlength=len(run)) > 0
            if not langs:
                continue
            width = len(vocab) + 1
            counts = np.bincount(row * width + table[gram], minlength=len(run) * width).reshape(len(run), width)[:, :-1]
            best = np.argsort(-counts, axis=1, kind="stable")[:, :top]
            present = np.take_along_axis(counts, best, axis=1) > 0
            n = present.sum(axis=1)
            mine = np.arange(best.shape[1])
            dist = np.empty((len(run), len(langs)))
            for i in range(len(langs)):
                theirs = ranks[i][best]
                dist[:, i] = (np.where(theirs < 0, profile, np.minimum(np.abs(theirs - mine), profile)) * present).sum(axis=1)
            pick = dist.argmin(axis=1)
            for j in np.flatnonzero(letters):
                found[first + j] = langs[pick[j]]
                score[first + j] = 1 - dist[j, pick[j]] / (profile * n[j]) if n[j] else 0.0
        return found, score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.full(1 << GRAM_BITS, len(vocab), np.int64)
        table[vocab] = np.arange(len(vocab))
        for batch in chunks(batches, names[place]):
            found, score = guess([t or "" for t in batch.column(place).to_pylist()], table)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return in_arrow(docs, run, plus(docs, lang_pred="string", score="double"))


def held_out(id_col: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold
