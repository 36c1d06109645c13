"""Vectors for the entries that have none: a pluggable embedder, retries and failures as rows, parts that are written whole, and a start from where a run broke off."""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ingest

#: From texts to vectors of numbers; an answer may be None, and a call may raise.
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float] | None]]

#: Tries of a text, texts of a call, and entries of a part.
TRIES, CALL_TEXTS, PART_ROWS = 2, 64, 100_000

VECTOR = "id string, embedder_id string, vec array<double>, tries int, error string"


class HashedWords:
    """A deterministic embedder: how many of a text's words fall into each of dims buckets by MD5, as functions.vectors.hashed_words counts them."""

    def __init__(self, dims: int = 64) -> None:
        self.dims = dims

    def __call__(self, texts: Sequence[str]) -> list[list[float] | None]:
        return [self.one(t) for t in texts]

    def one(self, text: str) -> list[float] | None:
        words = re.findall("[a-z0-9]+", text.lower())
        out = [0.0] * self.dims
        for w in words:
            out[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % self.dims] += 1
        return out if words else None


def _problem(vec: Sequence[float] | None, dims: int) -> str | None:
    """What is wrong with an answer, if anything."""
    if vec is None:
        return "no vector"
    if len(vec) != dims:
        return f"{len(vec)} dimensions, not {dims}"
    return None if all(x is not None and math.isfinite(x) for x in vec) else "not finite"


def _answers(model: Embedder, texts: list[str], dims: int, tries: int) -> list[tuple[list[float] | None, int, str | None]]:
    """(vector, tries, error) of each text. A call that raises, or gives too few answers, is made again text by text; bad answers are asked for again."""
    out: list[tuple[list[float] | None, int, str | None]] = [(None, 0, "not asked")] * len(texts)
    todo = [list(range(len(texts)))] if texts else []
    for n in range(1, tries + 1):
        again = []
        for group in todo:
            try:
                found = list(model([texts[i] for i in group]))
                if len(found) != len(group):
                    raise ValueError(f"{len(found)} answers for {len(group)} texts")
            except Exception as e:  # noqa: BLE001 - whatever a model raises is a row's error
                found, failed = [None] * len(group), f"{type(e).__name__}: {e}"
            else:
                failed = None
            for i, vec in zip(group, found, strict=True):
                error = failed or _problem(vec, dims)
                out[i] = ([float(x) for x in vec] if error is None else None, n, error)
                if error is not None:
                    again.append([i])
        todo = again
    return out


def embedded(work: DataFrame, load: Callable[[], Embedder], embedder_id: str, dims: int, tries: int = TRIES) -> DataFrame:
    """VECTOR of rows (id, content): load is called once a task, and what it gives with CALL_TEXTS texts at a time.

    An answer must have dims finite numbers. A text that got none after its tries is a row with error and without a
    vector; null contents count as empty texts. Nothing that a model raises stops the job.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            for at in range(0, len(frame), CALL_TEXTS):
                some = frame.iloc[at : at + CALL_TEXTS]
                answers = _answers(model, [t if isinstance(t, str) else "" for t in some["content"]], dims, tries)
                yield pd.DataFrame({"id": some["id"].to_numpy(), "embedder_id": embedder_id, "vec": [a[0] for a in answers], "tries": [a[1] for a in answers], "error": [a[2] for a in answers]})

    return work.select("id", "content").mapInPandas(run, VECTOR)


class Backfill:
    """Vectors in a folder, a folder a part, which Spark's commit shows whole or not at all.

    A run asks for the entries that have neither an embedder nor a vector here. After a break it is called again and
    goes on with the rest: each vector is written once. Failures are rows too; a later run asks for them again, and the
    last row of an entry counts.
    """

    def __init__(self, spark: SparkSession, path: str, load: Callable[[], Embedder], embedder_id: str, dims: int, tries: int = TRIES) -> None:
        self.spark, self.path, self.load, self.embedder_id, self.dims, self.tries = spark, path.rstrip("/"), load, embedder_id, dims, tries

    def _parts(self) -> list[tuple[int, str]]:
        """Order and path of the parts that were written whole."""
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        found = [s.getPath() for s in fs.listStatus(top) if s.isDirectory() and s.getPath().getName().startswith("part-")]
        return sorted((int(p.getName().split("-")[1]), str(p)) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def rows(self) -> DataFrame:
        """VECTOR of all parts, and part, their order."""
        parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], f"{VECTOR}, part int")
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/part-(\d+)-", 1).cast("int")
        return self.spark.read.schema(VECTOR).parquet(*[p for _, p in parts]).select("*", number.alias("part"))

    def vectors(self) -> DataFrame:
        """id, embedder_id and vec of all that were embedded."""
        return self.rows().where("vec is not null").select("id", "embedder_id", "vec")

    def failures(self) -> DataFrame:
        """id, error and tries of entries that have no vector yet, as of their last run."""
        last = self.rows().groupBy("id").agg(F.max_by(F.struct("error", "tries", F.col("vec").isNull().alias("bad")), "part").alias("x"))
        return last.where("x.bad").select("id", "x.error", "x.tries")

    def pending(self, entries: DataFrame) -> DataFrame:
        """Entries (id, content, embedder_id) that have no vector yet."""
        return ingest.pending(entries, self.vectors())

    def run(self, entries: DataFrame, part_rows: int = PART_ROWS, most_parts: int | None = None) -> int:
        """Embed what is pending in parts of about part_rows entries, most_parts of them at most; gives how many were written."""
        before = self._parts()
        first = max((n for n, _ in before), default=-1) + 1
        # what was pending when the run began, whatever it writes meanwhile: its parts don't overlap
        work = ingest.pending(entries, self.rows().where((F.col("part") < first) & F.col("vec").isNotNull()).select("id"))
        many = -(-work.count() // part_rows)
        written = many if most_parts is None else min(many, most_parts)
        for n in range(written):
            mine = work.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(many)) == n)
            embedded(mine, self.load, self.embedder_id, self.dims, self.tries).write.parquet(f"{self.path}/part-{first + n}-{uuid.uuid4().hex}")
        return written


def stored(entries: DataFrame, vectors: DataFrame, dims: int, as_of: str) -> DataFrame:
    """entries with the vectors (id, embedder_id, vec) that came after them: vec, embedder_id and embedded_at are replaced.

    Of several vectors of an id the one with the greatest embedder_id counts; one that hasn't dims finite components
    leaves an entry as it is, and one without an entry goes.
    """
    good = (F.size("vec") == dims) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    new = vectors.where(F.col("vec").isNotNull() & good).groupBy("id").agg(F.max_by(F.struct("embedder_id", "vec"), "embedder_id").alias("new"))
    have = set(entries.columns)
    old = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    hit = F.col("new").isNotNull()
    return entries.join(new, "id", "left").withColumns(
        {
            "vec": F.when(hit, F.col("new.vec")).otherwise(old("vec", "array<double>")),
            "embedder_id": F.when(hit, F.col("new.embedder_id")).otherwise(old("embedder_id", "string")),
            "embedded_at": F.when(hit, F.lit(as_of).cast("timestamp")).otherwise(old("embedded_at", "timestamp")),
        }
    ).drop("new")
