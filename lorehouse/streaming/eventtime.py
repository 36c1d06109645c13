"""Event time: streams whose state is bounded by a watermark, and the rows that the engine counts as too late."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass
class Run:
    """What a run of a stream gave: its rows, and by the engine's own count the rows that came too late and the rows of state it held at most and at its end."""

    rows: DataFrame
    late: int
    most_state: int
    last_state: int


def put_parts(rows: DataFrame, part: str, folder: str) -> str:
    """Write rows as one file a part, which a stream takes in the order of the parts; gives the folder."""
    path = f"{folder}/{uuid.uuid4().hex}"
    parts = [r[0] for r in rows.select(part).distinct().orderBy(part).collect()]
    for n, p in enumerate(parts):  # one after the other: a file stream takes the older file first
        rows.where(F.col(part) == p).drop(part).coalesce(1).write.parquet(f"{path}/part={n:05d}")
    return path


def parts_stream(spark: SparkSession, path: str, schema: str, most: int = 1) -> DataFrame:
    """A stream over what put_parts has written, `most` parts a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most).option("recursiveFileLookup", "true").parquet(path)


def counted(stream: DataFrame, folder: str, mode: str = "append", state: str | None = None) -> Run:
    """Run a stream over what is there now. Rows go to Parquet under folder, batch by batch; progress and the watermark are kept in `state`, so that another run with it goes on from there."""
    spark, path, batches = stream.sparkSession, f"{folder}/{uuid.uuid4().hex}", []

    def write(batch: DataFrame, n: int) -> None:
        batches.append(n)
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state or f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    operators = [op for p in query.recentProgress for op in json.loads(p.json)["stateOperators"]]
    rows = spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{path}/rows") if batches else spark.createDataFrame([], stream.schema)
    held = [op["numRowsTotal"] for op in operators]
    return Run(rows, sum(op["numRowsDroppedByWatermark"] for op in operators), max(held, default=0), held[-1] if held else 0)


def first_within(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The first row of each key within the watermark: state holds a key until the watermark has passed its time by `late`."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n) of sessions of rows with less than gap between them, given once the watermark has passed their end; then their state goes."""
    g = stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def session_marks(stream: DataFrame, key: str, ts: str, interval: int, idle_seconds: int, late: str) -> DataFrame:
    """(key, mark, at): each multiple of interval that the rows of a key reach without idle_seconds between them, and when.

    State is a count and the last time of a key. Once the watermark has passed the last time by idle_seconds the state
    goes, by the engine's time-out; a row that comes later begins anew. A batch's rows of a key are taken in time order.
    """

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last = state.get if state.exists else (0, None)
        times = pd.concat([p[ts] for p in parts]).sort_values(kind="stable").astype("datetime64[us]")
        marks = []
        for t, at in zip(times.astype("int64").tolist(), times, strict=True):
            n = n + 1 if last is not None and t - last < idle_seconds * 1_000_000 else 1
            last = t if last is None else max(last, t)
            if n % interval == 0:
                marks.append((name[0], n, at))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last // 1000 + idle_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        if marks:
            yield pd.DataFrame(marks, columns=[key, "mark", "at"]).astype({"mark": "int64", "at": "datetime64[us]"})

    kind = stream.schema[key].dataType.simpleString()
    rows = stream.withWatermark(ts, late).groupBy(key)
    return rows.applyInPandasWithState(step, f"{key} {kind}, mark long, at timestamp", "n long, last long", "append", GroupStateTimeout.EventTimeTimeout)
