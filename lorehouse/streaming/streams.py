"""Structured Streaming: rate windows, session counts, checkpoints, watermarks, idempotent imports."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream over a table's Parquet file or folder."""
    like = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.readStream.schema(like.schema).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern may match a file, a plain path must be a folder


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream with a time-zoned timestamp."""
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a stream over what is there now, and read its last result.

    Rows go to Parquet under folder, in complete mode the last batch alone counts. Progress is in a checkpoint beside
    them; a batch that is run again after a failure replaces its own rows.
    """
    spark, path = stream.sparkSession, f"{folder}/{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        target = f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={n}"
        batch.write.mode("overwrite").parquet(target)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows").select(stream.columns)


def rate_windows(stream: DataFrame, key: str = "user_id", minutes: int = 15, limit: int = 1000, late: str = "1 hour") -> DataFrame:
    """Requests by key in fixed windows and whether the limit is passed; rows later than `late` are dropped."""
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), key).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), key, "n", (F.col("n") > limit).alias("limited"))


def session_counts(stream: DataFrame, key: str = "user_id") -> DataFrame:
    """Requests and last use by session: state holds one row a session."""
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.max("ts").alias("last_used"))


def first_seen(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key, once, whatever is replayed."""
    return stream.dropDuplicates(keys)


def turn_checkpoints(stream: DataFrame, interval: int = 20) -> DataFrame:
    """(conv_id, checkpoint): for conversations' user turns, each multiple of interval that their number reaches.

    State is one count a conversation; turns that hold a command don't count.
    """
    turns = stream.where((F.col("role") == "user") & ~F.contains("text", F.lit("<command-message>"))).select("conv_id")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        after = before + sum(len(p) for p in parts)
        state.update((after,))
        marks = range((before // interval + 1) * interval, after + 1, interval)
        yield pd.DataFrame({"conv_id": [key[0]] * len(marks), "checkpoint": pd.Series(list(marks), dtype="int64")})

    kind = stream.schema["conv_id"].dataType.simpleString()
    return turns.groupBy("conv_id").applyInPandasWithState(step, f"conv_id {kind}, checkpoint long", "n long", "append", GroupStateTimeout.NoTimeout)


def ttl_cache(stream: DataFrame, seconds: int) -> DataFrame:
    """(key, ts, hit) of look-ups (key, ts): a hit within `seconds` of the fill before, else a miss, which fills the entry again.

    State is one number a key, the time of its last fill. A micro-batch's look-ups of a key are taken in time order.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
        filled = state.get[0] if state.exists else None
        hits = []
        for t in (rows["ts"].astype("datetime64[us]").astype("int64")).tolist():
            hits.append(filled is not None and t < filled + seconds * 1_000_000)
            if not hits[-1]:
                filled = t
        state.update((filled,))
        yield pd.DataFrame({"key": [key[0]] * len(rows), "ts": rows["ts"], "hit": hits})

    kind = stream.schema["key"].dataType.simpleString()
    return stream.select("key", "ts").groupBy("key").applyInPandasWithState(step, f"key {kind}, ts timestamp, hit boolean", "filled long", "append", GroupStateTimeout.NoTimeout)


def watermark_report(rows: DataFrame, part: str, ts: str, late: str) -> DataFrame:
    """(part, n, late) of rows that come part by part: how many of a part lie more than `late` before the last time of all parts before it.

    What a stream with this watermark drops of each micro-batch, as a table: the rows that come too late are counted,
    not only left out.
    """
    tops = rows.groupBy(part).agg(F.max(ts).alias("top"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    marks = tops.select(part, (F.max("top").over(before) - F.expr(f"interval {late}")).alias("mark"))
    return rows.join(F.broadcast(marks), part).groupBy(part).agg(F.count("*").alias("n"), F.count_if(F.col(ts) < F.col("mark")).alias("late"))
