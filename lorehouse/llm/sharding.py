"""Sharding by global byte prefix sums: contiguous shards of nearly equal bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def assign_shards(df: DataFrame, order: list[str], size: Column, n_shards: int = 8, keep: list[str] | None = None) -> DataFrame:
    """Deal the rows, in the given order, into n_shards runs of nearly equal total size.

    Each range partition of the order sums its sizes; the running totals over these few partition rows give every
    partition its offset, and a window inside a partition gives each row the bytes before it. A row goes to the shard
    in which its middle byte lies: shard = floor(n * (before + size / 2) / total). So shards are contiguous in the
    order, and each is within one row's size of its target.

    Returns the columns of keep (default: order), size long, shard int and slot long, the row's place in its shard
    from 0. Rows alike in order, size and all kept columns are interchangeable; nulls in order come first; a null
    size counts as 0; an empty table gives an empty result. Very long rows make a shard larger by at most that row.
    """
    keep = list(dict.fromkeys(keep or order))
    cols = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    sort = [f"o{i}" for i in range(len(order))]
    rows = df.select(*cols, *[F.col(c).alias(o) for c, o in zip(order, sort, strict=True)], F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    ties = [*sort, "size", *[f"k{i}" for i, c in enumerate(keep) if c not in order]]
    placed = cut(rows.repartitionByRange(*ties).withColumn("part", F.spark_partition_id()))

    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(over), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(over), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("total"))

    within = Window.partitionBy("part").orderBy(*ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("bytes_before") + F.sum("size").over(within) - F.col("size")
    located = (
        placed.join(F.broadcast(offsets), "part")
        .withColumn("before", before)
        .withColumn("place", F.col("rows_before") + F.row_number().over(Window.partitionBy("part").orderBy(*ties)) - 1)
    )
    middle = F.expr(f"(2 * before + size) * {n_shards} div (2 * greatest(total, 1))")
    dealt = located.withColumn("shard", F.least(F.lit(n_shards - 1), middle).cast("int"))
    firsts = dealt.groupBy("shard").agg(F.min("place").alias("first"))  # n_shards rows
    return dealt.join(F.broadcast(firsts), "shard").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "size", "shard", (F.col("place") - F.col("first")).alias("slot"))


def write_shards(df: DataFrame, order: list[str], size: Column, path: str, n_shards: int = 8) -> None:
    """Write the rows of df as Parquet folders shard=0..n-1, each in slot order within its files.

    Columns named size, shard or slot are replaced by those of assign_shards.
    """
    out = assign_shards(df, order, size, n_shards, df.columns if set(df.columns).isdisjoint({"size", "shard", "slot"}) else [c for c in df.columns if c not in ("size", "shard", "slot")])
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
