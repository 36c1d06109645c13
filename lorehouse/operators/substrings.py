"""Which strings are part of which texts, by the strings' rarest runs of characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a run, by which a string is looked for in texts; shorter strings are runs of their own.
RUN = 4
#: Strings that each text is searched for one by one, at most.
FEW = 1024


def _runs(text: str, size: int) -> Column:
    """All runs of size characters of a column, overlapping, each once."""
    return F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _searched(texts: DataFrame, needles: list[str]) -> DataFrame:
    """(id, needle) by looking for each needle in each text: in Arrow batches, as Python's search is several times faster than Spark's contains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [[n for n in needles if n in t] for t in batch.column("text").to_pylist()]
            rows = np.repeat(np.arange(batch.num_rows), [len(h) for h in hits])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array([n for h in hits for n in h], pa.string())], ["id", "needle"])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, needle string")


def contained(needles: DataFrame, texts: DataFrame, few: int = FEW) -> DataFrame:
    """(id, needle) of all pairs in which a text holds a needle; needles has needle, texts id (unique) and text.

    Up to `few` needles go to all tasks, where each text is searched for each of them; nothing is shuffled. With more,
    one run of RUN characters is chosen of each, that which fewest needles have, and a text's runs meet the needles'
    chosen ones in an equi-join, and what meets is looked at in full: work follows the length of the texts and the pairs
    that share a chosen run. Empty needles and nulls are in nothing.
    """
    n = needles.select("needle").where("needle <> ''").distinct()
    some = [r["needle"] for r in n.limit(few + 1).collect()]
    if len(some) <= few:
        return _searched(texts.where("text is not null").select("id", "text"), some)
    n = n.withColumn("size", F.least(F.length("needle"), F.lit(RUN)))
    found = None
    for size in range(1, RUN + 1):
        runs = n.where(F.col("size") == size).select("needle", F.explode(_runs("needle", size)).alias("run"))
        many = runs.groupBy("run").agg(F.count("*").alias("many"))
        chosen = runs.join(many, "run").groupBy("needle").agg(F.min(F.struct("many", "run"))["run"].alias("run"))
        met = texts.select("id", F.explode(_runs("text", size)).alias("run")).join(chosen, "run").select("id", "needle")
        found = met if found is None else found.unionByName(met)
    return found.join(texts.select("id", "text"), "id").where(F.contains("text", "needle")).select("id", "needle")
