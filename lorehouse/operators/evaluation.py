"""Ranking metrics, threshold sweeps, histograms and quantiles."""

from __future__ import annotations

from functools import cmp_to_key, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut, discard


def _positive(k: int) -> int:
    if not isinstance(k, int) or isinstance(k, bool) or k < 0:
        raise ValueError("k must be a whole number, not negative")
    return k


def precision_at_k(judged: DataFrame, k: int) -> DataFrame:
    """(query_id, precision) of rows (query_id, rank, rel): relevant among the first k, over k."""
    if not _positive(k):
        return judged.groupBy("query_id").agg(F.lit(0.0).alias("precision"))
    return judged.groupBy("query_id").agg((F.count_if((F.col("rank") <= k) & (F.col("rel") > 0)) / k).alias("precision"))


def reciprocal_rank(judged: DataFrame) -> DataFrame:
    return judged.groupBy("query_id").agg(F.coalesce(1 / F.min(F.when(F.col("rel") > 0, F.col("rank"))), F.lit(0.0)).alias("rr"))


def ndcg_at_k(judged: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """Binary gain over log2(rank + 1); totals has (query_id, relevant), all that are relevant to a query."""
    _positive(k)
    gain = judged.groupBy("query_id").agg(F.sum(F.when((F.col("rank") <= k) & (F.col("rel") > 0), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("relevant").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    best = totals.where("relevant > 0").select("query_id", ideal.alias("ideal"))
    return gain.join(best, "query_id", "left").select("query_id", F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)).alias("ndcg"))


def meta_share(ranked: DataFrame, k: int, extractor: str, subjects: tuple[str, ...]) -> DataFrame:
    """(query_id, share) of rows (query_id, rank, extracted_by, subject) about the store itself, over k; 0 for k = 0.

    That is what the extractor has made, or what has a subject that starts like one of subjects.
    """
    meta = F.coalesce(F.col("extracted_by") == extractor, F.lit(False))
    for head in subjects:
        meta = meta | F.coalesce(F.col("subject").startswith(head), F.lit(False))
    share = F.count_if((F.col("rank") <= k) & meta) / k if _positive(k) else F.lit(0.0)
    return ranked.groupBy("query_id").agg(share.alias("share"))


def sweep(pairs: DataFrame, low: int = 100, high: int = 199, scale: int = 200, weight: str | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 of (sim, dup) at the thresholds low/scale to high/scale; a row counts weight times, or once.

    Pairs are first counted by the last threshold that they reach, and running sums over the grid give every
    threshold's counts: a pair is read once, not once a threshold.
    """
    step = F.greatest(F.lit(low - 1), F.least(F.lit(high), F.floor(F.col("sim") * scale).cast("int")))
    times = F.lit(1) if weight is None else F.col(weight)
    counted = lambda x: F.sum(F.when(x, times).otherwise(0))
    counts = pairs.groupBy(step.alias("i")).agg(counted(F.col("dup")).alias("d"), counted(~F.col("dup")).alias("n"))
    grid = pairs.sparkSession.range(low - 1, high + 1).select(F.col("id").cast("int").alias("i"))
    down = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a threshold
    every = grid.join(counts, "i", "left").select("i", F.coalesce("d", F.lit(0)).alias("d"), F.coalesce("n", F.lit(0)).alias("n"))
    sums = every.select("i", F.sum("d").over(down).alias("tp"), F.sum("n").over(down).alias("fp"), F.sum("d").over(Window.partitionBy()).alias("dups")).where(F.col("i") >= low)
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(1.0)
    r = F.when(F.col("dups") > 0, F.col("tp") / F.col("dups")).otherwise(0.0)
    out = sums.select((F.col("i") / scale).alias("threshold"), "tp", "fp", (F.col("dups") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.withColumn("f1", f1)


def operating_points(swept: DataFrame, recall: float = 0.9) -> DataFrame:
    """One row: the threshold of the best F1 (the first of ties), the lowest above which nothing is falsely refused, the highest with this recall."""
    down = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = swept.withColumn("clean", F.sum("fp").over(down) == 0)
    return s.agg(
        F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("best_f1_threshold"),
        F.min(F.when(F.col("clean"), F.col("threshold"))).alias("zero_fp_threshold"),
        F.max(F.when(F.col("recall") >= recall, F.col("threshold"))).alias("recall_threshold"),
    )


def histogram(values: DataFrame, column: str, low: float = 0.5, high: float = 1.0, bins: int = 20, weight: str | None = None) -> DataFrame:
    """(bin, n) of the values in low..high; the upper edge counts for the last bin; a row counts weight times, or once."""
    v = F.col(column)
    at = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return values.where((v >= low) & (v <= high)).groupBy(at.alias("bin")).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))


def summary(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """n, min, p10, p25, median, p75, p90, max, mean by group; quantiles interpolate linearly."""
    qs = F.percentile(column, F.array(*[F.lit(q) for q in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    g = values.groupBy(*by).agg(F.count(column).alias("n"), F.min(column).alias("min"), qs.alias("q"), F.max(column).alias("max"), F.avg(column).alias("mean"))
    names = ("p10", "p25", "median", "p75", "p90")
    return g.select(*by, "n", "min", *[F.col("q")[i].alias(x) for i, x in enumerate(names)], "max", "mean")


def counted_summary(counts: DataFrame, column: str, weight: str, by: list[str], unit: int = 1_000_000) -> DataFrame:
    """As summary, of values that are whole multiples of 1 / unit and stand for weight rows each.

    Values are placed by running sums, first over the sums of spans of 1000 values, then within a span; quantiles and
    mean come from whole numbers, so they don't depend on the order of sums.
    """
    cells = counts.select(*by, F.round(F.col(column) * unit).cast("long").alias("k"), F.col(weight).alias("w")).withColumn("span", F.floor(F.col("k") / 1000))
    before = Window.partitionBy(*by).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # one row a span
    sums = cells.groupBy(*by, "span").agg(F.sum("w").alias("sw"))
    spans = sums.select(*[F.col(c).alias(f"s_{c}") for c in [*by, "span"]], F.coalesce(F.sum("sw").over(before), F.lit(0)).alias("before"), F.sum("sw").over(Window.partitionBy(*by)).alias("total"))
    within = Window.partitionBy(*by, "span").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cells.withColumn("upto", F.sum("w").over(within))
    placed = placed.join(spans, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in [*by, "span"]])).withColumn("upto", F.col("upto") + F.col("before"))
    names = {"p10": 2, "p25": 5, "median": 10, "p75": 15, "p90": 18}  # twentieths
    at = {x: (F.col("total") - 1) * q for x, q in names.items()}
    held = lambda place: F.max(F.when((place >= F.col("upto") - F.col("w")) & (place < F.col("upto")), F.col("k")))
    ends = [c for x, p in at.items() for c in (held(F.floor(p / 20)).alias(f"lo_{x}"), held(F.ceil(p / 20)).alias(f"hi_{x}"))]
    g = placed.groupBy(*by).agg(F.max("total").alias("total"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.sum(F.col("k") * F.col("w")).alias("sum"), *ends)
    rest = {x: p % 20 for x, p in at.items()}
    qs = [((F.col(f"lo_{x}") * (20 - r) + F.col(f"hi_{x}") * r) / (20 * unit)).alias(x) for x, r in rest.items()]
    return g.select(*by, F.col("total").alias("n"), (F.col("lo") / unit).alias("min"), *qs, (F.col("hi") / unit).alias("max"), (F.col("sum") / F.col("total") / unit).alias("mean"))


def legacy_order(ranked: DataFrame, query_col: str = "query_id") -> DataFrame:
    """Order a query's candidates (query_id, id, ord, confidence, legacy_relevance) by the legacy comparator.

    It prefers confidence where that differs by over 0.1, else relevance: not transitive, so a sort by comparison is
    the definition. A group is one query's candidate list.
    """

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        items = list(rows.sort_values("ord").itertuples())

        def compare(a, b):  # noqa: ANN001, ANN202
            gap = b.confidence - a.confidence
            d = gap if abs(gap) > 0.1 else b.legacy_relevance - a.legacy_relevance
            return (d > 0) - (d < 0)

        items.sort(key=cmp_to_key(compare))
        return pd.DataFrame({query_col: rows[query_col].iloc[0], "id": [x.id for x in items], "place": range(1, len(items) + 1)})

    kind = ranked.schema[query_col].dataType.simpleString()
    return ranked.groupBy(query_col).applyInPandas(order, f"{query_col} {kind}, id string, place int")


def sampled(rows: DataFrame, key: list[str], n: int) -> DataFrame:
    """n rows at random, the same at every run: those whose keys' MD5 come first."""
    return rows.withColumn("_h", F.md5(F.concat_ws("|", *key).cast("binary"))).orderBy("_h", *key).limit(n).drop("_h")


def auto_label(pairs: DataFrame, sim: Column, ratio: Column, same_source: Column, duplicate: float = 0.92, band: tuple[float, float] = (0.78, 0.90), most: int = 25) -> DataFrame:
    """Pairs (a, b, ...) with label and place, `most` a label by similarity: duplicate, or look-at within the band; others go."""
    label = F.when((sim >= duplicate) & same_source & (ratio > 0.5), "duplicate").when((sim >= band[0]) & (sim < band[1]), "look-at")
    order = Window.partitionBy("label").orderBy(F.desc("_sim"), "a", "b")
    found = pairs.withColumn("label", label).where("label is not null").withColumn("_sim", sim).withColumn("place", F.row_number().over(order))
    return found.where(F.col("place") <= most).drop("_sim")


def relabel(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b, label) with the label that labels (x, y, new_label) has for the same two ids, in whatever order."""
    new = labels.groupBy(F.least("x", "y").alias("_lo"), F.greatest("x", "y").alias("_hi")).agg(F.max("new_label").alias("new_label"))
    keyed = pairs.withColumns({"_lo": F.least("a", "b"), "_hi": F.greatest("a", "b")})
    return keyed.join(new, ["_lo", "_hi"], "left").withColumn("label", F.coalesce("new_label", "label")).drop("_lo", "_hi", "new_label")


def greedy_pairs(pairs: DataFrame, most: int) -> DataFrame:
    """(a, b, sim, place): the pairs that are taken one after the other, the most similar first, where each id is taken once.

    A pair is taken in the round in which it is the best of both its ids among the pairs that are left; it is then the
    next that a walk down the sorted pairs would take of either. Rounds go on until `most` are sure: no pair that is
    left is better than the last of them.
    """
    rank = F.struct(-F.col("sim"), "a", "b")
    left, taken = cut(pairs.select("a", "b", "sim")), None
    while True:
        ends = left.select(F.col("a").alias("id"), rank.alias("r")).union(left.select(F.col("b").alias("id"), rank.alias("r"))).groupBy("id").agg(F.min("r").alias("best"))
        mine = left.withColumn("r", rank).join(ends.select(F.col("id").alias("a"), F.col("best").alias("ba")), "a").join(ends.select(F.col("id").alias("b"), F.col("best").alias("bb")), "b")
        now = cut(mine.where((F.col("r") == F.col("ba")) & (F.col("r") == F.col("bb"))).select("a", "b", "sim"))
        taken = now if taken is None else cut(now, onto=taken)
        used = now.select(F.col("a").alias("id")).union(now.select(F.col("b").alias("id")))
        rest = cut(left.join(used.withColumnRenamed("id", "a"), "a", "left_anti").join(used.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b", "sim"))
        discard(left)
        left = rest
        best = left.agg(F.min(rank).alias("r")).first()["r"]
        sure = taken.orderBy(rank).limit(most).agg(F.count("*").alias("n"), F.max(rank).alias("r")).first()
        if best is None or sure["n"] == most and tuple(sure["r"]) < tuple(best):
            break
    top = taken.orderBy(rank).limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("sim"), "a", "b")))  # `most` rows
