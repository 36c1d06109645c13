"""Mixing sources to target weights by hash thresholds found in nested histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard

#: Hash bits: 60 in all, of which the first histogram looks at 12 and each refinement at 12 more.
HASH_BITS, STEP_BITS = 60, 12

WORDS = r"[^\x20\x09-\x0D]+"


def row_hash(key: Column) -> Column:
    """60 bits of the MD5 of the key as text; null hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets by source: share of all sizes by weight, none above most times its source's size.

    sizes has source and source_size, one row a source. Weights repeat along the sources by code point, null last.
    Resharing the excess by weight until no source is above its limit ends at a common level t with
    target = min(limit, t * weight); sources are capped in the order of limit / weight, so running sums give t.
    Windows here see one row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    all_rows = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    limit = F.col("source_size") * F.lit(float(most))
    s = sizes.withColumn("w", w).withColumn("limit", limit).withColumn("ratio", F.col("limit") / F.col("w"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("budget", F.sum("source_size").over(all_rows) * F.lit(float(share)))
        .withColumn("capped", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("rest"))
    )
    level = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "level"))).over(all_rows)["level"]  # the first source that isn't capped
    return s.withColumn("t", level).select("source", "source_size", F.when(F.col("t").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("t") * F.col("w"))).alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a source: src, source_size, target, whole and bound. sized has source, size and hash; targets source, source_size, target.

    With whole = floor(target / source_size) every row is taken whole times, and rows whose hash is below its
    source's threshold once more. The threshold is found without sorting: tokens are summed by source and the hash's
    top bits; the bucket in which the rest of the budget ends is refined by the next bits, and only its rows are
    summed again, until the bucket is a single hash value, which is taken when that brings the total nearer.
    """
    rest = F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")
    plan = targets.select(F.col("source").alias("src"), "source_size", "target", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("whole"), F.when(F.col("source_size") > 0, rest).otherwise(0.0).alias("rest"))
    state = plan.withColumn("low", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long"))  # hashes under low are taken and hold below tokens
    for done in range(0, HASH_BITS, STEP_BITS):
        shift = HASH_BITS - done - STEP_BITS
        inside = sized if not done else sized.join(F.broadcast(state.select("src", "low")), F.col("source").eqNullSafe(F.col("src")) & (F.shiftright("hash", shift + STEP_BITS) == F.shiftright("low", shift + STEP_BITS))).drop("src", "low")
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("tokens"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # 2 ** STEP_BITS rows a source at most
        run = sums.withColumn("sum_before", F.coalesce(F.sum("tokens").over(upto), F.lit(0)))
        j = run.join(F.broadcast(state), F.col("source").eqNullSafe(F.col("src")))
        hit = j.where(F.col("below") + F.col("sum_before") <= F.col("rest")).groupBy("src").agg(F.max(F.struct("bucket", (F.col("below") + F.col("sum_before")).alias("b"), "tokens")).alias("m"))
        got = hit.select(F.col("src").alias("s"), F.shiftleft(F.col("m.bucket"), shift).alias("l"), F.col("m.b").alias("b"), F.col("m.tokens").alias("last"))
        state, before = cut(state.drop("last").join(F.broadcast(got), F.col("src").eqNullSafe(F.col("s")), "left").select("src", "source_size", "target", "whole", "rest", F.coalesce("l", "low").alias("low"), F.coalesce("b", "below").alias("below"), F.coalesce("last", F.lit(0)).alias("last"))), state
        discard(before)
    nearer = F.col("below") + F.col("last") - F.col("rest") <= F.col("rest") - F.col("below")
    return state.select("src", "source_size", "target", "whole", (F.col("low") + F.when(nearer, 1).otherwise(0)).alias("bound"))


def take(rows: DataFrame, bounds: DataFrame, source: Column, hashed: Column) -> DataFrame:
    """Add source_size, target and times long to rows, whose source and hash these columns give; nothing is shuffled.

    Rows with equal source and hash are taken alike. A source without tokens is not taken.
    """
    once = F.when(hashed < F.col("bound"), 1).otherwise(0)
    out = rows.join(F.broadcast(bounds), source.eqNullSafe(F.col("src")))
    return out.withColumn("times", F.when(F.col("source_size") > 0, F.col("whole") + once).otherwise(0).cast("long")).drop("src", "whole", "bound")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes (doc_id, size, source, hash) and the thresholds of the sources."""
    sized = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
            F.col(source_col).cast("string").alias("source"),
            row_hash(F.col(id_col)).alias("hash"),
        )
    )
    targets = cut(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    bounds = thresholds(sized, targets)
    discard(targets)
    return sized, bounds


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Mix documents to target weights; sizes are words of the whole text (null: 0), hashes come from the id.

    Returns one row a document: doc_id, size, source, source_size, target, times. Repeated rows each get a row and
    the same times; rows with a null id hash alike; a null source is a source of its own, the last. An empty table
    gives an empty result. Targets stay one row a source; the broadcasts hold one row a source.
    """
    sized, bounds = plan(docs, id_col, text_col, source_col, weights, share, most)
    return take(sized, bounds, F.col("source"), F.col("hash")).select("doc_id", "size", "source", "source_size", "target", "times")
