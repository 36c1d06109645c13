"""A trie of conversation prefixes: dense names of turn blocks by prefix doubling, prefixes composed from them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, in_arrow

#: A name that more than one in HOT rows have goes to all tasks, as there are fewer than HOT of these; the others are joined by shuffling.
HOT = 1024
#: Turns whose sums one window takes together, and conversation ids of one piece of a node's list.
BLOCK, PIECE = 1024, 4096


def numbered(turns: DataFrame) -> DataFrame:
    """turns with pos, the place of each in its conversation from 0: by turn (null first), then by the other columns.

    Ranges of the whole order are numbered apart, and what comes before a range is added: a conversation of any length
    is spread over as many tasks as it fills. Turns without a conv_id are in no conversation and go.
    """
    order = ["conv_id", "turn", "role", "text"]
    ranged = turns.where("conv_id is not null").select(order).repartitionByRange(*(F.asc_nulls_first(c) for c in order)).withColumn("part", F.spark_partition_id())
    ranged = cut(ranged)
    n = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = n.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("conv_id", "part", F.coalesce("before", F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*(F.asc_nulls_first(c) for c in order[1:])))
    return ranged.withColumn("place", place).join(before, ["conv_id", "part"]).withColumn("pos", F.col("before") + F.col("place") - 1).drop("part", "before", "place")


def crossed(turns: DataFrame, most: int = 6, group: int = 100) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: the first h turns of the group's first conversation, then one's own after the first h; h is the CRC-32 of the decimal id modulo `most`.

    turns has conv_id, pos and any others. Returns the rebuilt turns, with depth from 1, and conv_id and length of every conversation, 0 where nothing is left.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    convs = own.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("of_base"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("of_base", F.lit(0))))
    convs = cut(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    rest = [c for c in turns.columns if c not in ("conv_id", "pos")]
    head = turns.where((F.col("pos") < most) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    first = convs.where("taken > 0").select("conv_id", "base", "taken").join(head, "base").where("pos < taken").select("conv_id", (F.col("pos") + 1).alias("depth"), *rest)
    # how far a turn of one's own moves depends on the first conversation's length alone: without a join for all but the group's short ones
    short = F.broadcast(convs.where("taken < h").select("conv_id", "taken")) if convs.where("taken < h").count() <= 100_000 else convs.where("taken < h").select("conv_id", "taken")
    later = turns.withColumn("h", h).where("pos >= h").join(short, "conv_id", "left")
    later = later.select("conv_id", (F.coalesce("taken", "h") + F.col("pos") - F.col("h") + 1).alias("depth"), *rest)
    return first.unionByName(later), convs.select("conv_id", "length")


def named(rows: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """`keep` of rows and the dense name of their key: whole numbers from 0 on, in no order. Key columns hold no nulls.

    Keys are numbered within each partition of their table, from where the partitions before it end. Names of keys that
    more than one in HOT rows have come by a broadcast of fewer than HOT rows, so that no task gets all rows of a common
    key. rows is read more than once. What comes back is a written table, so names last.
    """
    local = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    keys = cut(rows.groupBy(key).agg(F.count("*").alias("many")).withColumn("part", F.spark_partition_id()).withColumn("local", local))
    sizes = keys.groupBy("part").agg(F.count("*").alias("size"), F.sum("many").alias("many")).orderBy("part").collect()  # a row a partition
    total, ends = sum(r["many"] for r in sizes), accumulate(r["size"] for r in sizes)
    starts = [(r["part"], end - r["size"]) for r, end in zip(sizes, ends, strict=True)]
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "part int, start long"))
    names = keys.join(starts, "part").withColumn("name", F.col("start") + F.col("local"))
    common = F.col("many") * HOT > total
    hot = names.where(common).select(*key, "name")
    hot = F.broadcast(rows.sparkSession.createDataFrame(hot.collect(), hot.schema))
    rare = rows.join(hot, key, "left_anti").join(names.where(~common).select(*key, "name"), key)
    out = cut(rows.join(hot, key).select(*keep, "name").unionByName(rare.select(*keep, "name")))
    discard(keys)
    return out


def suffix_sums(rows: DataFrame, values: list[str]) -> DataFrame:
    """rows with each value replaced by its sum from the row's depth to its conversation's end; blocks of BLOCK turns are summed apart."""
    block = F.floor(F.col("depth") / BLOCK).alias("block")
    sums = rows.groupBy("conv_id", block).agg(*(F.sum(v).alias(v) for v in values))
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    after = sums.select("conv_id", "block", *(F.coalesce(F.sum(v).over(later), F.lit(0)).alias(f"{v}_after") for v in values))
    within = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("block", block).select("*", *(F.sum(v).over(within).alias(f"{v}_within") for v in values)).join(after, ["conv_id", "block"])
    return out.select(*(c for c in rows.columns if c not in values), *((F.col(f"{v}_within") + F.col(f"{v}_after")).alias(v) for v in values))


def prefix_names(turns: DataFrame, token: Column) -> DataFrame:
    """conv_id, depth and name of every prefix of 1 turn or more; prefixes have one name where they are equal.

    turns has conv_id and depth without gaps from 1. Blocks of 1, 2, 4, ... turns that begin at multiples of their
    length are named in turn, each from the names of its halves; a prefix of d turns is named from the prefix without
    the block of d's lowest bit, and that block. So each round joins what the rounds before have named, and there are
    twice as many rounds as the longest conversation has bits.
    """
    blocks = [named(turns.select("conv_id", (F.col("depth") - 1).alias("at"), token.alias("token")), ["token"], ["conv_id", "at"])]
    longest = turns.agg(F.max("depth")).first()[0] or 0
    while 2 ** len(blocks) <= longest:
        last = blocks[-1]
        left = last.where("at % 2 = 0").select("conv_id", (F.col("at") / 2).cast("long").alias("at"), F.col("name").alias("a"))
        right = last.where("at % 2 = 1").select("conv_id", ((F.col("at") - 1) / 2).cast("long").alias("at"), F.col("name").alias("b"))
        pairs = cut(left.join(right, ["conv_id", "at"]))
        blocks.append(named(pairs, ["a", "b"], ["conv_id", "at"]))
        discard(pairs)
    done = None
    for level in reversed(range(len(blocks))):
        size = 2**level  # prefixes whose lowest bit this is: m pairs of blocks, then one
        tail = blocks[level].where("at % 2 = 0").select("conv_id", (F.col("at") * size).alias("base"), F.col("name").alias("b"))
        head = tail.where("base = 0").select("conv_id", "base", "b", F.lit(0).cast("long").alias("a"))
        if done is not None:
            head = head.unionByName(tail.where("base > 0").join(done.select("conv_id", F.col("depth").alias("base"), F.col("name").alias("a")), ["conv_id", "base"]))
        # a tells how long the prefix is, so equal pairs of a level are of one depth
        head = cut(head.withColumn("depth", F.col("base") + size))
        found = named(head, ["a", "b"], ["conv_id", "depth"])
        discard(head, blocks[level])
        found = found.withColumn("name", (F.col("name") + 1) * len(blocks) + level)
        done = found if done is None else done.unionByName(found)
    return done


def ends(rows: DataFrame) -> DataFrame:
    """By name, SHA-256 of the decimal conv_ids, ascending, joined by commas.

    Ids come in pieces of neighbouring ids, PIECE at most; a task reads a name's pieces in order and holds one.
    """
    piece = F.floor(F.col("conv_id") / PIECE)
    pieces = rows.groupBy("name", piece.alias("piece")).agg(F.array_join(F.sort_array(F.collect_set("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            names, found = [], []
            for name, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if name != last:
                    if digest is not None:
                        names.append(last)
                        found.append(digest.hexdigest())
                    last, digest = name, hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(found, pa.string())], ["name", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["name", "ends_sha256"])

    return in_arrow(pieces.repartition("name").sortWithinPartitions("name", "piece"), run, "name long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of all conversations' prefixes, and what their subtrees hold.

    turns has conv_id, depth without gaps from 1, role and text; convs has conv_id and length, also 0. Turns are equal
    if role and text are (held by SHA-256); null ones count as empty. A node belongs to its smallest member's path, and
    what a subtree sums up is summed over the members of its top: along a path, each turn counts its text unless the
    path's conversation is the node's smallest member, and a path ends in one childless node at most that it owns. So
    all sums are linear in the turns and are added up before they are shuffled. Without conversations there are no nodes.

    Returns long columns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves and saved_tokens, and ends_sha256.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    token = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    short = cut(turns.select("conv_id", "depth", token.alias("token"), F.length(text).cast("long").alias("size")))
    convs = cut(convs.select("conv_id", "length"))
    names = prefix_names(short, F.col("token"))
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"))
    tips = convs.select("conv_id", F.col("length").alias("depth"), F.lit(1).cast("long").alias("last"))
    paths = names.unionByName(root).join(short.select("conv_id", "depth", "size"), ["conv_id", "depth"], "left").join(tips, ["conv_id", "depth"], "left")
    paths = cut(paths.withColumn("last", F.coalesce("last", F.lit(0))))
    nodes = cut(paths.groupBy("name").agg(F.min("conv_id").alias("owner"), F.first("depth").alias("depth"), F.count("*").alias("n_convs"), F.sum("last").alias("n_ends")))
    owned = nodes.select(F.col("owner").alias("conv_id"), "depth", (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf"))
    marked = paths.join(owned, ["conv_id", "depth"], "left")  # a path's step has one owner, so no key is common
    saved = F.when(F.col("leaf").isNull(), F.coalesce("size", F.lit(0))).otherwise(0)
    sums = suffix_sums(marked.select("conv_id", "depth", "name", saved.cast("long").alias("saved_tokens"), F.coalesce("leaf", F.lit(0)).cast("long").alias("n_leaves")), ["saved_tokens", "n_leaves"])
    subtrees = sums.groupBy("name").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    above = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    linked = cut(nodes.withColumnRenamed("owner", "conv_id").join(above, ["conv_id", "depth"], "left"))
    children = cut(linked.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children")))
    # parents with many children come by broadcast: fewer than HOT have more than one in HOT of all nodes
    total = linked.count()
    parents = children.join(nodes.select(F.col("name").alias("parent"), F.col("owner").alias("parent_conv_id")), "parent")
    common = parents.where(F.col("n_children") * HOT > total).select("parent", "parent_conv_id")
    common = F.broadcast(common.sparkSession.createDataFrame(common.collect(), common.schema))
    out = linked.join(common, "parent").unionByName(linked.join(common, "parent", "left_anti").join(parents.where(F.col("n_children") * HOT <= total).select("parent", "parent_conv_id"), "parent", "left"))
    hashes = ends(paths.where("last = 1").select("name", "conv_id"))
    out = out.join(children.withColumnRenamed("parent", "name"), "name", "left").join(subtrees, "name").join(hashes, "name", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
