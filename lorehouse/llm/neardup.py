"""MinHash near-duplicates by an inverted join over signature coordinates.

Each set of shingles gets a signature of COORDINATES minima. A document is posted under each coordinate-value pair;
sets that reach the similarity threshold share at least MATCHES of the COORDINATES pairs but for a probability of
3e-8 (at similarity 0.75). With all pairs in one order, rarest first, two such documents also share one within the
first s - MATCHES + 1 of the s pairs that either has in common with others: only these prefixes are joined, so the
longest lists are skipped, and the collisions of what the prefixes bring together are counted on the whole signatures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, cut, discard, in_arrow, mix64, plus, seeds, shingle_hashes, text_buffer, word_hashes

SHINGLE, COORDINATES, MATCHES = 5, 32, 10
#: Similarity at which documents are linked: NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 75, 100
#: Leaders of a list that its members are held against, twice, before the lists are searched for what is left. The first
#: time one leader is drawn and the others share most coordinates; the second time they share most of their shingles.
STARS = 3
#: Nodes that a list of a rare shingle holds at most, members of a long list that a task is dealt, and words of a set's map at most.
RARE, PART, MOST_WORDS = 8, 1024, 4096
#: Places that a class's sets are dealt to when it is named.
SALTS = 32

_XOR, _MUL, _TOKEN = seeds(COORDINATES, 3), seeds(COORDINATES, 5), seeds(COORDINATES, 7)
_PRINT = seeds(2, 13)


def _distinct(hashes: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    return [np.unique(hashes[a:b]) for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]


def _sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, the offsets of the rows, and 16-byte fingerprints of the sets."""
    words, _, _, word_rows = word_hashes(*text_buffer(column))
    found = _distinct(*shingle_hashes(words, word_rows, k))
    rows = np.zeros(len(found) + 1, np.int64)
    np.cumsum([len(x) for x in found], out=rows[1:])
    flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
    prints = np.zeros((len(found), 2), np.uint64)
    some = np.flatnonzero(np.diff(rows))
    if len(some):
        for i in range(2):
            prints[some, i] = np.add.reduceat(mix64(flat * _PRINT[i]), rows[some])
    return flat, rows, prints


def signatures(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """The columns of docs but text, n_shingles, fp (16 bytes, equal for equal sets; null for the empty set), tokens (a hash of each coordinate and its value)."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            flat, rows, prints = _sets(batch.column("text"), k)
            n = np.diff(rows)
            some = np.flatnonzero(n)
            tokens = np.zeros((len(n), COORDINATES), np.uint64)
            if len(some):
                for i in range(COORDINATES):
                    tokens[some, i] = mix64(np.minimum.reduceat((flat ^ _XOR[i]) * _MUL[i], rows[some]) ^ _TOKEN[i])
            fps = [p.tobytes() if m else None for p, m in zip(prints, n.tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * COORDINATES), pa.array(tokens.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), lists], [*names, "n_shingles", "fp", "tokens"])

    return in_arrow(docs.select(*names, "text"), run, plus(docs.select(*names), n_shingles="long", fp="binary", tokens="array<long>"))


def _shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """nid, set (the sorted hashes, 8 bytes each) of the rows whose set has the fingerprint fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            flat, rows, prints = _sets(batch.column("text"), k)
            mine = [i for i, fp in enumerate(batch.column("fp").to_pylist()) if prints[i].tobytes() == fp]
            sets = [flat[rows[i] : rows[i + 1]].tobytes() for i in mine]
            yield pa.RecordBatch.from_arrays([batch.column("nid").take(pa.array(mine, pa.int64())), pa.array(sets, pa.binary())], ["nid", "set"])

    return in_arrow(docs.select("nid", "fp", "text"), run, plus(docs.select("nid"), set="binary"))


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (x, y) whose sets have 100 * intersection >= 75 * union."""
    both = pairs.join(sets.select(F.col("nid").alias("x"), F.col("set").alias("a")), "x").join(sets.select(F.col("nid").alias("y"), F.col("set").alias("b")), "y").select("x", "y", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                merged = np.concatenate([a, b])
                merged.sort(kind="stable")
                inter = int((merged[1:] == merged[:-1]).sum())
                keep.append(DENOMINATOR * inter >= NUMERATOR * (len(merged) - inter))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return in_arrow(both, run, pairs.select("x", "y").schema)


def components(edges: DataFrame) -> DataFrame:
    """nid, label (the smallest nid reachable) of every node of the edges (x, y).

    Each round takes the least label of a node's neighbours and then its label's label, until nothing changes. The
    rounds start from written tables; the joins' unique side is the labels, so a hub's edges can be split over tasks.
    """
    links = cut(edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = cut(links.groupBy(F.col("x").alias("nid")).agg(F.min("y").alias("least")).select("nid", F.least("nid", "least").alias("label")))
    while True:
        near = links.join(labels.select(F.col("nid").alias("y"), "label"), "y").groupBy(F.col("x").alias("nid")).agg(F.min("label").alias("near"))
        new = labels.join(near, "nid").select("nid", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        theirs = new.select(F.col("nid").alias("label"), F.col("label").alias("next"))
        labels, before = cut(new.join(theirs, "label").select("nid", F.least("label", "next").alias("label"), "old")), labels
        discard(before)
        if labels.where("label < old").isEmpty():
            discard(links)
            return labels.select("nid", "label")


def _alike(a: str, b: str) -> Column:
    """Whether sets of these sizes can reach the similarity."""
    return (DENOMINATOR * F.col(a) >= NUMERATOR * F.col(b)) & (DENOMINATOR * F.col(b) >= NUMERATOR * F.col(a))


def _matching(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add to pairs (x, y) how many coordinates agree; those under MATCHES go."""
    mine, theirs = (nodes.select(F.col("nid").alias(c), F.col("tokens").alias(f"t{c}")) for c in "xy")
    counted = pairs.join(mine, "x").join(theirs, "y").select("x", "y", F.size(F.array_intersect("tx", "ty")).alias("match"))
    return counted.where(F.col("match") >= MATCHES)


def _dealt(lists: DataFrame, each: DataFrame) -> DataFrame:
    """Join to lists what each has for a token, where a long list's members are dealt over several tasks: by its parts."""
    spread = each.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return lists.withColumn("part", F.pmod(F.xxhash64("nid"), F.col("parts")).cast("int")).join(spread, ["token", "part"]).drop("part")


def _open(lists: DataFrame, found: DataFrame) -> DataFrame:
    """The lists that hold members of two components or more, with each member's label; a node in no component is its own."""
    known = lists.join(found, "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    several = known.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("parts").alias("parts")).where("low < high").select("token", "parts")
    return cut(_dealt(known, several))


def _common(sets: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the nodes of the lists have in common, and two tables that it is made of: each node's shingles, and how often those of several occur.

    The first has nid, common: how many of a node's shingles over RARE of these nodes have. Two nodes share no more of
    them than either's number, and no others but those that the lists of rare shingles hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nid, one in zip(batch.column("nid").to_pylist(), batch.column("set"), strict=True):
                flat = np.frombuffer(one.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), nid, np.int64)), pa.array(flat)], ["nid", "shingle"])

    each = cut(in_arrow(sets.join(lists.select("nid").distinct(), "nid").select("nid", "set"), run, "nid long, shingle long"))
    often = cut(each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"))
    common = each.join(often.where(F.col("df") > RARE), "shingle").groupBy("nid").agg(F.count("*").alias("common"))
    return cut(common), each, often


def _maps(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """nid, map array<long>: the last bits of a shingle's hash give the word, its first six the bit that is set; 16 to 32 bits a shingle, MOST_WORDS words at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, one in enumerate(batch.column("set")):
                flat = np.frombuffer(one.as_buffer(), np.uint64)
                words = min(MOST_WORDS, 1 << int(np.ceil(np.log2(max(1, len(flat) / 4)))))
                h, bits = mix64(flat), np.zeros((words, 64), bool)
                bits[(h % np.uint64(words)).astype(np.int64), (h >> np.uint64(58)).astype(np.int64)] = True
                held = np.packbits(bits).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("nid").slice(i, 1), pa.ListArray.from_arrays(pa.array([0, words], pa.int32()), pa.array(held))], ["nid", "map"])

    return in_arrow(sets.join(nodes, "nid").select("nid", "set"), run, "nid long, map array<long>")


def _within_reach() -> Column:
    """Whether sets p and q can reach the similarity by their maps.

    Of the shingles that both have, those that share a bit with another of p are at most n less the bits of p's map,
    and all others have bits of their own in both. A map of more words is folded to the other's.
    """

    def fold(a: Column, b: Column) -> Column:
        n = F.size(b)
        return F.when(F.size(a) > n, F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, n + 1, n), lambda x, y: x.bitwiseOR(y))).otherwise(a)

    def held(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, x: s + F.bit_count(x))

    a, b = fold(F.col("p.map"), F.col("q.map")), fold(F.col("q.map"), F.col("p.map"))
    both = held(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))) + F.least(F.col("p.n") - held(a), F.col("q.n") - held(b))
    return (NUMERATOR + DENOMINATOR) * both >= NUMERATOR * (F.col("p.n") + F.col("q.n"))


def _rare_pairs(each: DataFrame, often: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (x, y) of nodes (nid, n, label) that share a shingle of RARE of them at most, of two labels and of sizes that can reach the similarity.

    Lists of one label, and lists met before, go before a pair is formed.
    """
    few = each.join(often.where(F.col("df") <= RARE).select("shingle"), "shingle").join(nodes, "nid")
    held = few.groupBy("shingle").agg(F.sort_array(F.collect_list(F.struct("nid", "n", "label"))).alias("m"), F.min("label").alias("low"), F.max("label").alias("high"))
    able = f"{DENOMINATOR} * least(p.n, q.n) >= {NUMERATOR} * greatest(p.n, q.n)"
    pairs = F.expr(f"flatten(transform(m, (p, i) -> transform(filter(slice(m, i + 2, size(m)), q -> q.label <> p.label and {able}), q -> struct(p.nid as x, q.nid as y))))")
    return held.where("low < high").select("m").distinct().select(F.explode(pairs).alias("pair")).select("pair.x", "pair.y").distinct()


def _spokes(lists: DataFrame, nodes: DataFrame, sets: DataFrame, leads: list[Column]) -> DataFrame:
    """Verified pairs (x, y) of the lists' members with their lists' leaders, of the two leaders that agree most with each member.

    lists has token, parts, nid, n and label; leads are orders, each of which makes its first member a list's leader;
    pairs of one label are left out.
    """
    heads = lists.groupBy("token").agg(F.max("parts").alias("parts"), F.array(*[F.min(F.struct(lead.alias("order"), "nid", "n", "label")) for lead in leads]).alias("heads"))
    heads = heads.select("token", "parts", F.transform("heads", lambda h: F.struct(h["nid"].alias("nid"), h["n"].alias("n"), h["label"].alias("label"))).alias("heads"))
    each = _dealt(lists, heads).select(F.col("nid").alias("x"), "n", "label", F.explode(F.array_distinct("heads")).alias("head"))
    pairs = each.where(F.col("label") != F.col("head.label")).select("x", "n", F.col("head.nid").alias("y"), F.col("head.n").alias("m"))
    pairs = pairs.where(_alike("n", "m")).select("x", "y").distinct()
    best = Window.partitionBy("x").orderBy(F.desc("match"), "y")  # a few leaders for each of the prefix's lists
    held = _matching(pairs, nodes).withColumn("place", F.row_number().over(best)).where("place <= 2")
    return verify(held.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), sets)


def links(reps: DataFrame, docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """nid, label for the sets that are linked with others; reps has nid, fp, first (doc_id, spare), n, tokens, one row a set; docs has doc_id, spare, text."""
    posts = reps.select("nid", F.explode("tokens").alias("token"))
    often = posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = posts.join(often, "token").groupBy("nid").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("l")).where(F.size("l") >= MATCHES)
    nodes = cut(
        shared.join(reps.drop("tokens"), "nid").select("nid", "n", "fp", "first.doc_id", "first.spare", F.transform("l", lambda x: x["token"]).alias("tokens"), F.expr(f"slice(l, 1, size(l) - {MATCHES - 1})").alias("prefix"))
    )
    source = docs.join(nodes.select("nid", "fp", F.col("doc_id").alias("rid"), F.col("spare").alias("rspare")), F.col("doc_id").eqNullSafe(F.col("rid")) & F.col("spare").eqNullSafe(F.col("rspare")))
    sets = cut(_shingle_sets(source, k).groupBy("nid").agg(F.first("set").alias("set")))
    lists = nodes.select("nid", "n", F.explode("prefix").alias("p")).select("nid", "n", "p.token", F.ceil(F.col("p.df") / PART).cast("int").alias("parts"))

    # Each list's members against a few leaders of the list: most groups come together.
    chance = F.struct(F.lit(0), F.xxhash64("nid", F.lit(0)))
    central = [F.struct(-F.col("seen"), F.xxhash64("nid", F.lit(i))) for i in range(1, STARS)]
    seen = nodes.select("nid", F.size("tokens").alias("seen"))
    stars = cut(_spokes(lists.join(seen, "nid").withColumn("label", F.col("nid")), nodes, sets, [chance, *central]))

    # The same with leaders that hold least of their own, for what can still reach the similarity over two components.
    first = components(stars)
    apart = _open(lists, first)
    common, each, counted = _common(sets, apart)
    left = cut(apart.join(common, "nid").where(DENOMINATOR * F.col("common") >= NUMERATOR * F.col("n")))
    central = [F.struct(-F.col("common") / F.col("n"), F.xxhash64("nid", F.lit(i))) for i in range(STARS)]
    stars, before = cut(stars.union(_spokes(left, nodes, sets, central))), stars
    found = components(stars)
    discard(before, first)

    # What is then left over two components or more: the pairs that can still reach the similarity by what they share.
    remain = _open(left.drop("label"), found)
    largest = remain.groupBy("token", "label").agg(F.count("*").alias("c"), F.max("parts").alias("parts")).groupBy("token").agg(F.max(F.struct("c", "label"))["label"].alias("main"), F.max("parts").alias("parts"))
    prefixes = nodes.select("nid", F.transform("prefix", lambda p: p["token"]).alias("prefix"))
    maps = cut(_maps(sets, remain.select("nid").distinct()))
    open_lists = cut(_dealt(remain, largest).join(prefixes, "nid").join(maps, "nid"))
    p, q = open_lists.where("label != main").alias("p"), open_lists.alias("q")
    reach = (NUMERATOR + DENOMINATOR) * F.least("p.common", "q.common") >= NUMERATOR * (F.col("p.n") + F.col("q.n"))
    once = F.array_intersect("p.prefix", "q.prefix")[0] == F.col("p.token")  # a pair comes from the first list that holds both
    across = p.join(q, (F.col("p.token") == F.col("q.token")) & (F.col("p.label") != F.col("q.label")) & ((F.col("q.label") == F.col("q.main")) | (F.col("p.nid") < F.col("q.nid"))) & _alike("p.n", "q.n") & reach & once & _within_reach())
    across = across.select(F.least("p.nid", "q.nid").alias("x"), F.greatest("p.nid", "q.nid").alias("y"))
    labelled = apart.select("nid", "n").distinct().join(found, "nid", "left").select("nid", "n", F.coalesce("label", "nid").alias("label"))
    across = across.union(_rare_pairs(each, counted, labelled)).distinct()
    rest = cut(verify(_matching(across, nodes).select("x", "y"), sets))
    discard(apart, common, each, counted, left, remain, maps, open_lists, nodes, sets)
    out = found if rest.isEmpty() else components(stars.union(rest))
    discard(stars, rest)
    return out


def _classified(docs: DataFrame, k: int) -> DataFrame:
    """Add n_shingles, class (a number, null for the empty set) and least (the smallest id of the class, null if all are) to docs (doc_id, text and others), without text."""
    # Rows without an id are found again by a hash of the text in its place.
    docs = docs.withColumn("spare", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    signed = cut(signatures(docs, k))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "spare")).alias("first")
    sets = signed.where("fp is not null").groupBy("fp").agg(first, F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"))
    reps = cut(sets.withColumn("nid", F.monotonically_increasing_id()))  # numbers that last, once written
    found = links(reps, docs, k)
    classes = reps.select("nid", "fp", F.col("first.doc_id").alias("least"))
    linked = classes.join(found, "nid").withColumn("salt", F.pmod("nid", F.lit(SALTS)))
    # a class may hold much of the table, so its name goes to SALTS places; sets without links meet nothing
    of_all = linked.groupBy("label").agg(F.min("least").alias("of_all")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    named = linked.join(of_all, ["label", "salt"]).select("fp", F.col("label").alias("class"), "of_all")
    named = named.unionByName(classes.join(found, "nid", "left_anti").select("fp", F.col("nid").alias("class"), F.col("least").alias("of_all"))).withColumnRenamed("of_all", "least")
    return signed.drop("tokens", "spare").join(named, "fp", "left").drop("fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """Classes of documents linked by 100 * intersection >= 75 * union of their k-word shingle sets.

    Words are runs of other than space and 0x09-0x0D after A-Z are lower-cased; a text of fewer than k words has all
    of them as its one shingle; a null text, or one without words, has none and is linked with nothing. Equal sets are
    one node, so that copies are never paired; links are confirmed on the full sets, as 64-bit hashes of their
    shingles: some two of n shingles hash alike with a probability of n * n / 2 ** 65, so that a count is off by one
    for 1 in 4 * 10 ** 11 pairs of sets of 5000 shingles each.

    Returns a row a document: doc_id, n_shingles long, component_id (the smallest id of the class; its own for a
    document without shingles), kept boolean (doc_id = component_id). Repeated rows each get a row; rows that share an
    id are told apart by their text; a null id is linked like others but is never a component_id: a class of only
    such ids has null and keeps them. An empty table gives an empty result.
    """
    out = _classified(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), k)
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """The rows of docs, one of each class of near-duplicates: that of the smallest id, of rows alike in id any one.

    Rows without shingles are in no class and stay. Rows with a null id come after all others of their class. Rows
    that share an id but not a class are apart. All columns stay; one named _row is replaced and left out.
    """
    rows = cut(docs.withColumn("_row", F.monotonically_increasing_id()))  # numbers that last, once written
    classes = _classified(rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), "_row"), k)
    best = classes.where("class is not null").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row"))
    kept = best.select("_row").union(classes.where("class is null").select("_row"))
    return rows.join(kept, "_row", "left_semi").select([c for c in docs.columns if c != "_row"])
