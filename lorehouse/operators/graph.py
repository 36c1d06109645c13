"""Property-graph reads over edge tables (src, dst, type, strength, ord)."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.rules import decode_strength
from .substrings import contained


def usable(edges: DataFrame) -> DataFrame:
    """Edges with both ends and a safe type name."""
    return edges.where("src is not null and dst is not null").where(F.col("type").rlike("^[A-Za-z_][A-Za-z0-9_]*$"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge: node, other, direction, type, strength, ord."""
    e = usable(edges)
    out = e.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("out").alias("direction"), "type", "strength", "ord")
    back = e.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit("in").alias("direction"), "type", "strength", "ord")
    return out.unionByName(back)


def relationships(edges: DataFrame, entries: DataFrame, cap: int = 25, preview: int = 80) -> DataFrame:
    """Up to cap relationships a node: parallel edges collapse to the first, outgoing come before incoming.

    A hub's edges are first reduced to one a (node, direction, type, other), with partial aggregation, and the cap is
    taken with a rank that Spark prunes before the shuffle.
    """
    one = adjacency(edges).groupBy("node", "direction", "type", "other").agg(F.min(F.struct("ord", "strength")).alias("e"))
    order = Window.partitionBy("node").orderBy(F.desc("direction"), "e.ord", "type", "other")
    capped = one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)
    names = entries.select(F.col("id").alias("other"), F.substring("content", 1, preview).alias("preview"))
    return capped.join(names, "other", "left").select("node", "place", "direction", "type", "other", decode_strength(F.col("e.strength")).alias("strength"), F.coalesce("preview", F.lit("")).alias("preview"))


def related(edges: DataFrame, starts: DataFrame, depth: int = 2, limit: int = 20, relation: str = "RELATED_TO") -> DataFrame:
    """Nodes within depth undirected steps of each start (column start), by least distance, then by name, at most limit a start.

    The frontier is joined to the edges once a level; visited nodes are left out by an anti-join. A start goes on only
    while it has fewer than limit nodes, so of any node's neighbours none but the first 2 * limit + 1 by name can
    count: hubs are cut to these, by a rank that Spark prunes before the shuffle, and no result is lost.
    """
    steps = adjacency(edges.where(F.col("type") == relation)).select("node", "other").distinct()
    steps = steps.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("other"))).where(F.col("r") <= 2 * limit + 1).drop("r")
    frontier = starts.select("start", F.col("start").alias("node")).distinct()
    seen = frontier.withColumn("distance", F.lit(0))
    place = Window.partitionBy("start").orderBy("distance", "node")
    for level in range(1, depth + 1):
        new = frontier.join(steps, "node").select("start", F.col("other").alias("node")).distinct()
        fresh = new.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("distance", F.lit(level))
        seen = seen.unionByName(fresh).withColumn("place", F.row_number().over(place)).where(F.col("place") <= limit + 1).drop("place")
        short = seen.groupBy("start").agg(F.count("*").alias("n")).where(F.col("n") <= limit).select("start")
        frontier = seen.where(F.col("distance") == level).join(short, "start").select("start", "node")
    return seen.where("distance > 0").withColumn("place", F.row_number().over(place)).select("start", "node", "distance", "place")


def related_paths(edges: DataFrame, starts: DataFrame, depth: int = 2, limit: int = 20, relation: str = "RELATED_TO") -> DataFrame:
    """(start, node, distance, parent, strength, place): nodes within depth undirected steps, in the order of their discovery, with the edge that found each.

    A level goes through the edges of all nodes of the level before, outgoing ones first, then by ord; the first edge
    that leads to a node not seen before finds it, and gives its parent and strength. At most limit nodes a start count.
    As in related, a start goes on while it has fewer, and hubs are cut to the neighbours that can count.
    """
    both = adjacency(edges.where(F.col("type") == relation)).withColumn("at", F.struct((F.col("direction") == "in").alias("back"), "ord"))
    steps = both.groupBy("node", "other").agg(F.min(F.struct("at", "strength")).alias("e"))
    steps = steps.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("e.at", "other"))).where(F.col("r") <= 2 * limit + 1).drop("r")
    frontier = starts.select("start", F.col("start").alias("node")).distinct()
    seen = frontier.select("start", "node", F.lit(0).alias("distance"), F.lit(None).cast("struct<at:struct<back:boolean,ord:bigint>,strength:int,parent:string>").alias("first"))
    place = Window.partitionBy("start").orderBy("distance", "first.at", "node")
    for level in range(1, depth + 1):
        first = F.min(F.struct("e.at", F.col("e.strength").cast("int").alias("strength"), F.col("node").alias("parent"))).alias("first")
        new = frontier.join(steps, "node").groupBy("start", F.col("other").alias("found")).agg(first).withColumnRenamed("found", "node")
        fresh = new.join(seen.select("start", "node"), ["start", "node"], "left_anti").select("start", "node", F.lit(level).alias("distance"), "first")
        seen = seen.unionByName(fresh).withColumn("place", F.row_number().over(place)).where(F.col("place") <= limit + 1).drop("place")
        short = seen.groupBy("start").agg(F.count("*").alias("n")).where(F.col("n") <= limit).select("start")
        frontier = seen.where(F.col("distance") == level).join(short, "start").select("start", "node")
    found = seen.where("distance > 0").withColumn("place", F.row_number().over(place))
    return found.select("start", "node", "distance", "first.parent", decode_strength(F.col("first.strength")).alias("strength"), "place")


# The order in which a node's labels are looked at; the first that it has is its type. The first is no entity's.
LABELS = ("Knowledge", "Person", "Organization", "Project", "Technology", "Concept", "Service", "Event")
# Labels of nodes that run the store itself.
OPERATIONAL = ("ContextTrigger", "ToolRoute", "ResourceMap", "QueryType", "System", "MemoryTier")


def summaries(ids: DataFrame, nodes: DataFrame, edges: DataFrame, entries: DataFrame, neighbours: int = 4) -> DataFrame:
    """(id, name, type, summary, related) of ids that are nodes (id, label) of a known label, or entries (id, content).

    The type is the first of LABELS that a node has. The name is the content's first three words, the summary its first
    200 characters, both null without an entry; related are the entries among the first `neighbours` that RELATED_TO edges
    lead to or from, by least ord, each with 40 characters. What is no such node has neither name nor relations.
    """
    order = F.array_position(F.array(*map(F.lit, LABELS)), F.col("label"))
    typed = nodes.where(F.col("label").isin(*LABELS)).groupBy("id").agg(F.min_by("label", order).alias("type"))
    wanted = ids.select("id").distinct()
    # heads of the contents alone are shuffled
    e = entries.select("id", F.col("content").isNotNull().alias("there"), F.substring_index("content", " ", 3).alias("head"), F.substring("content", 1, 200).alias("summary"))
    j = wanted.join(typed, "id", "left").join(e, "id", "left").where("type is not null or there")
    near = adjacency(edges.where("type = 'RELATED_TO'")).join(wanted.select(F.col("id").alias("node")), "node", "left_semi")
    near = near.groupBy("node", "other").agg(F.min("ord").alias("ord")).withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("ord", "other"))).where(F.col("r") <= neighbours)
    named = near.join(entries.select(F.col("id").alias("other"), F.substring("content", 1, 40).alias("name")), "other").groupBy(F.col("node").alias("id")).agg(F.sort_array(F.collect_list(F.struct("r", F.col("other").alias("id"), "name"))).alias("all"))
    known = F.col("type").isNotNull()
    out = j.join(named, "id", "left")
    none = F.array().cast("array<struct<id:string,name:string>>")
    related_ = F.when(known, F.coalesce(F.transform("all", lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"))), none)).otherwise(none)
    return out.select("id", F.when(known, F.col("head")).alias("name"), F.coalesce("type", F.lit(LABELS[0])).alias("type"), "summary", related_.alias("related"))


def context(hits: DataFrame, most: int = 6) -> DataFrame:
    """(query_id, id, place): the first `most` different entities that a search's hits lead to, in their order.

    hits has query_id, arm, place, id, labels and refs, arrays or null. Hits of the arm graph with an entity's label, and
    no operational one, come first by place, then the refs of the arm mongodb, then those of mem0.
    """
    entity, running = F.array(*map(F.lit, LABELS[1:])), F.array(*map(F.lit, OPERATIONAL))
    own = hits.where((F.col("arm") == "graph") & F.arrays_overlap("labels", entity) & ~F.arrays_overlap("labels", running)).select("query_id", F.struct(F.lit(0).alias("arm"), "place", F.lit(0).alias("at")).alias("arrival"), "id")
    linked = hits.where(F.col("arm").isin("mongodb", "mem0")).select("query_id", F.when(F.col("arm") == "mongodb", 1).otherwise(2).alias("arm"), "place", F.posexplode("refs").alias("at", "id"))
    all_ = own.unionByName(linked.select("query_id", F.struct("arm", "place", "at").alias("arrival"), "id")).where("id is not null")
    first = all_.groupBy("query_id", "id").agg(F.min("arrival").alias("arrival"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("arrival", "id"))).where(F.col("place") <= most).drop("arrival")


def annotated(hits: DataFrame, entities: DataFrame) -> DataFrame:
    """hits with linked: their own id and refs that are among the query's entities (query_id, id), in this order."""
    refs = hits.select("query_id", "arm", "place", F.posexplode(F.concat(F.array("id"), F.coalesce("refs", F.array().cast("array<string>")))).alias("at", "ref"))
    met = refs.join(entities.select("query_id", F.col("id").alias("ref")), ["query_id", "ref"], "left_semi")
    linked = met.groupBy("query_id", "arm", "place").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "ref"))), lambda x: x["ref"]).alias("linked"))
    return hits.join(linked, ["query_id", "arm", "place"], "left").withColumn("linked", F.coalesce("linked", F.array().cast("array<string>")))


#: Names that a task searches for at once, at most.
BLOCK_NAMES = 50_000


def mentions(contents: DataFrame, entities: DataFrame, block: int = BLOCK_NAMES) -> DataFrame:
    """(id, entity): entities whose name or an alias, longer than 3 characters, is a substring of a content, case-folded.

    Up to `block` names go to the tasks, where a content is searched once for all of them (Aho-Corasick), in time linear
    in the text; nothing is shuffled. More names meet the contents by their rarest runs of characters.
    """
    names = entities.select("entity", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).select("entity", F.lower("name").alias("name")).where(F.length("name") > 3).distinct()
    kind, lower = entities.schema["entity"], contents.select("id", F.lower("content").alias("content"))
    few = names.limit(block + 1).collect()
    if len(few) <= block:
        return _mentioned(lower, few, T.StructType([contents.schema["id"], kind]))
    met = contained(names.select(F.col("name").alias("needle")), lower.withColumnRenamed("content", "text"))
    return met.join(names, F.col("needle") == F.col("name")).select("id", "entity").distinct()


def entity_refs(contents: DataFrame, entities: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, entity, how): what each content is about: of the ids that a model named those that are entities, else what its text mentions.

    contents has id and content, entities entity, name and aliases, answers id and found, the model's ids as an array of
    the entities' type, null or absent where it gave none. how is model or mention.
    """
    named = answers.select("id", F.explode("found").alias("entity")).distinct().join(entities.select("entity").distinct(), "entity", "left_semi").join(contents.select("id"), "id", "left_semi").select("id", "entity", F.lit("model").alias("how"))
    rest = contents.select("id", "content").join(named.select("id").distinct(), "id", "left_anti")
    return named.unionByName(mentions(rest, entities).select("id", "entity", F.lit("mention").alias("how")))


def _mentioned(contents: DataFrame, names: list[Row], schema: T.StructType) -> DataFrame:
    held: dict[str, list] = {}
    for r in names:
        held.setdefault(r["name"], []).append(r["entity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ahocorasick.Automaton()
        for name, owners in held.items():
            found.add_word(name, owners)
        found.make_automaton()
        for batch in batches if held else ():
            hits = [list(dict.fromkeys(x for _, owners in found.iter(t) for x in owners)) if t else [] for t in batch.column(1).to_pylist()]
            rows = np.repeat(np.arange(batch.num_rows), [len(x) for x in hits])
            entity = pa.array([x for xs in hits for x in xs])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), entity if len(entity) else entity.cast(kinds[1])], ["id", "entity"])

    kinds = [x.type for x in to_arrow_schema(schema)]
    return contents.mapInArrow(run, schema)


def auto_links(new: DataFrame, entries: DataFrame, most: int = 5) -> DataFrame:
    """For each new insight or relationship entry, the first `most` earlier entries by arrival with its type or its source.

    The candidates of a type or of a source are the first `most` + 1 alone, as the entry itself is the only one left out.
    """

    def heads(c: str) -> DataFrame:
        order = Window.partitionBy(c).orderBy("ord")
        return entries.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most + 1).select(F.col(c).alias("key"), F.col("id").alias("other"), F.col("ord").alias("other_ord"))

    n = new.where(F.col("content_type").isin("insight", "relationship")).select("id", "content_type", "source")
    both = n.join(heads("content_type"), F.col("content_type") == F.col("key")).select("id", "other", "other_ord").union(n.join(heads("source"), F.col("source") == F.col("key")).select("id", "other", "other_ord"))
    order = Window.partitionBy("id").orderBy("other_ord")
    picked = both.where("id <> other").distinct().withColumn("place", F.row_number().over(order))
    return picked.where(F.col("place") <= most).select("id", "place", "other")


def without_node(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that touch none of the nodes in gone (column node)."""
    return edges.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select(edges.columns)


def with_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Append those new edges whose two ends exist in nodes (column id)."""
    ends = nodes.select("id")
    known = new.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return edges.unionByName(known.select(edges.columns))


def degrees(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy("node").agg(F.count("*").alias("degree"))


def relation_types(edges: DataFrame, fallback: tuple[str, ...] = ("ABOUT", "RELATED_TO")) -> DataFrame:
    """The distinct safe types of edges (column type), or the fallback where there are none."""
    found = usable(edges).select("type").distinct()
    spare = edges.sparkSession.createDataFrame([(t,) for t in fallback], "type string")
    return found.unionByName(spare.join(F.broadcast(found.agg(F.count("*").alias("n"))), F.col("n") == 0).select("type"))


def labelled(nodes: DataFrame, labels: tuple[str, ...], each: int = 500, most: int = 500) -> DataFrame:
    """Nodes (id, label, ord) of the labels, `each` a label at most, and `most` in all, in the order of the labels."""
    place = F.array_position(F.array(*map(F.lit, labels)), F.col("label"))
    few = nodes.where(F.col("label").isin(*labels)).withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("ord"))).where(F.col("place") <= each)
    return few.orderBy(place, "place").limit(most)


def resolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (start, end, type: element ids of another store) by the nodes' own ids (element, id), and whether both ends were found."""
    at = lambda end, name: nodes.select(F.col("element").alias(end), F.col("id").alias(name))
    j = edges.join(at("start", "src"), "start", "left").join(at("end", "dst"), "end", "left")
    return j.select("src", "dst", "type", (F.col("src").isNotNull() & F.col("dst").isNotNull()).alias("found"))
