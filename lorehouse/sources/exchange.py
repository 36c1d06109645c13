"""Exchange of a store as JSON lines: a manifest, nodes and edges; reading checks labels and relations against lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "lorehouse-graph/1"
#: What a line may hold.
LINE = "struct<kind:string,format:string,id:string,label:string,content:string,src:string,dst:string,type:string,strength:int>"


def lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON text a line (column value): a manifest, nodes (id, label, content), edges (src, dst, type, strength) with both ends."""
    spark = nodes.sparkSession
    head = spark.range(1).select(F.to_json(F.struct(F.lit("manifest").alias("kind"), F.lit(FORMAT).alias("format"))).alias("value"))
    n = nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), "id", "label", "content")).alias("value"))
    e = edges.where("src is not null and dst is not null").select(F.to_json(F.struct(F.lit("edge").alias("kind"), "src", "dst", "type", "strength")).alias("value"))
    return head.unionByName(n).unionByName(e)


def write(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    lines(nodes, edges).write.text(path)


def read(spark: SparkSession, path: str, labels: Sequence[str], relations: Sequence[str]) -> DataFrame:
    """Every line of the files with its status: ok, manifest, malformed, unknown-kind, no-id, label-refused, relation-refused, no-end."""
    at = spark.read.text(path).select(F.from_json("value", LINE).alias("x")).select("x.*")
    node = F.when(F.coalesce("id", F.lit("")) == "", "no-id").when(~F.coalesce(F.col("label").isin(*labels), F.lit(False)), "label-refused").otherwise("ok")
    edge = F.when(F.col("src").isNull() | F.col("dst").isNull(), "no-end").when(~F.coalesce(F.col("type").isin(*relations), F.lit(False)), "relation-refused").otherwise("ok")
    status = F.when(F.col("kind").isNull(), "malformed").when(F.col("kind") == "manifest", "manifest").when(F.col("kind") == "node", node).when(F.col("kind") == "edge", edge).otherwise("unknown-kind")
    return at.withColumn("status", status)


def sidecar(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """Entries of JSON files that each hold one object {id: entry}; entry is the DDL of the values. A file is read by one task: it is an import of small stores, of which there may be many."""
    read_ = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("id", "entry"))
    return read_.select("id", "entry.*")


def node_content(columns: Sequence[str], id_col: str = "id") -> Column:
    """The non-blank ones of a node's texts joined by a dash, or its id."""
    joined = F.concat_ws(" — ", *[F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string"))) for c in columns])
    return F.when(joined != "", joined).otherwise(F.col(id_col))


# Properties that become an entry's own columns; the others are its metadata.
OWN = ("id", "name", "description", "content", "contentType", "source", "userId", "confidence", "timestamp", "createdAt")
#: Characters of a property at most.
MOST = 5000


def migrated_nodes(nodes: DataFrame, as_of: str, source: str = "graph-import") -> DataFrame:
    """Entries of a graph's nodes (element, labels, props as a JSON object), with element: an import from another graph.

    A node's id is its property, else its element's. Content joins the non-blank ones of name, description, notes,
    headline, content and text, or is the id. Type, source, user, confidence and time are properties, or the first label,
    `source`, '', 0.8 and as_of. The other properties are metadata: keys of letters, digits and underscore, arrays and
    objects as JSON, none longer than MOST; null ones go, and so does an object that isn't JSON.
    """
    p = F.from_json("props", "map<string,string>")
    text = lambda k: F.col("p").getItem(k)
    parts = F.filter(F.array(*[text(k) for k in ("name", "description", "notes", "headline", "content", "text")]), lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
    ident = F.coalesce(F.nullif(text("id"), F.lit("")), F.col("element"))
    rest = F.map_filter("p", lambda k, v: ~k.isin(*OWN) & v.isNotNull())
    safe = F.transform(F.map_entries(rest), lambda e: F.struct(F.regexp_replace(e["key"], "[^a-zA-Z0-9_]", "_").alias("key"), F.substring(e["value"], 1, MOST).alias("value")))
    last = F.aggregate(safe, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))  # keys that are then alike: the last counts
    joined = F.array_join(parts, " — ")
    # a generator gives the object once; as a column it would be parsed again for each property that is read
    return nodes.withColumn("p", F.explode(F.array_compact(F.array(p)))).select(
        "element",
        ident.alias("id"),
        F.coalesce(F.nullif(joined, F.lit("")), ident).alias("content"),
        F.coalesce(F.nullif(text("contentType"), F.lit("")), F.try_element_at("labels", F.lit(1)), F.lit("fact")).alias("content_type"),
        F.coalesce(F.nullif(text("source"), F.lit("")), F.lit(source)).alias("source"),
        F.coalesce(F.nullif(text("userId"), F.lit("")), F.nullif(text("user_id"), F.lit("")), F.lit("")).alias("user_id"),
        F.coalesce(text("confidence").try_cast("double"), F.lit(0.8)).alias("confidence"),
        F.coalesce(F.try_to_timestamp(F.coalesce(F.nullif(text("timestamp"), F.lit("")), text("createdAt"))), F.lit(as_of).cast("timestamp")).alias("ts"),
        last.alias("metadata"),
    )


def migrated_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, type, status) of relations (src_element, dst_element, type) by the ids of migrated nodes (element, id): ok, or no-end, with what is known of the ends."""
    at = nodes.select("element", "id")
    j = relations.join(at.select(F.col("element").alias("src_element"), F.col("id").alias("src")), "src_element", "left").join(at.select(F.col("element").alias("dst_element"), F.col("id").alias("dst")), "dst_element", "left")
    return j.select("src", "dst", F.regexp_replace(F.upper("type"), "[^A-Z0-9_]", "_").alias("type"), F.when(F.col("src").isNull() | F.col("dst").isNull(), "no-end").otherwise("ok").alias("status"))
