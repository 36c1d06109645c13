"""Corrections as table transformations: update, flag, supersede, reap, repair."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def update(entries: DataFrame, updates: DataFrame, as_of: str) -> DataFrame:
    """Apply (id, new_content, new_confidence, note, and ord where an id may occur more than once): given values replace, ts moves to as_of, update_history gains the notes in order.

    Of several updates of an id the last given value counts for each column.
    """
    at = F.col("ord") if "ord" in updates.columns else F.lit(0)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    notes = F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), "note"))), lambda x: x["note"]).alias("notes")
    u = updates.groupBy("id").agg(last("new_content"), last("new_confidence"), notes, F.lit(True).alias("hit"))
    j = entries.join(u, "id", "left")
    history = F.col("update_history") if "update_history" in entries.columns else F.array().cast("array<string>")
    changed = {
        "content": F.coalesce("new_content", "content"),
        "confidence": F.coalesce("new_confidence", "confidence"),
        "ts": F.when(F.col("hit"), F.lit(as_of).cast("timestamp")).otherwise(F.col("ts")),
        "update_history": F.when(F.col("hit"), F.concat(history, "notes")).otherwise(history),
    }
    return j.withColumns(changed).drop("new_content", "new_confidence", "notes", "hit")


def flag(entries: DataFrame, flags: DataFrame, as_of: str) -> DataFrame:
    """Apply (id, new_flag, new_successor, and ord where an id may occur more than once): a null flag un-flags; any flag but SUPERSEDED clears superseded_by.

    Of several flags of an id the last counts.
    """
    at = F.col("ord") if "ord" in flags.columns else F.lit(0)
    f = flags.groupBy("id").agg(F.max_by(F.struct("new_flag", "new_successor"), at).alias("f")).select("id", "f.new_flag", "f.new_successor", F.lit(True).alias("hit"))
    j = entries.join(f, "id", "left")
    successor = F.when(F.col("new_flag") == "SUPERSEDED", F.col("new_successor"))
    changed = {
        "superseded_by": F.when(F.col("hit"), successor).otherwise(F.col("superseded_by")),
        "flag_date": F.when(F.col("hit"), F.when(F.col("new_flag").isNotNull(), F.lit(as_of).cast("timestamp"))).otherwise(F.col("flag_date")),
        "flag": F.when(F.col("hit"), F.col("new_flag")).otherwise(F.col("flag")),
    }
    return j.withColumns(changed).drop("new_flag", "new_successor", "hit")


def supersede(entries: DataFrame, successors: DataFrame, as_of: str) -> DataFrame:
    """Add successors (the columns of entries and old_id) and flag the entries that they replace, in one table."""
    links = successors.select(F.col("old_id").alias("id"), F.lit("SUPERSEDED").alias("new_flag"), F.col("id").alias("new_successor"))
    return flag(entries, links, as_of).unionByName(successors.drop("old_id"))


def supersede_pairs(entries: DataFrame) -> DataFrame:
    """(old_id, new_id) of entries whose successor exists."""
    old = entries.where("superseded_by is not null").select(F.col("id").alias("old_id"), F.col("superseded_by").alias("new_id"))
    return old.join(entries.select(F.col("id").alias("new_id")), "new_id").select("old_id", "new_id")


def classify_superseded(entries: DataFrame, reverse: DataFrame) -> DataFrame:
    """(id, state, repair_to) of superseded entries; reverse has (old_id, new_id, ts): what the graph says replaced them.

    healthy: the successor is in the table; graph-only: only the graph knows one; repairable: no pointer, but the
    graph has one; true-orphan: neither; dangling: the pointer leads nowhere. The latest successor counts, of equal
    times the first by ord (where reverse has it, else by id).
    """
    order = "ord" if "ord" in reverse.columns else "new_id"
    last = reverse.groupBy("old_id").agg(F.max("ts").alias("ts"))
    latest = reverse.join(last, ["old_id", "ts"]).groupBy("old_id").agg(F.min_by("new_id", order).alias("found"))
    known = entries.select(F.col("id").alias("superseded_by"), F.lit(True).alias("exists"))
    j = entries.where("flag = 'SUPERSEDED'").select("id", "superseded_by").join(known, "superseded_by", "left").join(latest, F.col("id") == F.col("old_id"), "left")
    state = (
        F.when(F.col("superseded_by").isNull(), F.when(F.col("found").isNotNull(), "repairable").otherwise("true-orphan"))
        .when(F.col("exists"), "healthy")
        .when(F.col("found").isNotNull(), "graph-only")
        .otherwise("dangling")
    )
    return j.select("id", state.alias("state"), F.when(state == "repairable", F.col("found")).alias("repair_to"))


def repair(entries: DataFrame, reverse: DataFrame) -> DataFrame:
    """Entries with the successors of repairable ones filled in."""
    fixes = classify_superseded(entries, reverse).where("repair_to is not null").select("id", "repair_to")
    return entries.join(fixes, "id", "left").withColumn("superseded_by", F.coalesce("superseded_by", "repair_to")).drop("repair_to")


def unresolved(entries: DataFrame, contradictions: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Flag as UNVERIFIED the live entries with a contradiction (id, raised_at, resolved_at) that is open after days."""
    late = contradictions.where(F.col("resolved_at").isNull() & (F.col("raised_at") < F.timestamp_add("DAY", F.lit(-days), F.lit(as_of).cast("timestamp")))).select("id").distinct()
    marks = entries.where("flag is null").join(late, "id", "left_semi").select("id", F.lit("UNVERIFIED").alias("new_flag"), F.lit(None).cast("string").alias("new_successor"))
    return flag(entries, marks, as_of)


def reapable(entries: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Flagged entries whose flag is older than days."""
    return entries.where(F.col("flag").isNotNull() & (F.col("flag_date") < F.timestamp_add("DAY", F.lit(-days), F.lit(as_of).cast("timestamp"))))


def reap(entries: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    return entries.join(reapable(entries, as_of, days).select("id"), "id", "left_anti")


#: What each action needs beside its content.
REQUIRED = {"supersede": ("target_id", "reason"), "update": ("target_id", "reason"), "complement": ("target_id",), "force-new": ("reason",)}


def check_actions(rows: DataFrame) -> DataFrame:
    """Add error to rows (action, target_id, reason): what an action needs if it lacks any of it, or that it is unknown; null without an action or if all is there."""
    error = None
    for name, columns in REQUIRED.items():
        lacks = reduce(or_, [F.coalesce(F.trim(c), F.lit("")) == "" for c in columns])
        text = F.lit(f"{name} needs {' and '.join(columns)}")
        error = F.when((F.col("action") == name) & lacks, text) if error is None else error.when((F.col("action") == name) & lacks, text)
    return rows.withColumn("error", error.when(F.col("action").isNotNull() & ~F.col("action").isin(*REQUIRED), F.concat(F.lit("unknown action "), "action")))


def presence(ids: DataFrame, graph: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, in_graph, in_documents) of ids, by the tables of both stores (id)."""
    seen = lambda df, name: df.select("id", F.lit(True).alias(name)).distinct()
    j = ids.select("id").join(seen(graph, "g"), "id", "left").join(seen(documents, "d"), "id", "left")
    return j.select("id", F.coalesce("g", F.lit(False)).alias("in_graph"), F.coalesce("d", F.lit(False)).alias("in_documents"))


def retry_as_update(refused: DataFrame) -> DataFrame:
    """Updates (id, new_content, new_confidence, note, ord) of what refused entries (id, ord, content, confidence, against) were held against."""
    return refused.where("against is not null").select(F.col("against").alias("id"), F.col("content").alias("new_content"), F.col("confidence").alias("new_confidence"), F.concat(F.lit("merged from "), "id").alias("note"), "ord")
