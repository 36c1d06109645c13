"""Importers: chunking, transcripts, claims, sync plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a paragraph chunk, and of a preamble that is a chunk of its own.
PARAGRAPH_CHARS, PREAMBLE_CHARS = 3072, 200

CLAIM_SCHEMA = "struct<summary:string,claims:array<struct<type:string,content:string,qualitative_confidence:string,topics:array<string>,people:array<string>>>>"
CLAIM_TYPES = ("decision", "preference", "learning", "context", "brainstorm", "reference")
CONFIDENCES = ("firm", "tentative", "exploring")

#: White space at both ends, as a JavaScript trim takes it.
_ENDS = r"\A[\s\x{A0}]+|[\s\x{A0}]+\z"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, _ENDS, "")


def h2_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, chunk, text): sections at second-level headings of documents that have two or more; a preamble of over 200 characters is the first.

    The text is split before each heading line, inside the row.
    """
    parts = F.split(F.col(text_col), r"(?m)(?=^##[ \t])")
    n = F.size(F.filter(parts, lambda p: p.rlike(r"\A##[ \t]")))
    cut = docs.select(F.col(id_col).alias("id"), parts.alias("parts"), n.alias("n")).where("n >= 2").select("id", F.posexplode("parts").alias("pos", "part"))
    kept = cut.where(F.col("part").rlike(r"\A##[ \t]") | (F.length("part") > PREAMBLE_CHARS)).withColumn("text", trimmed(F.col("part"))).where("text <> ''")
    return kept.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("pos")) - 1).alias("chunk"), "text")


def pack_paragraphs(docs: DataFrame, id_col: str, text_col: str, limit: int = PARAGRAPH_CHARS) -> DataFrame:
    """(id, chunk, text): paragraphs packed greedily into chunks of limit characters at most; a longer one stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def step(s: Column, b: Column) -> Column:
        full = (F.length(s["buf"]) + F.length(b) + 2 > limit) & (F.length(s["buf"]) > 0)
        grown = F.when(F.length(s["buf"]) == 0, b).otherwise(F.concat(s["buf"], F.lit("\n\n"), b))
        return F.struct(F.when(full, F.concat(s["out"], F.array(trimmed(s["buf"])))).otherwise(s["out"]).alias("out"), F.when(full, b).otherwise(grown).alias("buf"))

    def finish(s: Column) -> Column:
        last = trimmed(s["buf"])
        return F.when(last != "", F.concat(s["out"], F.array(last))).otherwise(s["out"])

    packed = F.aggregate(F.split(F.col(text_col), r"\n\s*\n"), start, step, finish)
    return docs.select(F.col(id_col).alias("id"), F.posexplode(packed).alias("chunk", "text"))


def merge_speakers(segments: DataFrame, meeting: str = "meeting") -> DataFrame:
    """(meeting, turn, source, text): adjacent valid segments of one speaker joined by a space, by start then ord.

    segments has meeting, ord, source, text, is_final. Blank and non-final segments are left out before.
    """
    valid = segments.withColumn("text", trimmed(F.col("text"))).where((F.col("text") != "") & F.coalesce("is_final", F.lit(True)))
    order = Window.partitionBy(meeting).orderBy("ord")
    change = F.when(F.lag("source").over(order).eqNullSafe(F.col("source")), 0).otherwise(1)
    turns = valid.withColumn("change", change).withColumn("turn", F.sum("change").over(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ")
    return turns.groupBy(meeting, "turn", "source").agg(joined.alias("text"))


def distillation(raw: Column) -> Column:
    """The distilled JSON of a model's answer without BOM, fences or prose around it; null where it isn't valid.

    Valid: a summary, one claim or more, of which the first five count, each with a known type and confidence and a content.
    """
    s = F.trim(F.regexp_replace(raw, "^﻿", ""))
    s = F.coalesce(F.nullif(F.regexp_extract(s, r"(?is)\A```(?:json)?\s*(.*?)\s*```\z", 1), F.lit("")), s)
    s = F.when(s.startswith("{"), s).otherwise(F.regexp_extract(s, r"(?s)(\{.*\})", 1))
    parsed = F.from_json(s, CLAIM_SCHEMA)
    claims = F.slice(parsed["claims"], 1, 5)
    good = F.forall(claims, lambda c: c["type"].isin(*CLAIM_TYPES) & c["qualitative_confidence"].isin(*CONFIDENCES) & (F.length(F.trim(c["content"])) > 0))
    ok = (F.length(F.trim(parsed["summary"])) > 0) & (F.size(parsed["claims"]) > 0) & F.coalesce(good, F.lit(False))
    return F.when(ok, F.struct(F.trim(parsed["summary"]).alias("summary"), claims.alias("claims")))


def merged_claims(claims: DataFrame, most: int = 8) -> DataFrame:
    """Rows (doc, ord, qualitative_confidence, ...) by firmness, then ord, at most `most` a document."""
    level = F.when(F.col("qualitative_confidence") == "firm", 0).when(F.col("qualitative_confidence") == "tentative", 1).otherwise(2)
    order = Window.partitionBy("doc").orderBy(level, "ord")
    return claims.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def sync_plan(files: DataFrame, log: DataFrame, force: bool = False) -> DataFrame:
    """(path, action) of files (path, sha256) against a log (path, sha256, whole_doc_id, last_error): new, skip, retry or update."""
    prior = log.select("path", F.col("sha256").alias("prior_sha"), "whole_doc_id", "last_error", F.lit(True).alias("seen"))
    j = files.join(prior, "path", "left")
    whole = F.col("whole_doc_id").isNotNull()
    action = F.when(F.col("seen").isNull(), "new")
    if force:
        action = action.when(whole, "update").otherwise("retry")
    else:
        action = action.when((F.col("prior_sha") == F.col("sha256")) & whole, "skip").when(F.col("last_error").isNotNull() | ~whole, "retry").otherwise("update")
    return j.select("path", action.alias("action"))


def importable(path: Column, skip: tuple[str, ...] = ("node_modules", ".git", ".scratch", "assets", "data")) -> Column:
    """Whether a Markdown file lies outside the skipped and dot folders."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return path.endswith(".md") & ~F.exists(folders, lambda p: p.isin(*skip) | p.startswith("."))


def meetings(documents: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Documents (id, type, deleted_at, created_at) that are meetings, not deleted, with a start and a transcript (document_id, text, is_final, end_ts)."""
    live = documents.where("deleted_at is null and (type is null or type = 'meeting') and created_at is not null")
    spoken = transcripts.where((F.length(F.trim("text")) > 0) & F.coalesce("is_final", F.lit(True))).groupBy(F.col("document_id").alias("id")).agg(F.max("end_ts").alias("end_ts"), F.count("*").alias("segments"))
    return live.join(spoken, "id")


def after_watermark(meetings: DataFrame, since: str, watermark: str | None) -> DataFrame:
    """Meetings that end after the later of both; those at or before it are left out."""
    last = max(since, watermark) if watermark else since
    return meetings.where(F.col("end_ts") > F.lit(last).cast("timestamp"))


def canvases(messages: DataFrame, canvas: DataFrame, link: Column) -> DataFrame:
    """Messages with the canvas (file_id, markdown) that their link names."""
    return messages.withColumn("file_id", link).join(canvas, "file_id")


def changed_since(files: DataFrame, roots: tuple[str, ...], after: str | None = None) -> DataFrame:
    """Importable Markdown files (path, modified) under the chosen roots, one a path, of those changed after a time if one is given."""
    under = F.exists(F.array(*map(F.lit, roots)), lambda r: F.startswith("path", F.concat(r, F.lit("/"))))
    found = files.where(under & importable(F.col("path"))).groupBy("path").agg(F.max("modified").alias("modified"))
    return found if after is None else found.where(F.col("modified") > F.lit(after).cast("timestamp"))


def import_status(documents: DataFrame, transcripts: DataFrame, since: str, watermark: str | None) -> DataFrame:
    """(id, status, end_ts) of meeting documents: deleted, other-type, no-start, no-transcript, late (it ends at the watermark or before) or ready."""
    spoken = transcripts.where((F.length(F.trim("text")) > 0) & F.coalesce("is_final", F.lit(True))).groupBy(F.col("document_id").alias("id")).agg(F.max("end_ts").alias("end_ts"))
    last = F.lit(max(since, watermark) if watermark else since).cast("timestamp")
    status = (
        F.when(F.col("deleted_at").isNotNull(), "deleted")
        .when(F.col("type").isNotNull() & (F.col("type") != "meeting"), "other-type")
        .when(F.col("created_at").isNull(), "no-start")
        .when(F.col("end_ts").isNull(), "no-transcript")
        .when(F.col("end_ts") <= last, "late")
        .otherwise("ready")
    )
    return documents.join(spoken, "id", "left").select("id", status.alias("status"), "end_ts")


def keep_last(rows: DataFrame, partition: list[str], by: str, n: int) -> DataFrame:
    """The last n rows of each partition."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*partition).orderBy(F.desc(by)))).where(F.col("_r") <= n).drop("_r")


def pending(entries: DataFrame, completed: DataFrame) -> DataFrame:
    """Entries (embedder_id) without an embedder that aren't completed (id) either: a backfill's work, which shrinks by what it appends there."""
    return entries.where(F.coalesce("embedder_id", F.lit("")) == "").join(completed.select("id"), "id", "left_anti")
