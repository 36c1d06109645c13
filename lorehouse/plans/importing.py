"""The registered queries of the sources, the backfill and event time: what is written from whole tables and read again, or streamed."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import backfill, distil, ingest, synclog
from ..sources import exchange, readers, scratch
from ..sources import tables as S
from ..streaming import eventtime

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers f; its result is written, and what it wrote on the way is deleted."""

    @functools.wraps(f)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return scratch.settled(lambda: f(spark, d))

    QUERIES[f.__name__] = run
    return run


def _put(files: DataFrame, folder: str) -> None:
    """Write rows (path, content) as files."""
    readers.register(files.sparkSession)
    files.select("path", "content").write.format("text_files").option("path", folder).mode("append").save()


def _objects(rows: DataFrame, key: Column, value: Column, by: str) -> DataFrame:
    """By file number, the JSON text of {key: value}; values are structs."""
    return rows.groupBy(by).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key.cast("string"), value)))).alias("json"))


@query
def sidecar_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All entries written as files of {id: entry} and read again, beside a file that breaks off."""
    folder = scratch.folder(spark)
    readers.write_sidecar(S.entries(spark, d).select("id", "content", "content_type", "confidence", "tags"), folder)
    _put(spark.range(1).select(F.lit("broken.json").alias("path"), F.lit('{"lost": {"content": "x"').alias("content")), folder)
    back = readers.read_sidecar(spark, folder, "content string, content_type string, confidence double, tags array<string>")
    return back.select("id", F.sha2("content", 256).alias("content_sha"), "content_type", "confidence", F.array_join("tags", ",").alias("tags"), "problem")


def _cached_meetings(spark: SparkSession, d: str) -> str:
    """Eight cache files of all documents as meetings and all conversations as transcripts; the last one breaks off."""
    n, c = F.col("doc_id"), S.table(spark, d, "conversations")
    day = F.date_format(F.timestamp_add("DAY", (n * 7919 % 400).cast("int"), F.lit("2024-01-01").cast("timestamp")), "yyyy-MM-dd")
    at = lambda hour: F.struct(F.concat(day, F.lit(f"T{hour}:00:00Z")).alias("dateTime"))
    doc = F.struct(
        F.when(n % 7 != 0, F.concat(F.lit("m"), n)).alias("id"),
        F.when(n % 5 != 0, F.concat(F.lit("talk "), n)).otherwise("").alias("title"),
        F.when(n % 11 == 0, "note").when(n % 3 == 0, "meeting").alias("type"),
        F.when(n % 13 == 0, day).alias("deleted_at"),
        F.when(n % 17 == 0, "soon").otherwise(F.concat(day, F.lit("T08:30:00Z"))).alias("created_at"),
        F.concat(day, F.lit("T12:00:00Z")).alias("updated_at"),
        F.when(n % 4 == 0, F.struct(at("09").alias("start"), F.when(n % 8 == 0, at("10")).alias("end"))).alias("google_calendar_event"),
    )
    docs = _objects(S.table(spark, d, "documents").withColumn("k", n % 8), n, doc, "k").withColumnRenamed("json", "documents")
    t = F.col("turn")
    segment = F.struct(
        t.alias("turn"),
        F.when(t % 5 != 4, F.col("text")).otherwise("  ").alias("text"),
        F.when((t / 2).cast("int") % 2 == 0, "me").otherwise("them").alias("source"),
        F.when(t % 6 != 5, t % 3 != 2).alias("is_final"),
        F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("2024-06-01T10:0"), t % 10, F.lit(":00Z"))).alias("end_timestamp"),
    )
    said = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(segment)).alias("segments")).withColumn("k", F.col("conv_id") % 8)
    said = _objects(said, F.col("conv_id"), F.col("segments"), "k").withColumnRenamed("json", "transcripts")
    both = docs.join(said, "k", "left")
    whole = F.concat(F.lit('{"cache": {"version": 6, "state": {"documents": '), F.coalesce("documents", F.lit("{}")), F.lit(', "transcripts": '), F.coalesce("transcripts", F.lit("{}")), F.lit("}}}"))
    folder = scratch.folder(spark)
    _put(both.select(F.concat(F.lit("cache-"), "k", F.lit(".json")).alias("path"), F.when(F.col("k") == 7, F.substring(whole, F.lit(1), F.length(whole) - 10)).otherwise(whole).alias("content")), folder)
    return folder


@query
def meeting_cache_import(spark: SparkSession, d: str) -> DataFrame:
    meetings, _ = readers.meeting_cache(spark, _cached_meetings(spark, d))
    out = readers.importable_meetings(meetings, "2024-02-20")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return out.select("id", "title", stamp("start").alias("start"), stamp("end").alias("end"), "turns", F.sha2("transcript", 256).alias("transcript_sha"))


@query
def meeting_cache_report(spark: SparkSession, d: str) -> DataFrame:
    """Meetings that were read and what was wrong with files, by kind."""
    meetings, problems = readers.meeting_cache(spark, _cached_meetings(spark, d))
    counted = meetings.groupBy(F.when(F.col("segments").isNull(), "silent").otherwise("spoken").alias("kind")).agg(F.count("*").alias("n"))
    return counted.unionByName(problems.groupBy(F.concat(F.lit("problem: "), "problem").alias("kind")).agg(F.countDistinct("file").alias("n")))


@query
def meeting_cache_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Two runs with a kept watermark: meetings of even numbers first, then all; what ends at the mark or before is late and stays out."""
    meetings, _ = readers.meeting_cache(spark, _cached_meetings(spark, d))
    mark, out = synclog.Watermark(spark, scratch.folder(spark)), None
    for run, keep in enumerate((F.col("key").cast("long") % 2 == 0, F.lit(True))):
        found = scratch.cut(readers.importable_meetings(meetings.where(keep), mark.since("2024-02-20")).select("id", "start", "end"))
        mark.advance(found)
        rows = found.select(F.lit(run).alias("run"), "id")
        out = rows if out is None else out.unionByName(rows)
    end, ids = mark.read()
    return out.unionByName(spark.createDataFrame([(2, end[:16]), (3, str(len(ids)))], "run int, id string"))


@query
def chat_dump_import(spark: SparkSession, d: str) -> DataFrame:
    """Six dumps of all conversation turns, three of each shape; one array has a huddle without a channel, one object breaks off."""
    c = S.table(spark, d, "conversations").withColumn("n", F.col("conv_id") * 100 + F.col("turn")).withColumn("k", F.col("n") % 6)
    n = F.col("n")
    stamp, file_id = F.concat(n + 1_700_000_000, F.lit(".000100")), F.concat(F.lit("F"), n % 500)
    huddle = F.struct(
        F.concat(F.lit("C"), n % 9).alias("channel_id"),
        F.when((F.col("k") == 4) & (n % 10 == 0), "").otherwise(F.concat(F.lit("room-"), n % 9)).alias("channel_name"),
        stamp.alias("message_ts"),
        F.lit("T1").alias("team_id"),
        F.concat(F.lit("F"), n).alias("file_id"),
        F.col("text").alias("canvas_markdown"),
        F.when(n % 4 == 0, "2024-01-01").alias("huddle_date"),
    )
    arrays = c.where("k % 2 = 0").groupBy("k").agg(F.to_json(F.collect_list(huddle)).alias("content"))
    words = F.concat(F.when(n % 3 != 2, "AI huddle notes are ready: ").otherwise(""), F.lit("<https://x.slack.com/docs/T2/"), file_id, F.lit("|notes>"))
    message = F.struct(words.alias("text"), F.when(n % 4 == 1, "USLACKBOT").alias("user"), F.when(n % 5 == 0, "Slackbot").alias("username"), stamp.alias("ts"), F.concat(F.lit("C"), n % 9).alias("channel_id"), F.lit("side").alias("channel_name"))
    canvas = c.where("k % 2 = 1").select("k", file_id.alias("f"), "text").where("f rlike '[02468]$'").groupBy("k", "f").agg(F.min("text").alias("text"))
    canvas = canvas.groupBy("k").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("f", "text")))).alias("canvases"))
    objects = c.where("k % 2 = 1").groupBy("k").agg(F.to_json(F.collect_list(message)).alias("messages")).join(canvas, "k", "left")
    whole = F.concat(F.lit('{"messages": '), "messages", F.lit(', "canvases": '), F.coalesce("canvases", F.lit("{}")), F.lit("}"))
    objects = objects.select("k", F.when(F.col("k") == 5, F.substring(whole, F.lit(1), F.length(whole) - 2)).otherwise(whole).alias("content"))
    folder = scratch.folder(spark)
    _put(arrays.unionByName(objects).select(F.concat(F.lit("dump-"), "k", F.lit(".json")).alias("path"), "content"), folder)
    huddles, problems = readers.chat_dump(spark, folder)
    name = lambda c: F.regexp_extract(c, "dump-[0-9]+", 0)
    rows = huddles.select(name("file").alias("dump"), "channel_id", "channel_name", "message_ts", "team_id", "file_id", "huddle_date", F.sha2("canvas_markdown", 256).alias("canvas_sha"), F.lit(None).cast("string").alias("problem"))
    none = [F.lit(None).cast("string").alias(x) for x in ("channel_id", "channel_name", "message_ts", "team_id", "file_id", "huddle_date", "canvas_sha")]
    return rows.unionByName(problems.select(name("file").alias("dump"), *none, "problem").distinct())


@query
def markdown_import(spark: SparkSession, d: str) -> DataFrame:
    """All benchmark items as files of a tree, of which the Markdown outside skipped folders is read, below one root and right in another."""
    n = F.col("item_id")
    inside = F.when(n % 6 == 0, "node_modules/").when(n % 6 == 1, ".hidden/").when(n % 6 == 2, "deep/er/").otherwise("")
    path = F.concat(S.pick(("notes", "plans", "flat"), n % 3), F.lit("/"), inside, n, F.when(n % 10 == 9, ".txt").otherwise(".md"))
    folder = scratch.folder(spark)
    _put(S.table(spark, d, "benchmark").select(path.alias("path"), F.concat(F.lit("# "), n, F.lit("\n"), "text").alias("content")), folder)
    found = readers.markdown_tree(spark, [f"{folder}/notes", f"{folder}/plans"], [f"{folder}/flat"], "2020-01-01")
    name = F.element_at(F.split("path", "/(?=notes/|plans/|flat/)"), -1)
    return found.select(name.alias("path"), "project", "size", F.sha2("content", 256).alias("sha256"), T.word_count(F.col("content")).cast("long").alias("words"))


class Unsteady:
    """An embedder that fails for texts of some lengths: always where the length ends in 3, the first time where it ends in 4."""

    def __init__(self, dims: int) -> None:
        self.model, self.asked = backfill.HashedWords(dims), set()

    def __call__(self, texts: list[str]) -> list[list[float] | None]:
        again = [t for t in texts if len(t) % 10 == 4 and t not in self.asked]
        self.asked.update(again)
        if again:
            raise TimeoutError("try again")
        return [None if len(t) % 10 == 3 else self.model.one(t) for t in texts]


@query
def backfill_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Two thirds of the entries lack a vector: a run of some parts, one of the rest, and a third that asks for the failed ones again."""
    e = S.entries(spark, d).withColumn("embedder_id", F.when(F.col("ord") % 3 == 0, "older").when(F.col("ord") % 3 == 1, ""))
    fill = backfill.Backfill(spark, scratch.folder(spark), functools.partial(Unsteady, 8), "hashed-8", 8)
    size = max(1, e.count() // 6)
    fill.run(e, size, most_parts=2)
    fill.run(e, size)
    fill.run(e, size)
    out = backfill.stored(e, fill.vectors(), 8, S.AS_OF)
    rows = fill.rows().groupBy("id").agg(F.count_if(F.col("vec").isNotNull()).cast("long").alias("written"))
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
    return out.join(rows, "id", "left").join(fill.failures().select("id", "error"), "id", "left").select("id", "embedder_id", total.alias("words"), F.col("embedded_at").isNotNull().alias("filled"), F.coalesce("written", F.lit(0)).alias("written"), "error")


_EVENT = "event_id long, user_id long, ts timestamp"


def _streamed(spark: SparkSession, d: str, part: Column, keep: Column | None = None) -> DataFrame:
    """The events as a stream of parts, one a batch."""
    e = S.table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    e = (e if keep is None else e.where(keep)).withColumn("part", part)
    return eventtime.parts_stream(spark, eventtime.put_parts(e, "part", scratch.folder(spark)), _EVENT)


@query
def late_events(spark: SparkSession, d: str) -> DataFrame:
    """Events that come in four parts, each over all days: those that the stream keeps, and those that it counts as later than two days."""
    part = F.col("event_id") % 4
    stream = _streamed(spark, d, part, (part != 3) | (F.dayofmonth("ts") <= 10))
    run = eventtime.counted(eventtime.first_within(stream, ["event_id"], "ts", "2 days"), scratch.folder(spark))
    kept = run.rows.agg(F.lit("kept").alias("kind"), F.count("*").alias("n"))
    return kept.unionByName(spark.range(1).select(F.lit("late").alias("kind"), F.lit(run.late).cast("long").alias("n")))


@query
def closed_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Events that come by the week: the sessions of each user that the watermark has closed."""
    stream = _streamed(spark, d, F.floor(F.dayofmonth("ts") / 7))
    out = eventtime.counted(eventtime.sessions(stream, "user_id", "ts", "6 hours", "2 days"), scratch.folder(spark)).rows
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query
def session_marks(spark: SparkSession, d: str) -> DataFrame:
    """Events that come by the week: each third event of a user without a day between them."""
    stream = _streamed(spark, d, F.floor(F.dayofmonth("ts") / 7))
    out = eventtime.counted(eventtime.session_marks(stream, "user_id", "ts", 3, 86_400, "2 days"), scratch.folder(spark)).rows
    return out.select("user_id", "mark", F.unix_micros("at").alias("at_us"))


def _told(text: str) -> str:
    """A model that stands for one that distils: its answer follows from the text's length, and isn't always as it must be."""
    n = len(text)
    claims = [{"type": ingest.CLAIM_TYPES[(n + i) % 6] if n % 11 != 3 else "rumour", "content": f"claim {i} of {n}", "qualitative_confidence": ingest.CONFIDENCES[(n + i) % 3], "topics": [f"t{i}"], "people": []} for i in range(n % 7)]
    body = json.dumps({"summary": f"text of {n}", "claims": claims})
    return (f"```json\n{body}\n```", f"Here it is: {body} That is all.", f"\ufeff{body}", body[:-1] if n % 8 == 3 else body)[n % 4]


@query
def distilled(spark: SparkSession, d: str) -> DataFrame:
    """All entries through a table function, called from SQL: summaries, claims and errors."""
    distil.register(spark, "distil", lambda: _told)
    rows = spark.sql("SELECT * FROM distil(TABLE({entries}))", entries=S.entries(spark, d).select("id", "content"))
    return rows.select("id", "place", "type", "content", F.round("confidence", 2).alias("confidence"), F.array_join("topics", ",").alias("topics"), "error")


@query
def sync_log_runs(spark: SparkSession, d: str) -> DataFrame:
    """Three runs of an import of all documents as files: what is planned from the log in each, with failures and changes between."""
    log = synclog.SyncLog(spark, scratch.folder(spark))
    n = F.col("doc_id")
    out = None
    for run in range(3):
        changed = (n % 10 < run) if run else F.lit(False)
        files = S.table(spark, d, "documents").where(F.lit(run) >= n % 4 - 1).select("doc_id", F.concat(F.lit("notes/"), n, F.lit(".md")).alias("path"), F.sha2(F.concat_ws("#", "text", F.when(changed, F.lit(str(run)))), 256).alias("sha256"))
        plan = scratch.cut(log.plan(files.select("path", "sha256")))
        done = files.join(plan.where("action <> 'skip'"), "path")
        fails = (n + run) % 7 == 0
        log.record(done.select("path", "sha256", F.when(~fails, F.concat(F.lit("k"), n)).alias("whole_doc_id"), F.when(fails, F.lit("no answer")).alias("last_error")))
        if run == 1:
            log.compact()
        counted = plan.groupBy(F.lit(run).alias("run"), "action").agg(F.count("*").alias("n"))
        out = counted if out is None else out.unionByName(counted)
    return out


def _graph_dump(spark: SparkSession, d: str) -> DataFrame:
    """Parts and suppliers as nodes of another graph, with properties of every kind."""
    n, m = F.col("p_partkey"), F.col("s_suppkey")
    props = F.to_json(F.struct(F.when(n % 4 != 0, F.concat(F.lit("part-"), n)).alias("id"), F.when(n % 3 != 0, F.col("p_name")).alias("name"), F.when(n % 5 == 0, "  ").otherwise(F.col("p_brand")).alias("notes"), F.when(n % 7 == 0, "procedure").alias("contentType"), F.when(n % 2 == 0, n % 10 / 10).alias("confidence"), F.array(n % 3, n % 5).alias("tag-list"), F.repeat(F.lit("x"), F.lit(6000)).alias("long"), F.when(n % 6 == 0, "2024-03-01T10:00:00Z").alias("createdAt")))
    # a small file is one task, and its rows grow a hundredfold: they are dealt out while they are narrow
    dealt = S.table(spark, d, "part").select("p_partkey", "p_name", "p_brand").repartition(4 * spark.sparkContext.defaultParallelism)
    parts = dealt.select(F.concat(F.lit("4:p:"), n).alias("element"), F.when(n % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Part"), F.lit("Thing"))).alias("labels"), F.when(n % 50 == 0, F.lit("{broken")).otherwise(props).alias("props"))
    makers = S.table(spark, d, "supplier").select(F.concat(F.lit("4:s:"), m).alias("element"), F.array(F.lit("Organization")).alias("labels"), F.to_json(F.struct(F.col("s_name").alias("name"), m.alias("rank"))).alias("props"))
    return parts.unionByName(makers)


@query
def graph_migration(spark: SparkSession, d: str) -> DataFrame:
    """What nodes of another graph become as entries."""
    e = exchange.migrated_nodes(_graph_dump(spark, d), S.AS_OF)
    pairs = F.transform(F.array_sort(F.map_entries("metadata")), lambda x: F.concat(x["key"], F.lit("="), F.when(F.length(x["value"]) > 100, F.length(x["value"]).cast("string")).otherwise(x["value"])))
    return e.select("id", "content", "content_type", "source", F.round("confidence", 4).alias("confidence"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"), F.array_join(pairs, ";").alias("metadata"))


@query
def graph_migration_edges(spark: SparkSession, d: str) -> DataFrame:
    """Line items as relations between parts and suppliers: by part, those with both ends and those without."""
    nodes = exchange.migrated_nodes(_graph_dump(spark, d), S.AS_OF)
    rel = S.table(spark, d, "lineitem").select(F.concat(F.lit("4:p:"), "l_partkey").alias("src_element"), F.concat(F.lit("4:s:"), "l_suppkey").alias("dst_element"), F.concat(F.lit("sold by "), F.lower("l_returnflag")).alias("type"))
    edges = exchange.migrated_edges(rel, nodes)
    return edges.groupBy("src", "type", "status").agg(F.count("*").alias("n"), F.count_distinct("dst").alias("ends"))
