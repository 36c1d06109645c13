"""Sources and sinks of JSON stores and dumps, chat exports and Markdown trees.

The Python data sources here open files by pyarrow's file systems (a local path, file:, hdfs:, s3: and so on) in their
tasks, one file a task; Markdown trees are read by Spark itself.
"""

from __future__ import annotations

import codecs
import json
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import IO

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from ..functions import rules
from ..operators import ingest

#: Characters that a reader takes from a file at once.
CHUNK = 1 << 20


#: The problem of a file that is looked at as an array and is something else.
NOT_ARRAY = "not an array"


class Malformed(ValueError):
    """A file that isn't JSON, or hasn't what is looked for."""


_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|["{}\[\]]', re.S)
_SCALAR = re.compile(r"[^\s,\]}:]+")
_SPACE = re.compile(r"[ \t\r\n]*")


class _Text:
    """The text of a stream, of which no more is held than the value that is looked at."""

    def __init__(self, stream: IO[bytes], chunk: int = CHUNK) -> None:
        self.stream, self.chunk, self.buffer, self.at = stream, chunk, "", 0
        self.decode = codecs.getincrementaldecoder("utf-8-sig")("strict").decode
        self.ended = False

    def more(self) -> bool:
        if self.ended:
            return False
        raw = self.stream.read(max(self.chunk, len(self.buffer) - self.at))  # as much again, so that a long value is looked through few times
        self.ended = not raw
        try:
            self.buffer = self.buffer[self.at :] + self.decode(raw, not raw)
        except UnicodeDecodeError as e:
            raise Malformed("not UTF-8") from e
        self.at = 0
        return not self.ended

    def peek(self) -> str:
        """The next character that isn't white space; empty at the end."""
        while True:
            self.at = _SPACE.match(self.buffer, self.at).end()
            if self.at < len(self.buffer):
                return self.buffer[self.at]
            if not self.more():
                return ""

    def take(self, wanted: str) -> None:
        if (found := self.peek()) != wanted:
            raise Malformed(f"{wanted!r} is missing" if found else "ends early")
        self.at += 1

    def value(self, keep: bool = True) -> str:
        """The text of the next value, of which only brackets and strings are looked at; empty without keep."""
        first = self.peek()
        if not first or first in ",]}:":
            raise Malformed("ends early" if not first else f"no value before {first!r}")
        kept: list[str] = []
        if first not in '"{[':
            while (m := _SCALAR.match(self.buffer, self.at)).end() == len(self.buffer) and self.more():
                pass
            self.at = m.end() if m.end() <= len(self.buffer) else len(self.buffer)
            return m[0]
        depth, seen = 0, self.at
        while True:
            m = _TOKEN.search(self.buffer, seen)
            if m is None or m[0] == '"':  # the end of the buffer, or a string that goes on beyond it
                upto = m.start() if m else len(self.buffer)
                if keep:
                    kept.append(self.buffer[self.at : upto])
                self.at = upto
                if not self.more():
                    raise Malformed("ends early")
                seen = 0
                continue
            depth += {"{": 1, "[": 1, "}": -1, "]": -1}.get(m[0], 0)
            seen = m.end()
            if depth == 0:
                if keep:
                    kept.append(self.buffer[self.at : seen])
                self.at = seen
                return "".join(kept)


def members(text: _Text, path: Sequence[str] = ()) -> Iterator[tuple[str, str]]:
    """(key, JSON text) of the members of the object or array at a path of keys; an array's keys are its places.

    The path [] stands for the top, if that is an array.
    """
    first = text.peek()
    if list(path) == ["[]"]:
        if first != "[":
            raise Malformed(NOT_ARRAY if first else "empty")
        path = ()
    if path:
        if first != "{":
            raise Malformed(f"no {'.'.join(path)}")
        for key in _keys(text):
            if key == path[0]:
                yield from members(text, path[1:])
                return  # what follows isn't looked at
            text.value(keep=False)
        raise Malformed(f"no {'.'.join(path)}")
    if first == "{":
        for key in _keys(text):
            yield key, text.value()
    elif first == "[":
        text.take("[")
        place = 0
        while text.peek() != "]":
            if place:
                text.take(",")
            yield str(place), text.value()
            place += 1
        text.take("]")
    else:
        raise Malformed("empty" if not first else "neither object nor array")


def _keys(text: _Text) -> Iterator[str]:
    """The keys of an object, before each value, which the caller takes."""
    text.take("{")
    many = 0
    while text.peek() != "}":
        if many:
            text.take(",")
        if (found := text.peek()) != '"':
            raise Malformed("a key is missing" if found else "ends early")
        key = text.value()
        text.take(":")
        yield json.loads(key, strict=False)
        many += 1
    text.take("}")


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:/") else (pafs.LocalFileSystem(), uri)


def _files(uri: str) -> list[tuple[str, int]]:
    """Path and size of the files under a path, without those that start with a dot or underscore."""
    system, path = _opened(uri)
    info = system.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [info] if info.is_file else [x for x in system.get_file_info(pafs.FileSelector(path, recursive=True)) if x.is_file]
    return sorted((x.path, x.size) for x in found if x is info or not re.search(r"/[._]", x.path[len(path) :]))


@dataclass
class _File(InputPartition):
    path: str


class JsonMembers(DataSource):
    """Members of an object or array within JSON files, as (file, key, value, problem), one task a file.

    Options: path, a file or folder; at, the keys that lead there, with dots between (none: the top; []: the top, if it is an array). A value is JSON
    text, of which no more than one is held at a time. What is wrong with a file is a last row of it, with problem; what
    stood before that is given. Filters on key are taken to the files: other members are passed over.
    """

    @classmethod
    def name(cls) -> str:
        return "json_members"

    def schema(self) -> str:
        return "file string, key string, value string, problem string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _MembersReader(self.options["path"], [k for k in self.options.get("at", "").split(".") if k], int(self.options.get("chunk", CHUNK)))


class _MembersReader(DataSourceReader):
    def __init__(self, uri: str, at: list[str], chunk: int) -> None:
        self.uri, self.at, self.chunk, self.keys = uri, at, chunk, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("key",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keys = wanted if self.keys is None else self.keys & wanted
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [_File(path) for path, _ in _files(self.uri)] or [_File("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.path:
            return
        system, _ = _opened(self.uri)
        with system.open_input_stream(partition.path) as stream:
            try:
                text = _Text(stream, self.chunk)
                for key, value in members(text, self.at):
                    if self.keys is None or key in self.keys:
                        yield partition.path, key, value, None
                if self.at in ([], ["[]"]) and text.peek():
                    raise Malformed("more than one value")
            except Malformed as e:
                if self.keys is None:
                    yield partition.path, None, None, str(e)


class Sidecar(DataSource):
    """A sink of rows (id, entry), entry being JSON text, as files that hold one object {id: entry} each.

    Tasks write files of other names, which are renamed once all of them are whole; a write that fails leaves none.
    With mode overwrite the files that were there before go then.
    """

    @classmethod
    def name(cls) -> str:
        return "sidecar"

    def schema(self) -> str:
        return "id string, entry string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if [f.name for f in schema.fields] != ["id", "entry"]:
            raise ValueError("the columns must be id and entry")
        return _SidecarWriter(self.options["path"], overwrite)


@dataclass
class _Written(WriterCommitMessage):
    path: str
    rows: int


class _SidecarWriter(DataSourceWriter):
    def __init__(self, uri: str, overwrite: bool) -> None:
        self.uri, self.overwrite, self.job = uri, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        system, top = _opened(self.uri)
        system.create_dir(top, recursive=True)
        path, rows = f"{top}/_{self.job}-{uuid.uuid4().hex}.json", 0
        with system.open_output_stream(path) as out:
            out.write(b"{")
            for row in iterator:
                out.write(f"{',' if rows else ''}\n{json.dumps(row[0])}: {row[1] if row[1] is not None else 'null'}".encode())
                rows += 1
            out.write(b"\n}\n")
        return _Written(path, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, top = _opened(self.uri)
        old = [p for p, _ in _files(self.uri)] if self.overwrite else []
        for m in messages:
            if m is not None:
                if m.rows:
                    system.move(m.path, f"{top}/{m.path.rsplit('/_', 1)[1]}")
                else:
                    system.delete_file(m.path)
        for path in old:
            system.delete_file(path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, top = _opened(self.uri)
        for x in system.get_file_info(pafs.FileSelector(top, allow_not_found=True)):
            if f"/_{self.job}-" in x.path:
                system.delete_file(x.path)


class TextFiles(DataSource):
    """A sink of rows (path, content): each row is a UTF-8 file under the option path; a file that is there is replaced."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _TextFilesWriter(self.options["path"])


class _TextFilesWriter(DataSourceWriter):
    def __init__(self, uri: str) -> None:
        self.uri = uri

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        system, top = _opened(self.uri)
        for path, content in iterator:
            to = f"{top}/{path}"
            system.create_dir(to.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(to) as out:
                out.write((content or "").encode())
        return WriterCommitMessage()


def register(spark: SparkSession) -> None:
    """Makes json_members, sidecar and text_files known as formats, and lets filters be taken to Python sources in this session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (JsonMembers, Sidecar, TextFiles):
        spark.dataSource.register(source)


def json_members(spark: SparkSession, path: str, at: str = "") -> DataFrame:
    """(file, key, value, problem) of JSON files, see JsonMembers."""
    register(spark)
    return spark.read.format("json_members").option("path", path).option("at", at).load()


def read_sidecar(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """Entries of files of {id: entry}: id, the columns of the DDL entry, and problem for a file or an entry that isn't one."""
    rows = json_members(spark, path).withColumn("entry", F.from_json("value", entry))
    bad = F.coalesce("problem", F.when(F.col("value").isNotNull() & (F.col("entry").isNull() | ~F.col("value").startswith("{")), F.lit("entry")))
    return rows.select(F.col("key").alias("id"), "entry.*", bad.alias("problem"))


def write_sidecar(entries: DataFrame, path: str, overwrite: bool = True) -> None:
    """Write entries (id and other columns) as files of {id: entry}."""
    register(entries.sparkSession)
    rows = entries.select(F.col("id").cast("string").alias("id"), F.to_json(F.struct(*[c for c in entries.columns if c != "id"])).alias("entry"))
    rows.write.format("sidecar").option("path", path).mode("overwrite" if overwrite else "append").save()


def meeting_dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Meetings (file, id, title, date, transcript) of files that hold an array of them, and (file, key, problem) of what is wrong.

    A meeting needs id, title and transcript as strings; nothing is taken of a file in which one lacks any.
    """
    rows = json_members(spark, path, "[]")
    m = rows.where("problem is null").withColumn("m", F.from_json("value", "id string, title string, date string, transcript string"))
    quoted = lambda c: F.coalesce(F.get_json_object("value", f"$.{c}").isNotNull() & F.regexp_like("value", F.lit(rf'"{c}"\s*:\s*"')), F.lit(False))
    full = F.col("value").startswith("{") & quoted("id") & quoted("title") & quoted("transcript")
    bad = rows.where("problem is not null").select("file", "key", "problem").unionByName(m.where(~full).select("file", "key", F.lit("meeting").alias("problem")))
    return m.select("file", "m.*").join(bad.select("file").distinct(), "file", "left_anti"), bad


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Write labelled pairs as JSON lines, one file a task."""
    pairs.write.mode("overwrite").json(path)


def read_pairs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Labelled pairs of JSON lines, by a DDL schema, and _problem, the text of a line that isn't one."""
    return spark.read.schema(f"{schema}, _problem string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_problem").json(path)


_WHEN = "struct<dateTime:string>"
_DOCUMENT = f"id string, title string, type string, deleted_at string, created_at string, updated_at string, google_calendar_event struct<start:{_WHEN},end:{_WHEN}>"
_SEGMENTS = "array<struct<text:string,source:string,is_final:boolean,start_timestamp:string,end_timestamp:string>>"


def meeting_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Meetings of cache files {cache: {state: {documents: {id: ..}, transcripts: {id: [..]}}}}, and (file, key, problem) of what is wrong.

    The two maps are read apart and joined by file and key. Meetings have file, key, id, title, type, deleted_at, start
    (of the calendar, or when it was made), end (of the calendar, of the last segment that has one, or when it was last
    changed) and segments, null without a transcript. Nothing is taken of a file that isn't whole.
    """
    documents, transcripts = (json_members(spark, path, f"cache.state.{x}") for x in ("documents", "transcripts"))
    broken = documents.unionByName(transcripts).where("problem is not null").select("file", "problem")
    docs = documents.where("problem is null").withColumn("d", F.from_json("value", _DOCUMENT))
    odd = docs.where(~F.col("value").startswith("{") | F.col("d").isNull()).select("file", "key", F.lit("document").alias("problem"))
    said = transcripts.where("problem is null").select("file", "key", F.from_json("value", _SEGMENTS).alias("segments"))
    j = docs.where(F.col("value").startswith("{") & F.col("d").isNotNull()).join(said, ["file", "key"], "left").join(broken.select("file").distinct(), "file", "left_anti")
    time = lambda c: F.try_to_timestamp(c)
    ends = F.filter(F.transform(F.reverse(F.coalesce("segments", F.array().cast(_SEGMENTS))), lambda s: time(s["end_timestamp"])), lambda t: t.isNotNull())
    meetings = j.select(
        "file",
        "key",
        F.coalesce(F.nullif("d.id", F.lit("")), "key").alias("id"),
        F.coalesce(F.nullif("d.title", F.lit("")), F.lit("(untitled meeting)")).alias("title"),
        F.nullif("d.type", F.lit("")).alias("type"),
        F.nullif("d.deleted_at", F.lit("")).alias("deleted_at"),
        F.coalesce(time(F.col("d.google_calendar_event.start.dateTime")), time(F.col("d.created_at"))).alias("start"),
        F.coalesce(time(F.col("d.google_calendar_event.end.dateTime")), F.try_element_at(ends, F.lit(1)), time(F.col("d.updated_at"))).alias("end"),
        F.when(F.size("segments") > 0, F.col("segments")).alias("segments"),
    )
    return meetings, broken.distinct().select("file", F.lit(None).cast("string").alias("key"), "problem").unionByName(odd)


def importable_meetings(meetings: DataFrame, since: str | None = None) -> DataFrame:
    """Meetings that can be imported, with transcript: merged turns `source: text` joined by line feeds.

    Those go that are deleted, of another type, without a start or spoken text, or end at `since` or before.
    """
    live = meetings.where("deleted_at is null and coalesce(type, 'meeting') = 'meeting' and start is not null and segments is not null")
    if since is not None:
        live = live.where(F.col("end").isNull() | (F.col("end") > F.lit(since).cast("timestamp")))
    spoken = live.select(F.struct("file", "key").alias("meeting"), F.posexplode("segments").alias("ord", "s")).select("meeting", "ord", "s.source", "s.text", "s.is_final")
    turns = ingest.merge_speakers(spoken)
    line = F.concat_ws(": ", "source", "text")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n")
    said = turns.groupBy("meeting").agg(text.alias("transcript"), F.count("*").alias("turns"))
    return live.join(said, F.struct("file", "key") == F.col("meeting")).drop("meeting", "segments")


_HUDDLE = "channel_id string, channel_name string, message_ts string, team_id string, file_id string, canvas_markdown string, huddle_date string"
_MESSAGE = "text string, user string, username string, ts string, channel_id string, channel_name string"


def chat_dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Huddles of chat dumps in two shapes, and (file, key, problem) of what is wrong.

    A file is an array of huddles with their canvas, or an object of messages, an array, and canvases, a map from file id
    to Markdown. Of messages, a bot's recaps that link to a canvas of their file count. Huddles have file, channel_id,
    channel_name, message_ts, team_id, file_id, huddle_date and canvas_markdown. Nothing is taken of a file that isn't
    whole, or of an array with a huddle that lacks a text.
    """
    top, messages, canvases = (json_members(spark, path, at) for at in ("[]", "messages", "canvases"))
    objects = top.where(F.col("problem") == NOT_ARRAY).select("file")
    faults = messages.where("problem is not null").unionByName(canvases.where("problem is not null and problem <> 'no canvases'")).join(objects, "file", "left_semi")
    whole = top.where(F.col("problem") != NOT_ARRAY).unionByName(faults).select("file", F.lit(None).cast("string").alias("key"), "problem").distinct()

    h = top.where("problem is null").withColumn("h", F.from_json("value", _HUDDLE))
    need = ["channel_id", "channel_name", "message_ts", "team_id", "file_id", "canvas_markdown"]
    full = F.forall(F.array(*[F.col(f"h.{c}") for c in need]), lambda x: F.coalesce(F.length(x) > 0, F.lit(False)))
    lacking = h.where(F.col("h").isNull() | ~full).select("file", "key", F.lit("huddle").alias("problem"))
    bad = whole.unionByName(lacking)
    seconds = lambda ts: F.try_to_number(ts, F.lit("9999999999.999999"))
    date = lambda ts: F.date_format(F.when(seconds(ts) > 0, F.timestamp_seconds(seconds(ts))), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    listed = h.select("file", *[F.col(f"h.{c}").alias(c) for c in need], F.coalesce("h.huddle_date", date(F.col("h.message_ts"))).alias("huddle_date"))

    channel = F.from_json("value", "channel struct<id:string,name:string>")["channel"]
    plain = F.from_json("value", "channel string")["channel"]
    m = messages.where("problem is null").select("file", F.from_json("value", _MESSAGE).alias("m"), channel.alias("c"), plain.alias("n"))
    m = m.where(F.coalesce(rules.is_recap(F.col("m.text"), F.col("m.user"), F.col("m.username")), F.lit(False))).withColumn("ids", rules.canvas_ids(F.col("m.text"))).withColumn("file_id", F.col("ids.file"))
    text = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>")[0]
    pages = canvases.where(F.col("value").startswith('"')).select("file", F.col("key").alias("file_id"), text.alias("canvas_markdown"))
    none = F.lit("")
    name = F.when(F.col("c").isNotNull(), F.coalesce("c.name", none)).otherwise(F.coalesce("m.channel_name", none))
    ident = F.when(F.col("c").isNotNull(), F.coalesce("c.id", none)).otherwise(F.coalesce("m.channel_id", "n", none))
    linked = m.join(pages, ["file", "file_id"]).select("file", ident.alias("channel_id"), name.alias("channel_name"), F.coalesce("m.ts", none).alias("message_ts"), F.col("ids.team").alias("team_id"), "file_id", "canvas_markdown", date(F.col("m.ts")).alias("huddle_date"))
    return listed.unionByName(linked).join(bad.select("file").distinct(), "file", "left_anti"), bad


def markdown_tree(spark: SparkSession, roots: Sequence[str], flat: Sequence[str] = (), after: str | None = None) -> DataFrame:
    """Markdown files under roots, and right in the folders flat, one row a path: path, project (the root's name), size, modified, content.

    Spark lists and reads the files, from any store that it reads; dot folders and skipped ones are left out, and with
    after the files that didn't change after that time: content is read of those that are left.
    """
    found = None
    for root in [*roots, *flat]:
        top = root.rstrip("/")
        if not _exists(spark, top):
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(root in roots).lower()).option("pathGlobFilter", "*.md").load(top)
        inner = F.element_at(F.split("path", f"/{re.escape(top.rsplit('/', 1)[1])}/", 2), -1)
        files = files.where(ingest.importable(inner))
        if after is not None:
            files = files.where(F.col("modificationTime") > F.lit(after).cast("timestamp"))
        files = files.select("path", F.lit(top.rsplit("/", 1)[1]).alias("project"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("content"))
        found = files if found is None else found.unionByName(files)
    if found is None:
        return spark.createDataFrame([], "path string, project string, size long, modified timestamp, content string")
    return found.groupBy("path").agg(F.min_by(F.struct("project", "size", "modified", "content"), "project").alias("f")).select("path", "f.*")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
