"""The store as one plan a batch: requests are checked, inferred, gated, routed and applied to a table of entry versions."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..functions.vectors import valid
from ..sources.scratch import cut, discard, sent
from . import gate
from .corrections import check_actions

#: Where an entry has to be flagged if it is there; the third store keeps no flags.
FLAGGED_STORES = ("graph", "mongodb")
DEFAULT_USER = "personal"

REQUEST = "id string, ord long, ts timestamp, content string, content_type string, source string, user_id string, confidence double, subject string, metadata map<string,string>, vec array<double>, action string, target_id string, reason string, skip_dedup boolean"
ENTRY = (
    "id string, ord long, ts timestamp, content string, content_type string, source string, user_id string, confidence double, subject string, metadata map<string,string>, "
    "tags array<string>, related_to array<string>, update_history array<struct<at:timestamp,reason:string>>, fingerprint string, targets array<string>, vec array<double>, "
    "flag string, flag_date timestamp, flag_note string, superseded_by string"
)
DECISION = "id string, ord long, status string, entry_id string, against string, sim double, kind string, stores array<string>, error string"


def _no_meta() -> Column:
    return F.create_map().cast("map<string,string>")


def prepared(requests: DataFrame, projects: dict[str, str], dims: int | None = None) -> DataFrame:
    """Requests with what they leave open, and without vectors that haven't dims finite components, where dims is given: type, source, confidence and tags inferred from the content, the default user, targets by routing, and error where an action lacks something."""
    inferred = rules.inference(F.col("content"), projects)
    r = check_actions(requests).withColumn("inferred", inferred)
    r = r.withColumn("content_type", F.coalesce("content_type", "inferred.content_type"))
    r = r.withColumns(
        {
            "source": F.coalesce("source", rules.inferred_source(F.col("inferred.project"), F.col("content_type"))),
            "user_id": F.coalesce("user_id", F.lit(DEFAULT_USER)),
            "given": F.col("confidence"),
            "confidence": rules.inferred_confidence(F.col("confidence"), F.col("inferred.confidence")),
            "tags": F.col("inferred.tags"),
            "metadata": F.coalesce("metadata", _no_meta()),
            "vec": F.when(valid(F.col("vec"), dims), F.col("vec")) if dims else F.col("vec"),
        }
    )
    r = r.withColumn("targets", rules.storage_targets(F.col("content"), F.col("content_type"), F.col("source")))
    plain = F.col("action").isNull()
    return r.withColumns({"forced": F.when(plain, F.coalesce("skip_dedup", F.lit(False))).otherwise(F.col("action").isin("complement", "force-new", "supersede"))}).drop("inferred")


def _timeline(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """What the gate holds new entries against: each existing entry as it is before, between and after the batch's changes to it.

    changes has target_id, ord, action, content, subject and vec, one row a change. Entries without changes are one row
    that always counts; of a changed one each state counts from its change until the next; a superseded one never again.
    Rows have their fingerprint in place of the content, so that no content of an entry without changes is read.
    """
    columns = ["id", "ord", "content", "content_type", "user_id", "subject", "flag", "vec"]
    touched = sent(changes.select(F.col("target_id").alias("id")).distinct())
    lean = [c if c != "content" else "fingerprint" for c in columns]
    still = entries.join(touched, "id", "left_anti").select(*lean, F.lit(None).cast("long").alias("born"), F.lit(None).cast("long").alias("died"), F.col("id").alias("entry_id"))
    hit = entries.join(touched, "id", "left_semi").select(*columns)
    first = hit.withColumns({"born": F.lit(None).cast("long"), "gone": F.col("flag").isNotNull(), "updated": F.lit(True)})
    step = changes.select(F.col("target_id").alias("id"), F.col("ord").alias("born"), F.col("content").alias("c"), F.col("subject").alias("s"), F.col("vec").alias("v"), (F.col("action") == "supersede").alias("gone"), (F.col("action") == "update").alias("updated"))
    later = step.join(hit, "id").select("id", "ord", F.when(F.col("updated"), F.col("c")).alias("content"), "content_type", "user_id", F.when(F.col("updated"), F.col("s")).alias("subject"), "flag", F.when(F.col("updated"), F.col("v")).alias("vec"), "born", "gone", "updated")
    w = Window.partitionBy("id").orderBy(F.asc_nulls_first("born"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = first.unionByName(later).withColumns(
        {
            "content": F.last("content", ignorenulls=True).over(upto),
            "subject": F.last("subject", ignorenulls=True).over(upto),
            "vec": F.last(F.when(F.col("updated"), F.struct("vec")), ignorenulls=True).over(upto)["vec"],
            "gone": F.max("gone").over(upto),
            "died": F.lead("born").over(w),
        }
    )
    version = F.concat_ws("#", "id", "born")
    return still.unionByName(rows.where("not gone").withColumn("fingerprint", _fingerprint()).select(version.alias("id"), *lean[1:], "born", "died", F.col("id").alias("entry_id")))


def decide(entries: DataFrame, requests: DataFrame, keys: Sequence[str] = ("content_type",), refuse: float | None = None, confirm: float | None = None, down: Sequence[str] = ()) -> DataFrame:
    """A row a request (DECISION), in their order as if they came one by one: what becomes of it, and why.

    status is stored, dedup_required, invalid_action, superseded, updated or failed. entry_id is the entry that the
    request made or changed; against and sim the entry it is too like, kind the band (exact, refuse or confirm); stores
    are those it was written to. An action's target has to be in the store before the batch. Superseding needs the
    target in a store that keeps flags, and all such stores that have it up (not in down): otherwise it fails and
    nothing of it is written. An update of what isn't there fails.
    """
    aims = sent(requests.where("target_id is not null").select(F.col("target_id").alias("id")).distinct())
    asked = requests.join(sent(entries.join(aims, "id", "left_semi").select(F.col("id").alias("target_id"), F.col("targets").alias("there"))), "target_id", "left")
    flagged = F.filter("there", lambda t: t.isin(*FLAGGED_STORES))
    up = lambda stores: F.filter(stores, lambda t: ~t.isin(*down)) if down else stores
    lost = F.array_intersect(flagged, F.array(*map(F.lit, down)).cast("array<string>"))
    missing = F.coalesce(F.size(flagged) == 0, F.lit(True))
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when((F.col("action") == "supersede") & missing, F.concat(F.lit("not found: "), "target_id"))
        .when((F.col("action") == "supersede") & (F.size(lost) > 0), F.concat(F.lit("not flagged in "), F.array_join(lost, ", ")))
        .when((F.col("action") == "update") & F.col("there").isNull(), F.concat(F.lit("not found: "), "target_id"))
    )
    asked = cut(asked.withColumns({"fails": error, "flagged": flagged}))
    good = asked.where("fails is null")
    new = good.where("action is null or action <> 'update'").withColumn("flag", F.lit(None).cast("string"))
    if new.where("not forced").isEmpty():  # forced ones are held against none
        gated = new.select("id", F.lit("pass").alias("decision"), F.lit(None).cast("string").alias("against"), F.lit(None).cast("double").alias("sim"))
    else:
        lines = cut(_timeline(entries, good.where("action in ('supersede', 'update')").select("target_id", "ord", "action", "content", "subject", "vec")))
        gated = gate.decide(new, lines, list(keys), refuse, confirm)
        names = lines.where("id <> entry_id").select(F.col("id").alias("against"), "entry_id")
        gated = gated.join(names, "against", "left").select("id", "decision", F.coalesce("entry_id", "against").alias("against"), "sim")
    j = asked.join(gated, "id", "left")
    passed = F.col("decision") == "pass"
    status = (
        F.when(F.col("error").isNotNull(), "invalid_action")
        .when(F.col("fails").isNotNull(), "failed")
        .when(F.col("action") == "update", "updated")
        .when(F.col("action") == "supersede", "superseded")
        .when(passed, "stored")
        .otherwise("dedup_required")
    )
    entry = F.when(status == "updated", F.col("target_id")).when(status.isin("stored", "superseded"), F.col("id"))
    stores = F.when(status == "updated", up(F.col("there"))).when(status.isin("stored", "superseded"), up(F.col("targets")))
    refused = status == "dedup_required"
    return j.select("id", "ord", status.alias("status"), entry.alias("entry_id"), F.when(refused, F.col("against")).alias("against"), "sim", F.when(refused, F.col("decision")).alias("kind"), stores.alias("stores"), F.col("fails").alias("error"))


def _fingerprint() -> Column:
    return T.fingerprint(F.col("content"), F.col("user_id"), F.col("content_type"), F.col("subject"))


def made(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """The new entries (ENTRY) of requests that were stored or supersede, with the links and reasons of their actions in their metadata."""
    r = requests.join(decisions.where("status in ('stored', 'superseded')").select("id"), "id")
    action = F.col("action")
    notes = (
        F.when(action == "supersede", F.create_map(F.lit("supersedes"), F.col("target_id"), F.lit("supersede_reason"), F.col("reason")))
        .when(action == "force-new", F.create_map(F.lit("force_new_reason"), F.col("reason")))
        .otherwise(_no_meta())
    )
    kept = F.map_filter("metadata", lambda k, v: ~F.array_contains(F.map_keys(notes), k))
    none = F.lit(None)
    return r.select(
        *("id", "ord", "ts", "content", "content_type", "source", "user_id", "confidence", "subject"),
        F.map_concat(kept, notes).alias("metadata"),
        "tags",
        F.when(action == "complement", F.array("target_id")).otherwise(F.array().cast("array<string>")).alias("related_to"),
        F.array().cast("array<struct<at:timestamp,reason:string>>").alias("update_history"),
        _fingerprint().alias("fingerprint"),
        *("targets", "vec"),
        *(none.cast(kind).alias(c) for c, kind in (("flag", "string"), ("flag_date", "timestamp"), ("flag_note", "string"), ("superseded_by", "string"))),
    )


def changed(entries: DataFrame, requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """Entries (ENTRY) that requests have updated or superseded, after all of these.

    Of several updates the last given value counts for each column and for each key of the metadata; the history gains
    their reasons in order; the fingerprint follows content and subject. Of several that supersede the last counts.
    """
    acts = requests.join(decisions.where("status in ('updated', 'superseded')").select("id", "status"), "id").where("target_id is not null and action in ('update', 'supersede')")
    ups = acts.where("status = 'updated'")
    last = lambda c, name: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(name)
    notes = F.transform(F.array_sort(F.collect_list(F.struct("ord", "ts", "reason"))), lambda x: F.struct(x["ts"].alias("at"), x["reason"].alias("reason")))
    u = ups.groupBy("target_id").agg(last("content", "u_content"), last("given", "u_confidence"), last("subject", "u_subject"), F.max_by("vec", "ord").alias("u_vec"), F.max("ts").alias("u_ts"), notes.alias("notes"))
    pairs = ups.select("target_id", "ord", F.explode("metadata").alias("k", "v")).groupBy("target_id", "k").agg(F.max_by("v", "ord").alias("v"))
    meta = pairs.groupBy("target_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("u_meta"))
    s = acts.where("status = 'superseded'").groupBy("target_id").agg(F.max_by(F.struct("id", "ts", "reason"), "ord").alias("s"))
    touched = sent(acts.select(F.col("target_id").alias("id")).distinct())
    j = entries.join(touched, "id", "left_semi").join(u.withColumnRenamed("target_id", "id").withColumn("up", F.lit(True)), "id", "left").join(meta.withColumnRenamed("target_id", "id"), "id", "left").join(s.withColumnRenamed("target_id", "id"), "id", "left")
    j = j.where("up or s is not null")
    up, gone = F.coalesce("up", F.lit(False)), F.col("s").isNotNull()
    more = F.coalesce("u_meta", _no_meta())
    over = F.map_filter("metadata", lambda k, v: ~F.array_contains(F.map_keys(more), k))
    j = j.withColumns(
        {
            "content": F.coalesce("u_content", "content"),
            "confidence": F.coalesce("u_confidence", "confidence"),
            "subject": F.coalesce("u_subject", "subject"),
            "vec": F.when(up, F.col("u_vec")).otherwise(F.col("vec")),
            "ts": F.coalesce("u_ts", "ts"),
            "metadata": F.map_concat(over, more),
            "update_history": F.when(up, F.concat("update_history", "notes")).otherwise(F.col("update_history")),
            "flag": F.when(gone, "SUPERSEDED").otherwise(F.col("flag")),
            "flag_date": F.when(gone, F.col("s.ts")).otherwise(F.col("flag_date")),
            "flag_note": F.when(gone, F.col("s.reason")).otherwise(F.col("flag_note")),
            "superseded_by": F.when(gone, F.col("s.id")).otherwise(F.col("superseded_by")),
        }
    )
    return j.withColumn("fingerprint", F.when(up, _fingerprint()).otherwise(F.col("fingerprint"))).select(_names(ENTRY))


def _names(ddl: str) -> list[str]:
    return [f"`{f.name}`" for f in _schema(ddl).fields]


@functools.cache
def _schema(ddl: str):  # noqa: ANN202
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


class Store:
    """A store in a folder: versions/batch=n has the entries that batch n made or changed, decisions/batch=n a row a request.

    A batch reads what the batches before it have written and replaces its own folders, so running it again, also after
    it broke off half-way, changes nothing. snapshots/upto=n has the entries as they are after batch n; a read starts
    from the latest snapshot that was written whole.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = ("content_type",), refuse: float | None = None, confirm: float | None = None, down: Sequence[str] = (), projects: dict[str, str] | None = None, dims: int | None = None) -> None:
        self.spark, self.path, self.keys, self.refuse, self.confirm, self.down, self.projects, self.dims = spark, path.rstrip("/"), keys, refuse, confirm, down, projects or {}, dims

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the folders that were written whole."""
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        folders = [s.getPath() for s in fs.listStatus(top) if s.isDirectory() and "=" in s.getPath().getName()]
        return sorted(int(p.getName().partition("=")[2]) for p in folders if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _read(self, kind: str, name: str, numbers: list[int], ddl: str) -> DataFrame:
        schema = _schema(ddl)
        if not numbers:
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
        parts = [f"{self.path}/{kind}/{name}={n}" for n in numbers]
        number = F.regexp_extract(F.col("_metadata.file_path"), rf"/{name}=(\d+)/", 1).cast("long")
        return self.spark.read.schema(schema).parquet(*parts).select("*", number.alias("batch"))

    def entries(self, before: int | None = None) -> DataFrame:
        """Entries as they are after all batches below `before`, or after all: the last version of each."""
        snaps = [n for n in self._numbers("snapshots") if before is None or n < before]
        start = snaps[-1:] or []
        batches = [n for n in self._numbers("versions") if (before is None or n < before) and (not start or n > start[0])]
        rows = self._read("versions", "batch", batches, ENTRY)
        if start:
            rows = self._read("snapshots", "upto", start, ENTRY).unionByName(rows)
        if len(start) + len(batches) < 2:
            return rows.drop("batch")
        several = rows.groupBy("id").agg(F.max("batch").alias("last"), F.min("batch").alias("first")).where("first < last")
        several = sent(several.select(F.col("id").alias("several"), "last"))  # ids alone are shuffled
        return rows.join(several, (F.col("id") == F.col("several")) & (F.col("batch") < F.col("last")), "left_anti").drop("batch")

    def decisions(self) -> DataFrame:
        """DECISION of all batches, and batch."""
        return self._read("decisions", "batch", self._numbers("decisions"), DECISION)

    def load(self, entries: DataFrame, batch: int = 0) -> None:
        """Entries as they are, as a batch of their own; columns of ENTRY that they don't have are null, and the fingerprint is computed."""
        have = set(entries.columns)
        empty = {"metadata": _no_meta(), "update_history": F.array().cast("array<struct<at:timestamp,reason:string>>"), "related_to": F.array().cast("array<string>"), "tags": F.array().cast("array<string>")}
        rows = entries.withColumns({f.name: empty.get(f.name, F.lit(None)).cast(f.dataType) for f in _schema(ENTRY).fields if f.name not in have})
        rows = rows.withColumns({"fingerprint": _fingerprint(), "targets": F.coalesce("targets", rules.storage_targets(F.col("content"), F.col("content_type"), F.col("source")))})
        self._write(rows.select(_names(ENTRY)), f"versions/batch={batch}")

    def _write(self, rows: DataFrame, part: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{part}")

    def apply(self, requests: DataFrame, batch: int) -> None:
        """Decide on a batch of requests (REQUEST, ids unique) and write what it makes and changes; the same batch again replaces itself."""
        entries = self.entries(batch)
        asked = cut(prepared(requests, self.projects, self.dims))
        decisions = decide(entries, asked, self.keys, self.refuse, self.confirm, self.down)
        self._write(decisions.select(_names(DECISION)), f"decisions/batch={batch}")
        done = self._read("decisions", "batch", [batch], DECISION)
        self._write(made(asked, done).select(_names(ENTRY)).unionByName(changed(entries, asked, done)), f"versions/batch={batch}")
        discard(asked)

    def compact(self, upto: int) -> None:
        """Write the entries as they are after batch `upto`, which reads then start from."""
        self._write(self.entries(upto + 1), f"snapshots/upto={upto}")

    def follow(self, stream: DataFrame, state: str):  # noqa: ANN201
        """Apply a stream of requests batch by batch, with progress in the folder `state`; batch n of the stream is batch n + 1 of the store, as 0 is what was loaded."""
        return stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda df, n: self.apply(df, n + 1)).start()


def links(entries: DataFrame, decisions: DataFrame) -> DataFrame:
    """(src, dst, type) that the decisions made: SUPERSEDES from the new entry, RELATED_TO from one that complements another."""
    e = entries.join(decisions.where("status in ('stored', 'superseded')").select(F.col("entry_id").alias("id")), "id")
    old = e.where(F.col("metadata").getItem("supersedes").isNotNull()).select(F.col("id").alias("src"), F.col("metadata").getItem("supersedes").alias("dst"), F.lit("SUPERSEDES").alias("type"))
    near = e.select(F.col("id").alias("src"), F.explode("related_to").alias("dst"), F.lit("RELATED_TO").alias("type"))
    return old.unionByName(near)
