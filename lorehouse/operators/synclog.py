"""What importers have done, as a keyed log of append-only parts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ingest

#: The form of the log's rows. A log of another form is set aside, and a new one is begun.
VERSION = 1

FILE = "path string, sha256 string, whole_doc_id string, claim_ids array<string>, partial boolean, last_error string, at timestamp"
DONE = "id string, at timestamp"


class SyncLog:
    """A log in a folder, v1/part-n-...: the last row of a key counts, and a part is there whole or not at all.

    Two forms: of files, by path, with what they became or the error that their last import met; and of ids (of meetings
    or chats) that are done, which holds no failures, so that what failed is asked for again.
    """

    def __init__(self, spark: SparkSession, path: str, files: bool = True) -> None:
        self.spark, self.top, self.schema, self.key = spark, path.rstrip("/"), (FILE if files else DONE), ("path" if files else "id")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.set_aside = self._put_aside()

    def _path(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}" if name else self.top)

    def _names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self._fs.exists(self._path(name)) else []

    def _put_aside(self) -> list[str]:
        """Folders of other versions get another name; gives these."""
        moved = []
        for name in self._names():
            if name.startswith("v") and name != f"v{VERSION}":
                moved.append(f"aside-{name}-{uuid.uuid4().hex}")
                self._fs.rename(self._path(name), self._path(moved[-1]))
        return moved

    def _parts(self) -> list[tuple[int, str]]:
        found = [n for n in self._names(f"v{VERSION}") if n.startswith("part-") and self._fs.exists(self._path(f"v{VERSION}/{n}/_SUCCESS"))]
        return sorted((int(n.split("-")[1]), n) for n in found)

    def rows(self) -> DataFrame:
        """The last row of each key."""
        parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/part-(\d+)-", 1).cast("int")
        all_ = self.spark.read.schema(self.schema).parquet(*[f"{self.top}/v{VERSION}/{n}" for _, n in parts]).select("*", number.alias("_part"))
        order = Window.partitionBy(self.key).orderBy(F.desc("_part"))
        return all_.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_part")

    def record(self, rows: DataFrame) -> None:
        """Append rows, of which one a key counts; columns that they don't have are null."""
        have = set(rows.columns)
        fields = [f.strip().split(" ", 1) for f in self.schema.split(", ")]
        out = rows.where(F.col(self.key).isNotNull()).select([(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in fields])
        n = max((n for n, _ in self._parts()), default=-1) + 1
        out.dropDuplicates([self.key]).write.parquet(f"{self.top}/v{VERSION}/part-{n}-{uuid.uuid4().hex}")

    def plan(self, files: DataFrame, force: bool = False) -> DataFrame:
        """(path, action) of files (path, sha256), see ingest.sync_plan; of ids (id) those that aren't done, as new."""
        if self.key == "path":
            return ingest.sync_plan(files, self.rows(), force)
        return files.select("id", F.lit("new").alias("action")) if force else files.join(self.rows().select("id"), "id", "left_anti").select("id", F.lit("new").alias("action"))

    def compact(self) -> None:
        """One part in place of all that are there; a break in between leaves parts too many, of which the later ones count."""
        parts = self._parts()
        if len(parts) > 1:
            self.record(self.rows())
            for _, name in parts:
                self._fs.delete(self._path(f"v{VERSION}/{name}"), True)


class Watermark:
    """How far an importer has come, in a folder: the greatest end of what it imported, and its last ids.

    Each advance writes a mark that is there whole or not at all; the last one counts, and one that can't be read counts
    as none. The end only moves forward.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 200) -> None:
        self.spark, self.top, self.keep = spark, path.rstrip("/"), keep

    def _marks(self) -> list[str]:
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.top)
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        found = [s.getPath() for s in fs.listStatus(top) if s.getPath().getName().startswith("mark-")]
        return sorted((str(p) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))), key=lambda p: int(p.rsplit("-", 1)[1]))

    def read(self) -> tuple[str | None, list[str]]:
        """The end, as ISO text in UTC, and the ids, oldest first."""
        marks = self._marks()
        if not marks:
            return None, []
        text = "\n".join(r["value"] for r in self.spark.read.text(marks[-1], wholetext=True).collect())
        try:
            mark = json.loads(text)
        except ValueError:
            return None, []
        if not isinstance(mark, dict):
            return None, []
        end, ids = mark.get("end"), mark.get("ids")
        return end if isinstance(end, str) else None, [x for x in ids if isinstance(x, str)] if isinstance(ids, list) else []

    def since(self, given: str | None = None) -> str | None:
        """The later of the mark and a time that is given."""
        end, _ = self.read()
        return max((x for x in (given, end) if x), default=None)

    def advance(self, imported: DataFrame) -> None:
        """Move on by what was imported (id, start, end), oldest first; rows without an end leave the end where it is."""
        end, ids = self.read()
        last = imported.agg(F.date_format(F.max("end"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
        new = [r["id"] for r in imported.orderBy(F.desc_nulls_last("start"), F.desc("id")).select("id").limit(self.keep).collect()][::-1]  # as many rows at most
        ids = [x for x in ids if x not in set(new)] + new
        mark = json.dumps({"end": max((x for x in (end, last) if x), default=None), "ids": ids[-self.keep :]})
        number = int(self._marks()[-1].rsplit("-", 1)[1]) + 1 if self._marks() else 0
        self.spark.createDataFrame([(mark,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.top}/mark-{number}")
