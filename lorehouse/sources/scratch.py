"""Tables written into the folder that all executors share, to start later jobs from."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Paths written within each call of settled that is under way.
_WITHIN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one beside the warehouse of a local session.

    Raises ValueError on a cluster without the setting: a folder of the driver's machine is no use there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame, onto: DataFrame | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: later jobs start from the files, which outlive executors.

    With onto, a table that cut has given, the rows are added to its files, and the table read again has both.
    """
    path = f"{shared_dir(df.sparkSession)}/lorehouse/{uuid.uuid4().hex}" if onto is None else _PATHS.pop(onto)
    df.write.mode("append").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    if _WITHIN and path not in _WITHIN[-1]:
        _WITHIN[-1].append(path)
    return out


#: Rows of a table that is sent to all tasks, at most.
SENT_ROWS = 500_000


def sent(df: DataFrame) -> DataFrame:
    """df, to be sent to all tasks if it has no more than SENT_ROWS narrow rows, so that what it is joined to isn't shuffled; it is counted at once."""
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def folder(spark: SparkSession) -> str:
    """A path in the shared folder for files of one's own; within settled it is deleted like a written table."""
    path = f"{shared_dir(spark)}/lorehouse/{uuid.uuid4().hex}"
    if _WITHIN:
        _WITHIN[-1].append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that cut has given, once nothing reads them any more; other tables are let be."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            _delete(df.sparkSession, path)


def settled(plan: Callable[[], DataFrame]) -> DataFrame:
    """The result of plan, written; all other tables that were written for it are deleted, also if plan fails.

    For plans whose result reads tables that nobody else knows of.
    """
    _WITHIN.append([])
    spark, out = SparkSession.getActiveSession(), None
    try:
        lazy = plan()
        spark = lazy.sparkSession
        out = cut(lazy)
    finally:
        for path in _WITHIN.pop():
            if out is None or path != _PATHS[out]:
                _delete(spark, path)
        if out is not None and _WITHIN:
            _WITHIN[-1].append(_PATHS[out])
    return out
