"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: A local session's own folder where ``spark.checkpoint.dir`` is unset, by application.
_OWN: dict[str, str] = {}
#: Folders written and not yet deleted, with the session that wrote them.
_WRITTEN: dict[str, SparkSession] = {}
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a session on one machine gets a folder of its own; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    application = spark.sparkContext.applicationId
    if application not in _OWN:
        _OWN[application] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _OWN[application]


def new_folder(spark: SparkSession) -> str:
    """The name of a new folder in the shared one, deleted when the session's program ends."""
    at = f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"
    _WRITTEN[at] = spark
    return at


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme: one without is in the session's own file system, as for Spark's readers and writers."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def bytes_at(spark: SparkSession, path: str) -> int:
    """The bytes of all files at or below a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def paths_like(spark: SparkSession, pattern: str) -> list[str]:
    """The existing paths that a glob pattern names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return sorted(s.getPath().toString() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or [])


#: Spark's setting by which a query's shuffle files go when it ends, not when the driver's heap is next collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind: later jobs read what was written."""
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, was)


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later jobs start from the files, not from its lineage.

    Rows are kept apart by columns of few values, if there are any, so that what asks for one value reads no others.
    """
    at = new_folder(df.sparkSession)
    write = df.write.option("compression", "zstd")
    with passing(df.sparkSession):
        (write.partitionBy(*by) if by else write).parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    _FOLDERS[out] = at
    return out


def delete_folder(at: str) -> None:
    """Delete a folder that ``new_folder`` named."""
    spark = _WRITTEN.pop(at, None)
    if spark is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete what ``stored`` wrote for these tables. Nothing that is still to be computed may read them."""
    for df in tables:
        if df is not None and df in _FOLDERS:
            delete_folder(_FOLDERS.pop(df))


@atexit.register
def _clear() -> None:
    for at in list(_WRITTEN):
        try:
            delete_folder(at)
        except Exception:  # the JVM has gone before us: the folder stays, as after a killed program
            return
