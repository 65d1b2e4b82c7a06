"""Intermediate tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and the master is local a local folder is made; on a
cluster that would be another one on each machine, so there it is an error. Tables written here cut lineage, and outlive the loss of an executor.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="pageloom-")
    return _own_dir[app]


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none where it is not there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory()] if fs.exists(where) else []


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted at exit."""
    path = f"{shared_dir(spark)}/pageloom-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"

    def drop() -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            delete(spark, path)

    atexit.register(drop)
    return path


@contextlib.contextmanager
def shuffles_end_with_query(spark: SparkSession) -> Iterator[None]:
    """Queries inside leave no shuffle files behind: what they write is read from where they write it."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


class Stash:
    """A table written to the shared folder; ``df`` reads it, ``drop`` deletes it."""

    def __init__(self, spark: SparkSession, df: DataFrame, tag: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/pageloom-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"
        with shuffles_end_with_query(spark):
            df.write.option("compression", "zstd").parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        atexit.register(self.drop)

    def drop(self) -> None:
        """Call only when no plan that reads the table will run again. Called again at exit."""
        with contextlib.suppress(Exception):  # the session may be gone
            delete(self.spark, self.path)


def stash(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """df, written and read again; deleted at exit."""
    return Stash(spark, df, tag).df


def bounded_batches(spark: SparkSession, rows: int = 1000, mb: int = 16) -> None:
    """Hand Python at most so many rows and about so many MB of text at once; a session that has lower limits keeps them."""
    records, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(records, "0"))
    if now <= 0 or now > rows:
        spark.conf.set(records, str(rows))
    if spark.conf.get(size, "67108864b") == "67108864b":  # Spark's default
        spark.conf.set(size, f"{mb}m")
