"""Tables written to the folder that all executors share, to cut a plan between rounds; they go when the session's JVM ends."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Removes a query's shuffle files when it has ended, instead of when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: For queries that work long on few bytes: shuffles feed all cores rather than partitions of 1 MB.
HEAVY = {"spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. If unset, a temporary one, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir()
    if hasattr(found, "isDefined"):
        found = found.get() if found.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return str(found).rstrip("/")


def saved(df: DataFrame, label: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor loses nothing.

    Shuffle files of the query that made it go at once, since nothing reads them again. settings hold
    for that query only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    settings = {_CLEANUP: "true", **(settings or {})}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    files, at = _files(spark, path)
    files.deleteOnExit(at)
    return out


def _files(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of a path, and the path there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def state_of(spark: SparkSession, paths: list[str]) -> str:
    """A hash of the names, sizes and times of all files under some paths."""
    told = hashlib.sha256()
    for path in paths:
        files, at = _files(spark, path)
        found, rows = files.listFiles(at, True), []
        while found.hasNext():
            one = found.next()
            rows.append(f"{one.getPath()}|{one.getLen()}|{one.getModificationTime()}")
        told.update("\n".join(sorted(rows)).encode())
    return told.hexdigest()[:16]


#: Tables of this process by what they were made of.
_MADE: dict[tuple[str, str, str], DataFrame] = {}


def bytes_of(spark: SparkSession, paths: list[str]) -> int:
    """The size of all files under some paths."""
    return sum(files.getContentSummary(at).getLength() for files, at in (_files(spark, path) for path in paths))


def saved_once(spark: SparkSession, paths: list[str], label: str, build: Callable[[], DataFrame], settings: dict[str, str] | None = None) -> DataFrame:
    """saved(build(), label, settings), or the table that this session wrote before from the very same files, if it is still there."""
    key = (spark.sparkContext.applicationId, label, state_of(spark, paths))
    held = _MADE.get(key)
    if held is not None:
        files, at = _files(spark, f"{held._saved_at}/_SUCCESS")
        if files.exists(at):
            return spark.read.schema(held.schema).parquet(held._saved_at)
    _MADE[key] = saved(build(), label, settings)
    return _MADE[key]


def forget(*frames: DataFrame) -> None:
    """Remove tables made by saved(), once all that was made of them is itself saved."""
    for df in frames:
        files, at = _files(df.sparkSession, df._saved_at)
        files.delete(at, True)
