"""The event log as a table that many writers append to, and as a data source for batch and stream reads.

An append writes its rows under a name of its own, numbered from 0 in the order asked for. Then it
claims the offsets that follow the last committed ones by publishing a commit file that is named by
the first of them: only one writer can create that name, and the others look again and retry. So
offsets have no gap and no repeat, whoever writes at once; readers take only rows whose append is
committed, so a writer that is lost before that leaves nothing to be seen.

The rows of an append are numbered in parts, dealt by ranges of the order; the commit file has each
part's count. No task numbers a whole batch.

``event_log`` (EventLog) is the data source: a partition is a part of an append, a range of offsets.
Ranges before start_offset, or before an offset filter that Spark pushes down, aren't opened.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition
from pyspark.sql.types import StructType

from ledgerloom.schema import EVENT_TYPES, EVENT_VALUES, event_keys

COMMITS, DATA = "_commits", "data"
PARTS = 16
MOST_TRIES = 10_000
#: Rows that a task hands on at once.
BATCH = 4096
_DATA_SCHEMA = "part int, at long, event_type string, line string, append string"
_COMMIT_SCHEMA = "start long, rows long, append string, counts array<long>"


def _hadoop(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _publish(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file with its whole content, unless there is one; whether it was created.

    A hidden file is written first. It gets its name by a link on a local file system, and else by a
    rename, which must not replace a file, as on HDFS.
    """
    files, to = _hadoop(spark, path)
    hidden = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
    _, at = _hadoop(spark, hidden)
    out = files.create(at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if files.getUri().getScheme() != "file":
        done = files.rename(at, to)
    else:
        try:
            os.link(at.toUri().getPath(), to.toUri().getPath())
            done = True
        except FileExistsError:
            done = False
    files.delete(at, False)
    return done


def log_end(spark: SparkSession, log: str) -> int:
    """The offset that the next event gets: one more than the last committed."""
    files, folder = _hadoop(spark, f"{log}/{COMMITS}")
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    last = max((n for n in names if re.fullmatch(r"\d{20}\.json", n)), default=None)
    if last is None:
        return 0
    held = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(opened := files.open(_hadoop(spark, f"{log}/{COMMITS}/{last}")[1]), "UTF-8"))
    opened.close()
    return held["start"] + held["rows"]


def append_events(log: str, events: DataFrame, order: list[str], parts: int = PARTS) -> tuple[int, int]:
    """Append rows (event_type, line) in this order; the offsets they got, as (first, one past the last).

    Rows with equal order keys follow each other in any order. No rows, no commit. The rows are
    written once, before their offsets are claimed; the claim is one small file, tried again while others win.
    """
    spark = events.sparkSession
    name = uuid.uuid4().hex
    ranged = events.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    number = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    ranged.select("part", number.cast("long").alias("at"), "event_type", "line").write.parquet(f"{log}/{DATA}/append={name}")
    found = spark.read.schema("part int").parquet(f"{log}/{DATA}/append={name}").groupBy("part").count().collect()  # a row for each part
    counts = [0] * (max((r["part"] for r in found), default=-1) + 1)
    for r in found:
        counts[r["part"]] = r["count"]
    if not (rows := sum(counts)):
        return (end := log_end(spark, log)), end
    for _ in range(MOST_TRIES):
        start = log_end(spark, log)
        if _publish(spark, f"{log}/{COMMITS}/{start:020d}.json", json.dumps({"start": start, "rows": rows, "append": name, "counts": counts})):
            return start, start + rows
    raise RuntimeError(f"{MOST_TRIES} others committed first")


def read_log(spark: SparkSession, log: str, start_offset: int = 0) -> DataFrame:
    """offset, event_type, line of all committed events from an offset on, by Spark's own readers. No commits, no rows."""
    if not log_end(spark, log):
        return spark.createDataFrame([], "offset long, event_type string, line string")
    commits = spark.read.schema(_COMMIT_SCHEMA).json(f"{log}/{COMMITS}").where(F.col("start") + F.col("rows") > start_offset)
    before = F.expr("aggregate(slice(counts, 1, part), 0L, (a, c) -> a + c)")
    bases = commits.select("append", "start", "counts", F.posexplode("counts").alias("part", "n")).select("append", "part", (F.col("start") + before).alias("base"))
    rows = spark.read.schema(_DATA_SCHEMA).parquet(f"{log}/{DATA}").join(bases, ["append", "part"])
    return rows.select((F.col("base") + F.col("at")).alias("offset"), "event_type", "line").where(F.col("offset") >= start_offset)


def problem(line: str) -> str | None:
    """What is wrong with an event against the closed schema, null if nothing; as events.problems() tells it."""
    try:
        given = json.loads(line)
    except ValueError:
        given = None
    if not isinstance(given, dict):
        return "not a JSON object"
    kind = given.get("event_type")
    if kind not in EVENT_TYPES:
        return "unknown event type"
    keys = event_keys(kind)
    types = {"str": str, "int": int, "bool": bool, "list": list, "object": dict}
    right = lambda v, t: isinstance(v, types[t]) and isinstance(v, bool) == (t == "bool")
    told = (
        ("unknown keys: ", sorted(k for k in given if k not in keys)), ("missing keys: ", [k for k, (_, needed) in keys.items() if needed and k not in given]),
        ("wrong types: ", sorted(k for k, v in given.items() if k in keys and not right(v, keys[k][0]))),
        ("unknown values: ", sorted(f"{k}={v}" for k, v in given.items() if (kind, k) in EVENT_VALUES and v not in EVENT_VALUES[kind, k])),
    )
    return next((text + ", ".join(names) for text, names in told if names), None)


class Span(InputPartition):
    """A part of an append: the offsets from base on, of which those from start to before end are read."""

    def __init__(self, append: str, part: int, base: int, start: int, end: int):
        super().__init__((append, part))
        self.append, self.part, self.base, self.start, self.end = append, part, base, start, end


class _Log:
    """What batch and stream reads share."""

    def __init__(self, options: dict[str, str]):
        if not (path := options.get("path", "")):
            raise ValueError("event_log needs a path")
        self.path = path if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path) else os.path.abspath(path)
        self.start, self.mode = int(options.get("start_offset", 0)), options.get("mode", "failfast").lower()
        if self.mode not in ("failfast", "permissive"):
            raise ValueError("mode must be failfast or permissive")

    def files(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", self.path))

    def commits(self) -> list[dict]:
        """In order; raises if a range is missing."""
        files, at = self.files()
        found = files.get_file_info(pyarrow.fs.FileSelector(f"{at}/{COMMITS}", allow_not_found=True))
        names = sorted(f.path for f in found if re.fullmatch(r"\d{20}\.json", f.base_name))
        out, end = [], 0
        for name in names:
            with files.open_input_stream(name) as stream:
                out.append(json.loads(stream.readall()))
            if out[-1]["start"] != end:
                raise ValueError(f"no commit of offset {end}")
            end += out[-1]["rows"]
        return out

    def spans(self, start: int, end: int | None = None) -> list[Span]:
        out = []
        for commit in self.commits():
            base = commit["start"]
            for part, n in enumerate(commit["counts"]):
                low, high = max(start, base), base + n if end is None else min(end, base + n)
                if low < high:
                    out.append(Span(commit["append"], part, base, low, high))
                base += n
        return out

    def rows(self, span: Span) -> Iterator[tuple]:
        """offset, event_type, line, problem."""
        files, at = self.files()
        folder = f"{at}/{DATA}/append={span.append}"
        for info in files.get_file_info(pyarrow.fs.FileSelector(folder)):
            if not info.base_name.endswith(".parquet"):
                continue
            with files.open_input_file(info.path) as source:
                held = pyarrow.parquet.ParquetFile(source)
                groups = [g for g in range(held.num_row_groups) if _holds(held.metadata.row_group(g).column(0).statistics, span.part)]
                for batch in held.iter_batches(BATCH, groups) if groups else ():
                    for part, n, kind, line in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "event_type", "line")), strict=True):
                        offset = span.base + n
                        if part != span.part or not span.start <= offset < span.end:
                            continue
                        wrong = problem(line)
                        if wrong and self.mode == "failfast":
                            raise ValueError(f"event at offset {offset}: {wrong}")
                        yield offset, kind, line, wrong


def _holds(statistics, part: int) -> bool:
    """Whether a row group may have rows of a part."""
    return statistics is None or not statistics.has_min_max or statistics.min <= part <= statistics.max


class _Batch(DataSourceReader):
    def __init__(self, log: _Log):
        self.log, self.least, self.only = log, log.start, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Lower bounds of the offset are taken; other filters stay Spark's."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("offset",):
                self.least = max(self.least, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, EqualTo) and f.attribute == ("offset",):
                self.least, self.only = max(self.least, f.value), f.value
                yield f
            else:
                yield f

    def partitions(self) -> list[Span]:
        return self.log.spans(self.least, None if self.only is None else self.only + 1) or [Span("", 0, 0, 0, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        if partition.append:
            yield from self.log.rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, log: _Log):
        self.log = log

    def initialOffset(self) -> dict:  # noqa: N802
        return {"offset": self.log.start}

    def latestOffset(self) -> dict:  # noqa: N802
        commits = self.log.commits()
        return {"offset": max(self.log.start, commits[-1]["start"] + commits[-1]["rows"] if commits else 0)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return self.log.spans(start["offset"], end["offset"])

    def read(self, partition: Span) -> Iterator[tuple]:
        return self.log.rows(partition)


class EventLog(DataSource):
    """``event_log``: offset, event_type, line, problem of committed events.

    Options: path; start_offset (0); mode, failfast (a line that breaks the closed schema fails the
    query, with its offset) or permissive (it is a row with its problem). An append that isn't committed isn't
    seen. A stream takes up where its checkpoint ends.
    """

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return "offset long, event_type string, line string, problem string"

    def reader(self, schema: StructType) -> _Batch:
        return _Batch(_Log(self.options))

    def streamReader(self, schema: StructType) -> _Stream:  # noqa: N802
        return _Stream(_Log(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EventLog)
