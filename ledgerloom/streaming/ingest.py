"""Incremental ingest of human decisions into a bounded memory, as a stream with keyed state.

A key is a part of a class: entries are dealt to PARTS parts by their id, so a class that has a third
of all decisions is PARTS tasks' work. The state of a key is its best entries, at most as many as the
cap, and the ids it has seen; both are in the state store, so nothing is ranked again. A batch gives a
row for each key that it touched, and the sink turns these into the next snapshot: the last row of
every key, 65 x PARTS at most, whatever was ever ingested. A batch that is run again after a crash
starts from the state and the snapshot before it and replaces its own files, so it adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerloom.operators.memory import CAP, STORE, WEIGHTS, class_key, state_hash
from ledgerloom.schema import LABELS

DECISION = "offset long, gen_id string, scenario_id string, pool string, action string, final_text string, reason string"
PARTS = 16
_COUNTS = ("added", "refused", "declined")
_CHANGED = f"class_key string, part int, consumed_through_offset long, {', '.join(f'{c} long' for c in _COUNTS)}, best array<struct<{STORE.replace(' ', ':').replace(',:', ',')}>>"
_FIELDS = tuple(c.split()[0] for c in STORE.split(", "))
_OFFSET = _FIELDS.index("ingested_offset")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Best(StatefulProcessor):
    """Keeps a key's last entries by offset, then id; an id that was seen before is refused."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getListState("best", STORE)
        self.seen = handle.getMapState("seen", "entry_id string", "offset long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        best = {r[0]: tuple(r) for r in self.best.get()}
        at, counts = -1, dict.fromkeys(_COUNTS, 0)
        for row in rows:
            at = max(at, row.offset)
            if row.kind != "added":
                counts["declined"] += row.kind == "declined"
                continue
            entry = tuple(row.entry[c] for c in _FIELDS)
            if self.seen.containsKey((entry[0],)):
                counts["refused"] += 1
                continue
            counts["added"] += 1
            self.seen.updateValue((entry[0],), (row.offset,))
            best[entry[0]] = entry
            if len(best) > self.cap:
                del best[min(best, key=lambda i: (best[i][_OFFSET], i))]
        if best:
            self.best.put(list(best.values()))
        yield Row(class_key=key[0], part=key[1], consumed_through_offset=at, **counts, best=[dict(zip(_FIELDS, e, strict=True)) for e in best.values()])

    def close(self) -> None:
        pass


def _keyed(decisions: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Decisions as class_key, part, offset, kind (added, declined or other) and the entry that an added one becomes."""
    known = fixtures.where("pool = 'A'").select("scenario_id", F.lit(True).alias("known"), *LABELS)
    rows = decisions.join(known, "scenario_id", "left")
    enters = F.coalesce((F.col("pool") == "A") & F.col("action").isin(*WEIGHTS) & F.col("known"), F.lit(False))
    declined = F.coalesce((F.col("pool") == "A") & (F.col("action") == "decline"), F.lit(False))
    kind = F.when(enters, "added").when(declined, "declined").otherwise("other")
    id = F.concat(F.lit("mem-"), F.lpad(F.col("offset").cast("string"), 6, "0"))
    values = {"entry_id": id, "source_gen_id": F.col("gen_id"), "weight": F.when(F.col("action") == "edit", WEIGHTS["edit"]).otherwise(WEIGHTS["approve"]), "human_action": F.col("action"), "note": F.col("reason"), "ingested_offset": F.col("offset")}
    entry = F.struct(*(values.get(name, F.col(name)).cast(type_).alias(name) for name, type_ in (c.split() for c in STORE.split(", "))))
    return rows.select(F.when(enters, class_key()).otherwise("").alias("class_key"), F.pmod(F.xxhash64("offset"), F.lit(PARTS)).cast("int").alias("part"), "offset", kind.alias("kind"), F.when(enters, entry).alias("entry"))


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """The batches that have a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(f.getPath().getName().removeprefix("batch=")) for f in files.listStatus(path)) if files.exists(path) else []


def _stored(snapshot: DataFrame, cap: int) -> DataFrame:
    """The entries of a snapshot: of each class the last ``cap``."""
    rows = snapshot.select("class_key", F.inline("best"))
    last = Window.partitionBy("class_key").orderBy(F.desc("ingested_offset"), F.desc("entry_id"))
    return rows.withColumn("__n", F.row_number().over(last)).where(F.col("__n") <= cap).drop("__n")


def ingest_stream(spark: SparkSession, decisions: str, fixtures: DataFrame, store: str, checkpoint: str, cap: int = CAP, files_per_batch: int | None = None) -> StreamingQuery:
    """Consume a folder of human_decision rows (Parquet) that are new since the last call, then stop.

    Entries are decisions of pool A, by the event and by the fixture, that weren't declined; an id
    counts once. store/snapshot/batch=n has the memory after a batch (see ``entries``); store/ingests
    has a row for each batch: consumed_through_offset, entries_added, entries_refused (ids seen
    before), entries_evicted, declined, memory_state_hash. Only the last two snapshots are read again;
    older ones are history. A batch without rows leaves none. Needs the RocksDB state store, which is set on the session.
    """
    if spark.conf.get(_PROVIDER, "") != _ROCKS:
        spark.conf.set(_PROVIDER, _ROCKS)
    reader = spark.readStream.schema(DECISION)
    rows = (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(decisions)
    changed = _keyed(rows, fixtures).groupBy("class_key", "part").transformWithState(_Best(cap), _CHANGED, "Append", "None")

    def write(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            before = [b for b in _batches(spark, f"{store}/snapshot") if b < n]
            old = spark.read.schema(_CHANGED).parquet(f"{store}/snapshot/batch={before[-1]}") if before else spark.createDataFrame([], _CHANGED)
            # One file by a shuffle: coalesced, a single task would run, and hold the memory of, every partition of the join.
            batch.unionByName(old.join(batch.select("class_key", "part"), ["class_key", "part"], "left_anti")).repartition(1).write.mode("overwrite").parquet(f"{store}/snapshot/batch={n}")
            held, now = _stored(old, cap), _stored(spark.read.schema(_CHANGED).parquet(f"{store}/snapshot/batch={n}"), cap)
            told = batch.agg(F.max("consumed_through_offset").alias("at"), *(F.sum(c).alias(c) for c in _COUNTS)).first()
            if told["at"] is None:
                return
            row = (told["at"], told["added"], told["refused"], held.count() + told["added"] - now.count(), told["declined"], state_hash(now))
            kind = "consumed_through_offset long, entries_added long, entries_refused long, entries_evicted long, declined long, memory_state_hash string"
            spark.createDataFrame([row], kind).coalesce(1).write.mode("overwrite").parquet(f"{store}/ingests/batch={n}")
        finally:
            batch.unpersist()

    return changed.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def entries(spark: SparkSession, store: str, cap: int = CAP) -> DataFrame:
    """The memory as it is now, with class_key: what memory.kept() gives for all entries ever added. Empty before the first batch."""
    found = _batches(spark, f"{store}/snapshot")
    return _stored(spark.read.schema(_CHANGED).parquet(f"{store}/snapshot/batch={found[-1]}") if found else spark.createDataFrame([], _CHANGED), cap)


def ingests(spark: SparkSession, store: str) -> DataFrame:
    """A row for each batch: its number, counts and the hash of the memory after it."""
    return spark.read.option("basePath", f"{store}/ingests").parquet(f"{store}/ingests")


def ingest_events(spark: SparkSession, store: str, run_id: str) -> DataFrame:
    """event_type, line: an event of the log for each batch, in its closed schema."""
    line = F.to_json(F.struct("consumed_through_offset", "entries_added", "entries_evicted", F.lit("ingest").alias("event_type"), "memory_state_hash", F.lit(run_id).alias("run_id")))
    return ingests(spark, store).select(F.col("batch").cast("long").alias("batch"), F.lit("ingest").alias("event_type"), line.alias("line"))
