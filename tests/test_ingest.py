"""The keyed ingest stream: restarts, duplicates, evictions and crashes give the memory that ranking all entries gives."""

import random

import pytest
from pyspark.sql.classic.dataframe import DataFrame

from ledgerloom.operators import memory
from ledgerloom.schema import LABELS
from ledgerloom.sources import events
from ledgerloom.streaming import ingest
from ledgerloom.streaming.ingest import DECISION, entries, ingest_events, ingest_stream, ingests

FIXTURE = "scenario_id string, pool string, " + ", ".join(f"{c} boolean" for c in LABELS)


@pytest.fixture(scope="module")
def fixtures(spark):
    """Forty scenarios, of which half are of one class, a few of pool B."""
    rows = [(f"S-{i}", "B" if i % 9 == 4 else "A", *(bool((i if i % 2 else 0) >> b & 1) for b in range(6))) for i in range(40)]
    return spark.createDataFrame(rows, FIXTURE)


def decisions(draw, first, n):
    return [(o, f"g{o}", f"S-{draw.randrange(45)}", draw.choice("AAAB"), draw.choice(["approve", "edit", "decline"]), f"text {o}", None if o % 3 else "why") for o in range(first, first + n)]


def ranked(spark, rows, fixtures):
    """The memory by ranking all entries ever added."""
    return memory.kept(memory.decisions_to_entries(spark.createDataFrame(rows, DECISION).distinct(), fixtures))


def same(spark, store, rows, fixtures):
    want = ranked(spark, rows, fixtures)
    got = entries(spark, store)
    assert {tuple(r) for r in got.select(sorted(want.columns)).collect()} == {tuple(r) for r in want.select(sorted(want.columns)).collect()}
    assert memory.state_hash(got) == memory.state_hash(want)


def test_restarts_duplicates_and_evictions(spark, fixtures, tmp_path):
    feed, store, check = (str(tmp_path / x) for x in ("feed", "store", "check"))
    draw, all_rows, at = random.Random(5), [], 0
    assert entries(spark, store).count() == 0
    for call, n in enumerate((60, 0, 80, 40)):
        rows = decisions(draw, at, n) + (draw.sample(all_rows, 25) if all_rows and n else [])  # some come again
        at += n
        if rows:
            draw.shuffle(rows)
            spark.createDataFrame(rows, DECISION).repartition(2).write.mode("append").parquet(feed)
        all_rows += rows
        ingest_stream(spark, feed, fixtures, store, check, files_per_batch=1 if call == 2 else None).awaitTermination()
        same(spark, store, all_rows, fixtures)
    told = ingests(spark, store).orderBy("batch").collect()
    entering = {r[0] for r in all_rows if r[3] == "A" and r[4] != "decline" and int(r[2][2:]) < 40 and int(r[2][2:]) % 9 != 4}
    assert sum(r.entries_added for r in told) == len(entering)
    assert sum(r.entries_refused for r in told) == sum(r[0] in entering for r in all_rows) - len(entering)
    assert sum(r.entries_added - r.entries_evicted for r in told) == entries(spark, store).count() < len(entering)
    assert sum(r.declined for r in told) == sum(r[3] == "A" and r[4] == "decline" for r in all_rows)
    assert max(r.consumed_through_offset for r in told) == at - 1
    assert told[-1].memory_state_hash == memory.state_hash(entries(spark, store))
    assert [r.problem for r in events.problems(ingest_events(spark, store, "run").selectExpr("batch as offset", "line")).collect()] == [None] * len(told)


def test_a_crash_after_writing_adds_nothing_twice(spark, fixtures, tmp_path, monkeypatch):
    feed, store, check = (str(tmp_path / x) for x in ("feed", "store", "check"))
    rows = decisions(random.Random(9), 0, 50)
    spark.createDataFrame(rows[:30], DECISION).coalesce(1).write.parquet(feed)
    ingest_stream(spark, feed, fixtures, store, check).awaitTermination()
    spark.createDataFrame(rows[30:], DECISION).coalesce(1).write.mode("append").parquet(feed)

    def broken(_):
        raise RuntimeError("lost")

    monkeypatch.setattr(ingest, "state_hash", broken)  # after the snapshot was written, before the batch is done
    with pytest.raises(Exception, match="lost"):
        ingest_stream(spark, feed, fixtures, store, check).awaitTermination()
    monkeypatch.undo()
    ingest_stream(spark, feed, fixtures, store, check).awaitTermination()
    same(spark, store, rows, fixtures)
    told = ingests(spark, store).collect()
    assert len(told) == 2 and sum(r.entries_added - r.entries_evicted for r in told) == entries(spark, store).count()


def test_a_store_is_small(spark):
    row = lambda i: (f"e{i}", "g", "s", "A", 1.0, "t", "edit", None, i, *[False] * 6)
    many = spark.createDataFrame([row(i) for i in range(193)], memory.STORE)
    for use in (memory.canonical, lambda m: memory.random_entries(spark.createDataFrame([("q",)], "query_id string"), m, 2, 1)):
        with pytest.raises(ValueError, match="store holds"):
            use(many)


def test_a_snapshot_is_not_one_task_of_all_partitions(spark, fixtures, tmp_path, monkeypatch):
    """What writes a snapshot's file reads finished rows; coalesced, it would also run all partitions of the join and hold their memory."""
    plans = []
    real = DataFrame.write.fget
    monkeypatch.setattr(DataFrame, "write", property(lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df)))
    feed, store, check = (str(tmp_path / x) for x in ("feed", "store", "check"))
    spark.createDataFrame(decisions(random.Random(7), 0, 40), DECISION).repartition(2).write.parquet(feed)
    ingest_stream(spark, feed, fixtures, store, check, files_per_batch=1).awaitTermination()
    joins = [p for p in plans if "Join LeftAnti" in p]
    assert joins and not any("Repartition 1, false" in p for p in joins)
