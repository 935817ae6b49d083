"""The log under many writers, lost writers and readers of both kinds."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import events, log
from ledgerloom.sources.log import append_events, log_end, problem, read_log
from tests.test_state import event


def lines(spark, writer, n):
    rows = [("score", events.canonical(event("score", gen_id=f"{writer}-{i:04d}"))) for i in range(n)]
    return spark.createDataFrame(rows, "event_type string, line string").repartition(3)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """Eight writers at once, of different sizes, one of them without rows."""
    path = str(tmp_path_factory.mktemp("log") / "log")
    assert log_end(spark, path) == 0 and read_log(spark, path).count() == 0
    with ThreadPoolExecutor(8) as pool:
        spans = list(pool.map(lambda w: append_events(path, lines(spark, w, 10 * w), ["line"]), range(8)))
    return path, spans


def test_writers_at_once_leave_no_gap_and_no_repeat(spark, written):
    path, spans = written
    taken = sorted(s for s in spans if s[0] < s[1])
    assert taken[0][0] == 0 and all(a[1] == b[0] for a, b in zip(taken, taken[1:], strict=False)) and log_end(spark, path) == 280
    rows = read_log(spark, path).orderBy("offset").collect()
    assert [r.offset for r in rows] == list(range(280))
    for writer, (start, end) in enumerate(spans):
        assert [json.loads(r.line)["gen_id"] for r in rows[start:end]] == [f"{writer}-{i:04d}" for i in range(10 * writer)]  # in the order asked for
    assert [r.offset for r in read_log(spark, path, 200).orderBy("offset").collect()] == list(range(200, 280))


def test_a_lost_writer_leaves_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    append_events(path, lines(spark, 1, 5), ["line"])

    def lost(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(log, "_publish", lost)
    with pytest.raises(KeyboardInterrupt):
        append_events(path, lines(spark, 2, 5), ["line"])
    monkeypatch.undo()
    log.register(spark)
    assert read_log(spark, path).count() == 5 == spark.read.format("event_log").load(path).count()
    assert append_events(path, lines(spark, 3, 5), ["line"]) == (5, 10) and read_log(spark, path).count() == 10


def test_a_claim_that_another_wins_is_tried_again(spark, tmp_path, monkeypatch):
    path, real, once = str(tmp_path / "log"), log._publish, []

    def beaten(*given):
        if not once:
            once.append(1)
            append_events(path, lines(spark, 9, 3), ["line"])  # between reading the end and claiming it
        return real(*given)

    monkeypatch.setattr(log, "_publish", beaten)
    assert append_events(path, lines(spark, 1, 4), ["line"]) == (3, 7)
    assert not real(spark, f"{path}/_commits/{0:020d}.json", "{}")


def test_batch_and_stream_are_equal(spark, written, tmp_path):
    path, _ = written
    log.register(spark)
    want = {tuple(r) for r in read_log(spark, path).collect()}
    batch = spark.read.format("event_log").load(path)
    assert {tuple(r)[:3] for r in batch.collect()} == want and batch.where("problem is not null").count() == 0
    assert spark.read.format("event_log").option("start_offset", 250).load(path).agg(F.min("offset"), F.count("*")).first() == (250, 30)

    def stream(start=0):
        q = spark.readStream.format("event_log").option("start_offset", start).load(path).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(once=True)
        q.start(str(tmp_path / "out")).awaitTermination()
        return {tuple(r)[:3] for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    assert stream() == want
    append_events(path, lines(spark, "x", 7), ["line"])
    assert len(stream()) == len(want) + 7 and stream() == {tuple(r) for r in read_log(spark, path).collect()}


def test_offset_filters_prune_appends():
    reader = log._Batch(log._Log({"path": "/none"}))
    reader.log.commits = lambda: [{"start": 0, "rows": 50, "append": "a", "counts": [20, 30]}, {"start": 50, "rows": 10, "append": "b", "counts": [10]}]
    left = list(reader.pushFilters([log.GreaterThan(("offset",), 24), log.EqualTo(("event_type",), "score")]))
    assert left == [log.EqualTo(("event_type",), "score")]
    assert [(s.append, s.part, s.base, s.start, s.end) for s in reader.partitions()] == [("a", 1, 20, 25, 50), ("b", 0, 50, 50, 60)]
    assert list(reader.pushFilters([log.EqualTo(("offset",), 41)])) and [(s.append, s.start, s.end) for s in reader.partitions()] == [("a", 41, 42)]


def test_a_pushed_filter_gives_the_same_rows(spark, written):
    path, _ = written
    log.register(spark)
    rows = spark.read.format("event_log").load(path)
    for test in ("offset > 100", "offset >= 100 and offset < 120", "offset = 77", "offset > 270 and event_type = 'score'", "offset < 5"):
        assert {r.offset for r in rows.where(test).collect()} == {r.offset for r in read_log(spark, path).where(test).collect()}


BAD = [
    "{", "3", json.dumps({"event_type": "odd"}), json.dumps(event("score", odd=1)), json.dumps({k: v for k, v in event("score").items() if k != "stage"}),
    json.dumps(event("score", revision_count="2")), json.dumps(event("score", stage="last")), json.dumps(event("generation", is_first_pass=1)), json.dumps(event("score", revision_count=True)),
]


def test_bad_lines_and_torn_ones(spark, tmp_path):
    path = str(tmp_path / "log")
    log.register(spark)
    good = events.canonical(event("score", gen_id="é😀"))
    rows = [("score", x) for x in [good, *BAD, good[: len(good) // 2]]]
    append_events(path, spark.createDataFrame(rows, "event_type string, line string"), ["line"])
    found = spark.read.format("event_log").option("mode", "permissive").load(path)
    told = {r.line: r.problem for r in found.collect()}
    want = {r.line: r.problem for r in events.problems(read_log(spark, path)).collect()}
    assert told == want and sum(p is None for p in told.values()) == 1 and problem(good) is None
    with pytest.raises(Exception, match="event at offset"):
        spark.read.format("event_log").load(path).collect()
    with pytest.raises(Exception, match="failfast or permissive"):
        spark.read.format("event_log").option("mode", "odd").load(path).collect()


def test_a_missing_commit_is_an_error(tmp_path):
    (tmp_path / "_commits").mkdir()
    (tmp_path / "_commits" / f"{5:020d}.json").write_text(json.dumps({"start": 5, "rows": 1, "append": "a", "counts": [1]}))
    with pytest.raises(ValueError, match="no commit of offset 0"):
        log._Log({"path": str(tmp_path)}).commits()
