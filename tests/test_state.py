"""Statistics, memory, the event log, fixtures, the ingest stream, reports and lookups."""

import json
import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ledger, memory, render, reports, stats
from ledgerloom.plans import recovery, rounds
from ledgerloom.schema import EVENT_TYPES, EVENT_VALUES, LABELS, event_keys
from ledgerloom.sources import events, fixtures
from ledgerloom.sources.tables import order_ledger
from ledgerloom.streaming.ingest import entries, ingest_stream

from .conftest import SMALL


def ratings(spark, pairs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a int, b int")


def test_kappas_by_hand(spark):
    pairs = [(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15
    row = stats.cohen_kappa(ratings(spark, pairs), "a", "b").first()
    assert (row.n, row.raw_agreement, row.kappa, row.pabak) == (50, 0.7, pytest.approx(0.4), pytest.approx(0.4))
    assert stats.cohen_kappa(ratings(spark, [(1, 1)] * 4), "a", "b").first().kappa == 1.0
    assert stats.cohen_kappa(ratings(spark, [(1, 1), (2, 2), (3, 1)]), "a", "b").first().pabak is None
    assert stats.weighted_kappa(ratings(spark, [(1, 1), (4, 4), (2, 3)]), "a", "b", [1, 2, 3, 4]).first().weighted_kappa == pytest.approx(1 - 3 * 1 / (3 * (21 + 26) - 2 * 7 * 8))
    assert stats.weighted_kappa(ratings(spark, [(2, 2)] * 3), "a", "b", [1, 2, 3, 4]).first().weighted_kappa == 1.0
    with pytest.raises(Exception, match="outside the scale"):
        stats.weighted_kappa(ratings(spark, [(9, 1)]), "a", "b", [1, 2]).collect()
    tau = lambda pairs: stats.kendall_tau_b(ratings(spark, pairs), "a", "b").first().tau_b
    assert tau([(1, 1), (2, 2), (3, 3)]) == 1.0 and tau([(1, 3), (2, 2), (3, 1)]) == -1.0 and math.isnan(tau([(1, 1), (1, 2)]))
    assert tau([(1, 1), (1, 2), (2, 3), (3, 2)]) == pytest.approx(2 / 5)


def test_bootstrap(spark):
    pairs = ratings(spark, [(1, 1)] * 6 + [(0, 1)] * 2 + [(0, 0)] * 8)
    one, two = (stats.bootstrap_ci(pairs, "a", "b", ["i"], n_boot=300, seed=0).first() for _ in range(2))
    assert one == two and 0.2 < one.lo < 0.75 < one.hi <= 1.0
    same = stats.bootstrap_ci(ratings(spark, [(1, 1)] * 3), "a", "b", ["i"], n_boot=20).first()
    assert (same.lo, same.hi) == (1.0, 1.0)
    with pytest.raises(ValueError):
        stats.resamples(pairs.where("false"), ["i"], 5, 0)
    assert stats.percentile(pairs, "i", 0.25).first().value == 3.75


def test_agreement_report_and_rubric(spark):
    human = spark.createDataFrame([(f"C-{i:02d}", i % 3 > 0, 1 + i % 4, 1 + i % 2) for i in range(12)], "item_id string, acceptable boolean, tone int, clarity int")
    judge = human.where("item_id <> 'C-00'").withColumn("tone", F.least(F.lit(4), F.col("tone") + 1))
    got = {r.measure: r for r in stats.agreement_report(human, judge, n_boot=50).collect()}
    assert (got["acceptable"].n, got["acceptable"].statistic, got["clarity"].statistic) == (11, 1.0, 1.0) and got["tone"].statistic < 1
    outputs = spark.createDataFrame([("a", '{"tone": 4, "clarity": 1, "acceptable": true}'), ("b", '{"tone": 5, "clarity": 1, "acceptable": true}'), ("c", "no json"), ("d", None)], "item_id string, output string")
    assert {r.item_id: r.parse_ok for r in stats.rubric_rows(outputs).collect()} == {"a": True, "b": False, "c": False, "d": False}
    truth = spark.createDataFrame([("a", "CLEAN-1"), ("b", "live_pass2"), ("c", "T1-SWAP")], "item_id string, source string")
    assert {r.item_id for r in stats.clean_subset(truth).where("clean").collect()} == {"a", "b"}


def test_both_orders(spark):
    rows = [("p", "ab", "1", True), ("p", "ba", "2", True), ("q", "ab", "1", True), ("q", "ba", "1", True), ("r", "ab", "tie", True), ("r", "ba", "tie", True), ("s", "ab", "2", True), ("s", "ba", "2", False)]
    got = stats.both_orders(spark.createDataFrame(rows, "pair_id string, ordering string, winner string, parse_ok boolean")).collect()
    assert {(r.pair_id, r.verdict, r.flipped) for r in got} == {("p", "a", False), ("q", "tie", True), ("r", "tie", False), ("s", "tie", True)}


def entry(id, offset, weight=1.0, pool="A", **bits):
    return (id, pool, weight, offset, *(bits.get(c, False) for c in LABELS))


ENTRY = "entry_id string, pool string, weight double, ingested_offset long, " + ", ".join(f"{c} boolean" for c in LABELS)


def test_memory_cap_and_retrieval(spark):
    rows = [entry(f"m{i}", i, partial=True) for i in range(5)] + [entry("m4", 9, partial=True), entry("x", 1, 2.0, partial=True, ambiguous=True), entry("y", 2, open_credit=True), entry("z", 3)]
    kept = memory.kept(spark.createDataFrame(rows, ENTRY))
    assert {r.entry_id for r in kept.collect()} == {"m2", "m3", "m4", "x", "y", "z"}
    asks = spark.createDataFrame([("q1", *(c == "partial" for c in LABELS)), ("q2", *(c in ("partial", "ambiguous") for c in LABELS)), ("q3", *(False for _ in LABELS))], "query_id string, " + ", ".join(f"{c} boolean" for c in LABELS))
    got = {}
    for r in memory.retrieve(asks, kept, 4).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.entry_id)
    assert got == {"q1": ["m4", "m3", "m2", "x"], "q2": ["x", "m4", "m3", "m2"], "q3": ["z"]}
    assert memory.retrieve(asks, kept, 0).count() == 0
    assert memory.random_entries(asks, kept, 2, 1).groupBy("query_id").count().where("count = 2").count() == 3
    with pytest.raises(Exception, match="pool A only"):
        memory.kept(spark.createDataFrame([entry("b", 1, pool="B")], ENTRY)).collect()


def test_calibration_items(spark):
    drafts = spark.createDataFrame([(f"d{i}", i % 2 == 0) for i in range(40)], "draft_id string, clean boolean")
    got = memory.calibration_items(drafts).collect()
    assert sorted(r.item_id for r in got) == [f"C-{i:02d}" for i in range(1, 17)] and sum(r.clean for r in got) == 8


def decision(offset, scenario, pool, action):
    return (offset, f"g{offset}", scenario, pool, action, "text", "")


def test_ingest_stream_adds_nothing_twice(spark, tmp_path):
    scenarios = fixtures.generate(spark, 4)
    bits = ledger.signature(fixtures.from_documents(scenarios)).join(scenarios.select("scenario_id", "pool"), "scenario_id")
    kind = "offset long, gen_id string, scenario_id string, pool string, action string, final_text string, reason string"
    feed, store, check = (str(tmp_path / x) for x in ("feed", "store", "check"))
    spark.createDataFrame([decision(0, "S-0", "A", "approve"), decision(1, "S-1", "B", "edit"), decision(2, "S-2", "A", "edit"), decision(3, "S-0", "A", "decline"), decision(4, "S-1", "A", "edit")], kind).write.parquet(feed)
    for _ in range(2):
        ingest_stream(spark, feed, bits, store, check).awaitTermination()
    got = {(r.entry_id, r.weight) for r in entries(spark, store).collect()}
    assert got == {("mem-000000", 1.0), ("mem-000002", 2.0)}
    spark.createDataFrame([decision(7, "S-2", "A", "approve")], kind).write.mode("append").parquet(feed)
    ingest_stream(spark, feed, bits, store, check).awaitTermination()
    assert entries(spark, store).count() == 3
    whole = entries(spark, store)
    assert memory.state_hash(whole) == memory.state_hash(whole.orderBy("entry_id")) and memory.state_hash(whole.where("false")) == "empty"
    counts = memory.ingest_counts(spark.read.parquet(feed)).first()
    assert (counts.consumed_through_offset, counts.added, counts.declined) == (7, 4, 1)


def event(kind, **given):
    """A right event: a value of its type for each key that must be there."""
    sample = {"str": "x", "int": 1, "bool": True, "list": [], "object": {}}
    values = {key: sample[type_] for key, (type_, needed) in event_keys(kind).items() if needed} | {k: v[0] for (t, k), v in EVENT_VALUES.items() if t == kind}
    return values | {"event_type": kind, "run_id": "r"} | given


def test_event_log(spark, tmp_path):
    lines = [events.canonical(event("trace", error=None)), "", events.canonical(event("score", gen_id="g"))]
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(lines) + "\n")
    assert [r.offset for r in events.read_lines(spark, str(path)).orderBy("offset").collect()] == [0, 2]
    got = events.read_events(spark, str(path), "score", "run_id string, gen_id string").collect()
    assert [(r.offset, r.gen_id) for r in got] == [(2, "g")]
    assert events.read_lines(spark, str(path), 1).count() == 1 and events.line_count(events.read_lines(spark, str(path))) == 3
    bad = {
        "not a JSON object": "{", "unknown event type": json.dumps({"event_type": "odd"}), "unknown keys: odd": json.dumps(event("score", odd=1)), "missing keys: gen_id": json.dumps({k: v for k, v in event("ingest").items()} | {"event_type": "verification", "claims": [], "decision": {}}),
        "wrong types: grounding_total, seed": "", "unknown values: stage=middle": json.dumps(event("score", stage="middle")), "wrong types: grounding_total": json.dumps(event("score", grounding_total="3")), "wrong types: ok": json.dumps(event("tool_call", ok=None)),
    }
    bad["missing keys: gen_id"] = json.dumps({k: v for k, v in event("verification").items() if k != "gen_id"})
    del bad["wrong types: grounding_total, seed"]
    path.write_text("\n".join([*bad.values(), *(json.dumps(event(t)) for t in EVENT_TYPES)]))
    found = {r.offset: r.problem for r in events.problems(events.read_lines(spark, str(path))).collect()}
    assert [found[i] for i in range(len(bad))] == list(bad) and len(found) == len(bad) + 10 and set(found.values()) == {*bad, None}
    with pytest.raises(Exception, match="unknown keys"):
        path.write_text(json.dumps(event("score", odd=1)))
        events.read_events(spark, str(path), "score", "gen_id string").collect()
    assert len(events.event_schema()["oneOf"]) == 10
    entry = events.manifest("r", {"b": 1, "a": 2}, {"p": "x"}, "empty", {"S-1": "0"})
    assert entry == events.manifest("r", {"a": 2, "b": 1}, {"p": "x"}, "empty", {"S-1": "0"})
    events.write_manifest(spark, entry, str(tmp_path / "manifest"))
    assert json.loads(spark.read.text(str(tmp_path / "manifest")).first()[0])["run_id"] == "r"


def test_recoveries_within_their_budget(spark):
    """Calls beyond six don't run, forced ones neither; a recovery that can't be grounded has no text and is escalated."""
    call = lambda *names: [(n, "") for n in names]
    answers = [("a", 0, ("tools", call("x1", "x2", "x3"), None)), ("a", 1, ("tools", call("x4", "x5", "x6"), None)), ("a", 2, ("final", None, "text")), ("b", 0, ("tools", call("need", "NEED"), None)), ("b", 1, ("final", None, " text "))]
    answers.append(("c", 0, ("tools", call("x1", "x2", "x3", "need"), None)))
    given = spark.createDataFrame(answers, "draft_id string, step int, answer struct<type:string,calls:array<struct<tool_name:string,argument:string>>,draft:string>")
    cases = spark.createDataFrame([(d, "S-1") for d in "abc"], "draft_id string, scenario_id string")
    required = spark.createDataFrame([(d, "need", "") for d in "abc"], "draft_id string, tool_name string, argument string")
    got = {r.draft_id: r for r in recovery.recover(cases, required, given, spark.createDataFrame([("S-1", "need", "")], "scenario_id string, tool_name string, argument string")).collect()}
    assert (got["a"].text, got["a"].tool_calls, got["a"].llm_calls, got["a"].calls[-1].error) == ("", 6, 2, recovery.BUDGET_SPENT)
    assert (got["b"].text, got["b"].forced_final, [c.ok for c in got["b"].calls]) == ("text", False, [True, False])
    assert (got["c"].tool_calls, got["c"].coverage_forced, got["c"].text) == (1, ["need"], "")  # four calls at once ask for nothing


def test_settled_recoveries(spark):
    nested = fixtures.generate(spark, 3)
    scenarios = ledger.view(fixtures.from_documents(nested))
    good = {r.scenario_id: r.draft for r in render.golden(scenarios).collect()}
    texts = [("good", "S-0", good["S-0"]), ("short", "S-0", "Hello."), ("none", "S-0", "")]
    got = {r.draft_id: (r.action, r.reason) for r in recovery.settle(spark.createDataFrame(texts, "draft_id string, scenario_id string, text string"), scenarios).collect()}
    assert got == {"good": ("human_gate", "all checks passed"), "short": ("escalate", recovery.EXHAUSTED), "none": ("escalate", recovery.EXHAUSTED)}


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    """Offsets are those of the file, blank lines and long ones too, whatever the splits."""
    lines = ["" if i % 7 == 3 else f"{i} " + "x" * (i % 50) for i in range(5000)]
    path = tmp_path / "long.txt"
    path.write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 8
        got = {r.offset: r.line for r in events.read_lines(spark, str(path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i: x for i, x in enumerate(lines) if x}


def test_generated_ledgers_have_their_structure(spark, tmp_path):
    nested = fixtures.generate(spark, 60)
    books = fixtures.from_documents(nested)
    assert ledger.validate(books).count() == 0
    got = ledger.signature(books).join(nested.select("scenario_id", "structure_labels"), "scenario_id")
    assert got.where("labels <> structure_labels").count() == 0
    assert ledger.totals(books).select("scenario_id", "net_balance").exceptAll(ledger.naive_net(books)).count() == 0
    fixtures.write_fixtures(nested, str(tmp_path / "f"))
    index = json.loads((tmp_path / "f/index.json").read_text())
    assert len(index) == 60 and len({r["ref"] for r in index}) == 60
    for pool in "AB":
        again = fixtures.load_pool(spark, str(tmp_path / "f"), pool).drop("place")
        assert again.exceptAll(nested.where(F.col("pool") == pool).select(again.columns)).count() == 0 and again.count() == 30
    with pytest.raises(ValueError, match="labelled"):
        fixtures.write_fixtures(nested.withColumn("structure_labels", F.array(F.lit("ambiguous"))), str(tmp_path / "g"))
    folder = tmp_path / "single"
    folder.mkdir()
    for row in nested.limit(3).toJSON().collect():
        (folder / f"{json.loads(row)['scenario_id']}.json").write_text(row)
    (folder / "index.json").write_text(json.dumps([{"scenario_id": f"S-{i}", "pool": "A" if i % 2 == 0 else "B"} for i in (2, 1, 0)]))
    assert [r.scenario_id for r in fixtures.load_pool(spark, str(folder), "A").orderBy("place").collect()] == ["S-2", "S-0"]
    assert fixtures.load_ledger(spark, str(folder), "S-1").invoice.count() == 3
    with pytest.raises(ValueError):
        fixtures.load_pool(spark, str(folder), "C")
    (folder / "S-9.json").write_text('{"scenario_id": "S-9", "extra": 1}')
    with pytest.raises(Exception, match="unknown keys"):
        fixtures.load_ledger(spark, str(folder), "S-9").client.collect()


def test_label_files(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("item_id,acceptable,tone,clarity\nC-01,Yes,3,4\nC-02,no,1,2\n")
    assert [tuple(r) for r in fixtures.read_labels(spark, str(tmp_path / "labels.csv")).orderBy("item_id").collect()] == [("C-01", True, 3, 4), ("C-02", False, 1, 2)]
    (tmp_path / "judge.json").write_text(json.dumps({"C-01": {"scores": {"tone": 1, "clarity": 2, "acceptable": False}, "parse_ok": True}, "C-02": {"scores": None, "parse_ok": False}}))
    assert [r.item_id for r in fixtures.read_judge_scores(spark, str(tmp_path / "judge.json")).collect()] == ["C-01"]
    assert fixtures.read_rows(spark, str(tmp_path / "none.json"), "a int").count() == 0


def test_a_report_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(reports, "MOST_ROWS", 3)
    assert reports.markdown(spark.range(3).toDF("a"), ["a"]).count("\n") == 4
    with pytest.raises(ValueError, match="more than 3 rows"):
        reports.markdown(spark.range(4).toDF("a"), ["a"])


def test_reports_are_stable(spark, tmp_path):
    rows = spark.createDataFrame([(0, False), (0, True), (1, True), (1, True), (2, False)], "tier int, caught boolean")
    found = {r.tier: (r.errors, r.caught, r.sensitivity, r.specificity, r.balanced) for r in reports.injected_errors(rows).collect()}
    assert found == {1: (2, 2, 100, 50, 75), 2: (1, 0, 0, 50, 25)}
    score = "gen_id string, scenario_id string, pass_label string, stage string, grounding_checked int, grounding_total int, completeness_present int, completeness_total int, revision_count int, terminal_action string, offset int"
    inputs = {
        "scores": spark.createDataFrame([("g", "S-1", "pass1", "first_pass", 1, 2, 1, 1, 0, "human_gate", 0), ("h", "S-1", "pass2", "first_pass", 2, 2, 1, 1, 0, "human_gate", 1)], score),
        "errors": rows.select("tier", F.lit("e").alias("error"), F.lit("S-1").alias("scenario_id"), F.lit("revise").alias("action"), F.lit("a|b").alias("reason"), "caught"),
        "gaps": spark.createDataFrame([("d2", "other"), ("d1", "other")], "draft_id string, missing string"),
        "agreement": spark.createDataFrame([("tone", 16, 0.5, float("nan"), 1.0, None, 0.25)], "measure string, n int, statistic double, lo double, hi double, pabak double, raw_agreement double"),
        "pairs": spark.createDataFrame([("b", True), ("tie", False)], "verdict string, flipped boolean"), "traces": spark.createDataFrame([("draft", True, None)], "task string, ok boolean, error string"),
        "checked": spark.createDataFrame([("g1", True), ("g2", False)], "gen_id string, agree boolean"),
        "cases": spark.createDataFrame([("c", "break_sum", True, 1, False, 3, 4, True, False)], "draft_id string, failure_kind string, prompt_recovered boolean, prompt_llm_calls int, agentic_recovered boolean, agentic_llm_calls int, agentic_tool_calls int, agentic_forced_final boolean, agentic_coverage_forced boolean"),
    }
    first = reports.log_reports(**inputs)
    again = reports.log_reports(**{k: df.repartition(3) for k, df in inputs.items()})
    assert list(first) == list(reports.REPORTS) and first == again  # equal bytes, however the rows lie
    assert "| pass1 | 1 | 1/2 (50%) | 1/1 (100%) | 0 |" in first["before_after"] and "| S-1 | +50pp |" in first["before_after"] and "| 1 | 2 | 2 |" in first["injected_errors"]
    assert "| other | 2 | d1, d2 |" in first["capability_gaps"] and "| tone | 16 | 0.500 | n/a | 1.000 | n/a | 0.250 |" in first["calibration"] and "| false | 1 | g2 |" in first["oracle_crosscheck"].lower()
    none = reports.log_reports(**{k: df.where("false") for k, df in inputs.items()})
    assert all(none[name].endswith(placeholder + "\n") for name, (_, placeholder) in reports.REPORTS.items())
    paths = reports.write_reports(first, str(tmp_path))
    assert [open(p).read() for p in paths] == [first[n] for n in sorted(first)]
    with pytest.raises(ValueError, match="mark"):
        reports.write_reports({"x": reports.INJECTION}, str(tmp_path))
    text = "a\n<!-- results:errors -->\nold\n<!-- /results:errors -->\nb"
    once = reports.inject(text, {"errors": "new"})
    assert once == reports.inject(once, {"errors": "new"}) and "new" in once and "old" not in once
    for bad, blocks in ((text, {}), ("<!-- results:errors -->", {"errors": ""})):
        with pytest.raises(ValueError):
            reports.inject(bad, blocks)
    assert reports.cell("a|b\nc") == "a\\|b c"


def test_log_reports(spark):
    cases = spark.createDataFrame([(True, True, 2, 1, 3, False, False), (False, True, 1, 2, 0, True, False), (False, False, 1, 2, 4, True, True)], "prompt_recovered boolean, agentic_recovered boolean, prompt_llm_calls int, agentic_llm_calls int, agentic_tool_calls int, agentic_forced_final boolean, agentic_coverage_forced boolean")
    row = reports.recovery(cases).first()
    assert (row.prompt_recovered, row.agentic_recovered, row.mean_agentic_calls, row.mean_tool_calls, row.forced_share) == (1, 2, "1.6", "2.3", "66%")
    pending = spark.createDataFrame([("g1", "hello"), ("g2", "bye")], "gen_id string, draft string")
    asked = spark.createDataFrame([("g1", "approve", None, False), ("g2", "edit", "worse", False), ("g3", "approve", "x", False), ("g3", "decline", "x", True)], "gen_id string, action string, final_text string, override boolean")
    failing = spark.createDataFrame([("g2",)], "gen_id string")
    got = {(r.gen_id, r.action): (r.refused, r.sent_text) for r in reports.apply_decisions(pending, asked, failing).collect()}
    assert got == {("g1", "approve"): (None, "hello"), ("g2", "edit"): ("fails a check", None), ("g3", "approve"): ("not pending", None), ("g3", "decline"): (None, "")}
    generations = spark.createDataFrame([(0, "g1", True), (1, "g2", True), (2, "g3", False)], "offset long, gen_id string, is_first_pass boolean")
    scores = spark.createDataFrame([(0, "g1", 1, 2), (1, "g1", 2, 2), (2, "g2", 2, 2)], "offset long, gen_id string, grounding_checked long, grounding_total long")
    judged = spark.createDataFrame([("g1", 3, 3), ("g2", 1, 3)], "gen_id string, verified long, total long")
    assert {r.gen_id: r.agree for r in reports.crosscheck(generations, scores, judged).collect()} == {"g1": True, "g2": False}


def test_steps_limits_and_evidence(spark):
    steps = spark.sql("select stack(5, named_struct('type', 'tools', 'calls', array('x'), 'draft', ''), named_struct('type', 'tools', 'calls', array('a', 'b', 'c', 'd'), 'draft', ''), named_struct('type', 'final', 'calls', slice(array(''), 1, 0), 'draft', 'd'), named_struct('type', 'final', 'calls', slice(array(''), 1, 0), 'draft', ' '), named_struct('type', 'odd', 'calls', slice(array(''), 1, 0), 'draft', '')) as step")
    got = [r[0] for r in steps.select(F.expr(rounds.step_problem())).collect()]
    assert [x is None for x in got] == [True, False, True, False, False]
    calls = spark.createDataFrame([("g", r, "t", str(i), False) for r in (0, 1) for i in range(3)] + [("h", r, "t", str(i), False) for r in (0, 1, 2) for i in range(2)] + [("i", 0, "t", str(i), i > 2) for i in range(6)] + [("j", 0, "t", str(i), False) for i in range(4)], "gen_id string, round_index int, tool_name string, argument string, cached boolean")
    assert {(r.gen_id, r.limit) for r in rounds.over_limits(calls).collect()} == {("h", "rounds"), ("j", "calls_per_round")}
    need = spark.createDataFrame([("S", "get_invoice", "INV-1"), ("S", "get_invoice", "INV-2")], "scenario_id string, tool_name string, argument string")
    made = spark.createDataFrame([("S", "get_invoice", "inv-1", True), ("S", "get_invoice", "INV-2", False)], "scenario_id string, tool_name string, argument string, ok boolean")
    assert [r.argument for r in rounds.missing_evidence(need, made).collect()] == ["INV-2"]
