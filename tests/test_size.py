"""Work that must not grow faster than a draft or its ledger, and the same outcome in every form."""

import time

from pyspark.sql import functions as F

from ledgerloom import registry, spoiled
from ledgerloom.operators import corrupt, ledger, oracle, render
from ledgerloom.plans import rounds
from ledgerloom.sources import tables
from ledgerloom.sources.tables import Ledger, order_ledger

from .conftest import SMALL


def _docs(ids):
    return F.array(*(F.struct(F.lit("invoice").alias("kind"), F.lit(i).alias("id")) for i in ids))


def test_fabricated_ids_are_found_without_trying_all(spark):
    """The first id that neither ledger nor draft has; as many candidates as there are such ids, not a thousand a draft."""
    rows = lambda n, ids, text: spark.range(0, n, 1, 1).select(_docs(ids).alias("docs"), F.lit(text).alias("draft")).withColumn("x", F.expr(corrupt.fabricate_id()))
    one = lambda ids, text: rows(1, ids, text).first().x
    assert one(["INV-7", "INV-9000", "INV-9002"], "Pay INV-7, not INV-90019.") == "Pay INV-9003, not INV-90019."
    assert one(["INV-9000", "INV-90"], "INV-90 is due.") == "INV-9001 is due."
    assert one(["INV-7"], "Nothing is due.") is None
    assert one([f"INV-9{n:03}" for n in range(1000)], "INV-9001 is due.") is None
    assert one([f"INV-9{n:03}" for n in range(999)], "INV-9001 is due.") == "INV-9999 is due."
    many = rows(2000, [f"INV-{n}" for n in range(10, 36)], "INV-12 is due. " * 100)
    began = time.time()
    assert many.withColumn("x", F.concat("x", F.lit(""))).agg(F.max("x")).first()[0].startswith("INV-9000")
    assert time.time() - began < 10  # trying all takes over 20 ms a row


def test_verification_shuffles_and_writes_nothing(spark):
    """Claims, checks and decisions stay in their draft's row, so that a ledger isn't copied for each of its drafts."""
    scenarios = ledger.view(order_ledger(spark, SMALL))
    drafts = spoiled.sentences(scenarios).withColumnRenamed("sentence", "draft").withColumn("revision_index", F.lit(0))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    decisions = rounds.verify(drafts)[2]
    assert plan(decisions).count("Exchange") == plan(drafts).count("Exchange")
    assert "docs" not in decisions.columns


def test_the_ledgers_lines_are_sorted_once_in_small_tasks(spark, monkeypatch):
    """No second sort of the lines after the join, and as many partitions as keep a task's sort small, whatever the setting."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tables._order_facts(spark, SMALL)._jdf.queryExecution().sparkPlan().toString()
        full = tables._order_facts(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Window") >= 2
    assert full.count("Sort [") == 4  # lines, customers, and orders by customer and by order
    monkeypatch.setattr(tables, "bytes_of", lambda *_: 5 << 30)
    assert tables._small_tasks(spark, [])["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == "640"


def test_grounding_copies_no_figures_for_a_sentence(spark):
    """Sentences are judged in their draft's row: none is a row of its own, and the drafts are made once."""
    facts = spark.createDataFrame([("S", {"INV-1": [500], "PMT-2": [700]}, [900])], "scenario_id string, known map<string,array<long>>, totals array<long>")
    drafts = spark.createDataFrame([("a", "S", "INV-1 is $5.00. The rest is $9.00.\nINV-1 and PMT-2: $7, $9 and $8. INV-3 is $5."), ("b", "S", None), ("c", "T", "INV-1 is $5.00."), ("d", "S", "INV-1.")], "draft_id string, scenario_id string, draft string")
    found = oracle.grounding(drafts, facts)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r)[:3] + (None if r.unmatched is None else [tuple(u) for u in r.unmatched],) for r in found.orderBy("draft_id").collect()] == [
        ("a", 7, 10, [("amount", "$5"), ("amount", "$8"), ("id", "INV-3")]), ("b", 0, 0, None), ("c", 0, 0, None), ("d", 1, 1, []),
    ]


def test_draft_length_makes_drafts_of_lines_in_small_tasks(spark, monkeypatch):
    """Open documents become lines by compiled code; settled ones aren't shuffled; partitions follow the size of the tables."""
    plan = lambda name: registry.QUERIES[name](spark, SMALL)._jdf.queryExecution()
    for name in ("draft_length", "golden_draft"):
        assert "lambda" not in plan(name).optimizedPlan().toString()
    rows = registry.QUERIES["draft_length"](spark, SMALL)
    rows.collect()
    text = rows._jdf.queryExecution().optimizedPlan().toString()
    below = text[text.index("RepartitionByExpression [scenario_id") :]
    assert "NOT ((amount_cents" in below  # the filter of settled documents
    monkeypatch.setattr(tables, "bytes_of", lambda *_: 5 << 30)
    for name in ("draft_length", "golden_claims"):
        exchanges = [e for e in plan(name).sparkPlan().toString().splitlines() if "REPARTITION_BY_NUM" in e]
        assert exchanges and all("scenario_id" in e and ", 640)" in e for e in exchanges)


def test_the_ledger_is_written_without_what_its_numbers_tell(spark):
    """Texts that follow from keys are made when the table is read; the tasks that shuffle the lines read little each."""
    assert tables._small_tasks(spark, [])["spark.sql.files.maxPartitionBytes"] == "32m"
    assert sorted(n for n, kind in tables._order_facts(spark, SMALL).dtypes if kind == "string") == ["memo", "name"]


def test_drafts_of_lines_are_those_of_the_ledgers_rows(spark):
    """Equal positions, settled and overdrawn documents, scenarios without any, and nulls."""
    day = lambda *columns: [F.col(c).cast("date").alias(c) for c in columns]
    client = spark.createDataFrame([("a", "A", "CL-a", "Ann"), ("b", "B", "CL-b", None), ("c", "A", "CL-c", "Cy"), ("d", "B", "CL-d", "Di")], "scenario_id string, pool string, client_id string, name string").select("*", F.lit(30).alias("terms_days"), F.lit("2000-06-30").cast("date").alias("as_of"))
    invoice = spark.createDataFrame([("a", 1, "INV-2", "2000-01-01", "2000-02-01", 5000, "m"), ("a", 1, "INV-1", "2000-01-01", "2000-02-01", 123456789, None), ("a", 0, "INV-3", "2000-03-01", None, 70, "m"), ("a", 4, "INV-4", "2000-03-01", "2000-07-01", 100, ""), ("b", 1, "INV-5", "2000-03-01", "2000-07-01", 100, ""), ("d", 1, "INV-6", "2000-03-01", "2000-07-01", 100, "")], "scenario_id string, pos long, id string, date string, due string, amount_cents long, memo string").select("scenario_id", "pos", "id", *day("date", "due"), "amount_cents", "memo")
    paid = lambda *rows: spark.createDataFrame(list(rows), "scenario_id string, pos long, id string, date string, amount_cents long").select("scenario_id", "pos", "id", *day("date"), "amount_cents")
    payment = paid(("a", 2, "PMT-2", "2000-04-01", 9), ("a", 1, "PMT-1", "2000-04-01", 2000), ("b", 1, "PMT-3", "2000-04-01", 100), ("d", 1, "PMT-4", "2000-04-01", 300))
    credit = paid(("a", 1, "CM-1", "2000-04-02", 40), ("d", 1, "CM-2", "2000-04-02", None))
    applied = spark.createDataFrame([("a", 1, "PMT-1", "INV-2", 1500), ("b", 1, "PMT-3", "INV-5", 100), ("d", 1, "PMT-4", "INV-6", 400)], "scenario_id string, pos long, source_id string, target_invoice string, amount_cents long")
    by_hand = Ledger(client, invoice, payment, credit, applied)
    for books in (by_hand, order_ledger(spark, SMALL)):
        lines = render.golden_drafts(books)
        rows = render.golden(ledger.view(books)).select(*lines.columns)
        assert lines.count() == rows.count() > 0
        assert lines.exceptAll(rows).isEmpty() and rows.exceptAll(lines).isEmpty()


def test_claims_as_rows_are_found_once(spark):
    """No test of whether a draft has claims repeats the search for them, once or for each of them."""
    scenarios = ledger.view(order_ledger(spark, SMALL))
    drafts = spoiled.sentences(scenarios).withColumnRenamed("sentence", "draft").withColumn("revision_index", F.lit(0))
    claims, checked, _ = rounds.verify(drafts)
    for rows in (claims, checked, registry.QUERIES["spoiled_claims"](spark, SMALL)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert not any("Filter" in line and "sort_array" in line for line in plan.splitlines())
    none = drafts.withColumn("draft", F.lit("Thank you.")).limit(1)
    assert rounds.verify(none)[0].isEmpty() and rounds.verify(none)[1].isEmpty()


def test_sentences_that_errors_share_are_searched_once(spark):
    """Drafts with errors are found and checked before they become rows, and come out as each does on its own."""
    drafts = render.golden(ledger.view(order_ledger(spark, SMALL)))
    found = rounds.errors_run(drafts)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("array_position")  # an upper node comes first
    each = rounds.verify(corrupt.variants(drafts).withColumn("revision_index", F.lit(0)), keep=("error", "tier"))[2]
    columns = ["draft_id", "error", "tier", "action", "reason", F.transform("findings", lambda f: f["kind"]).alias("kinds")]
    key = lambda rows: sorted(map(tuple, rows), key=repr)
    assert key(found.select(*columns[:5], "kinds").collect()) == key(each.select(*columns).collect())


def test_only_the_sentences_asked_for_are_made(spark):
    """Cases that a query doesn't use cost it nothing, and texts of one scenario share what is found in them."""
    rows = spoiled.sentences(ledger.view(order_ledger(spark, SMALL)), ("unbound", "open_wrong"))
    assert "is settled." not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {r["case"] for r in rows.select("case").distinct().collect()} == {"unbound", "open_wrong"}
    plan = registry.QUERIES["corrections"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("array_position")
