"""Sentences about one small ledger: what is claimed, whether it holds, and what the gate makes of it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import corrupt, gate, ledger, oracle, render, score
from ledgerloom.operators.checks import check_claims
from ledgerloom.operators.extract import extract_claims
from ledgerloom.plans import rounds
from ledgerloom.schema import LEDGER
from ledgerloom.sources.fixtures import from_documents

DAY = dt.date


@pytest.fixture(scope="module")
def books(spark):
    """Open 8,450.00 of invoices, 6,300.00 of unapplied cash: a net of 2,150.00. S-2 is ambiguous."""
    one = (1, "S-1", "A", ["unapplied_cash"], ("CL-1", "Acme", 30, DAY(2026, 3, 31)), [("INV-1010", DAY(2026, 1, 5), DAY(2026, 2, 4), 210000, ""), ("INV-1011", DAY(2026, 2, 10), DAY(2026, 3, 12), 345000, ""), ("INV-1012", DAY(2026, 3, 10), DAY(2026, 4, 9), 500000, "")], [("PMT-0207", DAY(2026, 2, 1), 210000, "ach", ""), ("PMT-0208", DAY(2026, 3, 20), 630000, "ach", "")], [], [("PMT-0207", "INV-1010", 210000)])
    two = (1, "S-2", "B", [], ("CL-2", "Bolt", 30, DAY(2026, 3, 31)), [("INV-1", DAY(2026, 1, 5), DAY(2026, 2, 4), 1000, ""), ("INV-2", DAY(2026, 1, 6), DAY(2026, 2, 5), 1000, "")], [("PMT-0001", DAY(2026, 2, 1), 1000, "ach", "")], [], [])
    return from_documents(spark.createDataFrame([one, two], LEDGER))


@pytest.fixture(scope="module")
def judge(spark, books):
    scenarios = ledger.view(books).cache()

    def run(sentences, scenario="S-1"):
        rows = spark.createDataFrame([(f"{i:03d}", s) for i, s in enumerate(sentences)], "draft_id string, draft string")
        drafts = rows.crossJoin(scenarios.where(F.col("scenario_id") == scenario)).withColumn("revision_index", F.lit(0))
        found = check_claims(extract_claims(drafts), drafts).orderBy("draft_id", "n").collect()
        return [[(r.type, r.token, list(r.subject_ids), r.role, r.result and r.result.status) for r in found if r.draft_id == f"{i:03d}"] for i in range(len(sentences))]

    return run


def test_figures(books):
    got = {r.scenario_id: r for r in ledger.view(books).collect()}
    assert (got["S-1"].open_invoice_total, got["S-1"].unapplied_cash_total, got["S-1"].net_balance) == (845000, 630000, 215000)
    assert {(d.id, d.open, d.status) for d in got["S-1"].docs if d.kind == "invoice"} == {("INV-1010", 0, "paid"), ("INV-1011", 345000, "overdue"), ("INV-1012", 500000, "outstanding")}
    assert [(a.source_id, a.candidates) for a in got["S-2"].ambiguous] == [("PMT-0001", ["INV-1", "INV-2"])]
    assert {(r.scenario_id, tuple(r.labels)) for r in ledger.signature(books).collect()} == {("S-1", ("unapplied_cash",)), ("S-2", ("unapplied_cash", "near_duplicate", "ambiguous"))}


CASES = [
    ("The balance due on your account is $2,150.00.", [("C-SUM", "$2,150.00", [], "total", "pass")]),
    ("The balance due on your account is $8,450.00.", [("C-SUM", "$8,450.00", [], "total", "fail")]),
    ("Your two open invoices total $8,450.00.", [("C-SUM", "$8,450.00", [], "total", "pass")]),
    ("Invoices INV-1011 and INV-1012 total $8,450.00.", [("C-EXIST", "INV-1011", [], "", "pass"), ("C-EXIST", "INV-1012", [], "", "pass"), ("C-SUM", "$8,450.00", ["INV-1011", "INV-1012"], "total", "pass")]),
    ("INV-1011 has $3,450.00 outstanding.", [("C-EXIST", "INV-1011", [], "", "pass"), ("C-AMT", "$3,450.00", ["INV-1011"], "open", "pass"), ("C-STATUS", "outstanding", ["INV-1011"], "", "pass")]),
    ("INV-1010 has $2,100.00 remaining.", [("C-EXIST", "INV-1010", [], "", "pass"), ("C-AMT", "$2,100.00", ["INV-1010"], "open", "fail")]),
    ("Invoice No. 1012 was issued for five thousand dollars.", [("C-EXIST", "INV-1012", [], "", "pass"), ("C-AMT", "five thousand dollars", ["INV-1012"], "original", "pass")]),
    ("We received your payment 208 of 6,300.00.", [("C-EXIST", "PMT-0208", [], "", "pass"), ("C-AMT", "6,300.00", ["PMT-0208"], "", "pass")]),
    ("INV 9999 is due.", [("C-EXIST", "INV-9999", [], "", "fail")]),
    ("INV-1012 is overdue.", [("C-EXIST", "INV-1012", [], "", "pass"), ("C-STATUS", "overdue", ["INV-1012"], "", "fail")]),
    ("INV-1011 is past due.", [("C-EXIST", "INV-1011", [], "", "pass"), ("C-STATUS", "past due", ["INV-1011"], "", "pass")]),
    ("INV-1011 is taken care of.", [("C-EXIST", "INV-1011", [], "", "pass"), ("C-STATUS", "paid", ["INV-1011"], "", "fail"), ("C-FUZZY", "", [], "", None)]),
    ("Both INV-1011 and INV-1012 were issued on 2026-02-10.", [("C-EXIST", "INV-1011", [], "", "pass"), ("C-EXIST", "INV-1012", [], "", "pass"), ("C-DATE", "2026-02-10", ["INV-1011", "INV-1012"], "", "fail")]),
    ("INV-1012 is dated March 10, 2026, due 4/9/2026.", [("C-EXIST", "INV-1012", [], "", "pass"), ("C-DATE", "March 10, 2026", ["INV-1012"], "", "pass"), ("C-DATE", "4/9/2026", ["INV-1012"], "", "pass")]),
    ("As of 2026-03-31 all is well.", [("C-DATE", "2026-03-31", [], "", "pass")]),
    ("Please remit $8,450.00.", [("C-AMT", "$8,450.00", [], "", "fail")]),
    ("Please send USD 2,150.", [("C-AMT", "USD 2,150", [], "", "pass")]),
    ("We received $6,300.00.", [("C-AMT", "$6,300.00", [], "", "pass")]),
    ("We received $6,301.00.", [("C-AMT", "$6,301.00", [], "", "fail")]),
    ("It was 123.45 once.", [("C-AMT", "123.45", [], "", "unverifiable")]),
    ("You owe 50% of the total.", [("C-SUM", "50%", [], "total", "unverifiable")]),
    ("Half of the balance is fine.", [("C-SUM", "Half of the balance", [], "total", "unverifiable")]),
    ("Your account manager approved it.", [("C-FUZZY", "", [], "", None)]),
    ("Thank you for your patience.", []),
]


def test_claims_and_checks(judge):
    got = judge([s for s, _ in CASES])
    for (sentence, want), found in zip(CASES, got):
        assert found == want, sentence


def test_repeated_claims_are_one(judge):
    (found,) = judge(["INV-1011 is overdue.\nINV-1011 is overdue.\nSee INV-1011."])
    assert [c[:2] for c in found] == [("C-EXIST", "INV-1011"), ("C-STATUS", "overdue")]


@pytest.fixture(scope="module")
def decided(spark, books):
    """Decisions on named drafts of S-1, in revision 0 to 2."""
    scenarios = ledger.view(books).cache()
    good = render.golden(scenarios).select("scenario_id", F.col("draft").alias("good"))
    spoil = {
        "good": F.col("good"), "fake": F.concat("good", F.lit("\nSee INV-9.")), "loose": F.concat("good", F.lit("\nIt was 123.45 once.")), "wrong": F.concat("good", F.lit("\nINV-1012 is overdue.")),
        "fuzzy": F.concat("good", F.lit("\nYour manager approved it.")), "short": F.lit("The balance due on your account is $2,150.00."), "empty": F.lit(None).cast("string"),
    }
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), text.alias("draft")) for name, text in spoil.items())))
    rows = good.select("scenario_id", each.alias("x")).select("scenario_id", "x.*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("revision_index"))
    drafts = rows.withColumn("draft_id", F.concat_ws("/", "scenario_id", "name", "revision_index")).join(scenarios, "scenario_id").cache()
    verdicts = spark.createDataFrame([("S-1/fuzzy/0", "c", True, "unsupported", [], ""), ("S-1/fuzzy/1", "c", True, "supported", ["INV-1011"], ""), ("S-1/fuzzy/2", "c", True, "supported", ["INV-77"], "")], "draft_id string, claim_id string, ok boolean, verdict string, cited array<string>, reason string")
    claims = extract_claims(drafts).cache()
    fuzzy = claims.where("type = 'C-FUZZY'").select("draft_id", "claim_id")
    checked = check_claims(claims, drafts, verdicts.drop("claim_id").join(fuzzy, "draft_id"))
    return {r.draft_id: r for r in gate.decide(drafts, checked).collect()}


@pytest.mark.parametrize(("draft", "action", "reason"), [
    ("S-1/good/0", "human_gate", gate.PASSED), ("S-1/fake/0", "escalate", gate.FABRICATED), ("S-1/loose/0", "escalate", gate.UNVERIFIABLE), ("S-1/wrong/1", "revise", gate.CORRECTABLE),
    ("S-1/wrong/2", "escalate", gate.EXHAUSTED), ("S-1/fuzzy/0", "revise", gate.UNSUPPORTED), ("S-1/fuzzy/1", "human_gate", gate.PASSED), ("S-1/fuzzy/2", "escalate", gate.UNDETERMINED),
    ("S-1/short/0", "revise", gate.INCOMPLETE), ("S-1/short/2", "escalate", gate.INCOMPLETE), ("S-2/good/0", "abstain", gate.AMBIGUOUS), ("S-1/empty/0", "human_gate", gate.PASSED),
])
def test_decisions(decided, draft, action, reason):
    assert (decided[draft].action, decided[draft].reason) == (action, reason)


def test_correction_and_payload(decided):
    assert decided["S-1/wrong/0"].payload == "The ledger shows outstanding for INV-1012; your draft says overdue."
    assert [f.kind for f in decided["S-1/short/0"].findings] == ["missing_open_invoices_itemized", "missing_unapplied_cash_mentioned"]
    assert decided["S-2/good/0"].payload == "PMT-0001 could apply to any of: INV-1, INV-2"


def test_itemization_must_add_up(spark):
    """Original amounts listed as owed contradict the total, though each figure is true."""
    one = (1, "S-9", "A", [], ("CL-9", "Cog", 30, DAY(2026, 3, 31)), [("INV-1", DAY(2026, 1, 5), DAY(2026, 2, 4), 100000, ""), ("INV-2", DAY(2026, 1, 6), DAY(2026, 2, 5), 200000, "")], [("PMT-1", DAY(2026, 2, 1), 50000, "ach", "")], [], [("PMT-1", "INV-1", 50000)])
    scenarios = ledger.view(from_documents(spark.createDataFrame([one], LEDGER)))
    text = "The balance due on your account is $2,500.00.\n- INV-1: {}.\n- INV-2: $2,000.00."
    rows = spark.createDataFrame([("bad", text.format("$1,000.00")), ("right", text.format("$500.00"))], "draft_id string, draft string")
    got = {r.draft_id: r for r in rounds.verify(rows.crossJoin(scenarios).withColumn("revision_index", F.lit(0)))[2].collect()}
    assert (got["bad"].reason, got["right"].reason) == (gate.ITEMIZATION, gate.PASSED)
    assert "INV-1 $500.00, INV-2 $2,000.00" in got["bad"].payload


def test_gaps_and_scores(spark, books, decided):
    rows = spark.createDataFrame([(r.draft_id, r.scenario_id, r.action, r.reason, r.payload) for r in decided.values()], "draft_id string, scenario_id string, action string, reason string, payload string")
    got = {r.missing: r.gap_count for r in gate.aggregate_gaps(gate.derive_gaps(rows)).collect()}
    assert got["document_absent"] == 9 and got["unverifiable_quant"] == 6 and got["ambiguous_reference"] == 4
    drafts = render.golden(ledger.view(books)).withColumn("draft_id", F.col("scenario_id"))
    items = score.completeness(score.completeness_items(drafts, check_claims(extract_claims(drafts), drafts)))
    assert {(r.draft_id, r.completeness_present, r.completeness_total) for r in items.collect()} == {("S-1", 3, 3), ("S-2", 3, 3)}


def test_independent_judgement(spark, books):
    rows = [("a", "INV-1011 has $3,450.00 open. Net is $2,150.00."), ("b", "INV-1011 has $5,000.00 open. INV-7."), ("c", "INV-1011 and INV-1012: $5,000.00. Zero: $0.00."), ("d", None)]
    drafts = spark.createDataFrame([(i, "S-1", t) for i, t in rows], "draft_id string, scenario_id string, draft string")
    got = {r.draft_id: (r.verified, r.total) for r in oracle.grounding(drafts, oracle.figures(books)).collect()}
    assert got == {"a": (3, 3), "b": (1, 3), "c": (3, 4), "d": (0, 0)}


def test_rounds_stop(spark, books):
    scenarios = ledger.view(books).cache()
    good = render.golden(scenarios).where("scenario_id = 'S-1'").first()["draft"]
    bad, worse = good + "\nINV-1012 is overdue.", good + "\nINV-1012 is settled."
    run = lambda *texts: [(r.revision_index, r.action, r.reason) for r in rounds.run_scenarios(scenarios, spark.createDataFrame([("S-1", i, t) for i, t in enumerate(texts)], "scenario_id string, revision_index int, draft string")).where("scenario_id = 'S-1'").orderBy("revision_index").collect()]
    assert run(bad, good) == [(0, "revise", gate.CORRECTABLE), (1, "human_gate", gate.PASSED)]
    assert run(bad, bad, good) == [(0, "revise", gate.CORRECTABLE), (1, "escalate", gate.LOOP)]
    assert run(bad, worse, good + "\nINV-1012 is paid.")[-1] == (2, "escalate", gate.EXHAUSTED)


@pytest.mark.parametrize(("cents", "want"), [(123456, 132456), (100, 10), (1123, 1213), (5, None), (777, None), (0, None), (-120, None), (21, 12), (1121, 1211), (200, 20), (10, 1)])
def test_transposed_digits(spark, cents, want):
    """The first two different neighbours behind the leading digit; only if there are none, the leading pair."""
    assert spark.range(1).select(F.expr(corrupt.transpose(f"{cents}L"))).first()[0] == want


def test_errors_and_their_tiers(spark, books):
    scenarios = render.golden(ledger.view(books))
    got = {(r.scenario_id, r.error): r for r in rounds.errors_run(scenarios).collect()}
    good = {r.scenario_id: r for r in scenarios.collect()}
    texts = {(r.scenario_id, r.error): r.draft for r in corrupt.variants(scenarios).collect()}
    assert ("S-2", "clean") not in got and ("S-1", "ambiguous") not in got  # S-2 is the ambiguous one
    assert not got["S-1", "clean"].caught and got["S-2", "ambiguous"].caught and got["S-2", "ambiguous"].action == "abstain"
    assert all(r.caught for (_, error), r in got.items() if error != "clean")
    assert {r.tier for r in got.values()} == {0, 1, 2, 3, 4}
    swapped = texts["S-1", "swap_amount"]
    changed = [(a, b) for a, b in zip(good["S-1"].draft.split(), swapped.split()) if a != b]
    assert len(changed) == 1 and sorted(changed[0][0]) == sorted(changed[0][1]) and changed[0][0].startswith("$")
    assert got["S-1", "swap_amount"].action == "revise" and got["S-1", "fabricate_id"].action == "escalate"
    fake = set(texts["S-1", "fabricate_id"].split()) - set(good["S-1"].draft.split())
    assert fake == {"INV-9000"}
    told = {(r.scenario_id, r.error): r.prompt for r in corrupt.misreading_requests(scenarios.withColumn("prompt", F.lit("Draft."))).collect()}
    assert set(told) == {k for k in texts if k[1] in corrupt.DIRECTIVES} and all(p.startswith("Draft.\n\nIMPORTANT OVERRIDE: ") for p in told.values())


def test_failed_subjects_and_recovery(spark, books):
    text = "INV-1012 is overdue. INV-1011 was issued for $1.00. INV-1012 is settled. INV-9 is odd."
    drafts = ledger.view(books).where("scenario_id = 'S-1'").withColumns({"draft": F.lit(text), "draft_id": F.lit("d")})
    checked = check_claims(extract_claims(drafts), drafts)
    assert [r.subjects for r in rounds.failed_subjects(checked).collect()] == [["INV-1012", "INV-1011"]]
    errors = spark.createDataFrame([("a", "S-1", "swap_amount", "revise", "r"), ("b", "S-1", "fabricate_id", "escalate", "r"), ("c", "S-1", "break_sum", "revise", "r")], "draft_id string, scenario_id string, error string, action string, reason string")
    prompted = spark.createDataFrame([("a", "human_gate", 1), ("c", "escalate", 2)], "draft_id string, action string, llm_calls int")
    agentic = spark.createDataFrame([("a", "human_gate", 3, 4, False, False)], "draft_id string, action string, llm_calls int, tool_calls int, forced_final boolean, coverage_forced boolean")
    got = {r.draft_id: r for r in rounds.recovery_bench(errors, prompted, agentic).collect()}
    assert set(got) == {"a", "c"} and got["a"].prompt_recovered and got["a"].agentic_recovered and got["a"].agentic_tool_calls == 4
    assert not got["c"].prompt_recovered and got["c"].agentic_recovered is None


def test_prompts(spark):
    template = "About.\n\n[SYSTEM]\nBe right.\n\n[USER]\nSentence: {{claim_sentence}}\n\n\n{{ledger_records}}\n"
    row = spark.range(1).select(render.claim_prompt(template, F.lit("R"), F.lit("It is so.")).alias("p")).first().p
    assert (row.system, row.user) == ("Be right.", "Sentence: It is so.\n\nR")
    two = "[SYSTEM]\nJudge.\n[USER]\n{{ledger_block}}|{{draft_1}}|{{draft_2}}"
    assert spark.range(1).select(render.judge_prompt(two, F.lit("L"), F.lit("a"), F.lit("b")).alias("p")).first().p.user == "L|a|b"
    with pytest.raises(ValueError):
        render.sections("[SYSTEM]\nonly")


def test_sentences_are_searched_only_for_what_they_can_hold(spark):
    """Without a digit only worded amounts are searched for, in any language; letters that fold to ASCII ones, and other digits, count."""
    from ledgerloom.operators import extract

    assert extract._detected().count("if(digit and (") == len(extract.DATES) + sum(digits for *_, digits in extract.AMOUNTS)
    told = {"Pay 5 dollarſ é.": 1, "Pay USD 5 é.": 1, "Pay uſd 5.": 1, "Seven dollarſ are due.": 1, "One thırd of your balance.": 1, "Né à Paris, hier.": 0, "Pay $٥.": 1, "It is 5 PERCENT.": 1}
    rows = spark.createDataFrame(list(enumerate(told)), "draft_id int, draft string").selectExpr("*", "cast(array() as array<struct<id:string>>) as docs")
    assert [r.n for r in extract.detect(rows).selectExpr("draft_id", "size(amounts) as n").orderBy("draft_id").collect()] == list(told.values())
