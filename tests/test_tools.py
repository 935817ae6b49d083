"""Lookups: a table of requests against each lookup alone, their schemas, and SQL's table functions."""

import json

import pytest

from ledgerloom.functions.text import document_argument
from ledgerloom.operators import ledger, tools
from ledgerloom.sources.tables import order_ledger
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def books(spark):
    return order_ledger(spark, SMALL)


def asked(spark, *rows):
    return spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "request_id string, scenario_id string, tool_name string, arguments string")


def test_answers_are_those_of_each_lookup(spark, books):
    document = {r.kind: r for r in ledger.documents(books).where("scenario_id = 'S-2'").collect()}
    invoice, payment = document["invoice"].id, document["payment"].id
    rows = [("S-2", name, "{}") for name in tools.CATALOG if not tools.CATALOG[name][0]]
    rows += [("S-2", "get_invoice", json.dumps({"invoice_id": invoice.lower().replace("-", " ")})), ("S-2", "get_source", json.dumps({"source_id": payment})), ("S-2", "get_account_summary", "{}")]
    got = {int(r.request_id): r for r in tools.run_requests(books, asked(spark, *rows)).collect()}
    assert all(r.ok and r.error is None for r in got.values()) and len(got) == len(rows)
    data = [json.loads(got[i].data) for i in range(len(rows))]
    own = lambda df: df.where("scenario_id = 'S-2'").orderBy("pos").collect()
    assert data[0] == data[-1] and data[0]["net_balance"] == ledger.totals(books).where("scenario_id = 'S-2'").first().net_balance
    assert [x["id"] for x in data[1]] == [r.id for r in own(tools.open_invoices(books))] and all(x["open_text"].startswith("$") for x in data[1])
    assert {x["id"] for x in data[2]} == {r.id for r in own(tools.unapplied_sources(books))}
    assert [(x["source_id"], x["target_invoice"]) for x in data[3]["applications"]] == [(r.source_id, r.target_invoice) for r in own(tools.application_history(books))]
    assert {(x["id"], x["applied_cents"]) for x in data[3]["applied"]} == {(r.id, r.applied_cents) for r in tools.applied_totals(books).where("scenario_id = 'S-2'").collect()}
    assert data[4]["id"] == invoice and data[5]["id"] == payment


def test_no_request_fails_the_query(spark, books):
    invoice = books.invoice.where("scenario_id = 'S-1'").first().id
    wrong = {
        ("S-1", "nope", "{}"): "unknown tool: nope", ("S-1", None, "{}"): "unknown tool: none", ("S-1", "get_invoice", "{}"): "get_invoice takes [invoice_id]", ("S-1", "get_invoice", '{"invoice_id": 3}'): "invoice_id must be a string",
        ("S-1", "get_invoice", '{"invoice_id": null}'): "invoice_id must be a string", ("S-1", "get_invoice", "[]"): "arguments must be a JSON object", ("S-1", "get_invoice", None): "arguments must be a JSON object", ("S-1", "get_invoice", "{"): "arguments must be a JSON object",
        ("S-1", "list_open_invoices", '{"a": 1}'): "list_open_invoices takes []", ("S-x", "get_account_summary", "{}"): "unknown scenario: S-x", (None, "list_open_invoices", "{}"): "unknown scenario: none", ("S-x", "get_invoice", '{"invoice_id": "INV-1"}'): "unknown scenario: S-x",
        ("S-1", "get_source", json.dumps({"source_id": invoice})): f"{invoice} is an invoice; use get_invoice", ("S-1", "get_source", '{"source_id": "PMT-0"}'): "unknown source id: PMT-0", ("S-1", "get_invoice", '{"invoice_id": ""}'): "unknown invoice id: ",
    }
    got = {(r.scenario_id, r.tool_name, r.request_id): r for r in tools.run_requests(books, asked(spark, *wrong, *wrong)).collect()}
    assert len(got) == 2 * len(wrong)
    keys = list(wrong)
    for (_, _, i), r in got.items():
        assert (r.ok, r.error, r.data) == (False, wrong[keys[int(i) % len(keys)]], None)
    assert tools.run_requests(books, asked(spark, ("S", "t", "a")).limit(0)).count() == 0


def test_the_catalog_is_json_schema():
    told = tools.catalog()
    assert [t["name"] for t in told] == list(tools.CATALOG) and all(t["description"] for t in told)
    by = {t["name"]: t["parameters"] for t in told}
    assert by["get_source"] == {"type": "object", "properties": {"source_id": {"type": "string"}}, "additionalProperties": False, "required": ["source_id"]}
    assert "required" not in by["list_open_invoices"]


def test_lookups_are_table_functions(spark, books):
    tools.register(books)
    asks = ledger.documents(books).selectExpr("scenario_id", "lower(replace(id, '-', ' ')) as argument", "id", "kind")
    asks.createOrReplaceTempView("asks")
    got = spark.sql("select a.id, g.id as found, g.open_cents from asks a, lateral get_invoice(a.scenario_id, a.argument) g").collect()
    want = {(r.id, r.id, r.open_cents) for r in ledger.invoice_facts(books).collect()}
    assert {tuple(r) for r in got} == want
    assert spark.sql("select count(*) from asks a, lateral get_source(a.scenario_id, a.argument) g where g.id = a.id").first()[0] == asks.where("kind <> 'invoice'").count()
    plan = spark.sql("select * from (select distinct scenario_id from asks) a, lateral list_open_invoices(a.scenario_id)")
    assert plan.count() == tools.open_invoices(books).count()
    assert spark.sql("select net_balance from get_account_summary('S-1')").first()[0] == ledger.totals(books).where("scenario_id = 'S-1'").first().net_balance


def test_no_ledger_is_copied_for_each_request(spark, books):
    """Arguments meet documents by name: no array of all of a scenario's ids is joined to its requests."""
    asks = asked(spark, *((r.scenario_id, "get_source", json.dumps({"source_id": r.id})) for r in books.payment.limit(20).collect()))
    found = tools.run_requests(books, asks)
    assert "collect_set" not in found._jdf.queryExecution().analyzed().toString()
    assert found.where("ok").count() == 20


def test_names_resolve_as_they_do_among_all_ids(spark, books):
    """Zeros before a number, ids that differ by them only, other ids and odd arguments: as functions.text.document_argument tells."""
    ids = ["INV-7", "INV-007", "INV-012", "PMT-5", "CM-0", "X-03", "odd"]
    day = "cast('2000-01-01' as date)"
    invoice = spark.createDataFrame([("S", n, i) for n, i in enumerate(ids)], "scenario_id string, pos long, id string").selectExpr("*", f"{day} as date", f"{day} as due", "100L as amount_cents", "'' as memo")
    client = spark.createDataFrame([("S", "A", "c", "n", 30)], "scenario_id string, pool string, client_id string, name string, terms_days int").selectExpr("*", f"{day} as as_of")
    few = type(books)(client, invoice, books.payment.limit(0), books.credit_memo.limit(0), books.application.limit(0))
    given = ["inv-7", "INV 007", "Inv_0007", "invoice no. 12", "INV-12", " inv 12 ", "pmt5", "credit memo #00", "cm 9", "X-03", "X-3", "odd", "", "payment number 05", "INV--7", "INV-٧", "cm0"]
    wanted = spark.createDataFrame([("S", g) for g in given], "scenario_id string, argument string")
    got = {r.argument: r.id for r in tools.invoice_detail(few, wanted).collect()}
    array = "array(" + ", ".join(f"'{i}'" for i in ids) + ")"
    want = {r.argument: r.id for r in wanted.selectExpr("argument", f"{document_argument('argument', array)} as id").collect()}
    assert got == want and got["Inv_0007"] == "INV-0007" and got["INV-12"] == "INV-012"
