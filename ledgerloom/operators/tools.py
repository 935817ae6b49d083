"""Lookups on a ledger, by parameter; a table of requests is answered in one plan, and SQL calls them as table functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import let, render
from ledgerloom.functions.text import document_argument, loose_name, reference
from ledgerloom.operators.ledger import SID, document_facts, documents, invoice_facts, signature, source_facts, totals
from ledgerloom.sources.shared import saved
from ledgerloom.sources.tables import Ledger

FIGURES = ("open_invoice_total", "unapplied_cash_total", "unapplied_credit_total", "net_balance")


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    """Each column of cents also as text."""
    return df.select(*df.columns, *(F.expr(render(c)).alias(c.removesuffix("_cents") + "_text") for c in columns))


def account_summary(ledger: Ledger) -> DataFrame:
    rows = ledger.client.select(SID, "client_id", "name", "as_of").join(totals(ledger), SID).join(signature(ledger), SID)
    return _shown(rows, *FIGURES)


def _invoices(ledger: Ledger) -> DataFrame:
    rows = invoice_facts(ledger).select(SID, "pos", "id", "date", "due", F.col("amount_cents").alias("original_cents"), "applied_cents", "open_cents", "status", "memo")
    return _shown(rows, "original_cents", "applied_cents", "open_cents")


def _texts(ledger: Ledger) -> DataFrame:
    """Free text of sources by id."""
    return ledger.payment.select(SID, "id", "method", "reference", F.lit(None).cast("string").alias("reason")).unionByName(ledger.credit_memo.select(SID, "id", F.lit(None).cast("string").alias("method"), F.lit(None).cast("string").alias("reference"), "reason"))


def _sources(ledger: Ledger) -> DataFrame:
    rows = source_facts(ledger).withColumnRenamed("amount_cents", "original_cents").join(_texts(ledger), [SID, "id"])
    return _shown(rows.withColumnRenamed("kind", "type"), "original_cents", "applied_cents", "unapplied_cents")


def open_invoices(ledger: Ledger) -> DataFrame:
    return _invoices(ledger).where("open_cents > 0")


def unapplied_sources(ledger: Ledger) -> DataFrame:
    """In order: payments, then credit memos."""
    return _sources(ledger).where("unapplied_cents > 0")


def _by_name(ledger: Ledger) -> DataFrame:
    """Documents, their free text and their applications, met under each loose name (see functions.text.loose_name): one shuffle of all three."""
    kinds = {
        "doc": document_facts(ledger).select(SID, F.struct("id", "kind_rank", "pos", "kind", "date", "due", F.col("amount_cents").alias("original_cents"), "applied_cents", "open_cents", "status", "memo").alias("doc")),
        "text": _texts(ledger).select(SID, F.struct("id", "method", "reference", "reason").alias("text")),
        "use": ledger.application.select(SID, F.inline(F.array(*(F.struct(F.struct(F.col(mine).alias("id"), F.lit(billed).alias("billed"), "pos", F.col(other).alias("other"), "amount_cents").alias("use")) for mine, other, billed in (("target_invoice", "source_id", True), ("source_id", "target_invoice", False)))))),
    }
    rows = None
    for kind, one in kinds.items():
        given = one.select(SID, F.expr(loose_name(f"{kind}.id")).alias("name"), *(F.col(k) if k == kind else F.lit(None).cast(df.schema[k].dataType).alias(k) for k, df in kinds.items()))
        rows = given if rows is None else rows.unionByName(given)
    return rows.repartition(SID, "name").groupBy(SID, "name").agg(*(F.collect_list(k).alias(f"{k}s") for k in kinds))


def _asked(ledger: Ledger, wanted: DataFrame) -> DataFrame:
    """wanted (scenario_id, argument and others) with the canonical id and kind of what it names, and own, texts and uses of this id.

    An argument meets the documents of its loose name only, so that no ledger is copied for each of its requests.
    """
    rows = wanted.withColumn("r_", F.expr(reference("argument"))).withColumn("name", F.expr(loose_name("r_.id"))).join(_by_name(ledger), [SID, "name"], "left")
    ids = "array_distinct(transform(docs, d_ -> d_.id))"
    rows = rows.withColumn("id", F.expr(f"if(r_.ref and size({ids}) = 1, docs[0].id, r_.id)"))
    own = {c: F.expr(f"filter({given}, d_ -> d_.id = id)") for c, given in (("own", "docs"), ("texts", "texts"), ("uses", "uses"))}
    rows = rows.withColumns(own).withColumn("kind", F.expr("array_min(transform(own, d_ -> named_struct('kind_rank', d_.kind_rank, 'kind', d_.kind))).kind"))
    return rows.drop("r_", "name", "docs")


def _detail(cents: tuple[str, ...], more: dict[str, str], billed: bool, other: str) -> dict[str, Column]:
    """Columns of a document d with its texts and uses: its own, cents also as text, and its applications (null if none)."""
    pairs = f"sort_array(transform(filter(uses, u_ -> u_.billed = {str(billed).lower()}), u_ -> named_struct('pos', u_.pos, 'other', u_.other, 'amount_cents', u_.amount_cents)))"
    applied = f"transform({pairs}, u_ -> named_struct('{other}', u_.other, 'amount_cents', u_.amount_cents))"
    shown = {c.removesuffix("_cents") + "_text": render(more[c]) for c in cents}
    return {name: F.expr(e).alias(name) for name, e in (more | shown | {"applications": let(applied, "a_", "if(size(a_) > 0, a_, null)")}).items()}


def _invoice_columns() -> dict[str, Column]:
    own = {c: f"d.{c}" for c in ("pos", "date", "due", "original_cents", "applied_cents", "open_cents", "status", "memo")}
    return _detail(("original_cents", "applied_cents", "open_cents"), own, True, "source_id")


def _source_columns() -> dict[str, Column]:
    own = {"type": "d.kind", **{c: f"d.{c}" for c in ("kind_rank", "pos", "date", "original_cents", "applied_cents")}, "unapplied_cents": "d.open_cents", **{c: f"get(texts, 0).{c}" for c in ("method", "reference", "reason")}}
    return _detail(("original_cents", "applied_cents", "unapplied_cents"), own, False, "target_invoice")


INVOICE_ERROR = "case when kind = 'invoice' then null else concat('unknown invoice id: ', id) end"
SOURCE_ERROR = "case when kind in ('payment', 'credit_memo') then null when kind = 'invoice' then concat(id, ' is an invoice; use get_invoice') else concat('unknown source id: ', id) end"


def invoice_detail(ledger: Ledger, wanted: DataFrame) -> DataFrame:
    """One invoice for each argument, with its applications; error is set for an unknown one."""
    rows = _asked(ledger, wanted).withColumn("d", F.explode_outer(F.filter("own", lambda d: d["kind_rank"] == 0)))
    return rows.select(*wanted.columns, "id", F.expr(INVOICE_ERROR).alias("error"), *_invoice_columns().values())


def source_detail(ledger: Ledger, wanted: DataFrame) -> DataFrame:
    rows = _asked(ledger, wanted).withColumn("d", F.explode_outer(F.filter("own", lambda d: d["kind_rank"] > 0)))
    return rows.select(*wanted.columns, "id", F.expr(SOURCE_ERROR).alias("error"), *_source_columns().values())


def application_history(ledger: Ledger) -> DataFrame:
    """Every application with its source's type."""
    kinds = source_facts(ledger).select(SID, F.col("id").alias("source_id"), F.col("kind").alias("source_type"))
    return _shown(ledger.application.join(kinds, [SID, "source_id"], "left").select(SID, "pos", "source_id", "source_type", "target_invoice", "amount_cents"), "amount_cents")


def applied_totals(ledger: Ledger) -> DataFrame:
    """Applied cents of every invoice and every source, zeros too."""
    own = invoice_facts(ledger).select(SID, F.lit("invoice").alias("kind"), "id", "applied_cents")
    return own.unionByName(source_facts(ledger).select(SID, "kind", "id", "applied_cents"))


#: Lookups by name: their parameter, if they have one, the function, and what it tells.
CATALOG: dict[str, tuple[str | None, Callable, str]] = {
    "get_account_summary": (None, account_summary, "Totals of the account, its net balance and its structural conditions."),
    "list_open_invoices": (None, open_invoices, "The invoices with something open: amounts, status and memo."),
    "get_invoice": ("invoice_id", invoice_detail, "One invoice with what was applied to it; forms like 'inv 12' are understood."),
    "list_unapplied_sources": (None, unapplied_sources, "The payments and credit memos with something unapplied."),
    "get_source": ("source_id", source_detail, "One payment or credit memo with what was applied from it; not for invoices."),
    "get_application_history": (None, application_history, "All applications, and what was applied of each document."),
}
REQUEST = "request_id, scenario_id, tool_name, arguments"


def catalog() -> list[dict]:
    """name, description and parameters (JSON Schema) of each lookup."""
    told = []
    for name, (parameter, _, description) in CATALOG.items():
        kinds = {parameter: {"type": "string"}} if parameter else {}
        told.append({"name": name, "description": description, "parameters": {"type": "object", "properties": kinds, "additionalProperties": False} | ({"required": [parameter]} if parameter else {})})
    return told


def validated(requests: DataFrame) -> DataFrame:
    """requests with argument (null if the tool takes none) and error, null if tool and arguments are right."""
    takes = F.create_map(*(x for name, (p, *_) in CATALOG.items() for x in (F.lit(name), F.array(*([F.lit(p)] if p else [])).cast("array<string>"))))
    rows = requests.withColumn("takes", F.try_element_at(takes, F.coalesce("tool_name", F.lit(""))))
    rows = rows.withColumn("given", F.expr("try_variant_get(try_parse_json(arguments), '$', 'map<string,variant>')"))
    rows = rows.withColumn("value", F.expr("if(size(takes) = 1, given[takes[0]], null)"))
    error = F.when(F.col("takes").isNull(), F.concat(F.lit("unknown tool: "), F.coalesce("tool_name", F.lit("none"))))
    error = error.when(F.col("given").isNull(), "arguments must be a JSON object")
    error = error.when(F.expr("map_keys(given) <> takes"), F.concat("tool_name", F.lit(" takes ["), F.array_join("takes", ", "), F.lit("]")))
    error = error.when(F.expr("size(takes) = 1 and schema_of_variant(value) <> 'STRING'"), F.concat(F.expr("takes[0]"), F.lit(" must be a string")))
    return rows.select(*requests.columns, F.expr("try_variant_get(value, '$', 'string')").alias("argument"), error.alias("error"))


def _as_json(df: DataFrame) -> Column:
    return F.struct(*(c for c in df.columns if c not in {SID, "pos", "kind_rank"}))


def _listed(rows: DataFrame, *order: str, name: str = "data") -> DataFrame:
    """A list for each scenario, in this order."""
    each = F.struct(*order, _as_json(rows).alias("row"))
    return rows.groupBy(SID).agg(F.transform(F.sort_array(F.collect_list(each)), lambda x: x["row"]).alias(name))


def _for_all(ledger: Ledger, lists: DataFrame, *names: str) -> DataFrame:
    """Scenarios without rows have empty lists."""
    rows = ledger.client.select(SID).join(lists, SID, "left")
    return rows.select(SID, *(F.coalesce(c, F.array().cast(lists.schema[c].dataType)).alias(c) for c in names))


def _answers(ledger: Ledger, name: str) -> DataFrame:
    """scenario_id, data (JSON) of a lookup without a parameter."""
    run = CATALOG[name][1]
    if name == "get_account_summary":
        rows = run(ledger)
        return rows.select(SID, F.to_json(_as_json(rows)).alias("data"))
    if name == "get_application_history":
        used = applied_totals(ledger).withColumnRenamed("id", "pos").withColumn("id", F.col("pos"))
        lists = _listed(run(ledger), "pos", name="applications").join(_listed(used, "pos", name="applied"), SID, "full")
        return _for_all(ledger, lists, "applications", "applied").select(SID, F.to_json(F.struct("applications", "applied")).alias("data"))
    order = ("pos",) if name == "list_open_invoices" else ("kind_rank", "pos")
    return _for_all(ledger, _listed(run(ledger), *order), "data").select(SID, F.to_json("data").alias("data"))


def run_requests(ledger: Ledger, requests: DataFrame) -> DataFrame:
    """request_id, scenario_id, tool_name, ok, error, data for a table of requests, all six lookups in one plan.

    requests: request_id, scenario_id, tool_name, arguments (JSON text). data is JSON text, null with an
    error: an unknown tool, arguments that break the tool's schema, an unknown scenario, an unknown or
    wrong kind of document. No request fails the query; repeated ones are answered each. Lookups of a
    scenario run for those that are asked it, and meet their requests by a join on the scenario; those
    of a document meet them on the document's name, so a ledger isn't copied for each of its requests.
    """
    checked = saved(validated(requests.select(*REQUEST.split(", "))), "requests")
    none = lambda c: F.lit(None).cast("string").alias(c)
    told = [checked.where("error is not null").select("request_id", SID, "tool_name", "error", none("data"))]
    right = checked.where("error is null")
    plain = [name for name, (parameter, *_) in CATALOG.items() if not parameter]
    asks = right.where(F.col("tool_name").isin(plain))
    wanted = asks.select(SID).distinct()
    some = lambda df: df.join(wanted, SID, "left_semi")
    own = Ledger(some(ledger.client), some(ledger.invoice), some(ledger.payment), some(ledger.credit_memo), some(ledger.application), None if ledger.facts is None else some(ledger.facts))
    found = None
    for name in plain:
        one = _answers(own, name).select(F.lit(name).alias("tool_name"), SID, "data")
        found = one if found is None else found.unionByName(one)
    rows = asks.drop("error").join(found, ["tool_name", SID], "left")
    strange = F.concat(F.lit("unknown scenario: "), F.coalesce(SID, F.lit("none")))
    told.append(rows.select("request_id", SID, "tool_name", F.when(F.col("data").isNull(), strange).alias("error"), "data"))
    known = ledger.client.select(SID, F.lit(True).alias("known")).distinct()
    rows = _asked(ledger, right.where(~F.col("tool_name").isin(plain)).select("request_id", SID, "tool_name", "argument")).join(known, SID, "left")
    rows = rows.withColumn("of_invoice", F.col("tool_name") == "get_invoice").withColumn("d", F.explode_outer(F.expr("filter(own, d_ -> (d_.kind_rank = 0) = of_invoice)")))
    rows = rows.withColumn("error", F.when(F.col("known").isNull(), strange).otherwise(F.expr(f"if(of_invoice, {INVOICE_ERROR}, {SOURCE_ERROR})")))
    as_json = lambda columns: F.to_json(F.struct("id", *(c for name, c in columns.items() if name not in {"pos", "kind_rank"})))
    data = F.when(F.col("error").isNotNull(), F.lit(None)).when(F.col("of_invoice"), as_json(_invoice_columns())).otherwise(as_json(_source_columns()))
    told.append(rows.select("request_id", SID, "tool_name", "error", data.alias("data")))
    rows = told[0]
    for one in told[1:]:
        rows = rows.unionByName(one)
    return rows.select("request_id", SID, "tool_name", F.col("error").isNull().alias("ok"), "error", "data")


def register(ledger: Ledger) -> None:
    """The lookups as table functions of a session: ``select .. from asked, lateral get_invoice(scenario_id, 'inv 12')``.

    Those without a parameter take the scenario alone. Spark turns the lateral calls of a query into joins.
    """
    spark = ledger.client.sparkSession
    for name, (parameter, run, _) in CATALOG.items():
        if parameter:  # by canonical id; an argument is resolved by the function's own condition
            rows = run(ledger, documents(ledger).where(F.col("kind").isin(*(("invoice",) if name == "get_invoice" else ("payment", "credit_memo")))).select(SID, F.col("id").alias("argument"))).drop("error", "argument")
        else:
            rows = run(ledger)
        rows.createOrReplaceTempView(f"{name}_rows")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != SID)
        where = f"r.{SID} = {name}.scenario" + (f" and r.id = {document_argument(f'{name}.{parameter}', 'array(r.id)')}" if parameter else "")
        given = "scenario string" + (f", {parameter} string" if parameter else "")
        chosen = ", ".join(f"r.`{f.name}`" for f in rows.schema if f.name != SID)
        spark.sql(f"create or replace temporary function {name}({given}) returns table ({columns}) return select {chosen} from {name}_rows r where {where}")
