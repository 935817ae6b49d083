"""Derived figures of ledgers: applied, open, unapplied, totals, status, ambiguity, signature, problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.schema import CUTOFF_DAYS, LABELS
from ledgerloom.sources.tables import Ledger, status

SID = "scenario_id"


def sources(ledger: Ledger) -> DataFrame:
    """Payments, then credit memos: kind, kind_rank, pos, id, date, amount_cents."""
    own = lambda df, kind, rank: df.select(SID, F.lit(kind).alias("kind"), F.lit(rank).alias("kind_rank"), "pos", "id", "date", "amount_cents")
    return own(ledger.payment, "payment", 1).unionByName(own(ledger.credit_memo, "credit_memo", 2))


def document_facts(ledger: Ledger) -> DataFrame:
    """All documents with as_of, memo, applied_cents (to an invoice, from a source), open_cents (what is left) and an invoice's status.

    One aggregation of the applications serves both their sides.
    """
    if ledger.facts is not None:
        return ledger.facts
    sides = F.array(F.struct(F.lit(True).alias("billed"), F.col("target_invoice").alias("id")), F.struct(F.lit(False).alias("billed"), F.col("source_id").alias("id")))
    used = ledger.application.select(SID, "amount_cents", F.inline(sides)).groupBy(SID, "billed", "id").agg(F.sum("amount_cents").alias("applied_cents"))
    own = ledger.invoice.select(SID, F.lit("invoice").alias("kind"), F.lit(0).alias("kind_rank"), "pos", "id", "date", "due", "amount_cents", "memo")
    docs = own.unionByName(sources(ledger).withColumn("due", F.lit(None).cast("date")).withColumn("memo", F.lit(None).cast("string"))).withColumn("billed", F.col("kind_rank") == 0)
    docs = docs.join(used, [SID, "billed", "id"], "left").drop("billed").withColumn("applied_cents", F.coalesce("applied_cents", F.lit(0)))
    docs = docs.withColumn("open_cents", F.col("amount_cents") - F.col("applied_cents")).join(ledger.client.select(SID, "as_of"), SID)
    return docs.withColumn("status", F.when(F.col("kind_rank") == 0, status()))


def invoice_facts(ledger: Ledger) -> DataFrame:
    """Invoices with applied_cents, open_cents and status: paid, overdue (due before as_of) or outstanding."""
    return document_facts(ledger).where("kind_rank = 0").select(SID, "pos", "id", "date", "due", "amount_cents", "memo", "applied_cents", "open_cents", "as_of", "status")


def applied_to_invoice(ledger: Ledger) -> DataFrame:
    """Applied cents of every invoice, 0 if none."""
    return invoice_facts(ledger).drop("open_cents", "as_of", "status")


def source_facts(ledger: Ledger) -> DataFrame:
    """Sources with applied_cents and unapplied_cents."""
    return document_facts(ledger).where("kind_rank > 0").select(SID, "kind", "kind_rank", "pos", "id", "date", "amount_cents", "applied_cents", F.col("open_cents").alias("unapplied_cents"))


TOTALS = {"open_invoice_total": "invoice", "unapplied_cash_total": "payment", "unapplied_credit_total": "credit_memo"}


def totals_of(opened: str = "open_cents") -> list[Column]:
    """The three totals of a group of documents."""
    return [F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(opened))), F.lit(0)).alias(c) for c, kind in TOTALS.items()]


def totals(ledger: Ledger) -> DataFrame:
    """open_invoice_total, unapplied_cash_total, unapplied_credit_total and net_balance of every scenario."""
    sums = document_facts(ledger).groupBy(SID).agg(*totals_of())
    found = ledger.client.select(SID).join(sums, SID, "left").select(SID, *(F.coalesce(c, F.lit(0)).alias(c) for c in TOTALS))
    return found.withColumn("net_balance", F.expr("open_invoice_total - unapplied_cash_total - unapplied_credit_total"))


def naive_net(ledger: Ledger) -> DataFrame:
    """The net balance from face amounts: an application takes as much from its invoice as from its source, so none is read. A cross-check of totals()."""
    signed = F.when(F.col("kind_rank") == 0, F.col("amount_cents")).otherwise(-F.col("amount_cents"))
    sums = documents(ledger).groupBy(SID).agg(F.sum(signed).alias("net_balance"))
    return ledger.client.select(SID).join(sums, SID, "left").select(SID, F.coalesce("net_balance", F.lit(0)).alias("net_balance"))


def ambiguous_allocations(ledger: Ledger) -> DataFrame:
    """Sources with something unapplied whose amount is the open amount of two or more invoices, with the candidates."""
    source = source_facts(ledger).where("unapplied_cents > 0").select(SID, "kind_rank", F.col("pos").alias("source_pos"), F.col("id").alias("source_id"), F.col("amount_cents").alias("cents"))
    invoice = invoice_facts(ledger).select(F.col(SID).alias("s"), F.col("open_cents").alias("o"), "pos", "id")
    pairs = source.join(invoice, (source[SID] == invoice.s) & (source.cents == invoice.o))
    found = pairs.groupBy(SID, "kind_rank", "source_pos", "source_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("candidates"))
    return found.where(F.size("candidates") >= 2)


def documents(ledger: Ledger) -> DataFrame:
    """All documents: kind, kind_rank (invoices first), pos, id, date, due (null for sources), amount_cents."""
    columns = (SID, "kind", "kind_rank", "pos", "id", "date", "due", "amount_cents")
    if ledger.facts is not None:
        return ledger.facts.select(*columns)
    own = ledger.invoice.select(SID, F.lit("invoice").alias("kind"), F.lit(0).alias("kind_rank"), "pos", "id", "date", "due", "amount_cents")
    return own.unionByName(sources(ledger).withColumn("due", F.lit(None).cast("date"))).select(*columns)


def find_document(ledger: Ledger, wanted: DataFrame) -> DataFrame:
    """wanted (scenario_id, id) with kind, date, due, amount_cents; an invoice before a payment before a credit memo."""
    best = documents(ledger).groupBy(SID, "id").agg(F.min(F.struct("kind_rank", "pos", "kind", "date", "due", "amount_cents")).alias("d"))
    return wanted.join(best, [SID, "id"], "left").select(SID, "id", F.coalesce("d.kind", F.lit("")).alias("kind"), "d.date", "d.due", "d.amount_cents")


def signature(ledger: Ledger) -> DataFrame:
    """Six booleans of every scenario, and labels, the names of the true ones in their order.

    One pass: documents are counted by the amounts that may agree (of two invoices, or of a source and
    the open amounts of invoices), and these counts are summed up by scenario.
    """
    invoice, rest = F.col("kind_rank") == 0, F.col("open_cents") > 0
    amount = lambda of, cents: F.struct(F.lit(of).alias("of"), F.col(cents).alias("cents"))
    compared = F.when(invoice, F.array(amount("face", "amount_cents"), amount("open", "open_cents"))).otherwise(F.array(F.when(rest, amount("open", "amount_cents")).otherwise(F.struct(F.lit("none").alias("of"), F.lit(0).cast("long").alias("cents")))))
    flags = {
        "partial": invoice & (F.col("applied_cents") > 0) & (F.col("applied_cents") < F.col("amount_cents")), "unapplied_cash": (F.col("kind") == "payment") & rest,
        "open_credit": (F.col("kind") == "credit_memo") & rest, "cutoff_risk": F.col("date") >= F.date_sub("as_of", CUTOFF_DAYS),
    }
    rows = document_facts(ledger).select(SID, invoice.alias("invoice"), *(t.alias(c) for c, t in flags.items()), F.inline(compared))
    each = rows.groupBy(SID, "of", "cents").agg(F.count_if("invoice").alias("invoices"), F.count_if(~F.col("invoice")).alias("sources"), *(F.bool_or(c).alias(c) for c in flags))
    several = F.col("invoices") > 1
    found = each.groupBy(SID).agg(F.bool_or((F.col("of") == "face") & several).alias("near_duplicate"), F.bool_or((F.col("of") == "open") & several & (F.col("sources") > 0)).alias("ambiguous"), *(F.bool_or(c).alias(c) for c in flags))
    bits = ledger.client.select(SID).join(found, SID, "left").select(SID, *(F.coalesce(c, F.lit(False)).alias(c) for c in LABELS))
    return bits.withColumn("labels", labels_of(LABELS))


def labels_of(names: tuple[str, ...]) -> Column:
    return F.filter(F.array(*(F.when(F.col(n), F.lit(n)) for n in names)), lambda x: x.isNotNull())


def validate(ledger: Ledger) -> DataFrame:
    """Problems: scenario_id, problem, id (of the document, or of the source for unknown targets)."""
    docs, client = documents(ledger), ledger.client.select(SID, "as_of")
    problem = lambda df, name, column="id": df.select(SID, F.lit(name).alias("problem"), F.col(column).alias("id"))
    known = docs.select(SID, "id", "kind_rank").distinct()
    of_source = known.where("kind_rank > 0").select(SID, F.col("id").alias("source_id")).distinct()
    of_invoice = known.where("kind_rank = 0").select(SID, F.col("id").alias("target_invoice")).distinct()
    dated = docs.join(client, SID).where(F.col("date") > F.col("as_of"))
    parts = [
        problem(docs.groupBy(SID, "id").count().where("count > 1"), "duplicate id"),
        problem(ledger.application.join(of_source, [SID, "source_id"], "left_anti"), "application from unknown source", "source_id"),
        problem(ledger.application.join(of_invoice, [SID, "target_invoice"], "left_anti"), "application to unknown invoice", "target_invoice"),
        problem(invoice_facts(ledger).where("open_cents < 0"), "over-applied invoice"),
        problem(source_facts(ledger).where("unapplied_cents < 0 and kind = 'payment'"), "over-applied payment"),
        problem(source_facts(ledger).where("unapplied_cents < 0 and kind = 'credit_memo'"), "over-applied credit memo"),
        problem(ledger.invoice.where("due < date"), "due before date"),
        problem(dated.where("kind = 'invoice'"), "invoice after as_of"),
        problem(dated.where("kind = 'payment'"), "payment after as_of"),
        problem(dated.where("kind = 'credit_memo'"), "credit memo after as_of"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def parts(ledger: Ledger) -> int:
    """Partitions of documents by scenario: as many as the session's, more where the order tables are large."""
    return max(int(ledger.client.sparkSession.conf.get("spark.sql.shuffle.partitions")), ledger.parts)


def with_totals(ledger: Ledger, own: DataFrame) -> DataFrame:
    """Clients with what is known of their documents (own: scenario_id, the totals and more) and their net_balance."""
    found = ledger.client.join(own.hint("merge"), SID, "left")  # a broadcast of all ledgers would leave few tasks
    return found.withColumns({c: F.coalesce(c, F.lit(0)) for c in TOTALS}).withColumn("net_balance", F.expr("open_invoice_total - unapplied_cash_total - unapplied_credit_total"))


def view(ledger: Ledger) -> DataFrame:
    """One row for each scenario with all that checks need: client, totals, docs and allocations as arrays.

    docs: invoices, payments, credit memos in ledger order, with original, applied and open (for a
    source: unapplied) cents. A row is as large as its ledger; scenarios are many and ledgers small.
    What follows works long on each row, so as many tasks share them as there are partitions, however few bytes they have.
    """
    doc = F.struct("kind_rank", "pos", "kind", "id", "date", "due", F.col("amount_cents").alias("original"), F.col("applied_cents").alias("applied"), F.col("open_cents").alias("open"), "status")
    facts = document_facts(ledger)
    facts = facts.repartition(parts(ledger), SID)
    own = facts.groupBy(SID).agg(F.sort_array(F.collect_list(doc)).alias("docs"), *totals_of())
    found = with_totals(ledger, own)
    found = found.withColumn("docs", F.coalesce("docs", F.array().cast(dict(found.dtypes)["docs"])))
    could_pay = "transform(filter(docs, i_ -> i_.kind_rank = 0 and i_.open = s_.original), i_ -> i_.id)"
    unclear = f"filter(transform(filter(docs, s_ -> s_.kind_rank > 0 and s_.open > 0), s_ -> named_struct('source_id', s_.id, 'candidates', {could_pay})), x_ -> size(x_.candidates) >= 2)"
    return found.select(*ledger.client.columns, *TOTALS, "net_balance", "docs", F.expr(unclear).alias("ambiguous"))
