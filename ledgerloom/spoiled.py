"""Sentences whose claims and outcomes are known beforehand, for each scenario with an open invoice.

i and j are its first two open invoices. Each sentence makes one claim beside the existence of the
documents it names; what that claim must come to is written here once as SQL over the ledger's facts,
which both the tests and the queries' SQL use.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import quoted, render

_BARE = f"ltrim('$', {render('i.open')})"
_ON = "'On ', i.id, ' a balance of '"
#: name: (sentence, needs two open invoices, type, role, status). A status in brackets is SQL over cents, net and open_total.
CASES: dict[str, tuple[str, bool, str, str, str]] = {
    "open_right": (f"concat({_ON}, {render('i.open')}, ' remains.')", False, "C-AMT", "open", "pass"),
    "open_wrong": (f"concat({_ON}, {render('(i.open + 100)')}, ' remains.')", False, "C-AMT", "open", "fail"),
    "open_usd": (f"concat({_ON}, 'USD ', {_BARE}, ' remains.')", False, "C-AMT", "open", "pass"),
    "open_dollars": (f"concat({_ON}, {_BARE}, ' dollars remains.')", False, "C-AMT", "open", "pass"),
    "open_commas": (f"concat({_ON}, {render('(i.open div 100 * 100 + 100000000)')}, ' remains.')", False, "C-AMT", "open", "fail"),
    "open_plain": (f"concat({_ON}, replace({_BARE}, ',', ''), ' remains.')", False, "C-AMT", "open", "pass"),
    "open_grouped": (f"concat({_ON}, {_BARE}, ' remains.')", False, "C-AMT", "open", "pass"),
    "open_words": (f"concat({_ON}, 'three thousand and ninety-nine dollars remains.')", False, "C-AMT", "open", "fail"),
    "original_right": (f"concat(i.id, ' was issued for ', {render('i.original')}, '.')", False, "C-AMT", "original", "pass"),
    "original_wrong": (f"concat(i.id, ' was issued for ', {render('(i.original + 1)')}, '.')", False, "C-AMT", "original", "fail"),
    "applied_right": (f"concat('On ', i.id, ' you have remitted ', {render('i.applied')}, '.')", False, "C-AMT", "applied", "pass"),
    "applied_wrong": (f"concat('On ', i.id, ' you have remitted ', {render('(i.applied + 1)')}, '.')", False, "C-AMT", "applied", "fail"),
    "percent": ("concat(i.id, ' has 5 percent to go.')", False, "C-AMT", "", "unverifiable"),
    "fraction": ("concat('On ', i.id, ' it is half of the amount.')", False, "C-AMT", "", "unverifiable"),
    "unbound": ("'A figure of $0.77 stands here.'", False, "C-AMT", "", "unverifiable"),
    "received_wrong": ("'We received $0.77 in cash.'", False, "C-AMT", "", "fail"),
    "remit_right": (f"concat('Please remit ', {render('net_balance')}, '.')", False, "C-AMT", "", "pass"),
    "remit_wrong": (f"concat('Please remit ', {render('(net_balance + 1)')}, '.')", False, "C-AMT", "", "fail"),
    "total_wrong": (f"concat('The total due is ', {render('(net_balance + 1)')}, '.')", False, "C-SUM", "total", "fail"),
    "subtotal_right": (f"concat('Invoices ', i.id, ' and ', j.id, ' come to a total of ', {render('(i.open + j.open)')}, '.')", True, "C-SUM", "total", "pass"),
    "subtotal_wrong": (f"concat('Invoices ', i.id, ' and ', j.id, ' come to a total of ', {render('(i.open + j.open + 1)')}, '.')", True, "C-SUM", "total", "fail"),
    "status_right": ("concat('Invoice ', i.id, ' is ', i.status, '.')", False, "C-STATUS", "", "pass"),
    "status_wrong": ("concat('Invoice ', i.id, ' is settled.')", False, "C-STATUS", "", "fail"),
    "status_weaker": ("concat('Invoice ', i.id, ' is unpaid.')", False, "C-STATUS", "", "pass"),
    "status_paid_off": ("concat('Invoice ', i.id, ' is paid in full.')", False, "C-STATUS", "", "fail"),
    "two_documents": (f"concat('On ', i.id, ' and ', j.id, ' a balance of ', {render('j.open')}, ' remains.')", True, "C-AMT", "open", "pass"),
    "amount_first": (f"concat({render('i.open')}, ' remains on ', i.id, '.')", False, "C-AMT", "open", "pass"),
    "date_iso": ("concat(i.id, ' is dated ', i.date, '.')", False, "C-DATE", "", "pass"),
    "date_named": ("concat(i.id, ' is dated ', date_format(i.date, 'MMMM d, yyyy'), '.')", False, "C-DATE", "", "pass"),
    "date_slashed": ("concat(i.id, ' was due ', month(i.due), '/', day(i.due), '/', year(i.due), '.')", False, "C-DATE", "", "pass"),
    "date_wrong": ("concat(i.id, ' is dated 1990-01-01.')", False, "C-DATE", "", "fail"),
    "fuzzy": ("'Your account manager approved a waiver of the late fees on this balance.'", False, "C-FUZZY", "", "none"),
}


def sentences(scenarios: DataFrame, cases: Collection[str] = tuple(CASES)) -> DataFrame:
    """scenarios (rows of ledger.view) with each of these cases that applies: case, sentence, draft_id. Others aren't made."""
    opened = "filter(docs, d_ -> d_.kind = 'invoice' and d_.open > 0)"
    rows = scenarios.withColumn("i", F.expr(f"get({opened}, 0)")).withColumn("j", F.expr(f"get({opened}, 1)")).where("i is not null")
    each = ", ".join(f"if({'j is not null' if two else 'true'}, named_struct('case', {quoted(name)}, 'sentence', {text}), null)" for name, (text, two, *_) in CASES.items() if name in cases)
    rows = rows.withColumn("c", F.explode(F.expr(f"array({each})"))).where("c is not null")
    return rows.select(F.concat_ws("/", "scenario_id", "c.case").alias("draft_id"), F.col("c.case").alias("case"), F.col("c.sentence").alias("sentence"), *scenarios.columns)


def with_content(scenarios: DataFrame) -> DataFrame:
    """Two drafts of each scenario: one that lists no document, and one that lists each open invoice at its original amount."""
    balance = f"concat('The balance due on your account is ', {render('net_balance')}, '.')"
    items = f"array_join(transform(filter(docs, d_ -> d_.kind = 'invoice' and d_.open > 0), d_ -> concat('- ', d_.id, ': ', {render('d_.original')}, '.')), '\\n')"
    rows = scenarios.withColumn("c", F.explode(F.expr(f"array(named_struct('case', 'bare', 'draft', {balance}), named_struct('case', 'originals', 'draft', concat({balance}, '\\n', {items})))")))
    return rows.select(F.concat_ws("/", "scenario_id", "c.case").alias("draft_id"), F.col("c.case").alias("case"), F.col("c.draft").alias("draft"), F.lit(0).alias("revision_index"), *scenarios.columns)


#: name: (the call succeeded, verdict, cited as SQL).
VERDICTS = {
    "supported": ("true", "supported", "array(docs[0].id)"), "uncited": ("true", "supported", "array()"), "miscited": ("true", "supported", "array('no such record')"),
    "unsupported": ("true", "unsupported", "array()"), "unsure": ("true", "cannot_determine", "array()"), "failed": ("false", "supported", "array(docs[0].id)"),
}


def verdict() -> str:
    """SQL: the verdict on a fuzzy claim, as its draft's case (one of VERDICTS) says; null in other cases."""
    each = " ".join(f"when '{name}' then named_struct('ok', {ok}, 'verdict', {quoted(said)}, 'cited', cast({cited} as array<string>), 'reason', '')" for name, (ok, said, cited) in VERDICTS.items())
    return f"case `case` {each} end"
