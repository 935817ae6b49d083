"""Text blocks of a ledger: the drafter's, the verifier's, the correct reply, and prompts. One row for each scenario."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import let, quoted, render, render_column
from ledgerloom.operators.ledger import SID, TOTALS, document_facts, parts, totals_of, view, with_totals
from ledgerloom.sources.tables import Ledger


def _m(cents: str) -> str:
    return render(cents)


def _join(parts: list[str]) -> str:
    """Lines of arrays of lines."""
    return "array_join(concat(" + ", ".join(parts) + "), '\\n')"


def _of(kind: str, more: str = "true") -> str:
    return f"filter(docs, d_ -> d_.kind = '{kind}' and {more})"


def _lines(docs: str, text: str, empty: str | None = None) -> str:
    rows = f"transform({docs}, d_ -> {text})"
    return rows if empty is None else f"if(size({docs}) = 0, array({quoted(empty)}), {rows})"


def _applied(ledger: Ledger) -> DataFrame:
    row = F.struct("pos", "source_id", "target_invoice", "amount_cents")
    return ledger.application.groupBy(SID).agg(F.sort_array(F.collect_list(row)).alias("applications"))


def _memos(ledger: Ledger) -> DataFrame:
    """Free text of documents by id."""
    own = lambda df, text: df.select(SID, "id", F.expr(text).alias("note"))
    notes = own(ledger.invoice, "if(memo = '', '', concat(' | memo: ', memo))").union(own(ledger.payment, "concat(' | method ', method, if(reference = '', '', concat(' | reference ', reference)))")).union(own(ledger.credit_memo, "if(reason = '', '', concat(' | reason: ', reason))"))
    return notes.groupBy(SID).agg(F.map_from_entries(F.collect_list(F.struct("id", "note"))).alias("notes"))


def ledger_block(ledger: Ledger) -> DataFrame:
    """scenario_id, block: every figure of a ledger, for the drafter to copy from."""
    source = f"concat('  ', d_.id, ' | date ', d_.date, ' | amount ', {_m('d_.original')}, ' | applied ', {_m('d_.applied')}, ' | unapplied ', {_m('d_.open')})"
    invoice = f"concat('  ', d_.id, ' | date ', d_.date, ' | due ', d_.due, ' | amount ', {_m('d_.original')}, ' | applied ', {_m('d_.applied')}, ' | open ', {_m('d_.open')}, ' | ', d_.status)"
    applied = f"if(applications is null, array('  (none)'), transform(applications, a_ -> concat('  ', a_.source_id, ' -> ', a_.target_invoice, ': ', {_m('a_.amount_cents')})))"
    block = _join([
        "array(concat('CLIENT: ', name, ' (', client_id, ') | terms: net ', terms_days, ' | as_of ', as_of), 'INVOICES:')",
        _lines(_of("invoice"), invoice, "  (none)"), "array('PAYMENTS:')", _lines(_of("payment"), source, "  (none)"),
        "array('CREDIT MEMOS:')", _lines(_of("credit_memo"), source, "  (none)"), "array('APPLICATIONS:')", applied,
        f"array('TOTALS:', concat('  open invoice total: ', {_m('open_invoice_total')}), concat('  unapplied cash total: ', {_m('unapplied_cash_total')}), concat('  unapplied credit total: ', {_m('unapplied_credit_total')}), concat('  NET BALANCE DUE: ', {_m('net_balance')}))",
    ])
    return view(ledger).join(_applied(ledger), SID, "left").select(SID, F.expr(block).alias("block"))


def records_block(ledger: Ledger) -> DataFrame:
    """scenario_id, block: the records for the verifier, with memos, methods, references and reasons."""
    note = "coalesce(element_at(notes, d_.id), '')"
    invoice = f"concat('INVOICE ', d_.id, ' | date ', d_.date, ' | due ', d_.due, ' | amount ', {_m('d_.original')}, ' | open ', {_m('d_.open')}, ' | status ', d_.status, {note})"
    source = lambda name: f"concat('{name} ', d_.id, ' | date ', d_.date, ' | amount ', {_m('d_.original')}, ' | unapplied ', {_m('d_.open')}, {note})"
    applied = f"transform(coalesce(applications, array()), a_ -> concat('APPLIED ', a_.source_id, ' -> ', a_.target_invoice, ': ', {_m('a_.amount_cents')}))"
    block = _join(["array(concat('CLIENT ', client_id, ' (', name, ') | as_of ', as_of))", _lines(_of("invoice"), invoice), _lines(_of("payment"), source("PAYMENT")), _lines(_of("credit_memo"), source("CREDIT MEMO")), applied, f"array(concat('NET BALANCE DUE ', {_m('net_balance')}))"])
    return view(ledger).join(_applied(ledger), SID, "left").join(_memos(ledger), SID, "left").select(SID, F.expr(block).alias("block"))


# The sentences of a correct reply.
OPENING = "Thank you for reaching out about your account. Here is the current position as of "
ITEMIZED = "This balance reflects the following open invoices:"
CLOSING = "If you have questions about any of the items above, please reply to this message and we will be glad to walk through them with you."


def _item(d: str, money: Callable[[str], str]) -> str:
    """The line of an open invoice, whose fields start with d."""
    return f"concat('- ', {d}id, ' dated ', {d}date, ', due ', {d}due, ': ', {money(f'{d}open')}, ' ', {d}status, '.')"


def _cash(d: str, money: Callable[[str], str]) -> str:
    return f"concat('We have received your payment ', {d}id, ' of ', {money(f'{d}open')}, ', which has not yet been applied to a specific invoice. It is reflected in the balance above.')"


def _credit(d: str, money: Callable[[str], str]) -> str:
    return f"concat('An open credit memo ', {d}id, ' of ', {money(f'{d}open')}, ' is also reflected in the balance above.')"


def _reply(items: str, notes: str, net: str) -> str:
    """The whole reply, of arrays of lines: of open invoices, and of open payments and then credit memos."""
    none = "cast(array() as array<string>)"
    return _join([
        f"array(concat('Dear ', name, ' team,'), '', concat({quoted(OPENING)}, as_of, '.'), '', concat('The balance due on your account is ', {net}, '.'), '')",
        f"if(size({items}) = 0, {none}, concat(array({quoted(ITEMIZED)}), {items}, array('')))",
        notes, f"if(size({notes}) = 0, {none}, array(''))",
        f"array({quoted(CLOSING)}, '', 'Kind regards,', 'Accounts Receivable')",
    ])


def golden(scenarios: DataFrame) -> DataFrame:
    """scenarios (rows of ledger.view) with ``draft``, a reply that is right by construction."""
    opened, paid, credited = _of("invoice", "d_.open > 0"), _of("payment", "d_.open > 0"), _of("credit_memo", "d_.open > 0")
    notes = f"concat({_lines(paid, _cash('d_.', _m))}, {_lines(credited, _credit('d_.', _m))})"
    return scenarios.withColumn("draft", F.expr(let(_lines(opened, _item("d_.", _m)), "o_", let(notes, "n_", _reply("o_", "n_", _m("net_balance"))))))


def golden_drafts(ledger: Ledger) -> DataFrame:
    """The client's columns, totals, net_balance and ``draft`` of golden(view(ledger)), for what needs no documents.

    Each open document becomes its line in a row of its own, by compiled code, and only lines are
    collected; settled documents are in no total and on no line, so they aren't shuffled.
    """
    facts = document_facts(ledger).where("open_cents <> 0").withColumnsRenamed({"open_cents": "open", "amount_cents": "original", "applied_cents": "applied"})
    facts = facts.select(SID, "kind_rank", "kind", "pos", "id", "date", "due", "original", "applied", "open", "status").repartition(parts(ledger), SID)
    line = f"case kind when 'invoice' then {_item('', render_column)} when 'payment' then {_cash('', render_column)} else {_credit('', render_column)} end"
    line = F.when(F.col("open") > 0, F.struct("kind_rank", "pos", "kind", "id", "date", "due", "original", "applied", "open", F.expr(line).alias("line")))
    n = lambda test: F.count_if((F.col("open") > 0) & test).cast("int")
    own = facts.groupBy(SID).agg(F.sort_array(F.collect_list(line)).alias("lines"), n(F.col("kind_rank") == 0).alias("n_items"), n(F.col("kind_rank") > 0).alias("n_notes"), *totals_of("open"))
    found = with_totals(ledger, own)
    none = "cast(array() as array<string>)"
    items, notes = f"coalesce(slice(lines.line, 1, n_items), {none})", f"coalesce(slice(lines.line, n_items + 1, n_notes), {none})"
    return found.select(*ledger.client.columns, *TOTALS, "net_balance", F.expr(_reply(items, notes, render_column("net_balance"))).alias("draft"))


def prompt(template: Column, values: dict[str, Column]) -> Column:
    """Fill {{name}} in a template; runs of blank lines that empty values leave are squeezed to one."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
    return F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def sections(template: str) -> tuple[str, str]:
    """The texts after the lines [SYSTEM] and [USER] of a template."""
    found = {name: text.strip() for name, text in re.findall(r"^\[([A-Z]+)\][ \t]*$(.*?)(?=^\[[A-Z]+\][ \t]*$|\Z)", template, re.M | re.S)}
    if not {"SYSTEM", "USER"} <= set(found):
        raise ValueError("a template needs the lines [SYSTEM] and [USER]")
    return found["SYSTEM"], found["USER"]


def exemplars_block(texts: Column, header: str = "Replies that reviewers approved:") -> Column:
    """Approved replies, numbered; empty without any. texts: an array of strings."""
    each = F.transform(texts, lambda x, i: F.concat(F.format_string("--- EXAMPLE %d START ---\n", i + 1), F.btrim(x, F.lit(" \t\r\n")), F.format_string("\n--- EXAMPLE %d END ---", i + 1)))
    return F.when(F.size(texts) > 0, F.concat(F.lit(header + "\n"), F.array_join(each, "\n"))).otherwise("")


def correction_block(text: Column, header: str = "Your last draft has errors:", close: str = "Mend these only and leave all else as it is.") -> Column:
    """What a revision has to mend; empty without."""
    told = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n"))
    return F.when(told != "", F.concat(F.lit(header + "\n"), told, F.lit("\n" + close))).otherwise("")


def draft_prompt(template: str, block: Column, exemplars: Column, correction: Column) -> Column:
    """struct<system, user>: the drafter's prompt, for {{ledger_block}}, {{exemplars_block}} and {{correction_block}}."""
    system, user = sections(template)
    return F.struct(F.lit(system).alias("system"), prompt(F.lit(user), {"ledger_block": block, "exemplars_block": exemplars_block(exemplars), "correction_block": correction_block(correction)}).alias("user"))


def claim_prompt(template: str, records: Column, sentence: Column) -> Column:
    """struct<system, user>: the verifier's prompt on one sentence, which sees nothing else of its draft."""
    system, user = sections(template)
    return F.struct(F.lit(system).alias("system"), prompt(F.lit(user), {"ledger_records": records, "claim_sentence": sentence}).alias("user"))


def judge_prompt(template: str, block: Column, *drafts: Column) -> Column:
    """struct<system, user>: the judge's prompt on one draft ({{draft}}), or on two ({{draft_1}}, {{draft_2}})."""
    system, user = sections(template)
    names = ["draft"] if len(drafts) == 1 else [f"draft_{i}" for i in range(1, len(drafts) + 1)]
    return F.struct(F.lit(system).alias("system"), prompt(F.lit(user), {"ledger_block": block, **dict(zip(names, drafts))}).alias("user"))
