"""The gate: a decision for each draft, by the first rule that applies; and the gaps that decisions reveal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import quoted, render
from ledgerloom.functions.text import sha16
from ledgerloom.operators.score import items_in_rows, with_claims

# Budgets, reasons, kinds of findings and categories of gaps.
BUDGET, FUZZY_BUDGET = 2, 1
FABRICATED, UNVERIFIABLE, CORRECTABLE, EXHAUSTED = "fabricated document reference", "unverifiable quantitative claim", "correctable code-check failure", "revision budget exhausted"
UNSUPPORTED, UNSUPPORTED_AGAIN, UNDETERMINED = "unsupported fuzzy claim", "unsupported fuzzy claim after revision", "fuzzy claim cannot be determined from the records"
AMBIGUOUS, PASSED, LOOP = "ambiguous allocation", "all checks passed", "revision loop"
INCOMPLETE, ITEMIZATION = "draft is missing required content", "itemized amounts contradict the computed totals"
RESOLVES = "a record or human confirmation of the claimed arrangement"
KINDS = {"C-EXIST": "c_exist_fail", "C-AMT": "c_amt_fail", "C-SUM": "c_sum_fail", "C-STATUS": "c_status_fail", "C-DATE": "c_date_fail"}
SUBJECTS = {"C-SUM": "the total balance due", "C-DATE": "the statement", "C-AMT": "this account", "C-STATUS": "this document"}
GAPS = (  # action, reason (null: any), missing, would_need, resolvable_by
    ("abstain", None, "allocation_reference", "remittance advice tying the payment to an invoice", "human"),
    ("escalate", UNVERIFIABLE, "unverifiable_quant", "a claim normalizer for non-canonical amount phrasing", "tool"),
    ("escalate", UNDETERMINED, "ambiguous_reference", RESOLVES, "human"),
    ("escalate", FABRICATED, "document_absent", "drafter constrained to the document set", "tool"),
    ("escalate", None, "other", "human review of a draft the loop could not converge", "human"),
)


def correction(claim: str = "c_") -> str:
    """What a failed claim's author is told."""
    subject = f"case when {claim}.subject_id <> '' then {claim}.subject_id " + " ".join(f"when {claim}.type = '{t}' then {quoted(s)}" for t, s in SUBJECTS.items()) + " else 'this account' end"
    said = f"case when {claim}.result.actual <> '' then {claim}.result.actual when {claim}.token <> '' then {claim}.token else {claim}.span end"
    return f"if({claim}.result.expected <> '', concat('The ledger shows ', {claim}.result.expected, ' for ', {subject}, '; your draft says ', {said}, '.'), concat('The records do not support this statement; remove it or reword it to match the records: ', {claim}.span))"


def _of(test: str) -> str:
    return f"filter(claims, c_ -> {test})"


_EXIST = _of("c_.type = 'C-EXIST' and c_.result.status = 'fail'")
_UNREAD = _of("c_.result.status is null or c_.result.status = 'unverifiable'")
_WRONG = _of("c_.type in ('C-AMT', 'C-SUM', 'C-STATUS', 'C-DATE') and c_.result.status = 'fail'")
_LOOSE = _of("c_.type = 'C-FUZZY' and c_.result.status = 'unsupported'")
_OPEN = _of("c_.type = 'C-FUZZY' and c_.result.status = 'cannot_determine'")


def _findings(claims: str, kind: str, corrected: bool = False, detail: str = "coalesce(c_.result.detail, 'claim was never checked')") -> str:
    return f"transform({claims}, c_ -> named_struct('kind', {kind}, 'claim_id', c_.claim_id, 'span', c_.span, 'detail', {detail}, 'correction', {correction() if corrected else quoted('')}))"


def _plain(items: str, kind: str, detail: str, fix: str) -> str:
    return f"transform({items}, x_ -> named_struct('kind', {kind}, 'claim_id', '', 'span', '', 'detail', {detail}, 'correction', {fix}))"


def _spans(claims: str, text: str = "c_.span", between: str = "; ") -> str:
    return f"array_join(transform({claims}, c_ -> {text}), {quoted(between) if between != chr(10) else quoted(chr(10))})"


def decide(drafts: DataFrame, checked: DataFrame, incomplete_by_text: bool = True) -> DataFrame:
    """draft_id, action, reason, findings, payload for each draft.

    drafts: draft_id, scenario_id, draft, revision_index and the columns of ledger.view. A draft
    without claims is judged like others. Without ``incomplete_by_text`` (claims alone are at hand)
    only a citation of the net balance is asked for.
    """
    return decide_in_rows(with_claims(drafts, checked), incomplete_by_text)


def decide_in_rows(rows: DataFrame, incomplete_by_text: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """decide() of drafts with their checked claims in ``claims``. keep: further columns to hand on."""
    rows = items_in_rows(rows)
    # The figure given as owed on each open invoice: the last one called open, else the first without a role.
    rows = rows.withColumn("opened", F.expr("filter(docs, d_ -> d_.kind = 'invoice' and d_.open > 0)"))
    own = "filter(claims, c_ -> c_.type = 'C-AMT' and c_.result.status = 'pass' and size(array_distinct(c_.subject_ids)) = 1 and c_.subject_ids[0] = d_.id and c_.cents is not null and c_.role = '{}')"
    figure = f"coalesce(try_element_at({own.format('open')}, -1).cents, get({own.format('')}, 0).cents)"
    rows = rows.withColumn("figures", F.expr(f"transform(opened, d_ -> {figure})"))
    rows = rows.withColumn("itemized", F.expr("aggregate(figures, 0L, (t_, x_) -> t_ + x_)"))  # null unless every figure is given
    contradicts = "size(opened) >= 2 and unapplied_cash_total = 0 and unapplied_credit_total = 0 and coalesce(itemized <> open_invoice_total, false)"
    missing = "filter(items, i_ -> i_.applicable and not i_.present)"
    if not incomplete_by_text:
        stated = "exists(claims, c_ -> c_.result.status = 'pass' and array_contains(c_.result.cited, 'NET'))"
        missing = f"if(net_balance <> 0 and not {stated}, slice(items, 1, 1), slice(items, 1, 0))"
    unclear = "concat(x_.source_id, ' could apply to any of: ', array_join(x_.candidates, ', '))"
    detail7 = f"concat('itemized invoice amounts sum to ', {render('itemized')}, ' but the open-invoice total is ', {render('open_invoice_total')})"
    fix7 = f"concat('The itemized amounts contradict the computed balance: list each open invoice at its OPEN amount (', array_join(transform(array_sort(transform(opened, d_ -> named_struct('id', d_.id, 'open', d_.open))), d_ -> concat(d_.id, ' ', {render('d_.open')})), ', '), ').')"
    again = f"revision_index < {BUDGET}"
    kind = "case c_.type " + " ".join(f"when '{t}' then '{k}'" for t, k in KINDS.items()) + " end"
    rules = (  # test, action, reason, findings, payload
        (f"size({_EXIST}) > 0", "'escalate'", quoted(FABRICATED), _findings(_EXIST, kind), _spans(_EXIST, "concat(c_.span, ' [', c_.token, ']')")),
        (f"size({_UNREAD}) > 0", "'escalate'", quoted(UNVERIFIABLE), _findings(_UNREAD, "'unverifiable_quant'"), _spans(_UNREAD)),
        (f"size({_WRONG}) > 0", f"if({again}, 'revise', 'escalate')", f"if({again}, {quoted(CORRECTABLE)}, {quoted(EXHAUSTED)})", _findings(_WRONG, kind, True), _spans(_WRONG, correction(), "\n")),
        (f"size({_LOOSE}) > 0", f"if(revision_index < {FUZZY_BUDGET}, 'revise', 'escalate')", f"if(revision_index < {FUZZY_BUDGET}, {quoted(UNSUPPORTED)}, {quoted(UNSUPPORTED_AGAIN)})", _findings(_LOOSE, "'fuzzy_unsupported'", True), _spans(_LOOSE)),
        (f"size({_OPEN}) > 0", "'escalate'", quoted(UNDETERMINED), _findings(_OPEN, "'fuzzy_cannot_determine'"), _spans(_OPEN, f"concat(c_.span, {quoted(' | would resolve: ' + RESOLVES)})")),
        ("size(ambiguous) > 0", "'abstain'", quoted(AMBIGUOUS), _plain("ambiguous", "'ambiguous_allocation'", unclear, "''"), f"array_join(transform(ambiguous, x_ -> {unclear}), '; ')"),
        (contradicts, f"if({again}, 'revise', 'escalate')", quoted(ITEMIZATION), _plain("array(1)", "'itemization_inconsistent'", detail7, fix7), f"if({again}, {fix7}, {detail7})"),
        (f"size({missing}) > 0", f"if({again}, 'revise', 'escalate')", quoted(INCOMPLETE), _plain(missing, "concat('missing_', x_.name)", "concat('required content absent: ', x_.name)", "x_.hint"), f"if({again}, array_join(transform({missing}, x_ -> x_.hint), ' '), array_join(transform({missing}, x_ -> concat('required content absent: ', x_.name)), '; '))"),
        ("true", "'human_gate'", quoted(PASSED), _plain("slice(array(1), 1, 0)", "''", "''", "''"), "''"),
    )
    rows = rows.withColumn("rule", F.expr("case " + " ".join(f"when {test} then {n}" for n, (test, *_) in enumerate(rules, 1)) + " end"))
    pick = lambda part: F.expr("case rule " + " ".join(f"when {n} then {r[part]}" for n, r in enumerate(rules, 1)) + " end")
    return rows.select("draft_id", "scenario_id", "revision_index", *keep, "rule", pick(1).alias("action"), pick(2).alias("reason"), pick(3).alias("findings"), pick(4).alias("payload"))


def precheck(scenarios: DataFrame) -> DataFrame:
    """Scenarios for which no draft can be right: they abstain before one is written."""
    return scenarios.where("size(ambiguous) > 0").select("scenario_id", F.lit("abstain").alias("action"), F.lit(AMBIGUOUS).alias("reason"))


def stop_loops(decisions: DataFrame) -> DataFrame:
    """A revision whose draft had the same text before escalates. decisions: run_id, scenario_id, revision_index, draft, action, reason."""
    earlier = Window.partitionBy("run_id", "scenario_id", F.expr(sha16("draft"))).orderBy("revision_index").rowsBetween(Window.unboundedPreceding, -1)
    loop = (F.col("action") == "revise") & (F.count("*").over(earlier) > 0)
    rows = decisions.withColumn("loop", loop)
    return rows.withColumn("action", F.when(F.col("loop"), "escalate").otherwise(F.col("action"))).withColumn("reason", F.when(F.col("loop"), LOOP).otherwise(F.col("reason"))).drop("loop")


def _gap(part: int) -> Column:
    out = None
    for action, reason, *rest in GAPS:
        test = (F.col("action") == action) & (F.lit(True) if reason is None else F.col("reason") == reason)
        out = F.when(test, rest[part]) if out is None else out.when(test, rest[part])
    return out


def derive_gaps(decisions: DataFrame) -> DataFrame:
    """What was missing for the decisions that ended without a reply to approve."""
    rows = decisions.where(F.col("action").isin("abstain", "escalate"))
    detail = F.when(F.coalesce("payload", F.lit("")) == "", F.col("reason")).otherwise(F.col("payload"))
    return rows.select("draft_id", "scenario_id", _gap(0).alias("missing"), detail.alias("detail"), _gap(1).alias("would_need"), _gap(2).alias("resolvable_by"))


def aggregate_gaps(gaps: DataFrame, order: str = "draft_id") -> DataFrame:
    """missing, gap_count, draft_ids in order of first appearance."""
    seen = gaps.groupBy("missing", "draft_id").agg(F.min(order).alias("at"))
    return seen.groupBy("missing").agg(F.count("*").alias("gap_count"), F.transform(F.sort_array(F.collect_list(F.struct("at", "draft_id"))), lambda x: x["draft_id"]).alias("draft_ids"))
