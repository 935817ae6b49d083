"""Checks of claims against the ledger. Every checker is a SQL expression that gives status, expected, actual, cited, detail.

A checker sees a claim's columns and the scenario's docs, net_balance, open_invoice_total and as_of.
CHECKERS is the registry: a further type of claim needs an expression there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import let, quoted, render
from ledgerloom.functions.text import UNICODE, amount_cents, date_value, found
from ledgerloom.operators.extract import ITEMS
from ledgerloom.schema import CODE_TYPES, NET

# What a sentence without a document asserts, and the status words true of each status.
REMIT = r"\b(?:remit|send|wire|transfer|please\s+pay|pay\s+us|kindly\s+(?:send|wire|pay))\b"
RECEIVED = r"\b(?:received?|we\s+got|thank\s+you\s+for\s+your\s+payment)\b"
COMPATIBLE = {"paid": ("paid", "settled", "cleared"), "outstanding": ("outstanding", "unpaid", "open"), "overdue": ("overdue", "past due", "outstanding", "unpaid", "open")}

RESULT = "struct<status:string,expected:string,actual:string,cited:array<string>,detail:string>"
_NONE = "cast(array() as array<string>)"


def result(status: str, expected: str = "''", actual: str = "''", cited: str = _NONE, detail: str = "''") -> str:
    return f"named_struct('status', '{status}', 'expected', {expected}, 'actual', {actual}, 'cited', {cited}, 'detail', {detail})"


def context(span: str) -> str:
    """What an amount without a document asserts; that money came in counts before that it should."""
    return f"case when {found(span, RECEIVED)} then 'received' when {found(span, REMIT)} then 'remit' else 'plain' end"


def _document(id: str) -> str:
    return f"get(filter(docs, d_ -> d_.id = {id}), 0)"


def _exist() -> str:
    return f"if(exists(docs, d_ -> d_.id = token), {result('pass', 'token', 'token', 'array(token)')}, {result('fail', actual='token', detail=quoted('no such document in the ledger'))})"


def _bound_amount() -> str:
    values = "array_distinct(case role when 'open' then array(doc.open) when 'original' then array(doc.original) when 'applied' then array(doc.applied) else array(doc.original, doc.open) end)"
    wrong = result("fail", f"array_join(transform(ok, z_ -> {render('z_')}), ' or ')", render("cents"), "array(subject_ids[0])", "concat('amount does not match ', subject_ids[0], if(role = '', '', concat(' (', role, ')')))")
    right = result("pass", render("cents"), render("cents"), "array(subject_ids[0])")
    missing = result("fail", render("net_balance"), render("cents"), detail="concat('amount attached to ', subject_ids[0], ', which is not in the ledger')")
    return let(_document("subject_ids[0]"), "doc", f"if(doc is null, {missing}, {let(values, 'ok', f'if(exists(ok, z_ -> z_ = cents), {right}, {wrong})')})")


def _free_amount() -> str:
    net = result("pass", render("cents"), render("cents"), f"array('{NET}')")
    wrong = lambda detail: result("fail", render("net_balance"), render("cents"), f"array('{NET}')", quoted(detail))
    pays = "filter(docs, d_ -> d_.kind = 'payment')"
    hits = f"transform(filter({pays}, d_ -> d_.original = cents or d_.open = cents), d_ -> d_.id)"
    every = f"aggregate({pays}, 0L, (t_, d_) -> t_ + d_.original)"
    received = let(hits, "hit", f"if(size(hit) > 0 or cents = {every}, {result('pass', render('cents'), render('cents'), 'if(size(hit) > 0, hit, array(' + quoted('PAYMENTS-TOTAL') + '))')}, {result('fail', quoted('a recorded payment amount'), render('cents'), detail=quoted('asserts a received amount matching no payment on the ledger'))})")
    plain = f"""case when cents = net_balance then {net}
        when cents = open_invoice_total then {wrong('states the open-invoice total and ignores unapplied cash or credits')}
        else {result('unverifiable', actual=render('cents'), detail=quoted('amount is attached to no document and asserts no checkable total'))} end"""
    return f"case {context('span')} when 'remit' then if(cents = net_balance, {net}, {wrong('asks for an amount that is not the net balance')}) when 'received' then {received} else {plain} end"


def _amount() -> str:
    return f"if(size(subject_ids) = 1, {_bound_amount()}, {_free_amount()})"


def _sum() -> str:
    bound = "filter(subject_ids, b_ -> exists(docs, d_ -> d_.id = b_ and d_.kind = 'invoice'))"
    part = f"aggregate(bound, 0L, (t_, b_) -> t_ + {_document('b_')}.open)"
    subtotal = let(part, "part", f"if(cents = part, {result('pass', render('part'), render('cents'), 'bound', quoted('a true subtotal over the named invoices'))}, {result('fail', render('part'), render('cents'), 'bound', quoted('does not equal the open total of the named invoices'))})")
    opened = "transform(filter(docs, d_ -> d_.kind = 'invoice' and d_.open > 0), d_ -> d_.id)"
    wrong = lambda detail: result("fail", render("net_balance"), render("cents"), f"array('{NET}')", quoted(detail))
    whole = f"""case when cents = net_balance then {result('pass', render('net_balance'), render('cents'), f"array('{NET}')")}
        when cents = open_invoice_total and {found('span', ITEMS)} then {result('pass', render('cents'), render('cents'), opened, quoted('a true open-invoice subtotal, distinct from the net balance'))}
        when cents = open_invoice_total then {wrong('states the open-invoice total and ignores unapplied cash or credits')}
        else {wrong('does not match the computed balance')} end"""
    return let(bound, "bound", f"if(size(bound) > 0, {subtotal}, {whole})")


def _status() -> str:
    table = "map(" + ", ".join(f"'{k}', array({', '.join(map(quoted, v))})" for k, v in COMPATIBLE.items()) + ")"
    every = "array(" + ", ".join(quoted(w) for w in sorted(set().union(*COMPATIBLE.values()))) + ")"
    word = f"regexp_replace(lower(token), {quoted(UNICODE + chr(92) + 's+')}, ' ')"
    known = f"""case when not array_contains({every}, word) then {result('fail', 'doc.status', 'token', 'array(doc.id)', "concat('unrecognized status word ', token)")}
        when array_contains(element_at({table}, doc.status), word) then {result('pass', 'doc.status', 'token', 'array(doc.id)')}
        else {result('fail', 'doc.status', 'token', 'array(doc.id)', "concat('the ledger derives ', doc.status, ' for ', doc.id)")} end"""
    return f"""if(size(subject_ids) <> 1, {result('unverifiable', actual='token', detail=quoted('status claim with no resolvable document'))},
        {let(_document('subject_ids[0]'), 'doc', f"if(doc is null or doc.kind <> 'invoice', {result('unverifiable', actual='token', detail=quoted('status claim about a document that is not an invoice'))}, {let(word, 'word', known)})")})"""


def _date() -> str:
    bound = "filter(subject_ids, b_ -> exists(docs, d_ -> d_.id = b_))"
    missing = f"filter(bound, b_ -> not {let(_document('b_'), 'e_', 'day = e_.date or coalesce(day = e_.due, false)')})"
    dates = f"array_join(array_sort(array_distinct(transform(bound, b_ -> cast({_document('b_')}.date as string)))), ', ')"
    held = let(missing, "gone", f"if(size(gone) = 0, {result('pass', 'cast(day as string)', 'token', 'bound')}, {result('fail', dates, 'token', 'bound', 'if(day > as_of, ' + quoted('date is after the statement as_of') + ', concat(' + quoted('date is not carried by ') + ', array_join(gone, ' + quoted(', ') + ')))')})")
    hits = "concat(transform(filter(docs, d_ -> day = d_.date or coalesce(day = d_.due, false)), d_ -> d_.id), if(day = as_of, array('AS_OF'), cast(array() as array<string>)))"
    free = let(hits, "hit", f"if(size(hit) > 0, {result('pass', 'cast(day as string)', 'token', 'hit')}, {result('fail', quoted('no such date in the ledger; remove it or cite a document date'), 'token', detail='if(day > as_of, ' + quoted('date is after the statement as_of') + ', ' + quoted('date matches no document date, due date, or the statement as_of') + ')')})")
    return let(date_value("token"), "day", f"if(day is null, {result('unverifiable', actual='token', detail=quoted('date token could not be resolved'))}, {let(bound, 'bound', f'if(size(bound) > 0, {held}, {free})')})")


#: An expression for each type of claim that code can check.
CHECKERS = {"C-EXIST": _exist, "C-AMT": _amount, "C-SUM": _sum, "C-STATUS": _status, "C-DATE": _date}


def _checked() -> str:
    """SQL: the result of a claim's fields by name; null for a fuzzy claim. A preset isn't overwritten."""
    preset = result("unverifiable", actual="token", detail=quoted("the token can't be resolved to cents; escalated, not dropped"))
    unread = "preset is not null or (type in ('C-AMT', 'C-SUM') and cents is null)"
    return f"case when {unread} then {preset} " + " ".join(f"when type = '{t}' then {CHECKERS[t]()}" for t in CODE_TYPES) + " end"


def check_claims(claims: DataFrame, scenarios: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """claims with the struct ``result``; scenarios are drafts joined to ledger.view, with draft_id.

    Fuzzy claims get their result from ``verdicts`` (see fuzzy_results), and have none (null) without.
    Claims of whole drafts are checked without a join by check_in_rows().
    """
    facts = scenarios.select("draft_id", "scenario_id", "docs", "net_balance", "open_invoice_total", "as_of")
    rows = claims.join(facts, "draft_id").withColumn("cents", F.expr(f"if(type in ('C-AMT', 'C-SUM'), {amount_cents('token')}, cast(null as bigint))"))
    rows = rows.withColumn("result", F.expr(_checked()))
    keep = [*claims.columns, "scenario_id", "cents", "result"]
    if verdicts is None:
        return rows.select(keep)
    judged = fuzzy_results(rows.where("type = 'C-FUZZY'").select("draft_id", "claim_id", "docs"), verdicts)
    return rows.join(judged, ["draft_id", "claim_id"], "left").withColumn("result", F.coalesce("fuzzy", "result")).select(keep)


def check_in_rows(rows: DataFrame) -> DataFrame:
    """rows of claims_in_rows() with a result in each claim; fuzzy ones have none."""
    return rows.withColumn("claims", F.expr(f"transform(claims, c_ -> {_with_result(_of_claim())})"))


def check_in_texts(rows: DataFrame) -> DataFrame:
    """rows of found_in_texts() with a result in each claim found."""
    fields = ("type", "span", "token", "subject_ids", "role", "preset", "cents")
    return rows.withColumn("found", F.expr(f"transform(found, f_ -> transform(f_, c_ -> {_with_result(_of_claim(), fields)}))"))


def _of_claim() -> str:
    """_checked() of a claim c_."""
    body = _checked()
    for name in ("type", "span", "token", "subject_ids", "role", "preset", "cents"):
        body = let(f"c_.{name}", name, body)
    return body


def judge_in_rows(rows: DataFrame, verdict: str) -> DataFrame:
    """Rows of check_in_rows() with results of fuzzy claims. verdict: SQL over the row and a claim c_, a struct of ok, verdict, cited, reason or null."""
    judged = let(verdict, "v_", _fuzzy("v_."))
    return rows.withColumn("claims", F.expr(f"transform(claims, c_ -> if(c_.type = 'C-FUZZY', {_with_result(judged)}, c_))"))


def _with_result(value: str, fields: tuple[str, ...] = ("n", "claim_id", "type", "span", "token", "subject_ids", "subject_id", "role", "preset", "cents")) -> str:
    kept = ", ".join(f"'{name}', c_.{name}" for name in fields)
    return f"named_struct({kept}, 'result', cast({value} as {RESULT}))"


def fuzzy_results(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """What a model's verdict on a claim comes to: draft_id, claim_id, fuzzy.

    verdicts: draft_id, claim_id, ok, verdict, cited, reason. Without a verdict, with a failed call
    or with a citation the ledger doesn't have, a claim can't be determined; nor can a supported one
    that cites nothing.
    """
    rows = claims.join(verdicts, ["draft_id", "claim_id"], "left")
    return rows.select("draft_id", "claim_id", F.expr(_fuzzy()).alias("fuzzy"))


def _fuzzy(of: str = "") -> str:
    """SQL: what a verdict comes to, given its fields after a prefix, and docs."""
    cited = f"coalesce({of}cited, cast(array() as array<string>))"
    bad = f"size(array_except({cited}, transform(docs, d_ -> d_.id))) > 0"
    unclear = lambda detail: result("cannot_determine", cited=cited, detail=quoted(detail))
    return f"""case when not coalesce({of}ok, false) then {result('cannot_determine', detail=quoted('verifier call failed'))}
        when {bad} then {unclear('verdict cites a record that is not in the ledger')}
        when {of}verdict = 'supported' and size({cited}) = 0 then {unclear('supported without any citation')}
        when {of}verdict = 'supported' then {result('pass', cited=cited, detail=f"coalesce({of}reason, '')")}
        when {of}verdict = 'unsupported' then {result('unsupported', cited=cited, detail=f"if(coalesce({of}reason, '') = '', 'no record supports this statement', {of}reason)")}
        else {result('cannot_determine', cited=cited, detail=f"coalesce({of}reason, '')")} end"""
