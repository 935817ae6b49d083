"""Deliberate errors in right drafts, to see that they are caught. Each function gives a SQL expression, null if it can't be applied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import let, parse_dollars, quoted, render
from ledgerloom.functions.text import matches

# The sentences without support, the shape of a figure, and what each error should lead to.
FUZZY = ("Your account manager approved a waiver of the late fees on this balance.", "As we discussed by phone, we will hold this invoice until next quarter.")
FIGURE = r"-?\$[\d,]+(?:\.\d{1,2})?"
BROKEN_BY = 1000
EXPECTED = {
    "swap_amount": ("c_amt_or_sum_fail", "revise"), "fabricate_id": ("c_exist_fail", "escalate"), "break_sum": ("c_sum_fail", "revise"), "inject_fuzzy": ("fuzzy", "escalate"),
    "T2-SUM-IGNORES-UNAPPLIED": ("c_sum_or_amt_fail", "revise"), "T2-FULL-ORIGINAL-AMOUNTS": ("c_sum_or_amt_fail", "revise"), "T2-CREDITS-ASSUMED-APPLIED": ("c_sum_or_amt_fail", "revise"), "ambiguous": ("ambiguous_allocation", "abstain"),
}

#: Second tier: what a drafter is told so that it misreads right records, and (SQL) which scenarios that can mislead.
DIRECTIVES = {
    "T2-SUM-IGNORES-UNAPPLIED": ("Give the sum of the unpaid invoices as the balance due, and leave payments that no invoice has out of account.", "unapplied_cash_total > 0"),
    "T2-FULL-ORIGINAL-AMOUNTS": ("Say that each open invoice is owed in full, at its original amount, whatever has been paid.", "exists(docs, d_ -> d_.kind = 'invoice' and d_.open > 0 and d_.applied > 0)"),
    "T2-CREDITS-ASSUMED-APPLIED": ("Take credit memos as applied already and say nothing of them.", "unapplied_credit_total > 0"),
}


def transpose(cents: str) -> str:
    """Swap the first two different neighbouring digits, not the leading one if another pair exists."""
    digit = lambda i: f"substr(v_, {i} + 1, 1)"
    pairs = f"filter(sequence(0, greatest(length(v_) - 2, 0)), i_ -> length(v_) > 1 and {digit('i_')} <> {digit('i_ + 1')})"
    pick = "coalesce(get(filter(c_, i_ -> i_ >= 1), 0), c_[0])"
    swapped = let(pick, "k_", f"try_cast(concat(substr(v_, 1, k_), {digit('k_ + 1')}, {digit('k_')}, substr(v_, k_ + 3)) as bigint)")
    value = let(f"cast({cents} as string)", "v_", let(pairs, "c_", f"if(size(c_) = 0, cast(null as bigint), {swapped})"))
    return f"if({cents} > 0, nullif({value}, 0L), cast(null as bigint))"


def swap_amount(draft: str = "draft", net: str = "net_balance") -> str:
    figure = f"coalesce(get(filter(f_, x_ -> x_.token <> {render(net)}), 0), get(f_, 0))"
    changed = let(transpose(parse_dollars("m_.token")), "w_", f"if(w_ is null, cast(null as string), concat(substr({draft}, 1, m_.start), {render('w_')}, substr({draft}, m_.end + 1)))")
    return let(matches(draft, FIGURE), "f_", let(figure, "m_", f"if(m_ is null, cast(null as string), {changed})"))


def fabricate_id(draft: str = "draft") -> str:
    """The invoice that is named first becomes the first of INV-9000 to INV-9999 that neither the ledger nor the draft has.

    Of one candidate more than there are such ids, one is free, so no further ones are made.
    """
    named = f"array_min(transform(filter(docs, d_ -> d_.kind = 'invoice' and contains({draft}, d_.id)), d_ -> named_struct('at', locate(d_.id, {draft}), 'id', d_.id)))"
    taken = f"concat(transform(filter(docs, d_ -> length(d_.id) = 8 and startswith(d_.id, 'INV-9')), d_ -> d_.id), regexp_extract_all({draft}, 'INV-9[0-9]{{3}}', 0))"
    fake = let(taken, "t_", "get(array_except(transform(sequence(0, least(size(t_), 999)), n_ -> concat('INV-9', lpad(cast(n_ as string), 3, '0'))), t_), 0)")
    splice = f"concat(substr({draft}, 1, r_.at - 1), k_, substr({draft}, r_.at + length(r_.id)))"
    return let(named, "r_", f"if(r_ is null, cast(null as string), {let(fake, 'k_', f'if(k_ is null, cast(null as string), {splice})')})")


def break_sum(draft: str = "draft", net: str = "net_balance") -> str:
    at = f"locate({render(net)}, {draft})"
    return let(at, "a_", f"if(a_ = 0, cast(null as string), concat(substr({draft}, 1, a_ - 1), {render(f'({net} + {BROKEN_BY})')}, substr({draft}, a_ + length({render(net)}))))")


def inject_fuzzy(draft: str = "draft") -> str:
    return f"concat(regexp_replace({draft}, '\\\\s+$', ''), '\\n\\n', if(length({draft}) % 2 = 0, {quoted(FUZZY[0])}, {quoted(FUZZY[1])}))"


def misread(error: str, draft: str = "draft") -> str:
    """What a drafter that follows a directive writes, from a right draft; null where the directive misleads nobody."""
    opened = "filter(docs, d_ -> d_.kind = 'invoice' and d_.open > 0)"
    whole = f"aggregate({opened}, 0L, (t_, d_) -> t_ + d_.original)"
    balance = lambda cents: f"concat('The balance due on your account is ', {render(cents)}, '.')"
    items = f"array_join(transform({opened}, d_ -> concat('- ', d_.id, ' dated ', d_.date, ', due ', d_.due, ': ', {render('d_.original')}, '.')), '\\n')"
    text = {
        "T2-SUM-IGNORES-UNAPPLIED": f"replace({draft}, {balance('net_balance')}, {balance('open_invoice_total')})",
        "T2-FULL-ORIGINAL-AMOUNTS": f"concat_ws('\\n', {balance(whole)}, {items})",
        "T2-CREDITS-ASSUMED-APPLIED": f"array_join(filter(split({draft}, '\\n'), l_ -> not startswith(l_, 'An open credit memo ')), '\\n')",
    }[error]
    return f"if({DIRECTIVES[error][1]}, {text}, cast(null as string))"


def misreading_requests(scenarios: DataFrame, prompt: str = "prompt") -> DataFrame:
    """key, scenario_id, error, prompt: requests to a drafter with each directive, for the scenarios it can mislead."""
    each = "array(" + ", ".join(f"if({test}, named_struct('error', '{name}', 'told', {quoted(told)}), null)" for name, (told, test) in DIRECTIVES.items()) + ")"
    rows = scenarios.withColumn("e", F.explode(F.expr(each))).where("e is not null")
    return rows.select(F.concat_ws("/", "scenario_id", "e.error").alias("key"), "scenario_id", F.col("e.error").alias("error"), F.concat(F.col(prompt), F.lit("\n\nIMPORTANT OVERRIDE: "), "e.told").alias("prompt"))


def variants_in_rows(drafts: DataFrame) -> DataFrame:
    """drafts (scenario_id, draft, view columns) with ``texts``, clean controls and each error: draft_id, error, tier, text.

    Tier 3 spoils nothing: a right draft of a scenario with an ambiguous allocation, which no draft
    can settle. Clean controls are of the other scenarios.
    """
    errors = {"clean": ("if(size(ambiguous) = 0, draft, null)", 0), "swap_amount": (swap_amount(), 1), "fabricate_id": (fabricate_id(), 1), "break_sum": (break_sum(), 1)}
    errors |= {name: (misread(name), 2) for name in DIRECTIVES} | {"ambiguous": ("if(size(ambiguous) > 0, draft, null)", 3), "inject_fuzzy": (inject_fuzzy(), 4)}
    each = "array(" + ", ".join(f"named_struct('draft_id', concat_ws('/', scenario_id, '{name}'), 'error', '{name}', 'tier', {tier}, 'text', {text})" for name, (text, tier) in errors.items()) + ")"
    return drafts.withColumn("texts", F.expr(f"filter({each}, e_ -> e_.text is not null)"))


def variants(drafts: DataFrame) -> DataFrame:
    """variants_in_rows() as a row for each: draft_id, error, tier, draft, and the other columns of drafts."""
    rows = variants_in_rows(drafts).withColumn("e", F.explode_outer("texts")).where("e is not null")
    return rows.select("e.draft_id", "e.error", "e.tier", F.col("e.text").alias("corrupted"), *(c for c in drafts.columns if c != "draft")).withColumnRenamed("corrupted", "draft")
