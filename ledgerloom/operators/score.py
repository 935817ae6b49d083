"""Scores of checked drafts: grounding and completeness, and score events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import quoted, render
from ledgerloom.functions.text import found
from ledgerloom.schema import CODE_TYPES, NET

# How a reply says that nothing is due; what a complete reply holds.
NOTHING_DUE = r"no\s+balance|nothing\s+(?:further\s+)?(?:is\s+)?owed|fully\s+paid|paid\s+in\s+full"
ITEMS = ("net_balance_stated", "open_invoices_itemized", "unapplied_cash_mentioned", "open_credit_mentioned")


def grounding(checked: DataFrame) -> DataFrame:
    """draft_id, grounding_checked, grounding_total over the types that code checks; unresolved ones count in the total."""
    code = F.col("type").isin(*CODE_TYPES)
    return checked.groupBy("draft_id").agg(F.count_if(code & F.coalesce(F.col("result.status") == "pass", F.lit(False))).alias("grounding_checked"), F.count_if(code).alias("grounding_total"))


def with_claims(drafts: DataFrame, checked: DataFrame) -> DataFrame:
    """drafts with ``claims``, the checked claims of each in reading order; empty for one without."""
    claim = F.struct("n", "claim_id", "type", "span", "token", "subject_ids", "subject_id", "role", "cents", "result")
    rows = drafts.join(checked.groupBy("draft_id").agg(F.sort_array(F.collect_list(claim)).alias("claims")), "draft_id", "left")
    return rows.withColumn("claims", F.coalesce("claims", F.array().cast(dict(rows.dtypes)["claims"])))


def completeness_items(drafts: DataFrame, checked: DataFrame) -> DataFrame:
    """drafts (draft_id, draft, view columns) with ``claims`` and ``items``: name, applicable, present, hint; none for an empty draft."""
    return items_in_rows(with_claims(drafts, checked))


def items_in_rows(rows: DataFrame) -> DataFrame:
    """Rows with draft, claims (checked) and the view's columns, with ``items``. Passing claims tell which documents are named, and whether the net is stated."""
    passing = "filter(claims, c_ -> c_.result.status = 'pass')"
    rows = rows.withColumn("referenced", F.expr(f"array_distinct(flatten(transform(filter({passing}, c_ -> c_.type in ('C-EXIST', 'C-AMT')), c_ -> if(c_.type = 'C-EXIST', array(c_.token), c_.subject_ids))))"))
    rows = rows.withColumn("net_stated", F.expr(f"coalesce(exists({passing}, c_ -> c_.type = 'C-SUM' and exists(c_.result.cited, y_ -> y_ = '{NET}')), false)"))
    needed = lambda kind: f"filter(docs, d_ -> d_.kind = '{kind}' and d_.open > 0)"
    named = "coalesce(referenced, cast(array() as array<string>))"
    net = f"coalesce(net_stated, false) or (net_balance = 0 and {found('draft', NOTHING_DUE)})"
    item = lambda name, applicable, present, hint: f"named_struct('name', '{name}', 'applicable', {applicable}, 'present', {present}, 'hint', {hint})"

    def listed(name: str, kind: str, hint: str, figure: bool) -> str:
        each = f"concat(d_.id, ' (', {render('d_.open')}, ')')" if figure else "d_.id"
        return item(name, f"size({needed(kind)}) > 0", f"size({needed(kind)}) > 0 and size(array_except(transform({needed(kind)}, d_ -> d_.id), {named})) = 0", f"concat({quoted(hint)}, array_join(transform({needed(kind)}, d_ -> {each}), ', '))")

    items = "array(" + ", ".join([
        item(ITEMS[0], "true", net, f"concat('state the balance due, ', {render('net_balance')}, ', as the account total exactly once')"),
        listed(ITEMS[1], "invoice", "itemize every open invoice by its ID: ", False),
        listed(ITEMS[2], "payment", "mention the unapplied payment(s) by ID: ", True),
        listed(ITEMS[3], "credit_memo", "mention the open credit memo(s) by ID: ", True),
    ]) + ")"
    return rows.withColumn("items", F.expr(f"if(trim(coalesce(draft, '')) = '', filter({items}, i_ -> false), {items})"))


def completeness(items: DataFrame) -> DataFrame:
    """draft_id, completeness_present, completeness_total over the applicable items."""
    size = lambda test: F.expr(f"cast(size(filter(items, i_ -> {test})) as bigint)")
    return items.select("draft_id", size("i_.applicable and i_.present").alias("completeness_present"), size("i_.applicable").alias("completeness_total"))


def score_events(drafts: DataFrame, checked: DataFrame) -> DataFrame:
    """A score row for each draft, also for those without claims. drafts has scenario_id, pass_label, stage, revision_count, terminal_action."""
    return score_in_rows(with_claims(drafts, checked))


def score_in_rows(rows: DataFrame) -> DataFrame:
    """score_events() of rows with checked claims. Claims of a type that code checks count, unresolved ones in the total only."""
    keys = ["draft_id", "scenario_id", "pass_label", "stage", "revision_count", "terminal_action"]
    code = "c_.type in (" + ", ".join(map(quoted, CODE_TYPES)) + ")"
    size = lambda array, test: F.expr(f"cast(size(filter({array}, c_ -> {test})) as bigint)")
    return items_in_rows(rows).select(
        *keys, size("claims", f"{code} and c_.result.status = 'pass'").alias("grounding_checked"), size("claims", code).alias("grounding_total"),
        size("items", "c_.applicable and c_.present").alias("completeness_present"), size("items", "c_.applicable").alias("completeness_total"),
    )
