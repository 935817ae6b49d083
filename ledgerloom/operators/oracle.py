"""A second, independent judgement of drafts: figures by replay of the records, sentences split more simply.

Nothing here uses the ledger's derived figures or the claim extractor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import let, quoted
from ledgerloom.functions.text import UNICODE, unmarked
from ledgerloom.sources.tables import Ledger

# The figures and references that are looked for.
AMOUNT = r"-?\$\d[\d,]*(?:\.\d{1,2})?"
ID = r"\b(?:INV|PMT|CM)-\d+\b"
BREAK = r"(?<=[.!?])\s+|\n+"
SID = "scenario_id"


def _replay(ledger: Ledger) -> DataFrame:
    """scenario_id, id, kind, original, rest, applied by one signed sum over all records."""
    whole = lambda df, kind: df.select(SID, "id", F.lit(kind).alias("kind"), F.col("amount_cents").alias("face"), F.lit(0).cast("long").alias("used"))
    use = lambda column: ledger.application.select(SID, F.col(column).alias("id"), F.lit(None).cast("string").alias("kind"), F.lit(0).cast("long").alias("face"), F.col("amount_cents").alias("used"))
    events = whole(ledger.invoice, "i").union(whole(ledger.payment, "p")).union(whole(ledger.credit_memo, "c")).union(use("target_invoice")).union(use("source_id"))
    sums = events.groupBy(SID, "id").agg(F.max("kind").alias("kind"), F.sum("face").alias("original"), F.sum("used").alias("applied"))
    return sums.where("kind is not null").withColumn("rest", F.col("original") - F.col("applied"))


def figures(ledger: Ledger) -> DataFrame:
    """scenario_id, known (id to its true figures), totals (of the account), truth (all figures). Zero is true only of a zero balance."""
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rest"))), F.lit(0))
    own = F.array_distinct(F.filter(F.array("original", "rest", F.when(F.col("applied") > 0, F.col("applied"))), lambda x: x.isNotNull()))
    rows = _replay(ledger).withColumn("own", own)
    found = rows.groupBy(SID).agg(F.map_from_entries(F.collect_list(F.struct("id", "own"))).alias("known"), part("i").alias("i"), part("p").alias("p"), part("c").alias("c"), F.array_union(F.collect_set("original"), F.collect_set("rest")).alias("each"))
    found = found.withColumn("net", F.expr("i - p - c")).withColumn("sums", F.array("i", "p", "c", "net"))
    honest = lambda c: F.expr(f"array_distinct(filter({c}, x_ -> x_ <> 0 or net = 0))")
    return found.select(SID, "known", honest("sums").alias("totals"), honest("array_union(each, sums)").alias("truth"))


def parse_cents(token: str) -> str:
    """A lenient second reading of a figure: commas anywhere."""
    body = let(f"split(regexp_replace({token}, '[-$,]', ''), '\\\\.')", "h_", "try_cast(h_[0] as bigint) * 100 + try_cast(rpad(if(size(h_) > 1, h_[1], '0'), 2, '0') as bigint)")
    return f"({body}) * if(startswith({token}, '-'), -1L, 1L)"


def grounding(drafts: DataFrame, facts: DataFrame) -> DataFrame:
    """draft_id, verified, total, unmatched: the figures of each sentence against the documents it names, and every reference.

    A sentence that names one known document may state that document's figures, one that names none
    the account's totals, one that names several either. All of a draft stays in its own row, so that
    its ledger's figures aren't copied for each sentence.
    """
    rows = drafts.select("draft_id", SID, F.expr(unmarked("coalesce(draft, '')")).alias("t")).join(facts, SID, "left")
    tokens = lambda text, pattern: f"regexp_extract_all({text}, {quoted(UNICODE + pattern)}, 0)"
    named = f"filter({tokens('s', ID)}, x_ -> map_contains_key(known, x_))"
    value = parse_cents("v_")
    own = f"exists(n_, y_ -> array_contains(element_at(known, y_), {value}))"
    right = f"coalesce(case size(n_) when 1 then array_contains(element_at(known, n_[0]), {value}) when 0 then array_contains(totals, {value}) else array_contains(totals, {value}) or {own} end, false)"
    hits = let(named, "n_", f"transform({tokens('s', AMOUNT)}, v_ -> named_struct('token', v_, 'kind', 'amount', 'ok', {right}))")
    amounts = f"flatten(transform(filter(split(t, {quoted(UNICODE + BREAK)}), s -> contains(s, '$')), s -> {hits}))"
    ids = f"transform({tokens('t', ID)}, x_ -> named_struct('token', x_, 'kind', 'id', 'ok', map_contains_key(known, x_)))"
    rows = rows.withColumn("hits", F.expr(f"if(known is null, null, concat({amounts}, {ids}))"))
    told = {"verified": "coalesce(cast(array_size(filter(hits, h_ -> h_.ok)) as bigint), 0L)", "total": "coalesce(cast(array_size(hits) as bigint), 0L)"}
    wrong = "sort_array(transform(filter(hits, h_ -> not h_.ok), h_ -> named_struct('kind', h_.kind, 'token', h_.token)))"
    return rows.select("draft_id", *(F.expr(e).alias(c) for c, e in told.items()), F.expr(f"if(size(hits) > 0, {wrong}, null)").alias("unmatched"))
