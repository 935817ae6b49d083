"""Reports over the event log: DataFrames of figures; a few lines of Markdown are made of them on the driver."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import percent, points, ratio
from ledgerloom.functions.text import found

PASSES = ("pass1", "pass2", "pass2R")


def latest(events: DataFrame, *keys: str) -> DataFrame:
    """The last event of each key in the order of the log. max_by of all columns, so that map tasks already drop earlier ones."""
    rest = [c for c in events.columns if c not in keys]
    last = events.groupBy(*keys).agg(F.max_by(F.struct(*rest), "offset").alias("e"))
    return last.select(*keys, *(F.col("e").getField(c).alias(c) for c in rest))


def before_after(scores: DataFrame) -> DataFrame:
    """Sums of each pass over its scenarios' latest first-pass scores."""
    rows = latest(scores.where((F.col("stage") == "first_pass") & F.col("pass_label").isin(*PASSES)), "pass_label", "scenario_id")
    out = rows.groupBy("pass_label").agg(F.count("*").alias("scenarios"), *(F.sum(c).alias(c) for c in ("grounding_checked", "grounding_total", "completeness_present", "completeness_total", "revision_count")))
    return out.withColumn("grounding", F.expr(ratio("grounding_checked", "grounding_total"))).withColumn("completeness", F.expr(ratio("completeness_present", "completeness_total")))


def action_histogram(scores: DataFrame) -> DataFrame:
    """pass_label, terminal_action, action_count, place: the most frequent first, of equal ones by name."""
    rows = latest(scores.where((F.col("stage") == "first_pass") & F.col("pass_label").isin(*PASSES)), "pass_label", "scenario_id")
    counts = rows.groupBy("pass_label", "terminal_action").agg(F.count("*").alias("action_count"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("pass_label").orderBy(F.desc("action_count"), "terminal_action")))


def paired(scores: DataFrame, one: str = "pass1", two: str = "pass2") -> DataFrame:
    """Scenarios of either pass: paired ones with the change in points, others with paired = false."""
    rows = latest(scores.where(F.col("stage") == "first_pass"), "pass_label", "scenario_id")
    side = lambda label, tag: rows.where(F.col("pass_label") == label).select("scenario_id", F.col("grounding_checked").alias(f"checked{tag}"), F.col("grounding_total").alias(f"total{tag}"))
    both = side(one, 1).join(side(two, 2), "scenario_id", "full")
    whole = F.col("checked1").isNotNull() & F.col("checked2").isNotNull()
    return both.withColumn("paired", whole).withColumn("change", F.when(whole, F.expr(points("checked1", "total1", "checked2", "total2"))))


# Phrases that show a behaviour.
IN_PLACE = r"reflected in the balance|reduces the balance|already reflected"
INVITES = r"(do|does)\s+not\s+match\s+your\s+records|let us know if"


def behaviours(drafts: DataFrame) -> DataFrame:
    """Behaviours of first-pass drafts by pass: present of applicable. drafts: pass_label, draft, and columns of ledger.view."""
    opened = "filter(docs, d_ -> d_.kind = 'invoice' and d_.open > 0)"
    loose = "exists(docs, d_ -> d_.kind <> 'invoice' and d_.open > 0)"
    dated = f"forall({opened}, d_ -> contains(draft, cast(d_.date as string)) and contains(draft, cast(d_.due as string)))"
    tests = {
        "greets the client by name": "contains(draft, name)",
        "itemizes open invoices with issue and due dates": f"if(size({opened}) = 0, cast(null as boolean), {dated})",
        "explains unapplied cash or credit in place": f"if({loose}, {found('draft', IN_PLACE)}, cast(null as boolean))",
        "invites reconciliation in the closing": found("draft", INVITES),
    }
    each = drafts.select("pass_label", F.explode(F.map_from_entries(F.array(*(F.struct(F.lit(n), F.expr(t)) for n, t in tests.items())))).alias("behaviour", "shown"))
    return each.groupBy("pass_label", "behaviour").agg(F.count_if("shown").alias("present"), F.count("shown").alias("applicable"))


def draft_length(drafts: DataFrame) -> DataFrame:
    """Mean characters by pass, rounded down."""
    return drafts.groupBy("pass_label").agg(F.expr("sum(length(draft)) div count(*)").alias("mean_chars"))


def injected_errors(rows: DataFrame) -> DataFrame:
    """By tier: caught of spoiled, sensitivity, specificity (from clean rows, tier 0) and their mean, all rounded down. Tiers without spoiled rows are left out."""
    clean = rows.where("tier = 0").agg(F.count("*").alias("clean"), F.count_if(~F.col("caught")).alias("quiet"))
    bad = rows.where("tier > 0").groupBy("tier").agg(F.count("*").alias("errors"), F.count_if("caught").alias("caught"))
    both = bad.crossJoin(F.broadcast(clean))  # one row
    return both.withColumn("sensitivity", F.expr("100 * caught div errors")).withColumn("specificity", F.expr("if(clean = 0, null, 100 * quiet div clean)")).withColumn("balanced", F.expr("(sensitivity + specificity) div 2"))


def pairwise(results: DataFrame) -> DataFrame:
    """Wins of the second draft, ties, losses, decisive pairs and the share of flipped ones."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    out = results.agg(n("b").alias("wins"), n("tie").alias("ties"), n("a").alias("losses"), F.count_if(F.col("verdict") != "tie").alias("decisive"), F.count_if("flipped").alias("flips"), F.count("*").alias("pairs"))
    return out.withColumn("flip_rate", F.expr(percent("flips", "pairs")))


def trace_stats(traces: DataFrame) -> DataFrame:
    """By task: attempts, ok, share, and failed attempts that name parsing."""
    parse = ~F.col("ok") & F.lower(F.coalesce("error", F.lit(""))).contains("parse")
    out = traces.groupBy("task").agg(F.count("*").alias("attempts"), F.count_if("ok").alias("ok"), F.count_if(parse).alias("parse_failures"))
    return out.withColumn("ok_share", F.expr(percent("ok", "attempts")))


def crosscheck(generations: DataFrame, scores: DataFrame, oracle: DataFrame) -> DataFrame:
    """Whether the gate's score and the independent judgement of each first-pass draft agree on its being clean.

    oracle: gen_id, verified, total. Clean: there is something, and all of it is right.
    """
    last = latest(generations.where("is_first_pass"), "gen_id").select("gen_id")
    own = latest(scores, "gen_id").select("gen_id", "grounding_checked", "grounding_total")
    clean = lambda a, b: (F.col(b) > 0) & (F.col(a) == F.col(b))
    rows = last.join(own, "gen_id").join(oracle.select("gen_id", "verified", "total"), "gen_id")
    rows = rows.withColumn("gate_clean", clean("grounding_checked", "grounding_total")).withColumn("oracle_clean", clean("verified", "total"))
    return rows.withColumn("agree", F.col("gate_clean") == F.col("oracle_clean"))


def recovery(cases: DataFrame) -> DataFrame:
    """Of the two arms: recovered cases, calls, mean calls to one decimal (cut), and how often an end was forced."""
    n = lambda c: F.count_if(c)
    out = cases.agg(F.count("*").alias("cases"), n("prompt_recovered").alias("prompt_recovered"), n("agentic_recovered").alias("agentic_recovered"), F.sum("prompt_llm_calls").alias("prompt_calls"), F.sum("agentic_llm_calls").alias("agentic_calls"), F.sum("agentic_tool_calls").alias("tool_calls"), n("agentic_forced_final").alias("forced_final"), n("agentic_coverage_forced").alias("coverage_forced"))
    mean = lambda c: F.when(F.col("cases") > 0, F.expr(f"concat(cast({c} div cases as string), '.', cast((10 * {c} div cases) % 10 as string))"))
    return out.withColumn("mean_agentic_calls", mean("agentic_calls")).withColumn("mean_tool_calls", mean("tool_calls")).withColumn("forced_share", F.expr(percent("forced_final", "cases")))


def pending_review(generations: DataFrame, verifications: DataFrame, decisions: DataFrame) -> DataFrame:
    """Drafts that the gate passed on to a human and that none has decided, by gen_id."""
    asked = latest(verifications, "gen_id").where("action = 'human_gate'").select("gen_id")
    return latest(generations, "gen_id").join(asked, "gen_id").join(decisions.select("gen_id"), "gen_id", "left_anti")


def apply_decisions(pending: DataFrame, asked: DataFrame, failing: DataFrame) -> DataFrame:
    """asked (gen_id, action, final_text, override) with outcome: why it is refused, or null and the text that goes out.

    failing: gen_ids whose final text fails a code check. A decision on a draft that isn't pending, or
    whose text fails, is refused unless overridden; an approval without a text sends the draft.
    """
    rows = asked.join(pending.select("gen_id", "draft"), "gen_id", "left").join(failing.select("gen_id", F.lit(True).alias("bad")), "gen_id", "left")
    refused = F.when(~F.col("override") & F.col("draft").isNull(), "not pending").when(~F.col("override") & (F.col("action") != "decline") & F.coalesce("bad", F.lit(False)), "fails a check")
    text = F.when(F.col("action") == "decline", "").when((F.col("action") == "approve") & (F.coalesce("final_text", F.lit("")) == ""), F.col("draft")).otherwise(F.col("final_text"))
    return rows.select("gen_id", "action", refused.alias("refused"), F.when(refused.isNull(), text).alias("sent_text"))


def fixed3(column: str) -> str:
    """SQL: three decimals, n/a for NaN and null."""
    return f"if({column} is null or isnan({column}), 'n/a', format_string('%.3f', {column}))"


def cell(value: object) -> str:
    return str(value).replace("\n", " ").replace("|", "\\|")


#: A table in a report is for people; one with more rows is refused rather than gathered.
MOST_ROWS = 100_000


def markdown(df: DataFrame, order: list[str]) -> str:
    """A report's rows as a Markdown table, MOST_ROWS of them at most."""
    found = df.orderBy(*order, *(c for c in df.columns if c not in order)).limit(MOST_ROWS + 1).collect()  # ties in one order too
    if len(found) > MOST_ROWS:
        raise ValueError(f"a report of more than {MOST_ROWS} rows; sum them up first")
    rows = [df.columns, ["---"] * len(df.columns), *found]
    return "\n".join("| " + " | ".join(cell("" if v is None else v) for v in r) + " |" for r in rows)


INJECTION = "<!-- results:"


#: The fixed set of reports: name, title, and what it says as long as there is nothing to report.
REPORTS = {
    "before_after": ("First drafts by pass", "No first-pass scores are logged yet."),
    "injected_errors": ("Injected errors", "No errors were injected yet."),
    "capability_gaps": ("Capability gaps", "No gaps are logged yet."),
    "calibration": ("Agreement of the judge with people", "No judge scores were compared yet."),
    "pairwise": ("Drafts in pairs, in both orders", "No pairs were judged yet."),
    "trace_stats": ("Model calls", "No calls are logged yet."),
    "oracle_crosscheck": ("Gate and independent judgement", "No drafts were cross-checked yet."),
    "agentic_recovery": ("Recovery by prompt and with tools", "No recoveries were compared yet."),
}


def report_set(found: dict[str, list[tuple[DataFrame, list[str]]]]) -> dict[str, str]:
    """All reports as Markdown: a title and a table for each (figures, order); the placeholder where all figures are empty."""
    if unknown := set(found) - set(REPORTS):
        raise ValueError(f"unknown reports: {sorted(unknown)}")
    out = {}
    for name, (title, placeholder) in REPORTS.items():
        tables = [markdown(df, order) for df, order in found.get(name, ()) if not df.isEmpty()]
        out[name] = "\n\n".join([f"# {title}", *(tables or [placeholder])]) + "\n"
    return out


def log_reports(scores: DataFrame, errors: DataFrame, gaps: DataFrame, agreement: DataFrame, pairs: DataFrame, traces: DataFrame, checked: DataFrame, cases: DataFrame) -> dict[str, str]:
    """The eight reports from their inputs: score events, rows of rounds.errors_run, derived gaps, an agreement report,
    verdicts on pairs, trace events, rows of crosscheck() and of rounds.recovery_bench. Any may be empty."""
    from ledgerloom.operators.gate import aggregate_gaps

    shown = agreement.select("measure", "n", *(F.expr(fixed3(c)).alias(c) for c in ("statistic", "lo", "hi")), F.expr(fixed3("pabak")).alias("pabak"), F.expr(fixed3("raw_agreement")).alias("raw_agreement"))
    some = lambda df, rows: df.where("false") if rows.isEmpty() else df  # noqa: E731  sums over nothing are a row too
    verdicts = checked.groupBy("agree").agg(F.count("*").alias("drafts"), F.array_join(F.sort_array(F.collect_list(F.when(~F.col("agree"), F.col("gen_id")))), ", ").alias("disagreements"))
    return report_set({
        "before_after": [(before_after(scores).select("pass_label", "scenarios", "grounding", "completeness", "revision_count"), ["pass_label"]), (action_histogram(scores), ["pass_label", "place"]), (paired(scores).where("paired").select("scenario_id", "change"), ["scenario_id"])],
        "injected_errors": [(injected_errors(errors), ["tier"]), (errors.select("tier", "error", "scenario_id", "action", "reason", "caught"), ["tier", "error", "scenario_id"])],
        "capability_gaps": [(aggregate_gaps(gaps).select("missing", "gap_count", F.array_join("draft_ids", ", ").alias("draft_ids")), ["missing"])],
        "calibration": [(shown, ["measure"])],
        "pairwise": [(some(pairwise(pairs), pairs), ["pairs"])],
        "trace_stats": [(trace_stats(traces), ["task"])],
        "oracle_crosscheck": [(verdicts, ["agree"])],
        "agentic_recovery": [(some(recovery(cases), cases), ["cases"]), (cases.select("draft_id", "failure_kind", "prompt_recovered", "agentic_recovered", "agentic_llm_calls", "agentic_tool_calls", "agentic_forced_final"), ["draft_id"])],
    })


def write_reports(texts: dict[str, str], folder: str) -> list[str]:
    """Write each text as <name>.md; one that holds an injection mark is refused before anything is written."""
    from pathlib import Path

    if bad := [name for name, text in texts.items() if INJECTION in text]:
        raise ValueError(f"reports that hold an injection mark: {bad}")
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, text in sorted(texts.items()):
        (Path(folder) / f"{name}.md").write_text(text, encoding="utf-8")
    return [str(Path(folder) / f"{name}.md") for name in sorted(texts)]


def inject(text: str, blocks: dict[str, str]) -> str:
    """Replace the blocks between <!-- results:name --> and <!-- /results:name -->; an unknown or unclosed one fails."""
    opened, closed = (re.findall(rf"<!-- {x}results:([\w-]+) -->", text) for x in ("", "/"))
    if sorted(opened) != sorted(closed):
        raise ValueError("a block isn't closed")
    if unknown := set(opened) - set(blocks):
        raise ValueError(f"unknown blocks: {sorted(unknown)}")
    for name in opened:
        mark = rf"(<!-- results:{name} -->\n).*?(<!-- /results:{name} -->)"
        text = re.sub(mark, lambda m, n=name: m[1] + blocks[n].rstrip("\n") + "\n" + m[2], text, flags=re.S)
    return text
