"""The loop of draft, verify, decide and revise as batches: each round carries on only what has to be revised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.checks import check_in_rows, check_in_texts, judge_in_rows
from ledgerloom.operators.corrupt import variants, variants_in_rows
from ledgerloom.operators.extract import claims_in_rows, claims_of_texts, each_claim, extract_claims, found_in_texts
from ledgerloom.operators.gate import BUDGET, decide_in_rows, precheck
from ledgerloom.sources.shared import HEAVY, saved


def checked_in_rows(drafts: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """drafts with their claims, checked, in ``claims``. Without verdicts nothing is shuffled or written."""
    rows = check_in_rows(claims_in_rows(drafts))
    if verdicts is None:
        return rows
    own = verdicts.groupBy("draft_id").agg(F.collect_list(F.struct("claim_id", "ok", "verdict", "cited", "reason")).alias("verdicts"))
    return judge_in_rows(rows.join(own, "draft_id", "left"), "get(filter(verdicts, y_ -> y_.claim_id = c_.claim_id), 0)").drop("verdicts")


def checked_texts(rows: DataFrame) -> DataFrame:
    """checked_in_rows() of several texts of each row, in ``texts`` (structs of text and others): a row for each, with the others and the text as draft.

    A sentence that several of a row's texts have is searched and checked once.
    """
    return claims_of_texts(check_in_texts(found_in_texts(rows))).withColumnRenamed("text", "draft")


def verify(drafts: DataFrame, verdicts: DataFrame | None = None, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims, checked claims, decisions) of drafts: draft_id, scenario_id, draft, revision_index and the columns of ledger.view.

    Each is a plan of its own over the drafts; save drafts that cost much if more than one is used.
    keep: columns of the drafts that the decisions have too.
    """
    rows = checked_in_rows(drafts, verdicts)
    return extract_claims(drafts), each_claim(rows, "draft_id", "scenario_id"), decide_in_rows(rows, keep=keep)


def run_scenarios(scenarios: DataFrame, drafts: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """All decisions of a run: scenario_id, revision_index, action, reason, payload, first_pass, terminal.

    drafts (scenario_id, revision_index, draft) holds what the model would write in each round. A
    scenario that must abstain is never drafted, one without a draft for its round ends; a revision
    that repeats an earlier draft of its scenario escalates.
    """
    scenarios = saved(scenarios, "scenarios")
    unclear = precheck(scenarios)
    out = unclear.select("scenario_id", F.lit(0).alias("revision_index"), "action", "reason", F.lit("").alias("payload"))
    left = scenarios.join(unclear.select("scenario_id"), "scenario_id", "left_anti")
    earlier = None
    for n in range(BUDGET + 1):
        now = left.join(drafts.where(F.col("revision_index") == n).select("scenario_id", "revision_index", "draft"), "scenario_id").withColumn("draft_id", F.concat_ws("/", "scenario_id", "revision_index"))
        _, _, decisions = verify(now, verdicts)
        text = now.select("scenario_id", F.sha2("draft", 256).alias("hash"))
        if earlier is not None:
            repeated = text.join(earlier, ["scenario_id", "hash"], "left_semi").select("scenario_id", F.lit(True).alias("again"))
            loop = (F.col("action") == "revise") & F.coalesce("again", F.lit(False))
            decisions = decisions.join(repeated, "scenario_id", "left").withColumn("reason", F.when(loop, "revision loop").otherwise(F.col("reason"))).withColumn("action", F.when(loop, "escalate").otherwise(F.col("action")))
        earlier = text if earlier is None else earlier.union(text)
        decisions = saved(decisions.select("scenario_id", "revision_index", "action", "reason", "payload"), "decisions")
        out = out.unionByName(decisions)
        left = left.join(decisions.where("action = 'revise'").select("scenario_id"), "scenario_id", "left_semi")
    return out.withColumn("first_pass", F.col("revision_index") == 0).withColumn("terminal", F.col("action") != "revise")


def failed_subjects(checked: DataFrame) -> DataFrame:
    """draft_id, subjects: the documents of claims that didn't pass, each once, in reading order."""
    bad = checked.where("result.status is null or result.status <> 'pass'")
    each = bad.select("draft_id", "n", F.posexplode("subject_ids").alias("i", "subject")).groupBy("draft_id", "subject").agg(F.min(F.struct("n", "i")).alias("at"))
    return each.groupBy("draft_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "subject"))), lambda x: x["subject"]).alias("subjects"))


# Limits of the recovery with tools.
LIMITS = {"rounds": 2, "calls_per_round": 3, "executions": 6}


def required_evidence(scenarios: DataFrame, subjects: DataFrame) -> DataFrame:
    """scenario_id, tool_name, argument that a recovery must have looked up. subjects: scenario_id, subject (of a failed claim)."""
    one = lambda name, test="true": scenarios.where(test).select("scenario_id", F.lit(name).alias("tool_name"), F.lit("").alias("argument"))
    tool = F.when(F.col("subject").startswith("INV-"), "get_invoice").otherwise("get_source")
    own = subjects.select("scenario_id", tool.alias("tool_name"), F.col("subject").alias("argument")).distinct()
    return one("get_account_summary").unionByName(one("list_open_invoices")).unionByName(one("list_unapplied_sources", "unapplied_cash_total <> 0 or unapplied_credit_total <> 0")).unionByName(own)


def missing_evidence(required: DataFrame, calls: DataFrame) -> DataFrame:
    """What no successful call has looked up; arguments are compared without case. calls: scenario_id, tool_name, argument, ok."""
    key = F.lower(F.coalesce("argument", F.lit(""))).alias("key")
    done = calls.where("ok").select("scenario_id", "tool_name", key).distinct()
    return required.withColumn("key", F.lower("argument")).join(done, ["scenario_id", "tool_name", "key"], "left_anti").drop("key")


def over_limits(calls: DataFrame) -> DataFrame:
    """gen_id and limit for each recovery that broke one; calls from a cache are free. calls: gen_id, round_index (-1: forced), tool_name, argument, cached."""
    paid = calls.where(~F.coalesce("cached", F.lit(False)))
    rounds = calls.where("round_index >= 0").groupBy("gen_id").agg(F.countDistinct("round_index").alias("x")).where(F.col("x") > LIMITS["rounds"])
    each = paid.where("round_index >= 0").groupBy("gen_id", "round_index").agg(F.count("*").alias("x")).where(F.col("x") > LIMITS["calls_per_round"])
    total = paid.groupBy("gen_id").agg(F.count("*").alias("x")).where(F.col("x") > LIMITS["executions"])
    named = lambda df, limit: df.select("gen_id", F.lit(limit).alias("limit"), "x")
    return named(rounds, "rounds").unionByName(named(each, "calls_per_round")).unionByName(named(total, "executions"))


def step_problem(step: str = "step") -> str:
    """SQL: what is wrong with an agent's step (a struct of type, calls, draft), null if nothing."""
    return f"""case when {step} is null or {step}.type not in ('tools', 'final') then 'type must be tools or final'
        when {step}.type = 'tools' and coalesce(size({step}.calls), 0) = 0 then 'a tools step needs calls'
        when {step}.type = 'tools' and size({step}.calls) > {LIMITS['calls_per_round']} then 'too many calls'
        when {step}.type = 'final' and trim(coalesce({step}.draft, '')) = '' then 'a final step needs a draft'
        when {step}.type = 'final' and coalesce(size({step}.calls), 0) > 0 then 'a final step takes no calls' end"""


def errors_run(drafts: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Each error in each draft, and clean controls, through one verification: scenario_id, error, tier, action, reason, kinds, caught.

    caught, by tier: a clean control that isn't left for approval (so flagged wrongly); a spoiled or
    misread draft that is sent back, escalated or abstained from; an ambiguous scenario that is
    abstained from or escalated; a fuzzy claim that is sent back or escalated with a finding.
    """
    kept = ("error", "tier")
    if verdicts is None:
        decisions = decide_in_rows(checked_texts(variants_in_rows(drafts).drop("draft").withColumn("revision_index", F.lit(0))), keep=kept)
    else:
        _, _, decisions = verify(variants(drafts).withColumn("revision_index", F.lit(0)), verdicts, kept)
    found = decisions.withColumn("kinds", F.transform("findings", lambda f: f["kind"]))
    action = lambda *names: F.col("action").isin(*names)
    caught = F.when(F.col("tier") == 0, ~action("human_gate")).when(F.col("tier").isin(1, 2), action("revise", "escalate", "abstain"))
    caught = caught.when(F.col("tier") == 3, action("abstain", "escalate")).otherwise(action("revise", "escalate") & (F.size("kinds") > 0))
    return found.select("draft_id", "scenario_id", "error", "tier", "action", "reason", "kinds", caught.alias("caught"))


def recovery_bench(errors: DataFrame, prompt_arm: DataFrame, agentic_arm: DataFrame) -> DataFrame:
    """Correctable failures and how each arm fared. Arms: draft_id, action, llm_calls (agentic: tool_calls, forced_final, coverage_forced)."""
    cases = errors.where("action = 'revise'").select("draft_id", "scenario_id", F.col("error").alias("failure_kind"), "reason")
    ok = F.coalesce(F.col("action") == "human_gate", F.lit(False))
    one = prompt_arm.select("draft_id", ok.alias("prompt_recovered"), F.col("llm_calls").alias("prompt_llm_calls"))
    two = agentic_arm.select("draft_id", ok.alias("agentic_recovered"), F.col("llm_calls").alias("agentic_llm_calls"), F.col("tool_calls").alias("agentic_tool_calls"), F.col("forced_final").alias("agentic_forced_final"), F.col("coverage_forced").alias("agentic_coverage_forced"))
    return cases.join(one, "draft_id", "left").join(two, "draft_id", "left")
