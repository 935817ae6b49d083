"""A bounded recovery with lookups, for many drafts at once: every step of the loop is a column of a draft's own row.

A model's answers and the lookups that succeed are tables. Per draft there are at most two rounds and
a forced end, three calls a round and six executions, so all that a row holds is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import quoted
from ledgerloom.plans.rounds import LIMITS, step_problem, verify
from ledgerloom.sources.shared import saved

# Why a call or a recovery fails.
BUDGET_SPENT, FAILED, EXHAUSTED = "total tool budget exhausted", "tool call failed", "agentic_recovery_exhausted"
FORCED_ROUND = -1

_LOG = "array<struct<round_index:int,call_index:int,tool_name:string,argument:string,ok:boolean,cached:boolean,error:string>>"
_STATE = f"struct<cache:array<string>,executed:int,log:{_LOG}>"


def key(call: str) -> str:
    """SQL: what tells two calls apart; arguments without regard to case."""
    return f"concat({call}.tool_name, '|', lower(coalesce({call}.argument, '')))"


def _attempts(state: str, calls: str, round_index: int) -> str:
    """SQL: the state after some calls in order. A call made before with success is free; beyond the budget none runs."""
    fresh = f"array_contains(known, {key('x_')})"
    kind = f"case when array_contains(s_.cache, {key('x_')}) then 'cached' when s_.executed >= {LIMITS['executions']} then 'spent' when {fresh} then 'ok' else 'failed' end"
    error = f"case {kind} when 'spent' then {quoted(BUDGET_SPENT)} when 'failed' then {quoted(FAILED)} else '' end"
    row = f"named_struct('round_index', {round_index}, 'call_index', i_, 'tool_name', x_.tool_name, 'argument', coalesce(x_.argument, ''), 'ok', {kind} in ('cached', 'ok'), 'cached', {kind} = 'cached', 'error', {error})"
    after = f"named_struct('cache', if({kind} = 'ok', concat(s_.cache, array({key('x_')})), s_.cache), 'executed', s_.executed + if({kind} in ('ok', 'failed'), 1, 0), 'log', concat(s_.log, array({row})))"
    numbered = f"transform({calls}, (y_, n_) -> named_struct('x', y_, 'n', n_))"
    return f"aggregate({numbered}, {state}, (s_, c_) -> cast({after.replace('x_.', 'c_.x.').replace('i_,', 'c_.n,')} as {_STATE}))"


def _missing(state: str) -> str:
    return f"filter(required, r_ -> not array_contains({state}.cache, {key('r_')}))"


def recover(cases: DataFrame, required: DataFrame, answers: DataFrame, known: DataFrame) -> DataFrame:
    """draft_id, scenario_id, text, llm_calls, tool_calls, forced_final, coverage_forced, calls of each case.

    cases: draft_id, scenario_id. required: draft_id, tool_name, argument that must be looked up with
    success. answers: draft_id, step (0, 1 and, if it comes to that, 2), answer: struct<type, calls:
    array<struct<tool_name, argument>>, draft>; a missing or wrong one asks for nothing. known:
    scenario_id, tool_name, argument of the lookups that succeed.

    A final draft counts only once all that is required was looked up. After two rounds what is
    missing is looked up by force, within the same budget; if it still is, there is no text.
    """
    rows = cases.join(required.groupBy("draft_id").agg(F.sort_array(F.collect_list(F.struct("tool_name", "argument"))).alias("required")), "draft_id", "left")
    rows = rows.join(answers.where(F.col("step").between(0, LIMITS["rounds"])).groupBy("draft_id").agg(F.map_from_entries(F.collect_list(F.struct("step", "answer"))).alias("answers")), "draft_id", "left")
    rows = rows.join(known.select("scenario_id", F.expr(f"concat(tool_name, '|', lower(coalesce(argument, '')))").alias("k")).groupBy("scenario_id").agg(F.collect_set("k").alias("known")), "scenario_id", "left")
    empty = lambda c, kind: F.coalesce(F.col(c), F.expr(f"cast(array() as {kind})"))
    rows = rows.withColumn("required", empty("required", "array<struct<tool_name:string,argument:string>>")).withColumn("known", empty("known", "array<string>"))
    rows = rows.withColumn("state", F.expr(f"cast(named_struct('cache', array(), 'executed', 0, 'log', array()) as {_STATE})")).withColumn("text", F.lit(None).cast("string")).withColumn("llm_calls", F.lit(0))
    for n in range(LIMITS["rounds"]):
        rows = rows.withColumn("a", F.expr(f"if(text is null, try_element_at(answers, {n}), null)")).withColumn("valid", F.expr(f"a is not null and {step_problem('a')} is null"))
        rows = rows.withColumn("llm_calls", F.expr("llm_calls + if(text is null, 1, 0)"))
        rows = rows.withColumn("state", F.expr(f"if(valid and a.type = 'tools', {_attempts('state', 'a.calls', n)}, state)"))
        rows = rows.withColumn("text", F.expr(f"if(valid and a.type = 'final' and size({_missing('state')}) = 0, trim(a.draft), text)"))
    rows = rows.withColumn("forced_final", F.expr("text is null")).withColumn("before", F.col("state"))
    rows = rows.withColumn("state", F.expr(f"if(forced_final, {_attempts('state', _missing('state'), FORCED_ROUND)}, state)"))
    rows = rows.withColumn("coverage_forced", F.expr(f"transform(filter(state.log, l_ -> l_.round_index = {FORCED_ROUND} and l_.ok), l_ -> l_.tool_name)"))
    rows = rows.withColumn("asked", F.expr(f"forced_final and size({_missing('state')}) = 0")).withColumn("a", F.expr(f"if(asked, try_element_at(answers, {LIMITS['rounds']}), null)"))
    rows = rows.withColumn("text", F.expr(f"case when not forced_final then text when a is not null and {step_problem('a')} is null and a.type = 'final' then trim(a.draft) else '' end"))
    return rows.select("draft_id", "scenario_id", "text", F.expr("llm_calls + if(asked, 1, 0)").alias("llm_calls"), F.col("state.executed").alias("tool_calls"), "forced_final", "coverage_forced", F.col("state.log").alias("calls"))


def settle(recovered: DataFrame, scenarios: DataFrame, revision_index: int = 1, verdicts: DataFrame | None = None) -> DataFrame:
    """recovered with action and reason, by the same verification as any draft.

    A recovery is the last revision: one that would have to be revised again, or has no text, is escalated.
    """
    recovered = saved(recovered, "recovered")
    drafts = recovered.where("text <> ''").select("draft_id", "scenario_id", F.col("text").alias("draft"), F.lit(revision_index).alias("revision_index")).join(scenarios, "scenario_id")
    _, _, decisions = verify(drafts, verdicts)
    found = recovered.join(decisions.select("draft_id", "action", "reason"), "draft_id", "left")
    lost = F.coalesce(F.col("action") == "revise", F.lit(True))
    return found.withColumn("reason", F.when(lost, EXHAUSTED).otherwise(F.col("reason"))).withColumn("action", F.when(lost, "escalate").otherwise(F.col("action")))
