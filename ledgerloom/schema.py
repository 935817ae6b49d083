"""Schemas and closed vocabularies of the ledger, claims and events."""

from __future__ import annotations

from pyspark.sql import types as T

# The names that ledgers, claims, decisions and logs use.
LABELS = ("unapplied_cash", "partial", "open_credit", "near_duplicate", "cutoff_risk", "ambiguous")
CODE_TYPES = ("C-EXIST", "C-AMT", "C-SUM", "C-STATUS", "C-DATE")
FUZZY_TYPE = "C-FUZZY"
CHECK_STATUSES = ("pass", "fail", "unsupported", "cannot_determine", "unverifiable")
GATE_ACTIONS = ("revise", "abstain", "escalate", "human_gate")
HUMAN_ACTIONS = ("approve", "edit", "decline")
POOLS = ("A", "B")
NET = "NET"
CUTOFF_DAYS = 5
#: The keys that every event may have, with their types and whether they must be there.
EVENT_BASE = (
    ("event_type", "str", True),
    ("schema_version", "int", False),
    ("ts", "str", False),
    ("run_id", "str", False),
)
#: The keys of each type of event.
EVENT_TYPES = {
    "run_start": (
        ("pass_label", "str", True),
        ("seed", "int", True),
        ("git_sha", "str", True),
        ("model_name", "str", True),
        ("model_digest", "str", True),
        ("config_hash", "str", True),
        ("pool", "str", True),
        ("memory_state_hash", "str", True),
    ),
    "generation": (
        ("gen_id", "str", True),
        ("scenario_id", "str", True),
        ("pool", "str", True),
        ("pass_label", "str", True),
        ("ledger_ref", "str", True),
        ("prompt_sha", "str", True),
        ("draft", "str", True),
        ("revision_index", "int", True),
        ("is_first_pass", "bool", True),
        ("generation_mode", "str", False),
    ),
    "verification": (
        ("gen_id", "str", True),
        ("claims", "list", True),
        ("decision", "object", True),
    ),
    "human_decision": (
        ("gen_id", "str", True),
        ("scenario_id", "str", True),
        ("pool", "str", True),
        ("action", "str", True),
        ("final_text", "str", True),
        ("reason", "str", True),
        ("decided_at", "str", False),
    ),
    "capability_gap": (
        ("gen_id", "str", True),
        ("scenario_id", "str", True),
        ("missing", "str", True),
        ("detail", "str", True),
        ("would_need", "str", True),
        ("resolvable_by", "str", True),
    ),
    "ingest": (
        ("consumed_through_offset", "int", True),
        ("entries_added", "int", True),
        ("entries_evicted", "int", True),
        ("memory_state_hash", "str", True),
    ),
    "score": (
        ("gen_id", "str", True),
        ("scenario_id", "str", True),
        ("pass_label", "str", True),
        ("stage", "str", True),
        ("grounding_checked", "int", True),
        ("grounding_total", "int", True),
        ("completeness_present", "int", True),
        ("completeness_total", "int", True),
        ("revision_count", "int", True),
        ("terminal_action", "str", True),
    ),
    "judgment": (
        ("gen_id", "str", False),
        ("pair_id", "str", False),
        ("mode", "str", True),
        ("ordering", "str", False),
        ("scores", "object", False),
        ("verdict", "str", False),
        ("prompt_sha", "str", True),
        ("parse_ok", "bool", True),
        ("judge_model", "str", False),
    ),
    "tool_call": (
        ("gen_id", "str", True),
        ("revision_index", "int", True),
        ("round_index", "int", True),
        ("call_index", "int", True),
        ("tool_name", "str", True),
        ("arguments", "object", False),
        ("result", "object", False),
        ("ok", "bool", True),
        ("error", "str", False),
    ),
    "trace": (
        ("task", "str", True),
        ("prompt_sha", "str", True),
        ("prompt", "str", True),
        ("output", "str", True),
        ("model_name", "str", True),
        ("attempt", "int", True),
        ("ok", "bool", True),
        ("error", "str", False),
        ("meta", "object", False),
    ),
}
#: Keys whose values are of a closed vocabulary.
EVENT_VALUES = {
    ("generation", "generation_mode"): ("prompt_initial", "prompt_revision", "agentic_recovery"), ("human_decision", "action"): HUMAN_ACTIONS, ("score", "stage"): ("first_pass", "final"),
    ("capability_gap", "missing"): ("allocation_reference", "unverifiable_quant", "ambiguous_reference", "document_absent", "other"), ("capability_gap", "resolvable_by"): ("human", "tool", "records", "nobody"), ("judgment", "mode"): ("rubric", "pairwise"),
}


def event_keys(event_type: str) -> dict[str, tuple[str, bool]]:
    """Type and whether it must be there, of each key of an event."""
    return {name: (kind, needed) for name, kind, needed in (*EVENT_BASE, *EVENT_TYPES[event_type])}


_S, _L, _D, _I = T.StringType(), T.LongType(), T.DateType(), T.IntegerType()


def _rows(*fields: tuple[str, T.DataType]) -> T.ArrayType:
    return T.ArrayType(_row(*fields))


def _row(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


LEDGER = _row(
    ("schema_version", _I), ("scenario_id", _S), ("pool", _S), ("structure_labels", T.ArrayType(_S)),
    ("client", _row(("id", _S), ("name", _S), ("terms_days", _I), ("as_of", _D))),
    ("invoices", _rows(("id", _S), ("date", _D), ("due", _D), ("amount_cents", _L), ("memo", _S))),
    ("payments", _rows(("id", _S), ("date", _D), ("amount_cents", _L), ("method", _S), ("reference", _S))),
    ("credit_memos", _rows(("id", _S), ("date", _D), ("amount_cents", _L), ("reason", _S))),
    ("applications", _rows(("source_id", _S), ("target_invoice", _S), ("amount_cents", _L))),
)
