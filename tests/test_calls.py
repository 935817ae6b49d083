"""The table of a model's calls: how often a model is asked, what a run leaves behind, and its answers' schema."""

import json
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.plans import calls
from ledgerloom.plans.calls import answer_problem, ask, trace_lines
from ledgerloom.sources import events

ASK = "key string, prompt string"
GOOD = "if(output like 'good%', null, 'not good')"


def counting(folder, answers):
    """A model that notes each call in a file of its own; answers by prompt and attempt."""
    Path(folder).mkdir()

    @F.udf(T.StringType())
    def answer(prompt, attempt):
        import uuid

        (Path(folder) / uuid.uuid4().hex).write_text(f"{prompt}|{attempt}")
        return answers.get((prompt, attempt), answers.get(prompt))

    return lambda requests: requests.select("prompt_sha", answer("prompt", "attempt").alias("output"))


def asked(folder):
    return Counter(p.read_text() for p in Path(folder).iterdir())


def test_a_model_is_asked_once_for_a_prompt_and_attempt(spark, tmp_path):
    """Three keys, one of which always fails, answers and traces read many times: five calls."""
    complete = counting(tmp_path / "calls", {"p": "good", ("q", 2): "good at last"})
    requests = spark.createDataFrame([("a", "p"), ("b", "q"), ("c", "r")], ASK)
    table = str(tmp_path / "table")
    answers, traces = ask(requests, complete, table, "draft", GOOD, 2)
    for _ in range(3):
        assert {(r.key, r.output) for r in answers.collect()} == {("a", "good"), ("b", "good at last")} and traces.count() == 5
    assert asked(tmp_path / "calls") == {"p|1": 1, "q|1": 1, "r|1": 1, "q|2": 1, "r|2": 1}
    got = {(r.prompt, r.attempt): (r.ok, r.error) for r in traces.collect()}
    assert got == {("p", 1): (True, None), ("q", 1): (False, "not good"), ("q", 2): (True, None), ("r", 1): (False, "not good"), ("r", 2): (False, "not good")}


def test_a_run_goes_on_where_the_last_one_stopped(spark, tmp_path):
    table, folder = str(tmp_path / "table"), tmp_path / "calls"
    complete = counting(folder, {"p": "good", "q": "bad", "r": "good"})
    ask(spark.createDataFrame([("a", "p"), ("b", "q")], ASK), complete, table, "draft", GOOD, 1)
    more = spark.createDataFrame([("x", "p"), ("y", "q"), ("z", "r"), ("z2", "r"), ("n", None)], ASK)
    answers, traces = ask(more, complete, table, "draft", GOOD, 3)
    assert {r.key for r in answers.collect()} == {"x", "z", "z2"}
    assert asked(folder) == {"p|1": 1, "q|1": 1, "q|2": 1, "q|3": 1, "r|1": 1, "|1": 1, "|2": 1, "|3": 1}
    ask(more, complete, table, "draft", GOOD, 3)
    assert sum(asked(folder).values()) == 8
    ask(more, complete, table, "judge", GOOD, 1)  # another task has calls of its own
    assert sum(asked(folder).values()) == 12 and traces.count() == 8
    assert [r.problem for r in events.problems(trace_lines(traces, "run").selectExpr("monotonically_increasing_id() as offset", "line")).collect()] == [None] * 8


def test_a_failed_job_commits_nothing(spark, tmp_path):
    table = str(tmp_path / "table")
    requests = spark.createDataFrame([(str(i), f"p{i}") for i in range(200)], ASK)
    broken = lambda r: r.select("prompt_sha", F.when(F.col("prompt") == "p7", F.raise_error(F.lit("lost"))).otherwise(F.lit("good")).alias("output"))
    with pytest.raises(Exception, match="lost"):
        ask(requests, broken, table, "draft", GOOD)
    assert calls.calls(spark, table).count() == 0
    answers, _ = ask(requests, lambda r: r.select("prompt_sha", F.lit("good").alias("output")), table, "draft", GOOD)
    assert answers.count() == 200
    assert ask(requests.limit(0), broken, table, "draft", GOOD)[0].count() == 0


def test_tasks_of_an_attempt_are_bounded(spark, tmp_path, monkeypatch):
    """Each task reports to the driver, so there are no more of them than TASKS, whatever the number of calls."""
    monkeypatch.setattr(calls, "TASK_CALLS", 2)
    monkeypatch.setattr(calls, "TASKS", 8, raising=False)
    requests = spark.createDataFrame([(str(i), f"p{i}") for i in range(200)], ASK)
    answers, _ = ask(requests, lambda r: r.select("prompt_sha", F.lit("good").alias("output")), str(tmp_path / "table"), "draft", GOOD)
    assert answers.count() == 200 and 1 < len(list((tmp_path / "table").rglob("*.parquet"))) <= 8


def test_a_models_own_errors_are_failures(spark, tmp_path):
    complete = lambda r: r.select("prompt_sha", F.lit("good").alias("output"), F.when(F.col("attempt") == 1, "timeout").alias("error"))
    answers, traces = ask(spark.createDataFrame([("a", "p")], ASK), complete, str(tmp_path / "table"), "draft", GOOD)
    assert [(r.attempt, r.ok, r.error) for r in traces.orderBy("attempt").collect()] == [(1, False, "timeout"), (2, True, None)] and answers.count() == 1


SCHEMA = {
    "type": "object", "required": ["type", "n"], "additionalProperties": False,
    "properties": {
        "type": {"enum": ["tools", "it's"]}, "n": {"type": "integer", "minimum": 1, "maximum": 4}, "x": {"type": ["number", "null"]}, "s": {"type": "string", "minLength": 2}, "b": {"type": "boolean"}, "c": {"const": "k"},
        "calls": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "object", "properties": {"name": {"type": "string"}, "ids": {"type": "array", "items": {"type": "integer"}}}, "required": ["name"]}},
    },
}
CASES = [
    ({}, None), ({"n": 0}, "$.n: minimum is 1"), ({"n": 5}, "$.n: maximum is 4"), ({"n": 2.5}, "$.n: not of type integer"), ({"n": True}, "$.n: not of type integer"), ({"n": None}, "$.n: not of type integer"), ({"type": "odd"}, "$.type: not one of tools, it's"), ({"type": 3}, "$.type: not one of tools, it's"),
    ({"type": "it's"}, None), ({"x": 1}, None), ({"x": 1.5}, None), ({"x": 1e300}, None), ({"x": None}, None), ({"x": "1"}, "$.x: not of type number or null"), ({"s": "é"}, "$.s: shorter than 2"), ({"s": "éa"}, None), ({"b": 1}, "$.b: not of type boolean"), ({"b": False}, None), ({"c": "l"}, "$.c: not one of k"),
    ({"calls": []}, "$.calls: minItems is 1"), ({"calls": [{"name": "a"}] * 3}, "$.calls: maxItems is 2"), ({"calls": [{"name": "a"}, {}]}, "$.calls[]: lacks name"), ({"calls": [{"name": "a", "more": 1}]}, None), ({"calls": [{"name": 1}]}, "$.calls[].name: not of type string"), ({"calls": [{"name": "a", "ids": [1, "2"]}]}, "$.calls[].ids[]: not of type integer"),
    ({"calls": [{"name": "a", "ids": [1, 2]}]}, None), ({"calls": {}}, "$.calls: not of type array"), ({"odd": 1}, "$: has other keys"),
]


def test_schemas_become_sql(spark):
    rows = [(json.dumps({"type": "tools", "n": 2} | given), wrong) for given, wrong in CASES]
    rows += [('{"n": 2}', "$: lacks type"), ("[1]", "$: not of type object"), ("3", "$: not of type object"), ('"x"', "$: not of type object"), ("null", "$: not of type object"), ("{", "not JSON"), ("", "not JSON"), (None, "no answer")]
    got = spark.createDataFrame(rows, "output string, want string").selectExpr("output", "want", f"{answer_problem(SCHEMA)} as got").collect()
    assert [(r.output, r.got) for r in got] == rows


def test_schemas_that_are_not_understood():
    for schema in ({"oneOf": []}, {"type": "odd"}, {"enum": [1]}):
        with pytest.raises(ValueError):
            answer_problem(schema)
