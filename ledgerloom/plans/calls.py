"""Calls of a model as a write-once table: an answer is committed before anything reads it, and never asked for again.

A call is known by its task, the hash of its prompt and the attempt. Each attempt is one job that
writes its answers to the table; what follows, later attempts included, reads the table. So a plan that
is computed twice, or on other executors, calls nobody, equal prompts are one call, and a run that is
started again goes on where the last one stopped. Only calls of a task that was lost before it
committed are made again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.money import quoted

#: From requests (prompt_sha, prompt, attempt) to (prompt_sha, output, and error if there is one): a model at the boundary.
Completer = Callable[[DataFrame], DataFrame]
CALLS = "task string, prompt_sha string, attempt int, prompt string, output string, model_name string, ok boolean, error string"
#: Calls that a task makes in turn, so that a lost one repeats few; of more than TASKS times as many, each of TASKS makes its share,
#: since every task sends a report of what it wrote to the driver.
TASK_CALLS, TASKS = 64, 1000
_KINDS = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "boolean": "BOOLEAN", "integer": "BIGINT", "null": "VOID"}


def prompt_sha(prompt: str = "prompt") -> str:
    """SQL: the hash that a prompt is known by."""
    return f"substr(sha2({prompt}, 256), 1, 16)"


def _is(kind: str, value: str) -> str:
    told = f"schema_of_variant({value})"
    if kind == "number":
        return f"({told} = 'BIGINT' or {told} = 'DOUBLE' or {told} like 'DECIMAL%')"
    if kind not in _KINDS:
        raise ValueError(f"unknown type: {kind}")
    return f"startswith({told}, '{_KINDS[kind]}')"


def json_problem(schema: dict, value: str, at: str = "$", depth: int = 0) -> str:
    """SQL: the first thing by which a variant breaks a JSON Schema, null if nothing.

    Understood are type (one or a list), enum, const, minimum, maximum, minLength, minItems, maxItems,
    items, properties, required and additionalProperties (false); other keywords are an error. A keyword for one
    type says nothing of others.
    """
    known = {"type", "enum", "const", "minimum", "maximum", "minLength", "minItems", "maxItems", "items", "properties", "required", "additionalProperties", "description"}
    if odd := set(schema) - known:
        raise ValueError(f"keywords that aren't understood: {sorted(odd)}")
    cases = [f"when {value} is null then {quoted(f'{at}: missing')}"]
    fails = lambda test, text: cases.append(f"when {test} then {quoted(f'{at}: {text}')}")
    text, number, items = f"try_variant_get({value}, '$', 'string')", f"try_variant_get({value}, '$', 'double')", f"try_variant_get({value}, '$', 'array<variant>')"
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        fails("not (" + " or ".join(_is(k, value) for k in kinds) + ")", "not of type " + " or ".join(kinds))
    allowed = [schema["const"]] if "const" in schema else schema.get("enum")
    if allowed is not None:
        if not all(isinstance(x, str) for x in allowed):
            raise ValueError("enum and const are understood for strings only")
        fails(f"not coalesce({_is('string', value)} and {text} in ({', '.join(map(quoted, allowed))}), false)", "not one of " + ", ".join(allowed))
    for keyword, sign in (("minimum", "<"), ("maximum", ">")):
        if keyword in schema:
            fails(f"{_is('number', value)} and {number} {sign} {float(schema[keyword])!r}D", f"{keyword} is {schema[keyword]}")
    if "minLength" in schema:
        fails(f"{_is('string', value)} and length({text}) < {int(schema['minLength'])}", f"shorter than {schema['minLength']}")
    for keyword, sign in (("minItems", "<"), ("maxItems", ">")):
        if keyword in schema:
            fails(f"{_is('array', value)} and size({items}) {sign} {int(schema[keyword])}", f"{keyword} is {schema[keyword]}")
    entries = f"try_variant_get({value}, '$', 'map<string,variant>')"
    for name in schema.get("required", ()):
        fails(f"{_is('object', value)} and not map_contains_key({entries}, {quoted(name)})", f"lacks {name}")
    if schema.get("additionalProperties", True) is False:
        names = "array(" + ", ".join(map(quoted, schema.get("properties", {}))) + ")" if schema.get("properties") else "cast(array() as array<string>)"
        fails(f"{_is('object', value)} and size(array_except(map_keys({entries}), {names})) > 0", "has other keys")
    inner = []
    for name, below in schema.get("properties", {}).items():
        inner.append(f"if(map_contains_key({entries}, {quoted(name)}), {json_problem(below, f'{entries}[{quoted(name)}]', f'{at}.{name}', depth)}, null)")
    if "items" in schema:
        each = f"x{depth}_"
        inner.append(f"get(filter(transform({items}, {each} -> {json_problem(schema['items'], each, f'{at}[]', depth + 1)}), p_ -> p_ is not null), 0)")
    rest = f"coalesce({', '.join(inner)}, null)" if inner else "cast(null as string)"
    return f"case {' '.join(cases)} else {rest} end"


def answer_problem(schema: dict, output: str = "output") -> str:
    """SQL: what is wrong with an answer that must be JSON of this schema, null if nothing."""
    return f"case when {output} is null then 'no answer' when try_parse_json({output}) is null then 'not JSON' else {json_problem(schema, f'try_parse_json({output})')} end"


def answer_table(answers: DataFrame) -> Completer:
    """A model that is a table: (prompt_sha, attempt, output); a call it lacks fails."""

    def complete(requests: DataFrame) -> DataFrame:
        return requests.select("prompt_sha", "attempt").join(answers.select("prompt_sha", "attempt", "output"), ["prompt_sha", "attempt"], "left").select("prompt_sha", "output")

    return complete


def calls(spark: SparkSession, table: str) -> DataFrame:
    """All calls ever committed to a table. Equal ones, of runs at the same time, count once."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    rows = spark.read.option("recursiveFileLookup", "true").schema(CALLS).parquet(table) if there else spark.createDataFrame([], CALLS)
    return rows.dropDuplicates(["task", "prompt_sha", "attempt"])


def ask(requests: DataFrame, complete: Completer, table: str, task: str, problem: str, attempts: int = 3, model_name: str = "") -> tuple[DataFrame, DataFrame]:
    """(answers, traces) of requests (key, prompt): asked until an answer is right, ``attempts`` times at most.

    problem: SQL over output, null for a right answer (see answer_problem). answers: key, output, of
    those that got a right one. traces: a row of the table for each call of these prompts, earlier
    runs' included: task, prompt_sha, attempt, prompt, output, model_name, ok, error. A null prompt is an empty one.
    """
    spark = requests.sparkSession
    rows = requests.select("key", F.coalesce("prompt", F.lit("")).alias("prompt")).withColumn("prompt_sha", F.expr(prompt_sha()))
    prompts = rows.select("prompt_sha", "prompt").dropDuplicates(["prompt_sha"])
    own = lambda: calls(spark, table).where(F.col("task") == task)
    for attempt in range(1, attempts + 1):
        made = own().groupBy("prompt_sha").agg(F.max("attempt").alias("made"), F.bool_or("ok").alias("done"))
        left = prompts.join(made, "prompt_sha", "left").where(~F.coalesce("done", F.lit(False)) & (F.coalesce("made", F.lit(0)) == attempt - 1))
        left = left.select("prompt_sha", "prompt", F.lit(attempt).alias("attempt"))
        if not (n := left.count()):
            continue
        left = left.repartition(min(-(-n // TASK_CALLS), TASKS), "prompt_sha")
        found = complete(left)
        failed = F.col("error") if "error" in found.columns else F.lit(None).cast("string")
        told = left.join(found.select("prompt_sha", "output", failed.alias("failed")), "prompt_sha", "left")
        told = told.withColumn("error", F.coalesce("failed", F.expr(problem)))
        told.select(F.lit(task).alias("task"), "prompt_sha", "attempt", "prompt", "output", F.lit(model_name).alias("model_name"), F.col("error").isNull().alias("ok"), "error").write.parquet(f"{table}/{task}-{attempt}-{uuid.uuid4().hex}")
    traces = own().join(rows.select("prompt_sha").distinct(), "prompt_sha", "left_semi")
    answers = rows.join(own().where("ok").select("prompt_sha", "output"), "prompt_sha").select("key", "output")
    return answers, traces


def trace_lines(traces: DataFrame, run_id: str) -> DataFrame:
    """event_type, line: an event of the log for each call, in its closed schema."""
    line = F.to_json(F.struct("attempt", "error", F.lit("trace").alias("event_type"), F.coalesce("model_name", F.lit("")).alias("model_name"), "ok", F.coalesce("output", F.lit("")).alias("output"), "prompt", "prompt_sha", F.lit(run_id).alias("run_id"), "task"))
    return traces.select(F.lit("trace").alias("event_type"), line.alias("line"))
