"""The event log as JSON lines with their offsets, typed by event_type; see sources.log for one that is appended to."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators.digest import table_digest
from ledgerloom.schema import EVENT_TYPES, EVENT_VALUES, event_keys


def read_lines(spark: SparkSession, path: str, start_offset: int = 0) -> DataFrame:
    """offset, line for every line that isn't blank; blank ones take an offset. Exact for one file; a log is one file by nature.

    The file is read in splits: lines are numbered within each, and splits by the lines before them.
    """
    raw = spark.read.text(path, lineSep="\n")
    raw = raw.select(F.col("value").alias("line"), raw.metadataColumn("_metadata").getField("file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    sums = raw.groupBy("split").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each split
    numbered = raw.withColumn("n", F.row_number().over(Window.partitionBy("split").orderBy("at")) - 1).join(sums.select("split", before.alias("before")), "split")
    lines = numbered.select((F.col("before") + F.col("n")).alias("offset"), "line")
    return lines.where((F.trim("line") != "") & (F.col("offset") >= start_offset))


def read_events(spark: SparkSession, path: str, event_type: str, schema: str, start_offset: int = 0) -> DataFrame:
    """Typed rows of one event type; a line that isn't JSON, has an unknown type or an unknown key fails the query."""
    checked = validated(read_lines(spark, path, start_offset))
    rows = checked.where(F.col("event_type") == event_type)
    return rows.select("offset", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("e")).select("offset", "e.*")


_VARIANT = {"str": "STRING", "int": "BIGINT", "bool": "BOOLEAN", "list": "ARRAY", "object": "OBJECT"}
_JSON = {"str": "string", "int": "integer", "bool": "boolean", "list": "array", "object": "object"}


def _map(rows: dict, value) -> Column:
    return F.create_map(*(x for k, v in rows.items() for x in (F.lit(k), value(v))))


def problems(lines: DataFrame) -> DataFrame:
    """offset, line, event_type, problem (null if none) against the closed schema: keys, value types and vocabularies."""
    keys = {t: event_keys(t) for t in EVENT_TYPES}
    kinds = _map(keys, lambda k: _map(k, lambda v: F.lit(_VARIANT[v[0]])))
    must = _map(keys, lambda k: F.array(*(F.lit(c) for c, (_, needed) in k.items() if needed)))
    words = _map({f"{t}.{k}": v for (t, k), v in EVENT_VALUES.items()}, lambda v: F.array(*map(F.lit, v)))
    rows = lines.withColumn("v", F.expr("try_parse_json(line)")).withColumn("event_type", F.get_json_object("line", "$.event_type"))
    rows = rows.withColumn("given", F.expr("transform(map_entries(try_variant_get(v, '$', 'map<string,variant>')), e -> struct(e.key as key, schema_of_variant(e.value) as kind, try_variant_get(e.value, '$', 'string') as text))"))
    rows = rows.withColumn("kinds", F.try_element_at(kinds, "event_type")).withColumn("must", F.try_element_at(must, "event_type")).withColumn("words", words)
    names = "transform(given, g -> g.key)"
    more, less = F.expr(f"array_sort(filter({names}, k -> not map_contains_key(kinds, k)))"), F.expr(f"filter(must, k -> not array_contains({names}, k))")
    odd = F.expr("transform(filter(given, g -> not startswith(g.kind, kinds[g.key])), g -> g.key)")
    unknown = F.expr("transform(filter(given, g -> map_contains_key(words, concat(event_type, '.', g.key)) and not array_contains(words[concat(event_type, '.', g.key)], g.text)), g -> concat(g.key, '=', g.text))")
    told = lambda text, column: F.concat(F.lit(text), F.array_join(column, ", "))
    problem = F.when(F.col("given").isNull(), "not a JSON object").when(F.col("kinds").isNull(), "unknown event type")
    for text, column in (("unknown keys: ", more), ("missing keys: ", less), ("wrong types: ", odd), ("unknown values: ", unknown)):
        problem = problem.when(F.size(column) > 0, told(text, column))
    return rows.select("offset", "line", "event_type", problem.alias("problem"))


def validated(lines: DataFrame) -> DataFrame:
    rows = problems(lines)
    ok = F.when(F.col("problem").isNull(), F.col("line")).otherwise(F.raise_error(F.concat(F.lit("event at offset "), F.col("offset").cast("string"), F.lit(": "), "problem")))
    return rows.select("offset", "event_type", ok.alias("line"))


def event_schema() -> dict:
    """The closed schema as JSON Schema."""

    def one(event_type: str) -> dict:
        keys = event_keys(event_type)
        kinds = {k: {"const": event_type} if k == "event_type" else {"type": _JSON[kind]} for k, (kind, _) in keys.items()}
        for (t, k), words in EVENT_VALUES.items():
            if t == event_type:
                kinds[k]["enum"] = list(words)
        return {"type": "object", "properties": kinds, "required": [k for k, (_, needed) in keys.items() if needed], "additionalProperties": False}

    return {"oneOf": [one(t) for t in EVENT_TYPES]}


def canonical(event: dict) -> str:
    """Compact JSON with sorted keys and no nulls."""
    return json.dumps({k: v for k, v in event.items() if v is not None}, sort_keys=True, separators=(",", ":"), default=str)


def line_count(lines: DataFrame) -> int:
    """One more than the last offset."""
    last = lines.agg(F.max("offset").alias("n")).first()["n"]
    return 0 if last is None else last + 1


def manifest(run_id: str, config: dict, prompts: dict[str, str], memory_hash: str, ledger_refs: dict[str, str], tables: dict[str, DataFrame] | None = None) -> dict:
    """Hashes that identify a run; of ``tables`` their fingerprints, which don't depend on files or order (see operators.digest)."""
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()[:16]
    return {"run_id": run_id or uuid.uuid4().hex, "config_hash": sha(canonical(config)), "prompt_hashes": {k: sha(v) for k, v in sorted(prompts.items())}, "memory_state_hash": memory_hash, "ledger_refs": dict(sorted(ledger_refs.items()))} | ({"tables": {name: table_digest(df) for name, df in sorted(tables.items())}} if tables else {})


def write_manifest(spark: SparkSession, entry: dict, path: str) -> None:
    spark.createDataFrame([(canonical(entry),)], "value string").coalesce(1).write.mode("overwrite").text(path)
