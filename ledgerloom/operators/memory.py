"""Memory of past decisions: what is kept of each class, and which entries are retrieved for a scenario."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.schema import LABELS
from ledgerloom.sources.shared import saved

CAP = 3
#: An entry of a store.
STORE = "entry_id string, source_gen_id string, scenario_id string, pool string, weight double, final_text string, human_action string, note string, ingested_offset long, " + ", ".join(f"{c} boolean" for c in LABELS)
WEIGHTS = {"edit": 2.0, "approve": 1.0}


def class_key(prefix: str = "") -> Column:
    """The six bits of a signature; a missing one is false."""
    return F.concat_ws("", *(F.coalesce(F.col(prefix + c), F.lit(False)).cast("int").cast("string") for c in LABELS))


def overlap(left: str, right: str) -> Column:
    """How many labels two signatures share."""
    out = F.lit(0)
    for c in LABELS:
        out = out + (F.coalesce(F.col(left + c), F.lit(False)) & F.coalesce(F.col(right + c), F.lit(False))).cast("int")
    return out


def kept(entries: DataFrame, cap: int = CAP) -> DataFrame:
    """The entries a store ends up with: of each class the last ``cap`` by offset, then id. An id counts once; only pool A may enter."""
    entries = entries.withColumn("pool", F.when(F.col("pool") == "A", F.col("pool")).otherwise(F.raise_error(F.lit("memory takes entries of pool A only"))))
    once = Window.partitionBy("entry_id").orderBy("ingested_offset")
    entries = entries.withColumn("__n", F.row_number().over(once)).where("__n = 1").withColumn("class_key", class_key())
    last = Window.partitionBy("class_key").orderBy(F.desc("ingested_offset"), F.desc("entry_id"))
    return entries.withColumn("__n", F.row_number().over(last)).where(F.col("__n") <= cap).drop("__n")


def _store(memory: DataFrame, cap: int = CAP) -> DataFrame:
    """memory, written, if it is as small as a store: ``cap`` entries for each of 64 classes at most."""
    own = saved(memory, "store")
    if (n := own.count()) > cap * 2 ** len(LABELS):
        raise ValueError(f"{n} entries are more than a store holds; take kept() of them")
    return own


def retrieve(queries: DataFrame, memory: DataFrame, k: int) -> DataFrame:
    """query_id, place, entry_id: the best entries for each signature.

    An entry must share a label or be of the very class. Those of the class come first, then by
    shared labels, weight, offset (last first) and id. A store holds ``cap`` entries for each of 64
    classes at most, so it is checked to be that small and sent to every task.
    """
    if k <= 0:
        return queries.select("query_id", F.lit(0).alias("place"), F.lit("").alias("entry_id")).where("false")
    own = _store(memory.select("entry_id", "weight", "ingested_offset", class_key().alias("m_class"), *(F.col(c).alias(f"m_{c}") for c in LABELS)))
    # Scenarios of one class retrieve the same entries: rank once for each class.
    classes = queries.select(class_key().alias("class"), *LABELS).distinct()
    pairs = classes.join(F.broadcast(own)).withColumn("shared", overlap("", "m_")).withColumn("exact", F.col("class") == F.col("m_class")).where("shared > 0 or exact")
    best = Window.partitionBy("class").orderBy(F.desc("exact"), F.desc("shared"), F.desc("weight"), F.desc("ingested_offset"), "entry_id")
    ranked = pairs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("class", "place", "entry_id")
    return queries.select("query_id", class_key().alias("class")).join(ranked, "class").select("query_id", "place", "entry_id")


def random_entries(queries: DataFrame, memory: DataFrame, k: int, seed: int) -> DataFrame:
    """A control without relevance: k entries for each query in the order of a seeded hash."""
    own = _store(memory.select("entry_id"))
    pairs = queries.select("query_id").join(F.broadcast(own))
    order = Window.partitionBy("query_id").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "query_id", "entry_id")), "entry_id")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def calibration_items(drafts: DataFrame, each: int = 8, seed: int = 0) -> DataFrame:
    """item_id C-01.. for ``each`` clean and ``each`` spoiled drafts in a hashed order; drafts: draft_id, clean."""
    mark = lambda salt: F.md5(F.concat_ws("|", F.lit(seed), F.lit(salt), F.col("draft_id")))
    some = drafts.withColumn("n", F.row_number().over(Window.partitionBy("clean").orderBy(mark("pick"), "draft_id"))).where(F.col("n") <= each)
    at = F.row_number().over(Window.orderBy(mark("blind"), "draft_id"))  # 2 x each rows
    return some.select(F.concat(F.lit("C-"), F.lpad(at.cast("string"), 2, "0")).alias("item_id"), "draft_id", "clean")


def decisions_to_entries(decisions: DataFrame, fixtures: DataFrame, after: int = 0) -> DataFrame:
    """Entries from human decisions at offsets from ``after`` on: of pool A by the event and by the fixture, not declined."""
    rows = decisions.where((F.col("offset") >= after) & (F.col("pool") == "A") & F.col("action").isin(*WEIGHTS))
    rows = rows.join(fixtures.where("pool = 'A'").select("scenario_id", *LABELS), "scenario_id")
    weight = F.when(F.col("action") == "edit", WEIGHTS["edit"]).otherwise(WEIGHTS["approve"])
    return rows.select(F.concat(F.lit("mem-"), F.lpad(F.col("offset").cast("string"), 6, "0")).alias("entry_id"), F.col("gen_id").alias("source_gen_id"), "scenario_id", "pool", weight.alias("weight"), "final_text", F.col("action").alias("human_action"), F.col("reason").alias("note"), F.col("offset").alias("ingested_offset"), *LABELS)


def ingest_counts(decisions: DataFrame, after: int = 0) -> DataFrame:
    """consumed_through_offset and how many decisions an ingest adds or skips as declined."""
    rows = decisions.where(F.col("offset") >= after)
    pool = F.col("pool") == "A"
    return rows.agg(F.max("offset").alias("consumed_through_offset"), F.count_if(pool & F.col("action").isin(*WEIGHTS)).alias("added"), F.count_if(pool & (F.col("action") == "decline")).alias("declined"))


def canonical(memory: DataFrame) -> str:
    """The store as canonical JSON: entries by offset and id, keys sorted, no nulls. A memory that is larger than a store raises an error."""
    most = CAP * 2 ** len(LABELS)
    rows = memory.limit(most + 1).select("entry_id", "source_gen_id", "scenario_id", "pool", "weight", "final_text", "human_action", "note", "ingested_offset", *LABELS).orderBy("ingested_offset", "entry_id").collect()
    if len(rows) > most:
        raise ValueError("more entries than a store holds; take kept() of them")
    return json.dumps([{k: v for k, v in r.asDict().items() if v is not None} for r in rows], sort_keys=True, separators=(",", ":"))


def state_hash(memory: DataFrame) -> str:
    text = canonical(memory)
    return "empty" if text == "[]" else hashlib.sha256(text.encode()).hexdigest()[:16]
