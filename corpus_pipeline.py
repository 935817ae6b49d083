"""The corpus pipeline: quality rules, near-duplicates, substring duplicates, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last
return the columns of documents. Between stages the rows are written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import saved, table
from ledgerloom.llm.mixing import mix
from ledgerloom.llm.neardup import drop_near_duplicates
from ledgerloom.llm.packing import pack
from ledgerloom.llm.quality import line_quality, train
from ledgerloom.llm.queries import MAX_REPEATS, tokenizer_path
from ledgerloom.llm.substring import substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. The field is fitted on the labelled ones among docs.

    Null, empty and short texts are rejected; without labels of both kinds only base failures are.
    """
    return line_quality(docs, train(docs, table(spark, sf_dir, "labels"))).where("quality.kept").select(docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that with the smallest id; null and wordless texts all stay."""
    return drop_near_duplicates(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under repeated windows go, at all their places; the rest keeps its layout. A null text becomes an empty one."""
    text = F.col("dedup.kept_text")
    found = substring_dedup(docs, layout="original").withColumns({"text": text, "n_chars": F.length(text).cast("long")})
    return found.select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; those of rare sources are repeated up to MAX_REPEATS times, block by block in each epoch's order."""
    order = ("mix.epoch", "mix.place", F.xxhash64("doc_id", "text"))  # the hash parts a block's rows, which are many
    return mix(docs, max_repeats=MAX_REPEATS).repartitionByRange(*order).sortWithinPartitions(*order).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, each time it comes, in sequences of tokens; a null or empty text has the end token alone."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_duplicate),
    ("substring_dedup", substring),
    ("temperature_mixing", mixing),
    ("mixture_packing", packing),
]

#: The labelling, the signatures, the bisection and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
