"""What the training-data operators share: reading tables, row keys, columns of any name; shared storage is the library's."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.shared import forget, saved, shared_dir

__all__ = ["BATCH_ROWS", "KEY", "bound_batches", "column", "forget", "keyed", "list_column", "packed", "saved", "shared_dir", "table"]
#: Column names that the operators add start so; input columns may have any other name.
KEY = "__row_key"
BATCH_ROWS = 1000
#: Numbers of so many files are sent to every task, some 20 MB.
MOST_FILES = 100_000
#: A row key is a file's number times this, and the row's place in the file.
_FILE_ROWS = 1 << 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of_one_table(df: DataFrame) -> bool:
    """Whether df selects rows and columns of one Parquet table, so that each row has a place in a file."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    roots = plan.relation().location().rootPaths()
    return plan.relation().fileFormat().toString() == "Parquet" and roots.distinct().size() == roots.size()  # a folder read twice has two rows in a place


def keyed(df: DataFrame, name: str = KEY) -> DataFrame:
    """df with a long that tells its rows apart, however often and by whichever tasks it is computed.

    The key is the row's place: the number of its file, in order of the names, and its index there.
    It doesn't depend on splits, cores or settings, nor on nulls and repeats. A df that isn't a
    selection from one Parquet table is written first, since its rows have no place of their own.
    """
    if not _of_one_table(df):
        df = saved(df, "rows")
    place = df.metadataColumn("_metadata")
    files = sorted({re.sub("^([a-z0-9]+):/+", r"\1:/", f) for f in df.inputFiles()})
    rows = df.select("*", place.getField("row_index").alias(name), F.regexp_replace(place.getField("file_path"), "^([a-z0-9]+):/+", "$1:/").alias("__file"))
    if len(files) > 1:
        numbers = df.sparkSession.createDataFrame([(f, i * _FILE_ROWS) for i, f in enumerate(files)], "__file string, __base long")
        # A row for each file, so the bound is checked here; with more files the rows are dealt by file.
        rows = rows.join(F.broadcast(numbers) if len(files) <= MOST_FILES else numbers, "__file", "left")
        # A file that isn't listed can't be told from others by its number.
        base = F.when(F.col("__base").isNull(), F.raise_error(F.concat(F.lit("no number for "), "__file")).cast("long")).otherwise(F.col("__base"))
        rows = rows.withColumn(name, base + F.col(name)).drop("__base")
    return rows.drop("__file")


def column(name: str) -> Column:
    """The column of this name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, columns: list[str]) -> Column:
    """These columns of docs as one struct ``rest``, so that their names can't clash with an operator's."""
    return F.struct(F.lit(1).alias("__one"), *(column(c) for c in columns)).alias("rest")


def bound_batches(spark: SparkSession) -> None:
    """Send Python workers at most BATCH_ROWS texts at a time, since texts may be long. Set on the session, never raised."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def list_column(values, bounds, kind) -> pa.Array:
    """A list column from flat values and n+1 bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
