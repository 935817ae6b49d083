"""Fingerprints of tables: what they are blind to and what not, and that queries give the same ones under other settings."""

import pytest
from pyspark.sql import functions as F

from ledgerloom import registry
from ledgerloom.operators.digest import table_digest
from ledgerloom.sources import events, shared
from tests.conftest import SMALL

KIND = "a int, b string, c double, d array<int>, e struct<x:double,y:string>, f map<string,int>"
ROWS = [(1, "x", 0.1 + 0.2, [1, None], (1.0, None), {"k": 1, "l": 2}), (None, "x", None, None, None, None), (2, None, -0.0, [], (0.5, "y"), {}), (2, None, -0.0, [], (0.5, "y"), {})]


def test_order_files_and_columns_do_not_count(spark):
    df = spark.createDataFrame(ROWS, KIND)
    want = table_digest(df)
    assert len(want) == 32
    assert want == table_digest(df.repartition(7)) == table_digest(df.orderBy("b")) == table_digest(df.select(*reversed(df.columns)))
    assert want == table_digest(df.withColumn("c", F.when(F.col("a") == 1, 0.3).otherwise(F.abs("c"))))  # a sum in another order; no negative zero
    assert want == table_digest(df.withColumn("f", F.when(F.col("a") == 1, F.create_map(F.lit("l"), F.lit(2), F.lit("k"), F.lit(1))).otherwise(F.col("f"))))


def test_rows_counts_names_types_and_nulls_do(spark):
    df = spark.createDataFrame(ROWS, KIND)
    other = [df.limit(0), df.dropDuplicates(["a"]), df.union(df), df.drop("a"), df.withColumnRenamed("a", "g"), df.withColumn("a", F.col("a").cast("long")), df.withColumn("b", F.coalesce("b", F.lit(""))), df.withColumn("c", F.col("c") + 1e-6), df.withColumn("d", F.array_compact("d"))]
    swapped = spark.createDataFrame([(1, None), (None, 2)], "a int, b int"), spark.createDataFrame([(None, 1), (2, None)], "a int, b int")
    found = [table_digest(x) for x in [df, *other, *swapped]]
    assert len(set(found)) == len(found)


def test_a_manifest_names_tables(spark):
    df = spark.createDataFrame(ROWS, KIND)
    told = events.manifest("r", {}, {}, "empty", {}, {"rows": df, "none": df.limit(0)})
    assert told["tables"] == {"none": table_digest(df.limit(0)), "rows": table_digest(df.repartition(2))}
    assert "tables" not in events.manifest("r", {}, {}, "empty", {})


OTHER = {
    "spark.sql.shuffle.partitions": "3", "spark.sql.adaptive.enabled": "false", "spark.sql.files.maxPartitionBytes": "65536", "spark.sql.files.openCostInBytes": "1024", "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "100",
}


@pytest.fixture(scope="module")
def other(spark):
    """A session with other settings, in which shared tables are written anew."""
    before = {k: spark.conf.get(k, None) for k in OTHER}
    made = dict(shared._MADE)
    shared._MADE.clear()
    for k, v in OTHER.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    shared._MADE.clear()
    shared._MADE.update(made)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_every_query_is_the_same_under_other_settings(compare, other, name):
    """Other splits, partitions and joins: the whole result is the SQL's, as it is under the usual settings in test_queries."""
    compare(registry.QUERIES[name], registry.ORACLES[name])


def test_fingerprints_are_equal_under_other_settings(spark, other):
    """Of results that hold text, money, floats and lists; each computed twice, with tables written twice."""
    names = ["net_balance", "golden_draft", "application_history", "cohen_kappa", "memory_kept", "tool_requests"]
    got = {name: table_digest(registry.QUERIES[name](spark, SMALL)) for name in names}
    shared._MADE.clear()
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == {name: table_digest(registry.QUERIES[name](spark, SMALL)) for name in names}
    for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"):
        spark.conf.set(k, OTHER[k])
