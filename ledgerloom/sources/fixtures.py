"""Ledgers as JSON documents: reading and writing, and a generator of test ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import ledger
from ledgerloom.schema import LABELS, LEDGER, POOLS
from ledgerloom.sources.tables import Ledger


def from_documents(nested: DataFrame) -> Ledger:
    """The five tables of nested ledgers (see schema.LEDGER); positions are those in the arrays."""
    def flat(column: str) -> DataFrame:
        return nested.select("scenario_id", F.posexplode(column).alias("pos", "x")).select("scenario_id", F.col("pos").cast("long"), "x.*")

    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    client = nested.select("scenario_id", "pool", F.col("client.id").alias("client_id"), "client.name", "client.terms_days", "client.as_of")
    own = ("scenario_id", "pos", "id", "date")
    return Ledger(
        client,
        flat("invoices").select(*own, "due", "amount_cents", text("memo")),
        flat("payments").select(*own, "amount_cents", F.coalesce("method", F.lit("ach")).alias("method"), text("reference")),
        flat("credit_memos").select(*own, "amount_cents", text("reason")),
        flat("applications"),
    )


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a file. A type that differs fails; unknown keys and labels outside the vocabulary do too."""
    raw = spark.read.text(path, wholetext=True)
    known = F.array(*(F.lit(f.name) for f in LEDGER))
    more = F.array_except(F.json_object_keys("value"), known)
    rows = raw.select(F.when(F.size(more) > 0, F.raise_error(F.concat(F.lit("unknown keys: "), F.array_join(more, ", ")))).otherwise(F.from_json("value", LEDGER, {"mode": "FAILFAST"})).alias("l")).select("l.*")
    odd = F.array_except("structure_labels", F.array(*(F.lit(x) for x in LABELS)))
    return rows.withColumn("scenario_id", F.when(F.size(odd) > 0, F.raise_error(F.concat(F.lit("unknown labels: "), F.array_join(odd, ", ")))).otherwise(F.col("scenario_id")))


def load_ledger(spark: SparkSession, folder: str, scenario_id: str) -> Ledger:
    return from_documents(read_nested(spark, f"{folder}/{scenario_id}.json"))


def load_pool(spark: SparkSession, folder: str, pool: str) -> DataFrame:
    """Nested ledgers of a pool with place, their position in the index."""
    if pool not in POOLS:
        raise ValueError(f"unknown pool: {pool}")
    index = spark.read.text(f"{folder}/index.json", wholetext=True).select(F.posexplode(F.from_json("value", "array<struct<scenario_id:string,pool:string>>")).alias("place", "x")).select("place", "x.*").where(F.col("pool") == pool)
    return read_nested(spark, f"{folder}/S-*.json").join(index.select("place", "scenario_id"), "scenario_id")


def ledger_ref(nested: DataFrame) -> DataFrame:
    """scenario_id, ref: sixteen digits that identify a ledger's content."""
    return nested.select("scenario_id", F.substring(F.sha2(F.to_json(F.struct(*(F.col(f.name) for f in LEDGER))), 256), 1, 16).alias("ref"))


#: Fixtures are a test pool, a file each; more ledgers belong in a table.
MOST_FIXTURES = 10_000


def write_fixtures(nested: DataFrame, folder: str) -> None:
    """Nested ledgers as <scenario_id>.json and an index.json of labels and refs, as load_pool() reads them.

    They are audited first: the labels must be those of the figures, and there may be no problems.
    """
    spark = nested.sparkSession
    books = from_documents(nested)
    named = ledger.signature(books).select("scenario_id", F.array_sort("labels").alias("found")).join(nested.select("scenario_id", F.array_sort("structure_labels").alias("told")), "scenario_id")
    wrong = [r["scenario_id"] for r in named.where("found <> told").limit(5).collect()] + [r["scenario_id"] for r in ledger.validate(books).limit(5).collect()]
    if wrong:
        raise ValueError(f"ledgers that aren't what they are labelled, or have problems: {wrong}")
    index = nested.select("scenario_id", "pool", "structure_labels").join(ledger_ref(nested), "scenario_id").select(F.to_json(F.struct("scenario_id", "pool", "structure_labels", "ref")).alias("row"), "scenario_id")
    rows = nested.select("scenario_id", F.to_json(F.struct(*(f.name for f in LEDGER))).alias("text")).join(index, "scenario_id").orderBy("scenario_id").limit(MOST_FIXTURES + 1).collect()
    if len(rows) > MOST_FIXTURES:
        raise ValueError(f"more than {MOST_FIXTURES} fixtures")
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, text in [*((r["scenario_id"], r["text"]) for r in rows), ("index", "[" + ",\n".join(r["row"] for r in rows) + "]")]:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.json")
        out = path.getFileSystem(conf).create(path, True)
        out.write(bytearray(text.encode()))
        out.close()


def generate(spark: SparkSession, scenarios: int, seed: int = 7) -> DataFrame:
    """Nested ledgers of six structures in turn; every figure is a hash of the seed and the scenario.

    Structures: plain, unapplied cash, partial payment, open credit, equal amounts near the cutoff,
    and an ambiguous payment. Labels are those of the structure.
    """
    draw = lambda name, lo, hi: (F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "id"), F.lit(hi - lo)) + lo)
    as_of, kind = F.lit("2026-03-31").cast("date"), F.col("id") % 6
    amount = lambda i: F.when((F.lit(i) == 2) & kind.isin(4, 5), draw("amount1", 1000, 9000) * 100 + 7_000_00).otherwise(draw(f"amount{i}", 1000, 9000) * 100 + i * 7_000_00)
    paid = amount(0)
    base = (F.lit(1000) + draw("number", 0, 8000)).cast("string")
    doc = lambda prefix, i: F.concat(F.lit(prefix), (base.cast("int") + i).cast("string"))

    def invoice(i: int) -> Column:
        day = F.date_sub(as_of, F.when((kind == 4) & (F.lit(i) == 2), F.lit(2)).otherwise(F.lit(60 - 10 * i)))
        return F.struct(doc("INV-", i).alias("id"), day.alias("date"), F.date_add(day, 30).alias("due"), amount(i).cast("long").alias("amount_cents"), F.lit("").alias("memo"))

    def payment(i: int, cents: Column) -> Column:
        return F.struct(doc("PMT-", 20 + i).alias("id"), F.date_sub(as_of, 20 - i).alias("date"), cents.cast("long").alias("amount_cents"), F.lit("ach").alias("method"), F.lit("").alias("reference"))

    loose = F.when(kind == 1, amount(1) + 5).when(kind == 5, amount(1))
    half = F.when(kind == 2, F.floor(amount(1) / 2))
    payments = F.filter(F.array(payment(0, paid), payment(1, F.coalesce(loose, half))), lambda x: x["amount_cents"].isNotNull())
    credits = F.filter(F.array(F.struct(doc("CM-", 40).alias("id"), F.date_sub(as_of, 15).alias("date"), F.when(kind == 3, F.lit(5000)).cast("long").alias("amount_cents"), F.lit("").alias("reason"))), lambda x: x["amount_cents"].isNotNull())
    use = lambda source, target, cents: F.struct(source.alias("source_id"), target.alias("target_invoice"), cents.cast("long").alias("amount_cents"))
    applied = F.filter(F.array(use(doc("PMT-", 20), doc("INV-", 0), paid), use(doc("PMT-", 21), doc("INV-", 1), half)), lambda x: x["amount_cents"].isNotNull())
    labels = F.filter(F.array(*(F.when(kind.isin(*ks), F.lit(n)) for n, ks in zip(LABELS, ((1, 5), (2,), (3,), (4, 5), (4,), (5,))))), lambda x: x.isNotNull())
    client = F.struct(F.concat(F.lit("CL-"), "id").alias("id"), F.concat(F.lit("Client "), "id").alias("name"), F.lit(30).alias("terms_days"), as_of.alias("as_of"))
    return spark.range(scenarios).select(F.lit(1).alias("schema_version"), F.concat(F.lit("S-"), F.col("id").cast("string")).alias("scenario_id"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("pool"), labels.alias("structure_labels"), client.alias("client"), F.array(*(invoice(i) for i in range(3))).alias("invoices"), payments.alias("payments"), credits.alias("credit_memos"), applied.alias("applications"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """item_id, acceptable, tone, clarity from a CSV of human labels."""
    rows = spark.read.csv(path, header=True)
    return rows.select("item_id", F.lower("acceptable").isin("1", "true", "yes", "y").alias("acceptable"), F.col("tone").cast("int"), F.col("clarity").cast("int"))


def read_judge_scores(spark: SparkSession, path: str) -> DataFrame:
    """item_id, acceptable, tone, clarity of a JSON map; only parsed items with scores."""
    kind = "map<string,struct<scores:struct<tone:int,clarity:int,acceptable:boolean>,parse_ok:boolean>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("item_id", "x"))
    return rows.where("x.parse_ok and x.scores is not null").select("item_id", "x.scores.acceptable", "x.scores.tone", "x.scores.clarity")


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of row objects; no rows if the file isn't there."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
