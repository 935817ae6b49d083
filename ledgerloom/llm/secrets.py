"""Secret scans over a ledger of content-addressed blobs, in DataFrame and SQL functions only.

A blob is a text's SHA-256. The ledger has a row for every pair of a blob and a rule's version that
was ever scanned, with the spans found, if any. A scan hashes all versions of all paths, looks up
which pairs the ledger lacks, fetches each such blob's text once (from the row that comes first in
its table), applies only the rules that are new to it, and joins what the ledger then knows back to
every path that holds the blob. So a copy, a version that came back, or a second run costs a hash.

Only hashes and row places are shuffled to find the new pairs, so a blob with very many copies is
one row before any text moves. Texts are dealt by row place, and where few are new Spark broadcasts
the places instead. Spans come from the lengths of what stands between matches, summed up in a
window over one blob's matches, so no row grows with the number of matches but for the list of spans.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import KEY, column, forget, keyed, saved

LEDGER = "blob string, rule string, version int, spans array<struct<start:long,end:long>>"
#: Texts that are fetched are dealt without sorting them, where a task's row places fit in memory.
HASHED = {"spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m"}


class Rule(NamedTuple):
    """A regular expression; matches whose ``group`` has under ``least`` characters are dropped. Another pattern needs another version."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


#: The kinds that every scan reports, in the order in which ties are listed.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds that a scan adds: heads of private keys, tokens of code forges, signed web tokens.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED


def _matches(text: Column, rule: Rule) -> Column:
    """Of each match: the code points before it since the last one (gap), its own (size), and whether it counts (good). Null if there is none."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    size = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    good = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda m: F.length(m) >= rule.least)
    each = F.zip_with(F.arrays_zip(gaps.alias("gap"), size.alias("size")), good, lambda a, b: F.struct(a["gap"].alias("gap"), a["size"].alias("size"), b.alias("good")))
    return F.when(text.rlike(rule.pattern), F.filter(each, lambda m: m["size"].isNotNull()))


def _pairs(rules: tuple[Rule, ...]) -> Column:
    return F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules))


def hashed(versions: DataFrame, text: str = "text") -> DataFrame:
    """versions with their row keys and blob; a null text is an empty one."""
    raw = F.coalesce(column(text).cast("string"), F.lit(""))
    return keyed(versions).withColumn("__text", raw).withColumn("__blob", F.sha2(F.col("__text").cast("binary"), 256))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows that the ledger lacks: (blob, rule, version, spans) of every unseen pair among versions, written once.

    versions: a row for each path and version of it; only ``text`` is read. ledger: earlier results,
    in any number of files; repeated pairs do no harm. Spans are in code points, end exclusive,
    leftmost and without overlap for each rule. A blob without matches has a row with no spans, so it
    isn't scanned again. A null text is an empty blob; no versions, or none that is new, give no rows.
    """
    if len({r.name for r in rules}) < len(rules) or not rules:
        raise ValueError("rules need names of their own")
    spark = versions.sparkSession
    rows = hashed(versions.select(column(text).alias("text")))
    blobs = rows.groupBy("__blob").agg(F.min(KEY).alias(KEY))
    if ledger is None:
        ledger = spark.createDataFrame([], LEDGER)
    known = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("seen"))  # as many as rules ever had versions
    wanted = F.array_except(_pairs(rules), F.coalesce(F.col("seen"), F.expr("array()").cast("array<struct<rule:string,version:int>>")))
    unseen = blobs.join(known, blobs["__blob"] == known["blob"], "left").select(F.col("__blob").alias("blob"), KEY, wanted.alias("wanted")).where("size(wanted) > 0")
    unseen = saved(unseen, "unseen")
    texts = rows.select(KEY, "__text").join(unseen, KEY)
    new = lambda r: F.exists("wanted", lambda w: (w["rule"] == r.name) & (w["version"] == r.version))
    each = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), new(r).alias("new"), F.when(new(r), _matches(F.col("__text"), r)).alias("found")) for r in rules))
    scanned = saved(texts.select("blob", F.filter(each, lambda x: x["new"]).alias("each")), "scanned", HASHED)
    pairs = scanned.select("blob", F.inline("each"))
    nothing = F.expr("array()").cast("array<struct<start:long,end:long>>")
    clean = pairs.where("found is null").select("blob", "rule", "version", nothing.alias("spans"))
    hits = pairs.where("found is not null").select("blob", "rule", "version", F.posexplode("found").alias("pos", "m")).select("*", "m.*")
    end = F.expr("sum(gap + size) over (partition by blob, rule, version order by pos rows unbounded preceding)")
    spans = hits.withColumn("end", end).groupBy("blob", "rule", "version").agg(F.sort_array(F.collect_list(F.when(F.col("good"), F.struct((F.col("end") - F.col("size")).alias("start"), "end")))).alias("spans"))
    out = saved(clean.unionByName(spans), "ledger")
    forget(unseen, scanned)
    return out


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Every row of versions, its other columns in ``rest``, with its blob and ``spans``: (start, order, rule, end), sorted.

    ledger: must hold all pairs of these rules, as after scan(). order is a rule's place among rules.
    All paths and versions with a blob get its findings, repeated rows each; a null text has none.
    Blobs with spans are joined to all rows by an equi-join, whose hot keys Spark splits.
    """
    cols = versions.columns
    rows = hashed(versions, text).select(F.struct(F.lit(1).alias("__one"), *(column(c) for c in cols)).alias("rest"), F.col("__blob").alias("blob"))
    order = versions.sparkSession.createDataFrame([(r.name, r.version, i) for i, r in enumerate(rules)], "rule string, version int, place int")
    told = ledger.where("size(spans) > 0").join(F.broadcast(order), ["rule", "version"]).dropDuplicates(["blob", "rule"])  # a row for each rule is broadcast
    spans = told.groupBy("blob").agg(F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("place").alias("order"), F.col("rule"), s["end"].alias("end"))))).alias("spans"))
    none = F.expr("array()").cast("array<struct<start:long,order:int,rule:string,end:long>>")
    return rows.join(spans, "blob", "left").select("rest", "blob", F.sort_array(F.coalesce("spans", none)).alias("spans"))


def update(spark: SparkSession, folder: str, versions: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Scan what the ledger in ``folder`` lacks, append it there, and return the findings of all versions.

    The folder may be absent at first. Two updates at once may scan the same pair twice, with equal
    results, which do no harm. An update that fails appends all of its rows or none that are read.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    new = scan(versions, spark.read.schema(LEDGER).parquet(folder) if there else None, rules, text)
    new.write.mode("append").parquet(folder)
    forget(new)
    return findings(versions, spark.read.schema(LEDGER).parquet(folder), rules, text)
