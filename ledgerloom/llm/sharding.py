"""Rendezvous hashing of stable record keys over weighted shards.

Every record draws a number for each shard from a hash of its key and the shard; the shard with the
best draw, -ln(u) / weight being smallest, has the record. The draws for other shards don't change
when one is added or removed, so an added shard takes records only into itself, and a share of them
proportional to its weight. All of it is expressions on one row: no shuffle decides a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import KEY, column, keyed, packed

#: Parts into which a shard's records are dealt to number them; each is one task's at most.
SLOT_PARTS = 1024


def rendezvous(key: list[Column], shards: dict[int, float]) -> Column:
    """The shard of a record. shards: weight by number. Nulls in a key are a value like others."""
    if not shards or any(w <= 0 for w in shards.values()):
        raise ValueError("there must be shards, of positive weight")
    name = F.concat_ws("\u0001", *(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null")) for c in key))

    def draw(shard: int, weight: float) -> Column:
        part = F.substring(F.md5(F.concat(F.lit(f"{shard}|"), name)), 1, 13)
        unit = (F.conv(part, 16, 10).cast("double") + 0.5) / float(1 << 52)
        return F.struct((-F.log(unit) / F.lit(float(weight))).alias("draw"), F.lit(shard).alias("shard"))

    return F.array_min(F.array(*(draw(s, w) for s, w in sorted(shards.items())))).getField("shard")


def shard(docs: DataFrame, key: list[str], shards: dict[int, float], grown: dict[int, float] | None = None, parts: int = SLOT_PARTS) -> DataFrame:
    """docs with shard, slot (gapless from 0 in each shard) and grown_shard (with ``grown``, else null) added.

    The shard follows from the key alone. Slots follow a hash of the row's place in its table, so
    rows of one key, however many, are numbered by many tasks; the sums that offset them are shards x
    parts rows, whatever the size of docs. Records with equal keys share a shard, as do those with a
    null key; each has its own slot. An empty table gives no rows. Columns of docs named like an
    added one are replaced; others may have any name.
    """
    cols = [c for c in docs.columns if c not in ("shard", "slot", "grown_shard")]
    keys = [column(c) for c in key]
    wider = rendezvous(keys, grown) if grown else F.lit(None).cast("int")
    part = F.pmod(F.xxhash64(KEY), F.lit(parts)).cast("int")
    where = keyed(docs, KEY).select(packed(docs, cols), KEY, rendezvous(keys, shards).alias("shard"), wider.alias("grown_shard"), part.alias("part"))
    sums = where.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "part").orderBy(KEY)
    # shards x parts rows are broadcast.
    numbered = where.withColumn("n", F.row_number().over(within)).join(F.broadcast(offset), ["shard", "part"])
    return numbered.select(*(F.col("rest").getField(c).alias(c) for c in cols), "shard", (F.col("before") + F.col("n") - 1).cast("long").alias("slot"), "grown_shard")
