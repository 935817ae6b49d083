"""Mixing sources by temperature: shares raised to an exponent, realised as permutations of blocks.

A source with share s of the tokens gets weight s**a / sum(s**a). With exponent 1 that is the
corpus as it is, with 0 all sources weigh alike. The exponent is found by bisection: the smallest
one that keeps every source's repetitions within a limit, or the one whose weights have a wanted
entropy. The token budget is the least that uses every document once, so nothing is dropped: the
source with most tokens for its weight runs once, the others r >= 1 times. A source's documents are
dealt into blocks by a hash; every epoch permutes the blocks anew, and the last, partial epoch
takes blocks in that order while tokens of its budget are left (the block that reaches the budget
is the last one taken, so a source is over by less than a block).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import column, packed, saved
from ledgerloom.llm.packing import source_name

BLOCKS = 256
WORD = "[^\\x20\\x09-\\x0D]+"
#: Exponents that one pass over the sources tries at once.
TRIED = 32


def bisect(too_high: Callable[[list[float]], list[bool]], steps: int = 60, tried: int = 1) -> float:
    """The smallest exponent in [0, 1] that isn't too high up, by bisection; with ``tried`` points at a time, by that many parts."""
    if not too_high([0.0])[0]:
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(-(-steps // max(1, math.ceil(math.log2(tried + 1))))):
        points = [lo + (hi - lo) * (i + 1) / (tried + 1) for i in range(tried)]
        rising = too_high(points)
        at = rising.index(False) if False in rising else tried
        lo, hi = (points[at - 1] if at else lo), (points[at] if at < tried else hi)
    return hi


def repeat_exponent(least: int, most: int, max_repeats: float) -> float:
    """The exponent at which the source of fewest tokens is repeated max_repeats times while that of most runs once."""
    return bisect(lambda points: [(most / least) ** (1 - a) > max_repeats for a in points])


def entropy_exponent(totals: DataFrame, target: float) -> float:
    """The exponent at which the weights' entropy is the target. totals: a column ``total``, of positive numbers.

    With z the sum of s**a, the entropy is ln z - a * sum(s**a * ln s) / z; each pass over the
    sources sums it for TRIED exponents, so no list of sources is gathered.
    """
    whole = totals.agg(F.sum("total")).first()[0]
    share = F.col("total") / F.lit(float(whole))

    def above(points: list[float]) -> list[bool]:
        sums = [x for i, a in enumerate(points) for x in (F.sum(F.pow(share, F.lit(a))).alias(f"z{i}"), F.sum(F.pow(share, F.lit(a)) * F.log(share)).alias(f"l{i}"))]
        r = totals.agg(*sums).first()
        return [math.log(r[f"z{i}"]) - a * r[f"l{i}"] / r[f"z{i}"] > target for i, a in enumerate(points)]

    return bisect(above, 60, TRIED)


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", max_repeats: float | None = None, target_entropy: float | None = None, seed: int = 1, blocks: int = BLOCKS, tokens: Column | None = None) -> DataFrame:
    """docs with each row as often as it is used; adds a struct ``mix``: epoch, block, place (of the block in its epoch), tokens.

    tokens defaults to the number of words. A document without tokens (null or empty text) belongs
    to a block like others. Null sources are one source of their own; a source without any token is
    used once. Rows with equal or null keys share a block; repeated rows are each used. An empty
    table gives no rows. A column of docs named mix is replaced; others may have any name. There may
    be any number of sources: what is known of each stays in a table.
    """
    if (max_repeats is None) == (target_entropy is None):
        raise ValueError("give max_repeats or target_entropy")
    cols = [c for c in docs.columns if c != "mix"]
    tokens = F.coalesce(F.regexp_count(column(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long") if tokens is None else tokens
    block = F.pmod(F.xxhash64(F.lit(seed), column(key)), F.lit(blocks)).cast("int")
    rows = docs.select(packed(docs, cols), source_name(column(source)).alias("s"), block.alias("block"), tokens.alias("tokens"))
    sums = saved(rows.groupBy("s", "block").agg(F.sum("tokens").alias("tokens")), "blocks")
    totals = sums.groupBy("s").agg(F.sum("tokens").alias("total"))
    live = totals.where("total > 0")
    least, most = live.agg(F.min("total"), F.max("total")).first()
    exponent = 1.0 if not most else repeat_exponent(least, most, max_repeats) if max_repeats is not None else entropy_exponent(saved(live, "totals"), target_entropy)
    # Weights are total**exponent; with the budget at which the largest source runs once, a source runs so often:
    times = F.when(F.col("total") > 0, F.greatest(F.lit(1.0), F.pow(F.lit(float(most or 1)) / F.col("total"), F.lit(1 - exponent)))).otherwise(F.lit(1.0))
    plan = totals.select("s", "total", times.alias("times"))
    epochs = sums.join(plan, "s").withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.ceil("times") - 1).cast("int"))))
    order = Window.partitionBy("s", "epoch").orderBy(F.xxhash64(F.lit(seed), "s", "epoch", "block"), "block")
    placed = epochs.withColumn("place", F.row_number().over(order) - 1).withColumn("before", F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.where((F.col("epoch") == 0) | (F.col("before") < (F.col("times") - F.col("epoch")) * F.col("total")))
    uses = saved(placed.groupBy("s", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "place"))).alias("uses")), "uses")
    out = rows.join(uses, ["s", "block"]).select("*", F.explode("uses").alias("use"))
    return out.select(*(F.col("rest").getField(c).alias(c) for c in cols), F.struct(F.col("use.epoch"), "block", F.col("use.place"), "tokens").alias("mix"))
