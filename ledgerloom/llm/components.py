"""Connected components by alternating large-star and small-star steps, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import forget, saved


def _star(pairs: DataFrame) -> DataFrame:
    """From directed (u, v): every v and u itself are linked to the smallest node among them."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = pairs.join(least, "u").select(F.explode(F.array("u", "v")).alias("v"), "m")
    return linked.where("v <> m").distinct().select(F.col("v").alias("u"), F.col("m").alias("v"))


def connected_components(links: DataFrame, left: str, right: str) -> tuple[DataFrame, list[DataFrame]]:
    """(node, component) for every node of a link, and the saved tables that it reads; the component is its smallest node.

    Repeated links, both directions and self-links are allowed; rows with a null are no links. Each
    round is written to the shared folder, and the rounds grow as the logarithm of a component's
    diameter. No list of a node's neighbours is ever gathered: only minima are.
    """
    links = links.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b")).where("a is not null and b is not null")
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    nodes = saved(links.where("u = v").select("u").distinct(), "loops")
    now = saved(links.where("u <> v").distinct(), "links")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        both = now.union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.distinct(), "large-star")
        forget(now)
        now = saved(_star(large), "small-star")
        forget(large)
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    alone = nodes.select(F.col("u").alias("node")).join(found.select("node").union(roots.select("node")), "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.union(roots).union(alone), [now, nodes]
