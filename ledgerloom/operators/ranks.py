"""Inversions of weighted points: pairs of which one has the smaller a and the larger b.

Points are dealt to blocks twice, by ranges of (a, b) and by ranges of (b, a). An inversion lies in
one a-block, or in two a-blocks and one b-block, or in two of each. The first two kinds are counted
within blocks by merging; the third is a count of inversions of blocks, weighted by the points in
them, and is counted the same way, of at most a quarter as many points. So the work is n log n, and
no task has more than a block, however many points share a value.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.shared import saved

#: Points to a block; fewer are one block.
BLOCK = 50_000


def inversions_within(a: np.ndarray, b: np.ndarray, k: np.ndarray) -> int:
    """The sum of k_i * k_j over pairs with a_i < a_j and b_i > b_j, by bottom-up merging."""
    n = len(a)
    _, rank = np.unique(b, return_inverse=True)
    order = np.lexsort((rank, a))  # among equal a's, b ascends, so they make no inversion
    rank, k = rank[order], k[order].astype(np.int64)
    at, total, width = np.arange(n), 0, 1
    while width < n:
        run, right = at // (2 * width), at // width % 2
        falling = np.lexsort((1 - right, -rank, run))  # of equal b's the right half's come first
        left = np.where(right[falling] == 0, k[falling], 0)
        before = np.cumsum(left) - left
        starts = np.concatenate([[0], np.flatnonzero(np.diff(run[falling])) + 1])
        base = np.repeat(before[starts], np.diff(np.append(starts, n)))
        total += int(np.dot(np.where(right[falling] == 1, k[falling], 0), before - base))
        width *= 2
    return total


def _within(points: DataFrame, block: list[str], by: list[str], a: str) -> DataFrame:
    """(by, inverted) of each block of points."""
    kinds = ", ".join([*(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in by), "inverted decimal(38,0)"])

    def count(table: pa.Table) -> pa.Table:
        import decimal

        values = [table.column(c).to_numpy() for c in (a, "b", "k")]
        told = {c: table.column(c).slice(0, 1) for c in by}
        return pa.table(told | {"inverted": pa.array([decimal.Decimal(inversions_within(*values))], pa.decimal128(38, 0))})

    return points.groupBy(*block, *by).applyInArrow(count, kinds)


def inversions(points: DataFrame, by: list[str], block: int = BLOCK) -> DataFrame:
    """(by, inverted) for distinct points (by, a, b, k); groups without an inversion may be absent.

    a and b are numbers, k is a positive whole number. Each level deals the points out twice and is written.
    """
    n = points.count()
    # At most a quarter as many pairs of blocks as points.
    parts = min(-(-n // block), max(1, int(n**0.5 / 2)))
    if parts <= 1:
        return _within(points, [], by, "a")
    rows = saved(points.repartitionByRange(parts, *by, "a", "b").withColumn("x", F.spark_partition_id()), "ranked")
    rows = saved(rows.repartitionByRange(parts, *by, "b", "a").withColumn("y", F.spark_partition_id()), "ranked")
    pairs = saved(rows.groupBy(*by, F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("k").alias("k")), "blocks")
    found = [_within(rows, ["x"], by, "a"), _within(rows, ["y"], by, "x"), inversions(pairs, by, block)]
    return reduce(DataFrame.unionByName, found).groupBy(*by).agg(F.sum("inverted").cast("decimal(38,0)").alias("inverted"))
