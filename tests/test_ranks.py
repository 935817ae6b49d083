"""Inversions and tau-b against all pairs, and resampled tables against drawn rows."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import stats
from ledgerloom.operators.ranks import inversions, inversions_within


def all_pairs(points):
    return sum(p[2] * q[2] for p, q in itertools.combinations(points, 2) if (p[0] - q[0]) * (p[1] - q[1]) < 0)


def tau(rows):
    n = balance = left = right = 0
    for (a, b), (c, d) in itertools.combinations(rows, 2):
        n, balance = n + 1, balance + ((a > c) - (a < c)) * ((b > d) - (b < d))
        left, right = left + (a != c), right + (b != d)
    return balance / math.sqrt(left * right) if left and right else math.nan


def some_points(draw, n, values, shape):
    pairs = {(a, b) for _ in range(n) for a, b in [(draw.randrange(values), draw.randrange(values))]}
    if shape == "hot":
        pairs |= {(7, b) for b in range(n // 2)} | {(a, 9) for a in range(n // 2)}
    return [(a, b, draw.randrange(1, 5)) for a, b in sorted(pairs)]


@pytest.mark.parametrize("values", [1, 2, 7, 1000])
def test_within_a_block(values):
    draw = random.Random(values)
    for n in (1, 2, 3, 16, 77):
        points = some_points(draw, n, values, "")
        draw.shuffle(points)
        assert inversions_within(*(np.array(c) for c in zip(*points, strict=True))) == all_pairs(points)


@pytest.mark.parametrize("shape", ["", "hot"])
def test_across_blocks_and_levels(spark, shape):
    """Blocks of four points, so that blocks of blocks are counted too; a third of all points share a value."""
    points = some_points(random.Random(3), 300, 60, shape)
    df = spark.createDataFrame([(i % 2, *p) for i, p in enumerate(points)], "g int, a int, b int, k long").repartition(3)
    for block in (4, 10**6):
        got = {r.g: int(r.inverted) for r in inversions(df, ["g"], block).collect()}
        assert got == {g: all_pairs(points[g::2]) for g in (0, 1)}


def test_tau_of_two_continuous_ratings(spark):
    draw = np.random.Generator(np.random.PCG64(2))
    a = draw.normal(size=2000)
    b = np.round(a + draw.normal(size=2000), 2)
    rows = [(float(x), float(y)) for x, y in zip(a, b, strict=True)]
    df = spark.createDataFrame([*rows, (1.0, None)], "a double, b double")
    want = tau(rows)
    for block in (100, 10**6):
        assert stats.kendall_tau_b(df, "a", "b", block=block).first().tau_b == pytest.approx(want, abs=1e-12)


def test_tau_of_very_many_ratings(spark):
    """100,000 different values; a shifted order has a known tau."""
    n, shift = 100_000, 1000
    df = spark.range(n).select(F.col("id").alias("a"), ((F.col("id") + shift) % n).alias("b"))
    inverted = shift * (n - shift)
    assert stats.kendall_tau_b(df, "a", "b", block=8000).first().tau_b == pytest.approx(1 - 4 * inverted / (n * (n - 1)), abs=1e-12)


def test_resampled_cells_are_distributed_as_drawn_rows(spark):
    pairs = [(1, 1)] * 30 + [(0, 1)] * 8 + [(0, 0)] * 40 + [(1, 0)] * 2
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a int, b int")
    found = {}
    for how, drawn in (("cells", stats.cell_resamples(df, "a", "b", 3000, 1)), ("hashed", stats.hashed_resamples(df, "a", "b", 3000, 1))):
        rows = drawn.collect()
        boots = {}
        for r in rows:
            boots.setdefault(r.boot, {})[r.a, r.b] = r[stats.TIMES]
        assert len(boots) == 3000 and all(sum(x.values()) == 80 for x in boots.values())
        counts = np.array([[x.get(c, 0) for c in ((1, 1), (0, 1), (0, 0), (1, 0))] for x in boots.values()])
        p = np.array([30, 8, 40, 2]) / 80
        assert np.allclose(counts.mean(0), 80 * p, atol=0.3)
        assert np.allclose(np.cov(counts.T), 80 * (np.diag(p) - np.outer(p, p)), atol=1.6)
        found[how] = stats.bootstrap_ci(df, "a", "b", ["i"], n_boot=3000, seed=1, draws=how).first()
    found["published"] = stats.bootstrap_ci(df, "a", "b", ["i"], n_boot=3000, seed=1).first()
    for x in found.values():
        assert x.lo == pytest.approx(found["published"].lo, abs=0.03) and x.hi == pytest.approx(found["published"].hi, abs=0.03)
    again = stats.cell_resamples(df.repartition(7), "a", "b", 50, 1)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in stats.cell_resamples(df, "a", "b", 50, 1).collect()}


def test_a_million_ratings(spark):
    df = spark.range(1_000_000).select(F.expr("cast(id % 3 as int)").alias("a"), F.expr("cast(if(id % 5 = 0, id % 2, id % 3) as int)").alias("b"))
    got = stats.bootstrap_ci(df, "a", "b", [], categories=[0, 1, 2], n_boot=500, draws="cells").first()
    exact = stats.weighted_kappa(df, "a", "b", [0, 1, 2]).first().weighted_kappa
    assert got.lo < exact < got.hi and got.hi - got.lo < 0.01


def test_what_is_refused(spark):
    df = spark.createDataFrame([(1, 1)], "a int, b int")
    with pytest.raises(ValueError, match="positive"):
        stats.cell_resamples(df, "a", "b", 0, 1)
    with pytest.raises(ValueError, match="one of"):
        stats.bootstrap_ci(df, "a", "b", [], draws="odd")
    with pytest.raises(Exception, match="no ratings"):
        stats.cell_resamples(df.where("false"), "a", "b", 3, 1).collect()
    with pytest.raises(Exception, match="pairs of labels"):
        stats.cell_resamples(spark.range(10_001).selectExpr("id as a", "id as b"), "a", "b", 3, 1).collect()
