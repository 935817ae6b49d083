"""Agreement of two raters over a table of paired ratings: every statistic is sums over counted pairs."""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ranks import BLOCK, inversions
from ledgerloom.sources.shared import saved

NAN = float("nan")


#: A column of this name says how often a row counts; without it every row counts once.
TIMES = "__times"


def _pairs(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Counted pairs, the base of all statistics: as many rows as pairs of labels. Nulls aren't ratings."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    times = F.sum(TIMES) if TIMES in df.columns else F.count("*")
    return rows.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(times.alias("k"))


def _one(by: list[str]) -> list[str]:
    return by or ["__all"]


def _keyed(pairs: DataFrame, by: list[str]) -> DataFrame:
    return pairs if by else pairs.withColumn("__all", F.lit(0))


def raw_agreement(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return _pairs(df, a, b, by).groupBy(*by).agg(F.sum("k").alias("n"), (F.sum(F.when(F.col("a") == F.col("b"), F.col("k")).otherwise(0)) / F.sum("k")).alias("raw_agreement"))


def cohen_kappa(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Also pabak, 2 * agreement - 1 (null for more than two labels). Kappa is 1 for two constant, equal raters."""
    by = by or []
    pairs, keys = _keyed(_pairs(df, a, b, by), by), _one(by)
    left, right = pairs.groupBy(*keys, F.col("a").alias("label")).agg(F.sum("k").alias("ka")), pairs.groupBy(*keys, F.col("b").alias("label")).agg(F.sum("k").alias("kb"))
    labels = left.join(right, [*keys, "label"], "full").groupBy(*keys).agg(F.sum(F.coalesce("ka", F.lit(0)) * F.coalesce("kb", F.lit(0))).alias("chance"), F.count("*").alias("labels"))
    whole = pairs.groupBy(*keys).agg(F.sum("k").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("k")).otherwise(0)).alias("same")).join(labels, keys)
    po, pe = F.col("same") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    kappa = F.when(F.col("chance") == F.col("n") * F.col("n"), F.when(F.col("same") == F.col("n"), 1.0).otherwise(NAN)).otherwise((po - pe) / (1 - pe))
    return whole.select(*by, "n", po.alias("raw_agreement"), kappa.alias("kappa"), F.when(F.col("labels") <= 2, 2 * po - 1).alias("pabak"))


def weighted_kappa(df: DataFrame, a: str, b: str, categories: list, by: list[str] | None = None) -> DataFrame:
    """Quadratic weights on the positions in ``categories``; ratings outside the scale fail the query."""
    if len(set(categories)) != len(categories):
        raise ValueError("a category occurs twice")
    by = by or []
    at = lambda c: F.array_position(F.array(*(F.lit(x) for x in categories)), F.col(c))
    pairs = _pairs(df, a, b, by).select(*by, "k", *(F.when(at(c) > 0, at(c)).otherwise(F.raise_error(F.lit("a rating is outside the scale"))).alias(c) for c in ("a", "b")))
    s = lambda e: F.sum(F.col("k") * e)
    a_, b_ = F.col("a"), F.col("b")
    sums = pairs.groupBy(*by).agg(F.sum("k").alias("n"), s((a_ - b_) * (a_ - b_)).alias("seen"), s(a_).alias("sa"), s(b_).alias("sb"), s(a_ * a_ + b_ * b_).alias("squares"))
    expected = F.col("n") * F.col("squares") - 2 * F.col("sa") * F.col("sb")
    return sums.select(*by, "n", F.when(expected == 0, 1.0).otherwise(1 - F.col("n") * F.col("seen") / expected).alias("weighted_kappa"))


def kendall_tau_b(df: DataFrame, a: str, b: str, by: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Concordant less discordant pairs over those untied on either side, in n log n; NaN if a rater is constant.

    With all pairs, those tied by each rater and by both, and the inversions, concordant pairs are what is left.
    """
    by = by or []
    pairs, keys = saved(_keyed(_pairs(df, a, b, by), by), "pairs"), _one(by)
    of = lambda c: F.expr(f"cast({c} as decimal(20,0)) * ({c} - 1) div 2")
    ties = lambda c: pairs.groupBy(*keys, c).agg(F.sum("k").alias("t")).groupBy(*keys).agg(F.sum(of("t")).alias(f"ties_{c}"))
    whole = pairs.groupBy(*keys).agg(F.sum("k").alias("n"), F.sum(of("k")).alias("ties_ab")).withColumn("all", of("n"))
    whole = whole.join(ties("a"), keys).join(ties("b"), keys).join(inversions(pairs, keys, block), keys, "left")
    # Concordant and discordant pairs are untied on both sides; all sums are exact.
    balance = F.expr("all - ties_a - ties_b + ties_ab - 2 * coalesce(inverted, 0)").cast("double")
    below = (F.col("all") - F.col("ties_a")).cast("double") * (F.col("all") - F.col("ties_b")).cast("double")
    return whole.select(*by, "n", F.when(below == 0, NAN).otherwise(balance / F.sqrt(below)).alias("tau_b"))


#: Indices that the driver draws at most.
MOST_DRAWS = 2_000_000
#: Pairs of labels that a resampled table has at most, and tasks that boots are dealt to.
MOST_CELLS, BOOT_TASKS = 10_000, 64


def resamples(df: DataFrame, keys: list[str], n_boot: int, seed: int) -> DataFrame:
    """Rows of df drawn with replacement, once for each boot. For small tables: n_boot x n indices come from the driver."""
    if n_boot <= 0:
        raise ValueError("n_boot must be positive")
    spark = df.sparkSession
    rows = df.orderBy(*keys).limit(MOST_DRAWS // n_boot + 1).collect()
    if not rows:
        raise ValueError("no ratings")
    if len(rows) * n_boot > MOST_DRAWS:
        raise ValueError("too many ratings to draw from on the driver; use draws='cells'")
    draw = random.Random(seed)
    picks = [(b, draw.randrange(len(rows))) for b in range(n_boot) for _ in rows]
    numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))
    return spark.createDataFrame(picks, "boot int, i int").join(F.broadcast(numbered), "i").drop("i")


def _cells(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: all counted pairs, sorted. As many as pairs of labels, so a scale of continuous ratings is refused."""
    cells = _pairs(df, a, b, []).limit(MOST_CELLS + 1).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("a", "b", "k"))).alias("cells"))
    most = F.when(F.col("n") > MOST_CELLS, F.raise_error(F.lit(f"more than {MOST_CELLS} pairs of labels"))).when(F.col("n") == 0, F.raise_error(F.lit("no ratings")))
    return cells.select(F.coalesce(most.cast(cells.schema["cells"].dataType), "cells").alias("cells"))


def _boots(cells: DataFrame, n_boot: int) -> DataFrame:
    if n_boot <= 0:
        raise ValueError("n_boot must be positive")
    return cells.select("cells", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("boot")).repartition(BOOT_TASKS, "boot")


def cell_resamples(df: DataFrame, a: str, b: str, n_boot: int, seed: int) -> DataFrame:
    """boot, a, b and how often each pair was drawn: the table of pairs resampled as a multinomial, a binomial for each cell given the last.

    The distribution is that of drawing ratings with replacement; the work is boots x cells, whatever
    the number of ratings. A boot's generator is seeded by it, so its draws are the same wherever it runs.
    """

    @F.pandas_udf("array<long>")
    def drawn(boot: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for i, k in zip(boot, counts, strict=True):
            draw, left, among, found = np.random.Generator(np.random.PCG64([seed, i])), int(sum(k)), int(sum(k)), []
            for c in k:
                got = left if c == among else int(draw.binomial(left, c / among))
                found.append(got)
                left, among = left - got, among - int(c)
            out.append(found)
        return pd.Series(out)

    rows = _boots(_cells(df, a, b), n_boot)
    times = drawn("boot", F.transform("cells", lambda c: c["k"]))
    each = F.zip_with("cells", times, lambda c, m: F.struct(c["a"].alias(a), c["b"].alias(b), m.alias(TIMES)))
    return rows.select("boot", F.inline(each)).where(F.col(TIMES) > 0)


def hashed_resamples(df: DataFrame, a: str, b: str, n_boot: int, seed: int) -> DataFrame:
    """The same by one hashed draw for each rating: draw i of a boot is the pair that holds place md5(seed|boot|i) mod n.

    Places are counted through the sorted pairs, so ratings needn't be numbered. SQL can draw the same.
    """
    rows = _boots(_cells(df, a, b), n_boot)
    ends = F.expr("transform(sequence(1, size(cells)), i -> aggregate(slice(cells, 1, i), 0L, (s, c) -> s + c.k))")
    rows = rows.withColumn("ends", ends).withColumn("i", F.explode(F.expr("sequence(0L, element_at(ends, -1) - 1)")))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "boot", "i")), 1, 13), 16, 10).cast("long")
    rows = rows.withColumn("place", F.pmod(draw, F.expr("element_at(ends, -1)")))
    cell = F.expr("cells[size(filter(ends, e -> e <= place))]")
    return rows.select("boot", cell.alias("c")).groupBy("boot", F.col("c.a").alias(a), F.col("c.b").alias(b)).agg(F.count("*").alias(TIMES))


def bootstrap_ci(df: DataFrame, a: str, b: str, keys: list[str], categories: list | None = None, n_boot: int = 2000, seed: int = 0, alpha: float = 0.05, draws: str = "published") -> DataFrame:
    """Percentile interval of kappa, or of weighted kappa if ``categories`` is given; NaN statistics are skipped.

    draws: ``published`` (rows, in the order of keys, by Python's generator; small tables), ``cells``
    (any number of ratings), ``hashed`` (a hash for each rating). The last two don't use keys.
    """
    by: dict[str, Callable[[], DataFrame]] = {"published": lambda: resamples(df, keys, n_boot, seed), "cells": lambda: cell_resamples(df, a, b, n_boot, seed), "hashed": lambda: hashed_resamples(df, a, b, n_boot, seed)}
    if draws not in by:
        raise ValueError(f"draws must be one of {sorted(by)}")
    drawn = by[draws]()
    if draws != "published":
        drawn = saved(drawn, "draws")
    found = cohen_kappa(drawn, a, b, ["boot"]).select(F.col("kappa").alias("x")) if categories is None else weighted_kappa(drawn, a, b, categories, ["boot"]).select(F.col("weighted_kappa").alias("x"))
    at = lambda q: F.coalesce(F.expr(f"percentile(x, {q})"), F.lit(NAN))
    return found.where(~F.isnan("x")).agg(at(alpha / 2).alias("lo"), at(1 - alpha / 2).alias("hi"))


def percentile(df: DataFrame, column: str, q: float) -> DataFrame:
    """Linear interpolation at q * (n - 1)."""
    return df.agg(F.expr(f"percentile({column}, {q})").alias("value"))


def agreement_report(human: DataFrame, judge: DataFrame, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """One row for acceptable, tone and clarity over the items both have: n, statistic, interval, pabak, raw agreement.

    human, judge: item_id, acceptable (boolean), tone and clarity (1 to 4).
    """
    rows = human.select("item_id", *(F.col(c).alias(f"h_{c}") for c in ("acceptable", "tone", "clarity"))).join(judge.select("item_id", *(F.col(c).alias(f"j_{c}") for c in ("acceptable", "tone", "clarity"))), "item_id")
    scale = [1, 2, 3, 4]
    one = cohen_kappa(rows, "h_acceptable", "j_acceptable").crossJoin(F.broadcast(bootstrap_ci(rows, "h_acceptable", "j_acceptable", ["item_id"], None, n_boot, seed)))
    out = one.select(F.lit("acceptable").alias("measure"), "n", F.col("kappa").alias("statistic"), "lo", "hi", "pabak", "raw_agreement")
    for c in ("tone", "clarity"):
        k = weighted_kappa(rows, f"h_{c}", f"j_{c}", scale).crossJoin(F.broadcast(bootstrap_ci(rows, f"h_{c}", f"j_{c}", ["item_id"], scale, n_boot, seed))).crossJoin(F.broadcast(raw_agreement(rows, f"h_{c}", f"j_{c}").select("raw_agreement")))
        out = out.unionByName(k.select(F.lit(c).alias("measure"), "n", F.col("weighted_kappa").alias("statistic"), "lo", "hi", F.lit(None).cast("double").alias("pabak"), "raw_agreement"))
    return out


def clean_subset(truth: DataFrame) -> DataFrame:
    """item_id, clean: whether a calibration item's source is an unspoiled draft."""
    return truth.select("item_id", (F.col("source").contains("CLEAN") | F.col("source").contains("live_pass")).alias("clean"))


def map_winner(winner: str, ordering: str) -> str:
    """SQL: the draft (a or b) that a verdict on positions names."""
    return f"case when {winner} = 'tie' then 'tie' when ({winner} = '1') = ({ordering} = 'ab') then 'a' else 'b' end"


def both_orders(judgments: DataFrame) -> DataFrame:
    """pair_id, verdict, flipped: a verdict counts only if both orders give it; else, or with a failed parse, a tie.

    judgments: pair_id, ordering (ab or ba), winner (1, 2 or tie), parse_ok.
    """
    named = judgments.withColumn("v", F.when(F.col("parse_ok"), F.expr(map_winner("winner", "ordering"))))
    both = named.groupBy("pair_id").agg(F.max(F.when(F.col("ordering") == "ab", F.col("v"))).alias("ab"), F.max(F.when(F.col("ordering") == "ba", F.col("v"))).alias("ba"))
    agree = F.coalesce(F.col("ab") == F.col("ba"), F.lit(False))
    return both.select("pair_id", F.when(agree, F.col("ab")).otherwise("tie").alias("verdict"), (~agree).alias("flipped"))


RUBRIC = "struct<tone:int,tone_span:string,clarity:int,clarity_span:string,acceptable:boolean,acceptable_rationale:string>"


def rubric_rows(outputs: DataFrame) -> DataFrame:
    """outputs (item_id, output) parsed: scores, or null with parse_ok false if a field is missing or off the scale."""
    rows = outputs.withColumn("scores", F.from_json("output", RUBRIC))
    ok = F.coalesce(F.expr("scores.tone between 1 and 4 and scores.clarity between 1 and 4 and scores.acceptable is not null"), F.lit(False))
    return rows.select("item_id", F.when(ok, F.col("scores")).alias("scores"), ok.alias("parse_ok"))
