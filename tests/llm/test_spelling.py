"""Spelling variants against all pairs of words, and the query against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import spelling
from ledgerloom.llm.queries import op12_spelling_variants
from ledgerloom.llm.spelling import Rests, Shard, near_words, one_edit, roots, variant_groups

COLUMNS = ("word", "n", "n_near", "form", "form_n", "root")


def distance_one(a, b):
    """By definition: all words at one edit of a over the letters of both."""
    letters = set(a + b)
    return b != a and b in {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in letters} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in letters}


def brute(counts):
    near = {w: [x for x in counts if abs(len(x) - len(w)) < 2 and distance_one(w, x)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    rows = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, counts[w], len(near[w]), form[w], counts.get(form[w]), root))
    return rows


def some_words(draw, n, letters="abé"):
    out = set()
    while len(out) < n:
        out.add("".join(draw.choice(letters) for _ in range(draw.choice([5, 5, 6, 7, 8, 9]))))
    return sorted(out)


def found(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_one_edit():
    draw = random.Random(1)
    words = some_words(draw, 60, "ab") + ["", "a", "b", "ab", "ba"]
    for a in words:
        for b in words:
            assert one_edit(a, b) == (distance_one(a, b) or (not a and len(b) == 1) or (not b and len(a) == 1)), (a, b)


def test_rests_indexed_or_not_and_a_shard(monkeypatch):
    draw = random.Random(2)
    words = some_words(draw, 300)
    for few in (0, 10**9):
        monkeypatch.setattr(spelling, "FEW", few)
        rests = Rests()
        rests.rests = dict.fromkeys(words, 1)
        for w in words[:40]:
            assert rests.near(w) == {x for x in words if distance_one(w, x)}
        shard = Shard()
        for w in words:
            for side in (0, 1):
                shard.add(w, len(w), side)
        for w in words[:40]:
            assert {x for x, _ in shard.near(w)} == {x for x in words if distance_one(w, x)}
    assert list(Shard().near("words")) == []


@pytest.mark.parametrize("hot", [10**6, 20, 7])
def test_variants_are_those_of_all_pairs(spark, monkeypatch, hot):
    """Also where segments are dealt to blocks and chunks, over few letters, so that halves are shared by many."""
    monkeypatch.setattr(spelling, "HOT_WORDS", hot)
    monkeypatch.setattr(spelling, "SHARD_WORDS", 100)
    draw = random.Random(hot)
    counts = {w: int(3 * 2 ** draw.uniform(0, 8)) for w in some_words(draw, 400)}
    assert found(variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3))) == brute(counts)


def test_hot_halves_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HOT_WORDS", 10)
    words = [f"same{a}{b}" for a in "abcdefgh" for b in "stuvwxyz"] + [f"{a}{b}tail" for a in "abcdefgh" for b in "stuvwxyz"]
    pairs = {(r.word, r.near) for r in near_words(spark.createDataFrame([(w, 3) for w in words], "word string, n long")).collect()}
    assert pairs == {(a, b) for a in words for b in words if distance_one(a, b)}


def test_chains_ties_nulls_repeats_and_other_columns(spark):
    rows = [("aaaaa", 3, 1), ("aaaab", 6, 1), ("aaabb", 12, 1), ("aabbb", 24, 1), ("abbbb", 48, 1), ("bbbbb", 96, 1), (None, 9, 1), ("eeeee", None, 1), ("fffff", 2, 1), ("fffff", 3, 1), ("ffffg", 10, 1), ("ffffe", 10, 1)]
    df = spark.createDataFrame(rows, "word string, n long, shard int").withColumn("ro`ot", F.lit(1))
    counts = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "fffff": 5, "ffffg": 10, "ffffe": 10}
    got = found(variant_groups(df))
    assert got == brute(counts)
    assert ("aaaaa", 3, 1, "aaaab", 6, "bbbbb") in got and ("fffff", 5, 2, "ffffe", 10, "ffffe") in got
    assert variant_groups(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="too short: abc"):
        variant_groups(spark.createDataFrame([("abc", 1)], "word string, n long")).collect()


def test_roots_of_long_chains(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)], "word string, form string")
    assert {(r.word, r.root) for r in roots(links).collect()} == {(f"w{i}", "w37") for i in range(37)}


def test_the_query_on_a_fixture(spark, tmp_path):
    draw = random.Random(6)
    words = some_words(draw, 30, "abÄ×") + ["Straße", "straße", "ÀÉtoile", "àétoile", "Word", "words", "Words", "naïve"]
    rows = [(i, " ".join(draw.choice(words) + draw.choice(["", ",", "1", "\n"]) for _ in range(draw.randrange(60))), "x") for i in range(120)]
    rows += [(200, None, "x"), (201, "", "x"), (None, "straße straße straße", "x"), (5, rows[5][1], "x"), (300, "lengthy " * 20_000 + "É" * 5000, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    counts, edits = Counter(), 0
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run, edits = run[: h % len(run)] + run[h % len(run) + 1 :], edits + 1
            counts[run] += 1
    assert edits
    assert found(op12_spelling_variants(spark, str(tmp_path))) == brute({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert op12_spelling_variants(spark, str(tmp_path)).count() == 0
