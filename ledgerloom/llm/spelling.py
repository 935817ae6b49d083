"""Spelling variants: words at one edit from each other, by automata over halves of words.

Every word is cut into two segments, at half its length. One edit changes one segment only, so of
two near words one has a segment of the other, unchanged, at its start or at its end. Aho-Corasick
automata hold the segments of all words, dealt to shards by the segment; a word is scanned by the
shards to which segments go that it could share, at most four. A hit counts if the segment stands
at the start (end) and the lengths differ by one at most; then the distance of the rest is verified.

A shard holds about SHARD_WORDS segments. A segment that very many words share is dealt to blocks of
its words times chunks of those scanned, so no automaton and no task grows with it. The words under
a segment are looked up by their rests with a hole in place of one character, not one by one, so
verifying doesn't grow with the square of their number either.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import forget, saved

#: Segments to an automaton, about; and words that share one segment before it is dealt to blocks.
SHARD_WORDS, HOT_WORDS = 40_000, 20_000
#: So few words under a segment are compared one by one.
FEW = 8
LEAST_LENGTH = 4
_HOLE = "\0"


def one_edit(a: str, b: str) -> bool:
    """Whether b is a with exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


class Rests:
    """What words that share a segment have beside it, with each word's number; finds those at one edit."""

    __slots__ = ("holes", "rests")

    def __init__(self):
        self.rests: dict[str, int] = {}
        self.holes: dict[str, list[str]] | None = None

    def _index(self) -> dict[str, list[str]]:
        holes: dict[str, list[str]] = {}
        for rest in self.rests:
            for i in range(len(rest)):
                holes.setdefault(rest[:i] + _HOLE + rest[i + 1 :], []).append(rest)
        return holes

    def near(self, own: str) -> set[str]:
        if len(self.rests) <= FEW:
            return {r for r in self.rests if one_edit(own, r)}
        if self.holes is None:
            self.holes = self._index()
        found = set()
        for i in range(len(own)):
            head, tail = own[:i], own[i + 1 :]
            if head + tail in self.rests:
                found.add(head + tail)
            found.update(self.holes.get(head + _HOLE + tail, ()))
            found.update(self.holes.get(head + _HOLE + own[i:], ()))
        found.update(self.holes.get(own + _HOLE, ()))
        found.discard(own)
        return found


class Shard:
    """An automaton of segments: of each, the words that start with it and those that end with it."""

    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        self.ready = False

    def add(self, word: str, n: int, side: int) -> None:
        half = len(word) // 2
        segment, rest = (word[:half], word[half:]) if side == 0 else (word[half:], word[:half])
        held = self.automaton.get(segment, None)
        if held is None:
            held = (len(segment), Rests(), Rests())
            self.automaton.add_word(segment, held)
        held[1 + side].rests[rest] = n

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """Words at one edit that share a segment held here; some come twice."""
        if not len(self.automaton):
            return
        if not self.ready:
            self.automaton.make_automaton()
            self.ready = True
        last = len(word) - 1
        for end, (length, starting, ending) in self.automaton.iter(word):
            if end == length - 1 and starting.rests:  # at the start
                segment = word[:length]
                for rest in starting.near(word[length:]):
                    yield segment + rest, starting.rests[rest]
            if end == last and ending.rests:  # at the end
                segment = word[last + 1 - length :]
                for rest in ending.near(word[: last + 1 - length]):
                    other = rest + segment
                    yield other, ending.rests[rest]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, scanned, side, word, n), sorted by shard, scanned and word: segments first, then the words to scan."""
    at, shard, last = None, Shard(), None
    for batch in batches:
        words, near, counts = [], [], []
        for number, scanned, side, word, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "scanned", "side", "word", "n")), strict=True):
            if number != at:
                at, shard, last = number, Shard(), None
            if not scanned:
                shard.add(word, n, side)
                continue
            if word == last:  # several of its segments may be held here
                continue
            last = word
            for other, m in set(shard.near(word)):
                words.append(word)
                near.append(other)
                counts.append(m)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(near, pa.string()), pa.array(counts, pa.int64())], names=["word", "near", "near_n"])


def _segment(side: Column, word: Column, length: Column) -> Column:
    return F.when(side == 0, F.substring(word, F.lit(1), length)).otherwise(F.substring(word, F.length(word) - length + 1, length))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) of all pairs of words at one edit, in both directions, some repeated.

    words: (word, n), distinct words of at least LEAST_LENGTH code points, none of them U+0000.
    """
    sides = F.explode(F.array(F.lit(0), F.lit(1)))
    size = F.length("word")
    half = lambda n: F.when(F.col("side") == 0, F.floor(n / 2)).otherwise(F.ceil(n / 2)).cast("int")
    held = words.select("word", "n", sides.alias("side")).withColumn("segment", _segment(F.col("side"), F.col("word"), half(size)))
    lengths = F.array_distinct(F.array(half(size - 1), half(size), half(size + 1)))
    tried = words.select("word", "n", sides.alias("side")).withColumn("length", F.explode(lengths)).withColumn("segment", _segment(F.col("side"), F.col("word"), F.col("length"))).drop("length")
    hot = held.groupBy("side", "segment").count().where(F.col("count") > HOT_WORDS)
    hot = saved(hot.select("side", "segment", F.ceil(F.col("count") / HOT_WORDS).cast("int").alias("blocks")), "hot-segments")
    total, extra = 2 * words.count(), hot.agg(F.sum(F.col("blocks") * F.col("blocks"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS) + extra)
    rows = held.withColumn("scanned", F.lit(False)).unionByName(tried.withColumn("scanned", F.lit(True)))
    rows = rows.join(hot, ["side", "segment"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # A segment's own block, in all chunks; a scanned word's own chunk, of all blocks.
    own, each = F.pmod(F.xxhash64(F.lit(5), "word"), "blocks").cast("int"), F.expr("sequence(0, blocks - 1)")
    cells = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.transform(each, lambda other: F.when(F.col("scanned"), other * F.col("blocks") + own).otherwise(own * F.col("blocks") + other)))
    number = F.pmod(F.xxhash64("side", "segment", "cell"), F.lit(shards)).cast("int")
    rows = rows.withColumn("cell", F.explode(cells)).select(number.alias("shard"), "scanned", "side", "word", "n")
    dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard", "scanned", "word")
    return dealt.mapInArrow(_scan, "word string, near string, near_n long")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for links (word, form) that form no circle, by doubling: each round follows twice as many forms.

    Rounds grow with the logarithm of the longest chain; each is written.
    """
    now = saved(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = saved(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = jumped.where("moved").limit(1).count()
        forget(now)
        now = jumped
        if not moved:
            return now.select("word", "root")


def variant_groups(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for distinct words with their counts.

    Near words differ by exactly one code point inserted, deleted or replaced. A word's form is its
    near word with the largest n, the first in code-point order of those with equal n, if that n is at
    least twice its own; else null. The root is where following forms ends, the word itself if it
    has none; counts at least double at each step, so there are no circles. Rows with a null word or
    null n are no words; of a repeated word all counts are added. No words, no rows. Other columns
    aren't read. Words under LEAST_LENGTH code points have halves too short to tell apart and raise an error.
    """
    words = words.select(F.col("word").cast("string"), F.col("n").cast("long")).where("word is not null and n is not null").groupBy("word").agg(F.sum("n").alias("n"))
    short = F.length("word") < LEAST_LENGTH
    words = saved(words.withColumn("word", F.when(short, F.raise_error(F.concat(F.lit("too short: "), "word"))).otherwise(F.col("word"))), "words")
    # A word of m code points over an alphabet of a letters has (2m + 1) a near words at most.
    near = near_words(words).groupBy("word").agg(F.collect_set(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("near"))
    best = F.array_min("near")
    found = words.join(near, "word", "left").select("word", "n", F.when(F.col("near").isNull(), F.lit(0)).otherwise(F.size("near")).cast("long").alias("n_near"), best["form"].alias("form"), (-best["less"]).alias("form_n"))
    enough = F.col("form_n") >= 2 * F.col("n")
    found = saved(found.withColumns({"form": F.when(enough, F.col("form")), "form_n": F.when(enough, F.col("form_n"))}), "variants")
    forget(words)
    ends = roots(found.where("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
