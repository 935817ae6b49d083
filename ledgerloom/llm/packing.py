"""Mixture-controlled packing: deficit round robin over source queues, in closed form.

Every source is a queue of its documents' tokens. A window (a sequence of ``length`` tokens) takes
from each queue its quantum, the queue's share of the window; what a quantum has beyond whole
tokens is the queue's deficit and is carried to the next window, and so on over all windows and all
partitions. As a queue may be cut anywhere, the state of the round robin after w windows is known
without running it: with P(q) tokens up to queue q of N in all, the queues up to q have given
floor(P(q) * w * length / N) tokens. So each task finds the windows of its own documents, and no
task has to follow another. Only the last sequence is shorter.

With target weights, sources are used up one after the other, and the rest goes on with the others'
weights. Without, the targets are the sources' shares of all tokens. Sources too rare for two tokens
a window share the first queue, where each has turns of about a TURN-th of a window at distances that
follow from its own share, with a deficit of its own: ``Tiers`` for any number of sources whose weights
are their tokens, of which it needs a sum for each tier only; ``Turns`` for those of a list of weights.
Sources without a weight come last, at even rates.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import hashing
from ledgerloom.llm.common import bound_batches, column, packed, saved

LENGTH, END = 4096, 2
#: Words whose ids a worker remembers; beyond, it forgets them all. Bounds memory, not results.
REMEMBERED = 1_000_000
#: Parts in which the sources of a tier are numbered.
SOURCE_PARTS = 256
#: A rare source's turn has at least this part of a window, and two tokens.
TURN = 64
#: Target weights are rounded to this part of their sum.
WEIGHTS = 2**64


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_BETWEEN = "\ua66e"


class WordEncoder:
    """Ids of whole texts by a tokenizer that lowers case and drops white space, so that words are encoded alone.

    The tokenizer's normalizer works on characters, and its splitter joins nothing across white
    space, nor a letter and a following mark other than an apostrophe; so a text's ids are those of
    its parts in order. Parts met before are looked up by a 64-bit hash. Texts with "<|", with which
    special tokens begin, are parted at white space only. ``by_word=False`` encodes whole texts, for
    other tokenizers.
    """

    def __init__(self, path: str, by_word: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.between = np.array(self.tokenizer.encode(_BETWEEN, add_special_tokens=False).ids, np.uint32)
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.sizes, self.ids, self.used, self.words = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0, 0

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in data, and each text's bounds in them."""
        if not self.by_word:
            found = self.tokenizer.encode_batch([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])], add_special_tokens=False)
            return np.concatenate([np.zeros(0, np.uint32), *(np.array(x.ids, np.uint32) for x in found)]), np.concatenate([[0], np.cumsum([len(x.ids) for x in found])]).astype(np.int64)
        if self.words > REMEMBERED:
            self._forget()
        cuts = None
        if b"<|" not in data.tobytes():
            data = _LOWER[data]
            cuts = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1 if len(data) > 1 else None
        words = hashing.Words(data, offsets, cuts)
        if not len(words.hashes):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        unique, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == unique[inside]
        if not known.all():
            self._learn(unique[~known], at[~known], [words.word(i).decode("utf-8", "replace") for i in first[~known].tolist()])
            at = np.searchsorted(self.hashes, unique)
        slot = self.slots[at][inverse]
        size = self.sizes[slot]
        end = np.cumsum(size)
        place = np.repeat(self.starts[slot] - (end - size), size) + np.arange(end[-1])
        return self.ids[place], np.concatenate([[0], end])[words.bounds]

    def _learn(self, hashes: np.ndarray, at: np.ndarray, words: list[str]) -> None:
        for lo in range(0, len(words), 2048):
            for ids in self._encode(words[lo : lo + 2048]):
                if self.used + len(ids) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
                if self.words == len(self.starts):
                    self.starts, self.sizes = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.starts, self.sizes))
                self.ids[self.used : self.used + len(ids)] = ids
                self.starts[self.words], self.sizes[self.words] = self.used, len(ids)
                self.used, self.words = self.used + len(ids), self.words + 1
        self.hashes = np.insert(self.hashes, at, hashes)
        self.slots = np.insert(self.slots, at, np.arange(self.words - len(words), self.words))

    def _encode(self, words: list[str]) -> list[np.ndarray]:
        """Many words in one call, parted by a rare word; one by one if its ids turn up elsewhere."""
        ids = np.array(self.tokenizer.encode(f" {_BETWEEN} ".join(words), add_special_tokens=False).ids, np.uint32)
        n = len(self.between)
        cut = np.flatnonzero(np.logical_and.reduce([ids[i : len(ids) - n + 1 + i] == self.between[i] for i in range(n)])) if len(ids) >= n else np.zeros(0, np.int64)
        if len(cut) != len(words) - 1:
            return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        return [ids[a:b] for a, b in zip([0, *(cut + n)], [*cut, len(ids)])]


_encoders: dict = {}


def _encoder(path: str, by_word: bool) -> WordEncoder:
    if (path, by_word) not in _encoders:
        _encoders[path, by_word] = WordEncoder(path, by_word)
    return _encoders[path, by_word]


def _tokenize(path: str, by_word: bool, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, given = _encoder(path, by_word), TaskContext.get().partitionId(), {}
        for batch in batches:
            for lo, hi, data, offsets in hashing.pieces(batch.column("t")):
                some = batch.slice(lo, hi - lo)
                ids, bounds = encoder.encode(data, offsets)
                sources, size = some.column("q").to_pylist(), np.diff(bounds) + 1
                ids = np.insert(ids, bounds[1:], end)
                starts = []
                for q, n in zip(sources, size.tolist()):
                    starts.append(given.get(q, 0))
                    given[q] = starts[-1] + n
                raw = ids.astype("<u2" if int(ids.max()) < 65536 else "<u4")
                edge = np.concatenate([[0], np.cumsum(size)]) * raw.itemsize
                held = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.record_batch({"rest": some.column("rest"), "q": some.column("q"), "part": pa.array(np.full(len(size), part), pa.int32()), "start": pa.array(starts, pa.int64()), "n": pa.array(size, pa.int64()), "ids": held})

    return run


class Turns:
    """The order of tokens in the queue that rare sources share.

    A source has its turn of ``least`` to twice as many tokens at equal distances, by its weight; what
    a turn has beyond whole tokens is its deficit and is carried to the next. Sources whose weights
    are within a factor of two are a tier; one of tier t has a turn in every 2**t-th round, and a
    tier's sources are dealt over these rounds. Within a tier those used up first come first, so the
    tokens that the first i have given by turn r are a closed form.
    """

    def __init__(self, totals: dict[str, int], weights: dict[str, int], least: int):
        self.top = max(weights[s] for s in totals)
        tiers: dict[int, list[tuple[int, str]]] = {}
        for s, n in totals.items():
            t = (self.top // weights[s]).bit_length() - 1
            tiers.setdefault(t, []).append((-(-n * self.top // (weights[s] * (least << (t + 1)))), s))
        self.at: dict[str, tuple[int, int]] = {}
        self.weights = {s: weights[s] for s in totals}
        self.tiers = []  # exponent, size of a turn at the top weight, last turns, sums of tokens, sums of weights
        for t, found in sorted(tiers.items()):
            found.sort()
            self.at.update((s, (len(self.tiers), i)) for i, (_, s) in enumerate(found))
            tokens = [0, *accumulate(totals[s] for _, s in found)]
            self.tiers.append((t, least << (t + 1), [x for x, _ in found], tokens, [0, *accumulate(weights[s] for _, s in found)]))

    def _upto(self, tier: int, i: int, r: int) -> int:
        """Tokens that the first i sources of a tier have given in their first r turns."""
        _, step, ends, tokens, weights = self.tiers[tier]
        e = bisect_right(ends, r)
        return tokens[i] if i <= e else tokens[e] + r * step * (weights[i] - weights[e]) // self.top

    def _before(self, tier: int, b: int) -> int:
        """Tokens that a tier has given before round b."""
        t, _, ends, _, _ = self.tiers[tier]
        r, part = divmod(b, 1 << t)
        i = len(ends) * part >> t
        return self._upto(tier, i, r + 1) + self._upto(tier, len(ends), r) - self._upto(tier, i, r)

    def runs(self, source: str, start: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(start, length, start in the shared queue) of the turns that hold tokens start to start+n of a source."""
        tier, i = self.at[source]
        t, step, ends, _, _ = self.tiers[tier]
        part = (((i + 1) << t) - 1) // len(ends)
        first = len(ends) * part >> t

        def given(r: int) -> int:
            return self._upto(tier, i + 1, r) - self._upto(tier, i, r)

        at, end = start, start + n
        r = start * self.top // (self.weights[source] * step)
        while r and given(r) > at:
            r -= 1
        begin, to = given(r), given(r + 1)
        while at < end:
            while to <= at:
                r += 1
                begin, to = to, given(r + 1)
            b = (r << t) + part
            place = sum(self._before(x, b + (x < tier)) for x in range(len(self.tiers)))
            place += self._upto(tier, i, r + 1) - self._upto(tier, i, r) - self._upto(tier, first, r + 1) + self._upto(tier, first, r)
            stop = min(end, to)
            yield at, stop - at, place + at - begin
            at = stop


class Tiers:
    """The order of tokens of any number of sources, all of which end together.

    Sources with totals within a factor of two are a tier, and have equally many turns, of ``least``
    to twice as many tokens (one turn if they have fewer). In a turn of the tier its sources follow each other; the
    first sources, of c tokens in all, have given floor(c * r / turns) in r turns, so what a turn has beyond
    whole tokens is carried to the next, and a source needs to know only the tokens before it in its
    tier. The tiers are dealt out in quanta of twice ``least`` tokens at equal distances, each its own.
    """

    def __init__(self, totals: dict[int, int], least: int):
        self.least, self.quantum, self.totals = least, 2 * least, dict(sorted(totals.items()))
        self.counts = {k: -(-n // self.quantum) for k, n in self.totals.items()}

    def _place(self, tier: int, j: int) -> int:
        """Where quantum j of a tier begins: all quanta are full but the last of each tier."""
        out, n = 0, self.counts[tier]
        for k, m in self.counts.items():
            ahead = (2 * j + 1) * m - n  # quantum i of k is earlier if (2 * i + 1) / m < (2 * j + 1) / n; of equal ones the lower tier's
            before = ahead // (2 * n) + 1 if k < tier else -(-ahead // (2 * n))
            out += min(max(0, before) * self.quantum, self.totals[k])
        return out

    def runs(self, tier: int, base: int, whole: int, start: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(start, length, place) of the runs that hold tokens start to start+n of a source of ``whole``, with ``base`` before it in its tier."""
        turns, total = max(1, (1 << tier) // self.least), self.totals[tier]
        given = lambda r: (base + whole) * r // turns - base * r // turns
        at, end = start, start + n
        r = max(0, start * turns // whole - 1)
        while given(r + 1) <= at:
            r += 1
        while at < end:
            begin, to = given(r), given(r + 1)
            stream = total * r // turns + base * (r + 1) // turns - base * r // turns - begin  # of the tier, at this source's token 0
            while at < min(to, end):
                j = (stream + at) // self.quantum
                stop = min(to, end, (j + 1) * self.quantum - stream)
                yield at, stop - at, self._place(tier, j) + stream + at - j * self.quantum
                at = stop
            r += 1


class Schedule:
    """After g tokens in all, ``upto(q, g)`` of them came from the first q queues.

    Sources are used up in the order of tokens by weight. With that order's sums of tokens and of
    weights, the tokens given by any queues after g in all are a closed form.
    """

    def __init__(self, totals: dict[str, int], weights: dict[str, float] | None, length: int, rest: dict[int, int] | None = None):
        """totals: of the sources with queues of their own or a weight. rest: tokens of all others, by tier."""
        others = sum((rest or {}).values())
        self.length, self.total = length, sum(totals.values()) + others
        left = {s: totals[s] for s in sorted(totals)} | ({"": others} if others and not weights else {})
        share = {s: Fraction(weights[s]) for s in left} if weights else {s: Fraction(n) for s, n in left.items()}
        whole = sum(share.values()) or Fraction(1)
        rate = {s: max(1, round(x / whole * WEIGHTS)) if weights else left[s] for s, x in share.items() if x}
        order = sorted(rate, key=lambda s: Fraction(left[s], rate[s]))
        least, twice = max(2, length // TURN), 2 * sum(rate.values())
        rare = {s: left[s] for s in sorted(rate) if s == "" or (weights and rate[s] * length < twice)}
        hot = [s for s in order if s not in rare]
        self.turns = Turns(rare, rate, least) if weights and rare else None
        self.tiers, self.shift = Tiers(rest or {}, least), sum(rare.values()) if weights else 0  # sources without a weight come last
        self.queue = {s: q for q, s in enumerate(hot, 1)}
        self.tokens, self.weights = ([0, *accumulate(x[s] for s in order)] for x in (left, rate))
        self.rare_tokens, self.rare_weights = ([0, *accumulate(x[s] if s in rare else 0 for s in order)] for x in (left, rate))
        self.hot_tokens, self.hot_weights = ([0, *accumulate(x[s] for s in hot)] for x in (left, rate))
        self.hot_ended = [0, *accumulate(int(s not in rare) for s in order)]
        # So many tokens have been given in all when a source is used up.
        self.ends = [self.tokens[i] - (-left[s] * (self.weights[-1] - self.weights[i]) // rate[s]) for i, s in enumerate(order)]

    def upto(self, q: int, g: int) -> int:
        if not q:
            return 0
        g = min(g, self.total)
        if g >= self.tokens[-1]:
            return self.rare_tokens[-1] + g - self.tokens[-1] + self.hot_tokens[q - 1]
        e = bisect_right(self.ends, g)
        h, weights = self.hot_ended[e], self.rare_weights[-1] - self.rare_weights[e]
        if q - 1 > h:
            weights += self.hot_weights[q - 1] - self.hot_weights[h]
        return self.rare_tokens[e] + self.hot_tokens[min(q - 1, h)] + (g - self.tokens[e]) * weights // (self.weights[-1] - self.weights[e])

    def given(self, q: int, w: int) -> int:
        """Tokens that queue q has given to the first w windows."""
        return self.upto(q + 1, w * self.length) - self.upto(q, w * self.length)

    def window(self, q: int, x: int) -> int:
        """The window with token x of queue q: the last one that begins at or before it."""
        lo, hi = 0, -(-self.total // self.length)
        guess = x * self.total // max(1, self.given(q, hi)) // self.length  # exact but for rounding if no source ends before others
        for near in (guess - 2, guess + 3):
            near = min(max(near, 0), hi)
            if self.given(q, near) <= x:
                lo = max(lo, near)
            else:
                hi = min(hi, near)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.given(q, mid) <= x else (lo, mid)
        return lo

    def pieces(self, source: str, start: int, n: int, tier: int | None = None, base: int = 0, whole: int = 0) -> Iterator[tuple[int, int, int, int]]:
        """(start in the document, length, window, offset in the window) for tokens start to start+n of a source.

        tier, base and whole are those of a source of the rest, see Tiers.
        """
        if tier is None and (q := self.queue.get(source, 0)):
            yield from self._pieces(q, 0, start, n)
            return
        runs = self.turns.runs(source, start, n) if tier is None else self.tiers.runs(tier, base, whole, start, n)
        for at, size, place in runs:
            yield from self._pieces(0, at - start, place + (0 if tier is None else self.shift), size)

    def _pieces(self, q: int, begins: int, start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """Pieces for tokens start to start+n of a queue, the first of which is at ``begins`` in its document."""
        at, end = start, start + n
        w = self.window(q, at)
        begin, to = self.given(q, w), self.given(q, w + 1)
        while at < end:
            while to <= at:
                w += 1
                begin, to = to, self.given(q, w + 1)
            stop = min(end, to)
            offset = self.upto(q, (w + 1) * self.length) - self.upto(q, w * self.length) + at - begin
            yield at - start + begins, stop - at, w, offset
            at = stop


def _cut(schedule: Schedule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                row, out = [], [[], [], [], [], [], []]
                columns = (some.column(c).to_pylist() for c in ("q", "at", "n", "tier", "base", "whole", "ids"))
                for i, (q, at, n, *rest, raw) in enumerate(zip(*columns)):
                    wide = np.frombuffer(raw, np.uint16).astype("<u4").tobytes() if len(raw) == 2 * n else raw
                    for start, length, w, offset in schedule.pieces(q, at, n, *rest):
                        row.append(i)
                        for column, value in zip(out, (start, length, zlib.crc32(wide[4 * start : 4 * (start + length)]), n, w, offset)):
                            column.append(value)
                arrays = [some.column("rest").take(pa.array(row, pa.int32())), *(pa.array(x, pa.int64()) for x in out)]
                yield pa.record_batch(arrays, names=["rest", *_PIECE])

    return run


_PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def source_name(column: Column) -> Column:
    """A queue's name; rows without a source have one of their own."""
    return F.when(column.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), column.cast("string")))


def _tiers(sources: DataFrame) -> DataFrame:
    """sources (q, whole) with tier and base, the tokens before a source in its tier: numbered in parts, these chained by their sums."""
    rows = sources.withColumn("tier", F.length(F.bin("whole")) - 1).withColumn("bucket", F.pmod(F.xxhash64("q"), F.lit(SOURCE_PARTS)).cast("int"))
    upto = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("tier", "bucket").agg(F.sum("whole").alias("sum"))  # 64 x SOURCE_PARTS rows at most
    sums = sums.select("tier", "bucket", F.coalesce(F.sum("sum").over(upto(["tier"], "bucket")), F.lit(0)).alias("first"))
    own = F.coalesce(F.sum("whole").over(upto(["tier", "bucket"], "q")), F.lit(0))
    return rows.withColumn("own", own).join(F.broadcast(sums), ["tier", "bucket"]).select("q", "whole", "tier", (F.col("first") + F.col("own")).alias("base"))


def pack(docs: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", source: str = "source", length: int = LENGTH, end: int = END, weights: dict[str, float] | None = None, by_word: bool = True) -> DataFrame:
    """Pack every token of docs into sequences of ``length``; a row for each piece of a document.

    Returns the columns ``keep`` of docs, then start, length, ids_crc32, doc_tokens, sequence_id and
    offset. Each document's ids end with ``end``; a null or empty text has that id alone. Documents
    are cut where a window's quantum ends. Repeated rows are packed as often as they occur; null
    sources are one queue, null ids are kept; an empty table gives no rows. Columns in ``keep`` that
    are named like a result column come out as ``input_<name>``. weights: by source, else the
    sources' shares of the tokens; sources without a weight come last. There may be any number of
    sources: those with a queue or a weight of their own are known to every task, at most half a
    window's length or as many as there are weights; what is known of others stays in a table.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    base = docs.select(packed(docs, list(keep)), source_name(column(source)).alias("q"), column(text).cast("string").alias("t"))
    kept = base.schema["rest"]
    told = T.StructType([kept, T.StructField("q", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
    tokens = saved(base.mapInArrow(_tokenize(tokenizer, by_word, end), told), "tokens")
    # Where each task's part of a queue begins: a row for each task and source, not for each document.
    parts = tokens.groupBy("q", "part").agg(F.sum("n").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("q").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = saved(parts.select("q", "part", "sum", before.alias("before")), "parts")
    sources = parts.groupBy("q").agg(F.sum("sum").alias("whole"))
    total = sources.agg(F.sum("whole")).first()[0] or 0
    out = T.StructType([kept, *(T.StructField(c, T.LongType()) for c in _PIECE)])
    named = [F.col("rest").getField(c).alias(f"input_{c}" if c in _PIECE else c) for c in keep]
    if not total:
        return spark.createDataFrame([], out).select(*named, *_PIECE)
    wanted = None if weights is None else {f"={k}": v for k, v in weights.items() if v > 0}
    if wanted:
        own = sources.join(spark.createDataFrame([(k,) for k in wanted], "q string"), "q")
    else:  # two tokens a window, so at most half a window's length of them
        own = sources.where(F.col("whole") * F.lit(length) >= F.lit(2 * total))
    totals = {r["q"]: r["whole"] for r in own.collect()}
    rest = saved(_tiers(sources.join(own.select("q"), "q", "left_anti")), "sources")
    tiers = {r["tier"]: r["sum"] for r in rest.groupBy("tier").agg(F.sum("whole").alias("sum")).collect()}  # 64 rows at most
    schedule = Schedule(totals, wanted and {k: wanted[k] for k in totals}, length, tiers)
    places = parts.select("q", "part", "before").join(rest, "q", "left")
    rows = tokens.join(places, ["q", "part"]).select("rest", "q", (F.col("before") + F.col("start")).alias("at"), "n", "tier", "base", "whole", "ids")
    return rows.mapInArrow(_cut(schedule), out).select(*named, *_PIECE)
