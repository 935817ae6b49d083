"""Substring deduplication: a relative Lempel-Ziv parse of every text against an index of the corpus.

The reference that texts are parsed against is the corpus itself. It is too large for one index, so
it is dealt into blocks by content: every window of ``window`` words has an anchor, the smallest
hash among its runs of ``anchor`` words, and a block holds windows of one anchor. A window can only
be found under its anchor, so each text is matched against every block that could hold one of its
windows, without meeting the others.

1. Anchors of each text, once a text; those of two or more texts are *repeated*. Nothing else can match.
2. Each text sends the windows under its repeated anchors to blocks, as runs (segments). An anchor's
   texts are dealt over as many blocks as it takes for about ``group`` texts each.
3. A block sorts its windows and so finds, for each, an equal window elsewhere: the source, that in
   the text with the smallest key (for that one, the next). Runs of
   windows whose sources are as consecutive as they are lie on one diagonal.
4. Of an anchor with several blocks, each block hands on every different window once. Equal ones of
   different blocks are found by a count over the window, to which a block adds one row at most.
5. A text is factored greedily: at the first window that no factor covers yet, the diagonal that goes
   on longest is the next factor. Windows that cross a factor's end were looked up like all others,
   so a passage put together from two sources is also found. Windows found twice in a text have that
   text as their source. The words of the factors are the duplicate spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import hashing
from ledgerloom.llm.common import KEY, bound_batches, column, forget, keyed, packed, saved

WINDOW, ANCHOR = 35, 10
#: About so many texts of one anchor meet in a block; it bounds a task's memory, not the result.
GROUP = 500
_SEGMENT = "a long, g int, several boolean, k long, s int, ws binary"
#: Rows with w hand on a window (sure: its block has it twice); the others are runs of n matched windows.
_FOUND = "k long, s int, n int, source long, source_at int, a long, w long, sure boolean"


def _anchors(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window, the index of its anchor; and the hash at each index."""
    g = hashing.grams(hashes, anchor)
    return hashing.sliding_min(g, window - anchor + 1), g


def _emit_anchors(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("k").to_numpy(zero_copy_only=False)
            for lo, hi, words in hashing.runs(batch.column("t")):
                a, k = [], []
                for d in range(hi - lo):
                    h = words.hashes[words.bounds[d] : words.bounds[d + 1]]
                    if len(h) >= window:
                        at, g = _anchors(h, window, anchor)
                        a.append(np.unique(g[at]))
                        k.append(np.full(len(a[-1]), keys[lo + d]))
                if a:
                    yield pa.record_batch({"a": np.concatenate(a).view(np.int64), "k": np.concatenate(k)})

    return run


def _emit_segments(window: int, anchor: int):
    """Runs of windows under one repeated anchor; a window already seen in its text isn't sent again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, wanted = batch.column("k").to_numpy(zero_copy_only=False), batch.column("anchors")
            bound, held, blocks = wanted.offsets.to_numpy(), wanted.values.field("a").to_numpy(), wanted.values.field("blocks").to_numpy()
            for lo, hi, words in hashing.runs(batch.column("t")):
                rows: list[list] = [[], [], [], [], [], []]
                for d in range(hi - lo):
                    h = words.hashes[words.bounds[d] : words.bounds[d + 1]]
                    if len(h) < window:
                        continue
                    own, of = held[bound[lo + d] : bound[lo + d + 1]], blocks[bound[lo + d] : bound[lo + d + 1]]
                    order = np.argsort(own)
                    own, of = own[order], of[order]
                    at, g = _anchors(h, window, anchor)
                    w = hashing.grams(h, window, 1)
                    first = np.zeros(len(w), bool)
                    first[np.unique(w, return_index=True)[1]] = True
                    mine = g.view(np.int64)[at]
                    place = np.minimum(np.searchsorted(own, mine), len(own) - 1)
                    sent = np.flatnonzero(first & (own[place] == mine))
                    if not len(sent):
                        continue
                    cut = np.flatnonzero((np.diff(sent) != 1) | (np.diff(at[sent]) != 0)) + 1
                    begins, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(sent)]])
                    raw, lead = w[sent].tobytes(), sent[begins]
                    number = of[place[lead]]
                    block = hashing.mix(np.full(1, keys[lo + d], np.int64).view(np.uint64)) % number.astype(np.uint64)
                    rows[0].append(mine[lead])
                    rows[1].append(block.astype(np.int32))
                    rows[2].append(number > 1)
                    rows[3].append(np.full(len(begins), keys[lo + d]))
                    rows[4].append(lead.astype(np.int32))
                    rows[5].extend(raw[8 * b : 8 * e] for b, e in zip(begins.tolist(), ends.tolist()))
                if rows[0]:
                    yield pa.record_batch([*(pa.array(np.concatenate(x)) for x in rows[:5]), pa.array(rows[5], pa.binary())], names=["a", "g", "several", "k", "s", "ws"])

    return run


def _match(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Match the segments of whole blocks against each other."""
    a, g, several, k, s = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in ("a", "g", "several", "k", "s"))
    ws = [x for p in parts for x in p.column("ws").to_pylist()]
    length = np.fromiter(map(len, ws), np.int64, len(ws)) // 8
    w = np.frombuffer(b"".join(ws), np.uint64)
    if not len(w):
        return
    row = np.repeat(np.arange(len(ws)), length)
    inside = np.arange(len(w)) - (np.cumsum(length) - length)[row]
    block = np.cumsum(np.concatenate([[False], (a[1:] != a[:-1]) | (g[1:] != g[:-1])]))[row]  # rows come sorted by block
    order = np.lexsort((w, block))
    same = (w[order][1:] == w[order][:-1]) & (block[order][1:] == block[order][:-1])
    with_left, with_right = np.concatenate([[False], same]), np.concatenate([same, [False]])
    at = (s[row] + inside).astype(np.int32)
    if len(hits := np.flatnonzero(with_left | with_right)):
        lead = np.maximum.accumulate(np.where(~with_left, np.arange(len(w)), 0))  # the first of each run of equal windows
        source = np.full(len(w), -1, np.int64)
        source[order[hits]] = np.where(with_left, order[lead], np.concatenate([order[1:], order[-1:]]))[hits]
        hit = np.sort(order[hits])
        to = source[hit]
        goes_on = (np.diff(hit) == 1) & (row[hit[1:]] == row[hit[:-1]]) & (np.diff(to) == 1) & (row[to[1:]] == row[to[:-1]])
        begin = np.concatenate([[0], np.flatnonzero(~goes_on) + 1])
        size = np.diff(np.concatenate([begin, [len(hit)]]))
        x, y = hit[begin], to[begin]
        yield _rows(k[row[x]], at[x], size, k[row[y]], at[y])
    if len(on := order[np.flatnonzero(~with_left & several[row[order]])]):
        twice = np.zeros(len(w), bool)
        twice[order] = with_right
        yield _rows(k[row[on]], at[on], np.ones(len(on)), None, None, a[row[on]], w[on].view(np.int64), twice[on])


def _rows(k, s, n, source, source_at, a=None, w=None, sure=None) -> pa.RecordBatch:
    kinds = {"k": pa.int64(), "s": pa.int32(), "n": pa.int32(), "source": pa.int64(), "source_at": pa.int32(), "a": pa.int64(), "w": pa.int64(), "sure": pa.bool_()}
    given = (k, s, np.asarray(n).astype(np.int32), source, source_at, a, w, sure)
    return pa.record_batch([pa.nulls(len(k), t) if x is None else pa.array(x, t) for x, t in zip(given, kinds.values())], names=list(kinds))


def _match_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; those of the last block are held, as they came, until another begins."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        a, g = batch.column("a").to_numpy(), batch.column("g").to_numpy()
        cut = int(np.flatnonzero((a != a[-1]) | (g != g[-1]))[-1]) + 1 if ((a != a[-1]) | (g != g[-1])).any() else 0
        if held and (cut or held[-1].column("a")[0].as_py() != a[0] or held[-1].column("g")[0].as_py() != g[0]):
            yield from _match([*held, batch.slice(0, cut)] if cut else held)
            held = []
        elif cut:
            yield from _match([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield from _match(held)


def _parse(window: int, layout: str):
    """Factors, spans and the kept text of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = batch.column("k").to_numpy(zero_copy_only=False), batch.column("found")
            known = np.asarray(found.is_valid())
            bound, run = found.offsets.to_numpy(), [found.values.field(c).to_numpy(zero_copy_only=False) for c in ("s", "n", "source", "source_at")]
            for lo, hi, words in hashing.runs(batch.column("t")):
                out: list[list] = [[], [], [], [], []]
                for d in range(hi - lo):
                    b0, b1 = words.bounds[d], words.bounds[d + 1]
                    n = int(b1 - b0)
                    factors = []
                    if n > window:
                        own = _within(hashing.grams(words.hashes[b0:b1], window, 1), int(keys[lo + d]))
                        if known[lo + d]:
                            own += zip(*(x[bound[lo + d] : bound[lo + d + 1]].tolist() for x in run))
                        factors = _factors(own)
                    elif n == window and known[lo + d]:
                        factors = _factors(list(zip(*(x[bound[lo + d] : bound[lo + d + 1]].tolist() for x in run))))
                    cover = np.zeros(n + 1, np.int64)
                    for x in factors:
                        cover[x["start"]] += 1
                        cover[x["start"] + x["windows"] + window - 1] -= 1
                    gone = np.cumsum(cover)[:n] > 0
                    out[0].append(n)
                    out[1].append(int(gone.sum()))
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
                    out[2].append([{"start": int(x), "length": int(y - x)} for x, y in zip(edge[::2], edge[1::2])])
                    out[3].append(factors)
                    out[4].append(_kept(words, d, gone, edge, layout))
                dedup = pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip(out, _KINDS)], names=DEDUP.names)
                yield pa.record_batch([batch.column("rest").slice(lo, hi - lo), batch.column("t").slice(lo, hi - lo), dedup], names=["rest", "t", "dedup"])

    return run


def _within(w: np.ndarray, key: int) -> list[tuple[int, int, int, int]]:
    """Runs (start, windows, source, its start) of windows that a text has twice, by the first other place."""
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    if not same.any():
        return []
    with_left, with_right = np.concatenate([[False], same]), np.concatenate([same, [False]])
    lead = np.maximum.accumulate(np.where(~with_left, np.arange(len(w)), 0))
    to = np.full(len(w), -1, np.int64)
    to[order] = np.where(with_left, order[lead], np.where(with_right, np.concatenate([order[1:], order[-1:]]), -1))
    hit = np.flatnonzero(to >= 0)
    begin = np.concatenate([[0], np.flatnonzero((np.diff(hit) != 1) | (np.diff(to[hit]) != 1)) + 1])
    size = np.diff(np.concatenate([begin, [len(hit)]]))
    return [(int(x), int(n), key, int(y)) for x, n, y in zip(hit[begin], size, to[hit[begin]])]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
_FACTORS = pa.list_(pa.struct([("start", pa.int32()), ("windows", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())]))
_KINDS = (pa.int64(), pa.int64(), _SPANS, _FACTORS, pa.string())
DEDUP = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())]))),
    T.StructField("factors", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("windows", T.IntegerType()), T.StructField("source", T.LongType()), T.StructField("source_start", T.IntegerType())]))),
    T.StructField("kept_text", T.StringType()),
])


def _factors(runs: list[tuple[int, int, int, int]]) -> list[dict]:
    """The greedy parse: runs on the same diagonal of one source are joined, then the longest way on is taken each time."""
    joined: list[list[int]] = []
    last: dict[tuple[int, int], list[int]] = {}
    for s, n, source, at in sorted(set(runs)):
        before = last.get((source, at - s))
        if before is not None and before[1] >= s:
            before[1] = max(before[1], s + n)
        else:
            last[source, at - s] = x = [s, s + n, source, at]
            joined.append(x)
    out, end, i = [], 0, 0
    while i < len(joined):
        start, best = max(end, joined[i][0]), None
        while i < len(joined) and joined[i][0] <= start:
            if best is None or joined[i][1] > best[1]:
                best = joined[i]
            i += 1
        if best[1] > start:
            out.append({"start": start, "windows": best[1] - start, "source": best[2], "source_start": best[3] + start - best[0]})
            end = best[1]
    return out


def _kept(words: hashing.Words, d: int, gone: np.ndarray, edge: np.ndarray, layout: str) -> str:
    b0 = int(words.bounds[d])
    lo, hi = int(words.offsets[d]), int(words.offsets[d + 1])
    if layout == "words":
        raw = words.data[lo:hi].tobytes().split()
        return b" ".join([w for w, g in zip(raw, gone.tolist()) if not g] if len(edge) else raw).decode("utf-8", "replace")
    if not len(edge):
        return words.data[lo:hi].tobytes().decode("utf-8", "replace")
    parts, at, starts = [], lo, words.starts
    for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
        parts.append(words.data[at : int(starts[b0 + x])].tobytes())
        at = int(starts[b0 + y]) if b0 + y < int(words.bounds[d + 1]) else hi
    return b"".join([*parts, words.data[at:hi].tobytes()]).decode("utf-8", "replace")


def substring_dedup(docs: DataFrame, text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, layout: str = "words", group: int = GROUP) -> DataFrame:
    """Remove every word under a window of ``window`` words that also starts anywhere else.

    Returns the columns of docs with a struct ``dedup`` added: n_words, n_removed, spans (of removed
    words), factors (start and length in windows, the source row's key and start), kept_text. layout
    "words" joins the kept words by one space, "original" keeps the white space between them.

    Windows are judged on the input: all places of a repeated window go, the first too. A null text
    has no words and gives an empty kept_text; texts shorter than a window are never touched;
    repeated rows are each other's duplicates; an empty table gives an empty result. Columns of docs
    may have any names but ``dedup``, which is replaced. Row keys are those of ``common.keyed``.
    """
    if not 0 < anchor <= window:
        raise ValueError("an anchor lies within a window")
    bound_batches(docs.sparkSession)
    cols = [c for c in docs.columns if c != "dedup"]
    base = keyed(docs, KEY)
    base = base.select(F.col(KEY).alias("k"), column(text).cast("string").alias("t"), packed(docs, [c for c in cols if c != text]))
    anchors = saved(base.select("k", "t").mapInArrow(_emit_anchors(window, anchor), "a long, k long"), "anchors")
    repeated = saved(anchors.groupBy("a").count().where("count > 1").select("a", F.ceil(F.col("count") / group).cast("int").alias("blocks")), "repeated")
    wanted = saved(anchors.join(repeated, "a").groupBy("k").agg(F.collect_list(F.struct("a", "blocks")).alias("anchors")), "wanted")
    forget(anchors, repeated)
    segments = base.select("k", "t").join(wanted.hint("merge"), "k").mapInArrow(_emit_segments(window, anchor), _SEGMENT)
    # In one query with the parse below, so that both read one shuffle of the texts; the hints keep that so at any size.
    met = segments.repartition("a", "g").sortWithinPartitions("a", "g", "k", "s").mapInArrow(_match_block, _FOUND)
    found = _across(met).groupBy("k").agg(F.collect_list(F.struct("s", "n", "source", "source_at")).alias("found"))
    out = T.StructType([base.schema["rest"], T.StructField("t", T.StringType()), T.StructField("dedup", DEDUP)])
    parsed = base.join(found.hint("merge"), "k", "left").mapInArrow(_parse(window, layout), out)
    return parsed.select(*((F.col("t") if c == text else F.col("rest").getField(c)).alias(c) for c in cols), "dedup")


def _across(met: DataFrame) -> DataFrame:
    """Runs as they are, and those windows handed on that another block has too.

    Runs pass through the same window function, each as its own group, so that ``met`` is made once.
    """
    handed = F.col("w").isNotNull()
    same = Window.partitionBy(handed, F.when(handed, F.col("a")).otherwise(F.col("k")), F.when(handed, F.col("w")).otherwise(F.col("s")))
    place = F.struct("k", "s")
    rows = met.select("*", F.count("*").over(same).alias("times"), F.min(place).over(same).alias("low"), F.max(place).over(same).alias("high"))
    other = F.when(F.col("low") == place, F.col("high")).otherwise(F.col("low"))
    runs = rows.where(~handed | ((F.col("times") > 1) & ~F.col("sure")))
    return runs.select("k", "s", "n", F.when(handed, other["k"]).otherwise(F.col("source")).alias("source"), F.when(handed, other["s"]).otherwise(F.col("source_at")).alias("source_at"))
