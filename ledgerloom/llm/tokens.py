"""Token counts of sections: whole texts are encoded once, and tokens are attributed by their offsets.

A byte-level vocabulary loses nothing, so the lengths of the ids' byte strings add up to each
token's span. Tokens are interval-joined to sections by binary search of the span's ends in the
sections' bounds. A token that crosses a bound is allocated by a rule:

first     to the section of its first byte
last      to the section of its last byte
majority  to the section with most of its bytes, of equal ones the first
split     to each section by its share of the bytes
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import hashing
from ledgerloom.llm.common import bound_batches, column

RULES = ("first", "last", "majority", "split")
_encoders: dict = {}


def encoder(path: str, pattern: str):
    """A tiktoken encoding from a file of ranks, and the byte length of each id."""
    if (path, pattern) not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for raw, rank in ranks.items():
            size[rank] = len(raw)
        _encoders[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size
    return _encoders[path, pattern]


def attribute(ends: np.ndarray, starts_at: np.ndarray, stops_at: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens and crossing tokens of each section, and what no section has.

    ends: of the tokens' byte spans, in order. Sections are sorted and disjoint, in bytes, and may
    leave gaps; a token, or a part of one under "split", in a gap belongs to no section.
    """
    n = len(starts_at)
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    # Gaps are sections too: section 2i+1 is the i-th, even ones lie between.
    bounds = np.stack([starts_at, stops_at], axis=1).ravel()
    lo, hi = np.searchsorted(bounds, begins, "right"), np.searchsorted(bounds, ends - 1, "right")
    crossing = np.zeros(2 * n + 1)
    where = np.flatnonzero(lo != hi)
    counts = np.bincount(hi if rule == "last" else lo, minlength=2 * n + 1).astype(np.float64)
    edges = np.concatenate([[-1], bounds, [np.iinfo(np.int64).max]])
    for t in where.tolist():
        parts = np.arange(lo[t], hi[t] + 1)
        share = np.minimum(edges[parts + 1], ends[t]) - np.maximum(edges[parts], begins[t])
        parts, share = parts[share > 0], share[share > 0]
        if len(parts) < 2:
            continue
        crossing[parts] += 1
        if rule == "majority":
            counts[lo[t]] -= 1
            counts[parts[np.argmax(share)]] += 1
        elif rule == "split":
            counts[lo[t]] -= 1
            counts[parts] += share / share.sum()
    return counts[1::2], crossing[1::2].astype(np.int64), float(counts[::2].sum())


def _lines(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(data == 10) + 1
    if len(cut) and cut[-1] == len(data):
        cut = cut[:-1]
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(data)]])


_SECTION = pa.list_(pa.struct([("section", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("tokens", pa.float64()), ("crossing", pa.int64())]))


def _count(path: str, pattern: str, rule: str, given: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coding, size = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                out, total, rest = [], [], []
                data, offsets = hashing.text_buffers(some.column("t"))
                sections = some.column("sections").to_pylist() if given else None
                for d in range(some.num_rows):
                    own = data[offsets[d] : offsets[d + 1]]
                    text = own.tobytes().decode("utf-8", "replace")
                    ids = np.asarray(coding.encode_ordinary(text), np.int64)
                    ends = np.cumsum(size[ids])
                    point = np.concatenate([np.flatnonzero((own & 0xC0) != 0x80), [len(own)]])  # byte offset of each code point
                    if given:
                        want = sorted((min(x["start"], len(point) - 1), min(x["stop"], len(point) - 1)) for x in sections[d] or ())
                        a, b = (np.array([x[i] for x in want], np.int64) for i in (0, 1))
                        if len(a) and ((a > b).any() or (a[1:] < b[:-1]).any() or a[0] < 0):
                            raise ValueError("sections overlap or end before they start")
                        first, last = point[a], point[b]
                    else:
                        first, last = _lines(own)
                        a, b = np.searchsorted(point, first), np.searchsorted(point, last)
                    tokens, crossing, left = attribute(ends, first, last, rule)
                    out.append([dict(zip(("section", "start", "stop", "tokens", "crossing"), x)) for x in zip(range(len(a)), a.tolist(), b.tolist(), tokens.tolist(), crossing.tolist())])
                    total.append(len(ids))
                    rest.append(left)
                counts = pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(rest, pa.float64()), pa.array(out, _SECTION)], names=["total", "outside", "sections"])
                yield pa.record_batch([some.column("rest"), some.column("t"), counts], names=["rest", "t", "tokens"])

    return run


def token_counts(docs: DataFrame, path: str, pattern: str, text: str = "text", sections: Column | None = None, rule: str = "first") -> DataFrame:
    """docs with a struct ``tokens`` added: total, outside, and sections (section, start, stop, tokens, crossing).

    sections: array of struct<start, stop> in code points, disjoint; the default is the lines, each
    with its line end. total is the sum over the sections and outside, whatever the rule. A null or
    empty text has no tokens and, by default, one empty section. Repeated rows get equal results; an
    empty table gives no rows; a column named tokens is replaced.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    bound_batches(docs.sparkSession)
    cols = [c for c in docs.columns if c != "tokens"]
    more = [] if sections is None else [sections.alias("sections")]
    base = docs.select(column(text).cast("string").alias("t"), F.struct(F.lit(1).alias("__one"), *(column(c) for c in cols if c != text)).alias("rest"), *more)
    counts = T.StructType([T.StructField("total", T.LongType()), T.StructField("outside", T.DoubleType()), T.StructField("sections", T.ArrayType(T.StructType([T.StructField("section", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("tokens", T.DoubleType()), T.StructField("crossing", T.LongType())])))])
    found = base.mapInArrow(_count(path, pattern, rule, sections is not None), T.StructType([base.schema["rest"], T.StructField("t", T.StringType()), T.StructField("tokens", counts)]))
    return found.select(*((F.col("t") if c == text else F.col("rest").getField(c)).alias(c) for c in cols), "tokens")
