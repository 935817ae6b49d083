"""Near-duplicates by DartMinHash signatures in bands, with every candidate link checked exactly.

A document is a weighted set of word shingles. Each shingle is a strip as wide as its weight on
which darts fall at random places and times, the same ones in every document that has the shingle.
A dart is thrown by hashing, region by region: a region is a unit of a strip's width times a span
of time, and spans double in length. A document keeps the darts that land inside its strips up to a
time chosen so that about k ln k of them do; of those that fall to the same of k coordinates the
earliest is the signature's entry. Two documents agree on a coordinate with a probability of their
weighted Jaccard similarity, and one with few shingles costs no more darts than one with many.

From signatures to classes:
1. Texts with the same shingles are one node (a digest of the set), so copies cost one row.
2. Bands of rows of the signature are bucket keys; keys of one node alone are dropped.
3. Each bucket has a hub, the member that meets most others in all its buckets. Every other member
   is compared with it exactly, on shingles, so a bucket of copies of one text takes a comparison a
   member, not one a pair. Members of one component need no further comparison. Those of different
   components are compared unless a bound rules a link out: a set that has too few shingles in
   common with all open members together is set aside, and two sets can have no more in common than
   the smaller of what each has in common with their hub, class by class of shingles, and of what
   each has in common with others beside. These bounds are exact, so no link within a bucket is lost.
4. Classes are the components of the links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import hashing
from ledgerloom.llm.common import KEY, bound_batches, column, forget, keyed, list_column, saved
from ledgerloom.llm.components import connected_components

SHINGLE, SIMILARITY = 5, 0.8
#: 24 bands of 5 rows: two documents of similarity 0.8 share no band with a probability of 7e-5.
BANDS, ROWS = 24, 5
_FIRST_SPAN = 1 / 16
_FANOUT = 64
#: Shingles are told apart by so many classes when two sets are bounded by what they share with a hub.
_CLASSES = 64


def shingle_sets(words: hashing.Words, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles of each text and how often each occurs; a shorter text is one shingle."""
    whole, out = hashing.grams(words.hashes, size), []
    for b0, b1 in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if b1 - b0 >= size:
            out.append(np.unique(whole[b0 : b1 - size + 1], return_counts=True))
        elif b1 > b0:
            out.append((hashing.grams(words.hashes[b0:b1], b1 - b0), np.ones(1, np.int64)))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return out


@lru_cache(maxsize=64)
def _poisson(mean: float) -> np.ndarray:
    """Distribution function of the number of darts in a region."""
    n = int(mean + 12 * math.sqrt(mean) + 24)
    p = np.exp(np.arange(n) * math.log(mean) - mean - np.array([math.lgamma(i + 1) for i in range(n)]))
    return np.cumsum(p)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _darts(strips: np.ndarray, width: np.ndarray, until: np.ndarray, owner: np.ndarray):
    """(owner, dart, time) of the darts on unit strips, up to each strip's time and inside its width."""
    found, begin, span, region = [], 0.0, _FIRST_SPAN, 0
    live = np.arange(len(strips))
    while len(live):
        seed = hashing.mix(strips[live] + np.uint64((0x9E3779B97F4A7C15 * (region + 1)) & hashing.MASK))
        number = np.searchsorted(_poisson(span), _unit(seed), "right")
        which = np.repeat(live, number)
        place = np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number)
        dart = hashing.mix(np.repeat(seed, number) + (place + 1).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
        time = begin + span * _unit(hashing.mix(dart ^ np.uint64(0x94D049BB133111EB)))
        inside = (time < until[which]) & (_unit(hashing.mix(dart ^ np.uint64(0xD6E8FEB86659FD93))) < width[which])
        found.append((owner[which[inside]], dart[inside], time[inside]))
        begin, span, region = begin + span, span * 2, region + 1
        live = live[until[live] > begin]
    return tuple(np.concatenate(x) for x in zip(*found))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """Signatures of weighted sets (elements, weights), a row of k entries each; empty sets give zeros."""
    out = np.zeros((len(sets), k), np.uint64)
    todo, more = [i for i, (e, _) in enumerate(sets) if len(e)], 1.0
    while todo:
        strips, width, owner, total = [], [], [], np.zeros(len(sets))
        for i in todo:
            e, w = sets[i]
            w = np.asarray(w, np.float64)
            total[i] = w.sum()
            if (w == 1).all():
                strips.append(e)
                width.append(w)
            else:  # a strip for each unit of weight, the last one narrower
                units = np.ceil(w).astype(np.int64)
                unit = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
                strips.append(np.repeat(e, units) + unit.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
                width.append(np.minimum(1.0, np.repeat(w, units) - unit))
            owner.append(np.full(len(strips[-1]), i))
        strips, width, owner = np.concatenate(strips), np.concatenate(width), np.concatenate(owner)
        until = more * (k * math.log(k) + 3 * k) / total[owner]
        own, dart, time = _darts(strips, width, until, owner)
        slot = own * k + (hashing.mix(dart ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((dart, time, slot))
        slot = slot[order]
        first = np.concatenate([[True], slot[1:] != slot[:-1]])
        row, column = np.divmod(slot[first], k)
        out[row, column] = dart[order][first]
        full = np.bincount(row, minlength=len(sets)) == k
        todo, more = [i for i in todo if not full[i]], more * 2  # some coordinate met no dart: wait twice as long
    return out


def _sign(size: int, weighted: bool, bands: int, rows: int):
    salt = hashing.mix(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in hashing.runs(batch.column("t")):
                sets = shingle_sets(words, size)
                digest = [hashlib.blake2b(e.tobytes() + (c.tobytes() if weighted else b""), digest_size=16).digest() if len(e) else None for e, c in sets]
                found = signatures(sets if weighted else [(e, np.ones(len(e))) for e, _ in sets], bands * rows).reshape(len(sets), bands, rows)
                band = np.zeros((len(sets), bands), np.uint64)
                for r in range(rows):
                    band = hashing.mix(band + found[:, :, r])
                band = hashing.mix(band + salt)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(band.view(np.int64).ravel()))
                yield pa.record_batch({"k": batch.column("k").slice(lo, hi - lo), "digest": pa.array(digest, pa.binary()), "bands": keys})

    return run


def _shingles(size: int, weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in hashing.runs(batch.column("t")):
                sets = shingle_sets(words, size)
                yield pa.record_batch({"k": batch.column("k").slice(lo, hi - lo), "e": pa.array([e.tobytes() for e, _ in sets], pa.binary()), "c": pa.array([c.astype(np.int32).tobytes() if weighted else b"" for _, c in sets], pa.binary()), "n": pa.array([int(c.sum()) if weighted else len(e) for e, c in sets], pa.int64())})

    return run


def _each_shingle(weighted: bool):
    """A row for each shingle, by 32 bits of its hash: two that share them only seem to be common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                k, e, c = (batch.column(x)[lo : lo + 512].to_pylist() for x in ("k", "e", "c"))
                x = (np.frombuffer(b"".join(e), np.uint64) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                w = np.frombuffer(b"".join(c), np.int32) if weighted else np.ones(len(x), np.int32)
                yield pa.record_batch({"k": np.repeat(np.array(k, np.int64), [len(y) // 8 for y in e]), "x": x, "w": w})

    return run


def _compare(weighted: bool):
    """Exact similarity of each row's two sets, which are sorted, and what they have in common by class of shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some, out, profiles = batch.slice(lo, 512), [], []
                for e1, c1, e2, c2 in zip(*(some.column(c) for c in ("e1", "c1", "e2", "c2"))):
                    x, y = (np.frombuffer(e.as_buffer(), np.uint64) for e in (e1, e2))
                    at = np.searchsorted(y, x)
                    at[at == len(y)] = 0
                    both = y[at] == x
                    shared = (x[both] % np.uint64(_CLASSES)).astype(np.int64)
                    if weighted:
                        m, n = (np.frombuffer(c.as_buffer(), np.int32) for c in (c1, c2))
                        weight = np.minimum(m[both], n[at[both]])
                        profile, total = np.bincount(shared, weight, _CLASSES), int(m.sum()) + int(n.sum())
                    else:
                        profile, total = np.bincount(shared, minlength=_CLASSES), len(x) + len(y)
                    common = int(profile.sum())
                    out.append(common / (total - common))
                    profiles.append(profile.astype(np.int32))
                yield pa.record_batch({"u": some.column("u"), "v": some.column("v"), "similarity": pa.array(out, pa.float64()), "profile": list_column(np.concatenate(profiles), np.arange(len(out) + 1) * _CLASSES, pa.int32())})

    return run


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, weighted: bool = False, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, row_key, class_id, class_size, representative): a row for each row of docs.

    Two texts are linked if the Jaccard similarity of their shingle sets is ``similarity`` or more
    (weighted: of the multisets, each shingle weighing as often as it occurs). class_id is the
    smallest id in the class, representative marks one row of each class. Texts of fewer than
    ``shingle`` words are one shingle. Null texts and texts without a word are alone in their class
    (class_id is their own id). Repeated rows are in one class, of which one row is the
    representative. Null ids sort last. An empty table gives no rows. row_key is that of
    ``common.keyed``; columns other than id and text aren't read.
    """
    return _classes(keyed(docs.select(column(id).alias(id), column(text).alias(text)), KEY), id, text, similarity, shingle, weighted, bands, rows)


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, weighted: bool = False, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of docs that represent their class: of each class that with the smallest id, of equal ids the first row.

    Nulls, repeated rows and short texts are as in near_duplicates(). All columns are kept.
    """
    own = keyed(docs, KEY)
    found = _classes(own.select(KEY, column(id), column(text)), id, text, similarity, shingle, weighted, bands, rows)
    gone = saved(found.where(~F.col("representative")).select(F.col("row_key").alias(KEY)), "gone")
    return own.join(gone, KEY, "left_anti").select(*(column(c) for c in docs.columns))


def _classes(docs: DataFrame, id: str, text: str, similarity: float, shingle: int, weighted: bool, bands: int, rows: int) -> DataFrame:
    bound_batches(docs.sparkSession)
    base = docs.select(F.col(KEY).alias("k"), column(id).alias("i"), column(text).cast("string").alias("t"))
    signed = saved(base.select("k", "t").mapInArrow(_sign(shingle, weighted, bands, rows), "k long, digest binary, bands array<long>"), "signatures")
    # Copies: one node each, named by the smallest row key of its set.
    nodes = saved(signed.where("digest is not null").groupBy("digest").agg(F.min("k").alias("node"), F.min_by("bands", "k").alias("bands")), "nodes")
    member = nodes.select("node", F.explode("bands").alias("band"))
    shared = saved(member.groupBy("band").count().where("count > 1"), "shared")
    member = saved(member.join(shared.hint("merge"), "band"), "members")
    reach = member.groupBy("node").agg(F.sum("count").alias("reach"))
    met = saved(reach.select("node"), "met")
    sets = saved(base.join(met, base.k == met.node, "left_semi").select("k", "t").mapInArrow(_shingles(shingle, weighted), "k long, e binary, c binary, n long"), "shingles")
    reached = saved(member.join(reach, "node").select("node", "band", "reach"), "reached")
    forget(shared, member, met)
    component, used = connected_components(_links(reached, sets, similarity, weighted), "u", "v")
    group = nodes.select("digest", "node").join(component, "node", "left")
    group = saved(group.select("digest", F.coalesce("component", "node").alias("component")), "groups")
    forget(nodes, sets, *used)
    row = base.select("k", "i").join(signed.select("k", "digest"), "k").join(group, "digest", "left").select("k", "i", F.coalesce("component", "k").alias("component"))
    row = saved(row, "rows")
    forget(signed, group)
    classes = row.groupBy("component").agg(F.min("i").alias("class_id"), F.count("*").alias("class_size"), F.min(F.struct(F.col("i").isNull().alias("n"), "i", "k")).getField("k").alias("first"))
    classes = saved(classes, "classes")
    return row.join(classes, "component").select(F.col("i").alias(id), F.col("k").alias("row_key"), "class_id", "class_size", (F.col("k") == F.col("first")).alias("representative"))


def _links(member: DataFrame, sets: DataFrame, similarity: float, weighted: bool) -> DataFrame:
    """All links within buckets that join different components, saved; see the module's text for the steps."""
    # The hub is a maximum, with map-side maxima; a bucket isn't gathered.
    hub = saved(member.groupBy("band").agg(F.max_by("node", F.struct("reach", F.negative("node"))).alias("hub")), "hubs")
    reached, member = member, saved(member.join(hub, "band").select("band", "node", "hub"), "members")
    pairs = saved(member.select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).distinct(), "pairs")
    met = _similarities(pairs, sets, weighted)
    forget(reached, hub, pairs)
    links = met.where(F.col("similarity") >= similarity).select("u", "v")
    component, used = connected_components(links, "u", "v")
    labelled = saved(member.join(component, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component"), "labelled")
    forget(member, *used)
    member = _prune(_open(labelled), sets, similarity, weighted)
    if not member.limit(1).count():
        out = saved(links, "links")
        forget(member, met)
        return out
    # Any two members of different components: one of them isn't in the bucket's largest component.
    profiles = member.withColumn("u", F.greatest("node", "hub")).withColumn("v", F.least("node", "hub")).join(met.select("u", "v", "profile"), ["u", "v"])
    profiles = saved(profiles.select("band", "node", "c", "n", "profile", (F.col("common") - F.aggregate("profile", F.lit(0), lambda a, x: a + x)).alias("beside")), "profiles")
    forget(member)
    # Saved in between, so that Spark can split the join of a hot bucket.
    largest = saved(profiles.groupBy("band", "c").count().groupBy("band").agg(F.max_by("c", F.struct("count", "c")).alias("largest")), "largest")
    other = saved(profiles.join(largest, "band").where("c <> largest").select(*(F.col(x).alias(f"{x}2") for x in profiles.columns)), "others")
    most = F.expr("aggregate(zip_with(profile, profile2, (x, y) -> least(x, y)), 0, (a, x) -> a + x) + least(beside, beside2)")
    possible = F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("n2")) <= most + F.lit(1e-6)
    pairs = profiles.join(other, (F.col("band") == F.col("band2")) & (F.col("c") != F.col("c2")) & possible)
    pairs = saved(pairs.select(F.greatest("node", "node2").alias("u"), F.least("node", "node2").alias("v")).distinct().join(met.select("u", "v"), ["u", "v"], "left_anti"), "pairs")
    more = _similarities(pairs, sets, weighted)
    out = saved(links.union(more.where(F.col("similarity") >= similarity).select("u", "v")), "links")
    forget(profiles, largest, other, pairs, met, more)
    return out


def _similarities(pairs: DataFrame, sets: DataFrame, weighted: bool) -> DataFrame:
    """The sets of u are sent to their v. A v with very many pairs is copied to _FANOUT places, so they aren't one task's."""
    hot = saved(pairs.groupBy("v").count().where(F.col("count") > _FANOUT * 8).select("v", F.lit(_FANOUT).alias("ways")), "hot")  # saved, so that Spark can split the join
    spread = saved(pairs.join(hot, "v", "left").select("u", "v", F.pmod(F.xxhash64("u"), F.coalesce("ways", F.lit(1))).alias("p")), "spread")
    copies = spread.select("v", "p").distinct().join(sets.select(F.col("k").alias("v"), F.col("e").alias("e2"), F.col("c").alias("c2")).hint("merge"), "v")
    both = spread.join(sets.select(F.col("k").alias("u"), F.col("e").alias("e1"), F.col("c").alias("c1")).hint("merge"), "u").join(copies.hint("merge"), ["v", "p"])
    found = saved(both.select("u", "v", "e1", "c1", "e2", "c2").mapInArrow(_compare(weighted), "u long, v long, similarity double, profile array<int>"), "compared")
    forget(hot, spread)
    return found


def _open(member: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component; ``member`` is a saved table, which goes."""
    mixed = member.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("band")
    found = saved(member.join(mixed, "band", "left_semi"), "open")
    forget(member)
    return found


def _prune(member: DataFrame, sets: DataFrame, similarity: float, weighted: bool) -> DataFrame:
    """Drop members that can't be linked to any open member of another component; adds n and common.

    What two sets have in common is at most what one has in common with all the others (with hubs)
    together, and a link needs similarity / (1 + similarity) of both sizes. A partner isn't smaller
    than the smallest member of another component in the same buckets, nor than similarity times the
    set's own size. With members gone, others have less in common; so again, while a tenth goes.
    """
    before = None
    while (now := member.count()) and (before is None or now < 0.9 * before):
        own = sets
        if before is not None:  # first with all sets, without a join
            own = saved(sets.join(member.select(F.explode(F.array("node", "hub")).alias("k")).distinct(), "k", "left_semi"), "left")
        each = own.select("k", "e", "c").mapInArrow(_each_shingle(weighted), "k long, x int, w int")
        # A shingle whose owners have one smallest and largest key has one owner.
        alone = each.groupBy("x").agg(F.min("k").alias("k"), F.max("k").alias("last"), F.sum("w").alias("w")).where("k = last")
        alone = saved(alone.groupBy("k").agg(F.sum("w").alias("alone")), "alone")
        size = own.select("k", "n").join(alone, "k", "left").select(F.col("k").alias("node"), "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common"))
        sized = saved(member.drop("n", "common").join(size, "node"), "sized")
        forget(member, alone, *([own] if before is not None else []))
        before = now
        small = saved(sized.groupBy("band", "c").agg(F.min("n").alias("n")), "small")
        first = small.groupBy("band").agg(F.min(F.struct("n", "c")).alias("x"))
        # Saved before it is summed by bucket, so that Spark can split the join of a hot bucket.
        beside = saved(small.join(first, "band").where(F.col("c") != F.col("x.c")).select("band", "x", "n"), "beside")
        other = saved(beside.groupBy("band").agg(F.first("x").alias("x"), F.min("n").alias("second")), "bounds")
        least = F.when(F.col("c") == F.col("x.c"), F.col("second")).otherwise(F.col("x.n"))
        need = F.lit(similarity / (1 + similarity)) * (F.col("n") + F.greatest(least, F.lit(similarity) * F.col("n"))) - F.lit(1e-6)
        left = saved(sized.join(other, "band").where(F.col("common") >= need).drop("x", "second"), "left")
        forget(sized, small, beside, other)
        member = _open(left)
    return member
