"""Each operator against brute force, a round trip, or its definition; with nulls, empty texts, ties, repeats and clashing names."""

import gzip
import hashlib
import io
import itertools
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import hashing, warc
from ledgerloom.llm.common import KEY, keyed
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.fingerprint import differences, version_likeness
from ledgerloom.llm.mixing import entropy_exponent, mix, repeat_exponent
from ledgerloom.llm.neardup import drop_near_duplicates, near_duplicates, signatures
from ledgerloom.llm.packing import Schedule, WordEncoder, pack
from ledgerloom.llm.queries import op2_rendezvous_sharding
from ledgerloom.llm.quality import FEATURES, Field, fit, line_quality, train
from ledgerloom.llm.sharding import shard
from ledgerloom.llm.substring import substring_dedup
from ledgerloom.llm.tokens import attribute, encoder, token_counts

tokenizers = pytest.importorskip("public_tokenizers")
BPE = tokenizers.path("word_bpe_49k.json")
RANKS = tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def prose(n, seed=0):
    draw = np.random.Generator(np.random.PCG64(seed))
    return " ".join(f"w{x}" for x in draw.integers(0, 5000, n))


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Nulls, empty and long texts, repeated rows and ids, and columns that clash with the operators' own."""
    base, shared = prose(300, 1), prose(60, 2)
    near = base.split()
    near[150] = "changed"
    loop = " ".join(["again"] * 200)
    rows = [
        (1, base, "a"), (2, base, "a"), (3, " ".join(near), "b"), (4, None, None), (5, "", "b"), (6, "  \n\t ", "a"), (7, "one two", "a"), (7, "one two", "a"),
        (8, prose(100, 3) + " " + shared + "\n" + prose(50, 4), "c"), (9, shared + " " + prose(120, 5), "c"), (None, prose(80, 6), "a"), (None, None, "c"),
        (10, loop, "b"), (11, prose(20000, 7) + "\n" + prose(900, 8), "a"), (12, "é È ß 漢字 😀 " * 30, "b"), (13, prose(34, 9), "a"), (14, prose(34, 9), "a"),
    ]
    rows = [(*r, f"x{i}", 1.5) for i, r in enumerate(rows)]
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, source string, shard string, dedup double").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def words(text):
    return WORDS.findall((text or "").encode())


def test_hashing_finds_the_words_of_each_text():
    texts = ["a  bb\tccc", None, "", "x", "\n", "é ü", "end "]
    (lo, hi, found), = hashing.runs(pa.array(texts))
    assert (lo, hi) == (0, 7)
    got = [[found.word(i) for i in range(found.bounds[d], found.bounds[d + 1])] for d in range(7)]
    assert got == [words(t) for t in texts]
    again = hashing.Words(*hashing.text_buffers(pa.array(["zz x"])))
    assert again.hashes[1] == found.hashes[3]
    values = np.array([5, 3, 3, 9, 1, 7], np.uint64)
    assert hashing.sliding_min(values, 3).tolist() == [1, 1, 4, 4]


def test_signatures_estimate_weighted_similarity():
    draw = np.random.Generator(np.random.PCG64(5))
    e = draw.integers(0, 2**63, 400, dtype=np.uint64)
    w1, w2 = draw.random(400) * 3, draw.random(400) * 3
    k = 4096
    found = signatures([(e, w1), (e, w2), (e, w1), (np.zeros(0, np.uint64), np.zeros(0))], k)
    want = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    assert abs((found[0] == found[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / k)
    assert (found[0] == found[2]).all() and (found[0] != 0).all() and (found[3] == 0).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b")[0].collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200}


def classes(rows, similarity=0.8):
    """Brute force: class ids of (id, text)."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return group


def test_near_duplicates(spark, docs):
    got = near_duplicates(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(got) == len(rows)
    group, ids = classes(rows), defaultdict(list)
    for g, (i, _) in zip(group, rows):
        ids[g].append(i)
    want = Counter((i, min((x for x in ids[g] if x is not None), default=None), len(ids[g])) for g, (i, _) in zip(group, rows))
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want
    assert sum(r.representative for r in got) == len(ids)
    assert near_duplicates(docs.where("false")).count() == 0


def test_near_duplicates_of_a_large_loose_group(spark, tmp_path):
    """Copies with few to many changed words: only those within the threshold of each other are linked."""
    base, draw = prose(200, 11).split(), np.random.Generator(np.random.PCG64(3))
    rows = []
    for i in range(120):
        w = list(base)
        for at in draw.integers(0, 200, int(draw.integers(0, 20))):
            w[at] = f"e{draw.integers(0, 10**9)}"
        rows.append((i, " ".join(w[: 200 - int(draw.integers(0, 15))])))
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    for weighted in (False, True):
        got = {r.doc_id: r.class_id for r in near_duplicates(spark.read.parquet(path), weighted=weighted).collect()}
        group = classes(rows)
        first = {g: min(i for i, h in enumerate(group) if h == g) for g in group}
        assert got == {i: first[g] for i, g in enumerate(group)}


def test_sharding(spark, docs):
    eight = {s: 1.0 for s in range(8)}
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("old").alias("shard"))
    got = shard(rows, ["doc_id"], eight, eight | {8: 1.0}).collect()
    assert len(got) == 4000
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        assert 400 < sum(r.shard == s for r in got) < 600
    moved = [r for r in got if r.shard != r.grown_shard]
    assert all(r.grown_shard == 8 for r in moved) and 350 < len(moved) < 540
    heavy = Counter(r.shard for r in shard(rows, ["doc_id"], {0: 1.0, 1: 3.0}).collect())
    assert 2800 < heavy[1] < 3200
    odd = shard(docs.withColumn("rest", F.lit(1)).withColumn("part", F.lit(2)).withColumn("before", F.lit(3)), ["doc_id"], eight).collect()
    assert {(r.rest, r.part, r.before) for r in odd} == {(1, 2, 3)} and Counter(r.text for r in odd) == Counter(r.text for r in docs.collect())
    assert len(odd) == docs.count() and len({(r.shard, r.slot) for r in odd}) == len(odd) and all(r.grown_shard is None for r in odd)
    assert shard(docs.where("false"), ["doc_id"], eight).count() == 0


def test_the_query_of_shards_by_definition(spark, docs, tmp_path):
    """Sizes, checksums and the draws of every shard in plain Python; nulls and repeated ids too."""
    docs.select("doc_id", "text").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))

    def best(key, shards):
        name = "null" if key is None else f"={key}"
        unit = lambda s: (int(hashlib.md5(f"{s}|{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return min(range(shards), key=lambda s: -math.log(unit(s)))

    got = Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in op2_rendezvous_sharding(spark, str(tmp_path)).collect())
    assert got == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), "key", best(r.doc_id, 8), best(r.doc_id, 9)) for r in docs.collect())


def test_columns_of_any_name(spark, docs):
    """A backtick, a dot and names of the operators' own columns come through."""
    odd = ["a`b", "c.d", "rest", "k", "t", "q", "s"]
    rows = docs.select("doc_id", "text", "source", *(F.lit(i).alias(c) for i, c in enumerate(odd)))
    eight = {s: 1.0 for s in range(8)}
    found = [shard(rows, ["doc_id"], eight), line_quality(rows, None), mix(rows, max_repeats=1.5).where("mix.epoch = 0"), substring_dedup(rows), token_counts(rows, RANKS, tokenizers.PATTERN), pack(rows, BPE, keep=("doc_id", *odd)).where("start = 0")]
    for df in found:
        got = df.collect()
        assert len(got) == rows.count() and all([r[c] for c in odd] == list(range(len(odd))) for r in got)
    assert all([r[c] for c in odd] == list(range(len(odd))) for r in drop_near_duplicates(rows).collect())


def test_transitions_change_a_labelling():
    """A line that alone looks like boilerplate is content among content, where changes of label cost; the last words decide."""
    weight = np.zeros((len(FEATURES), 2))
    weight[0] = [0.0, 1.0]
    lines = np.zeros((5, len(FEATURES)))
    lines[:, 0] = [2.0, 2.0, -0.5, 2.0, -3.0]
    alone, chained = Field(weight, np.zeros((2, 2))), Field(weight, np.array([[0.6, -0.6], [-0.6, 0.6]]))
    assert alone.decode(lines).tolist() == [1, 1, 0, 1, 0] and chained.decode(lines).tolist() == [1, 1, 1, 1, 0]


def test_quality_counts(spark, docs):
    for r in line_quality(docs, None).collect():
        w, q, text = words(r.text), r.quality, r.text or ""
        threes = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + j for i in range(len(w) - 2) if threes[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        want = (len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == want
        assert q.base_failed == (len(w) < 50 or 2 * len(covered) > len(w)) and q.kept == (not q.base_failed)
    assert line_quality(docs.where("false"), None).count() == 0


def test_viterbi_is_the_best_labelling():
    draw = np.random.Generator(np.random.PCG64(1))
    field = Field(draw.normal(size=(len(FEATURES), 2)), draw.normal(size=(2, 2)))
    for n in (1, 2, 7):
        x = draw.normal(size=(n, len(FEATURES)))
        score = lambda labels: sum((x[i] @ field.weight)[k] for i, k in enumerate(labels)) + sum(field.step[a, b] for a, b in zip(labels, labels[1:]))  # noqa: B023, E731
        best = max((tuple(map(int, f"{b:0{n}b}")) for b in range(2**n)), key=score)
        assert tuple(field.decode(x)) == best


def test_the_field_is_fitted_by_its_likelihood():
    """The fit's gradient leads to where no labelling's expected counts differ from those seen."""
    draw = np.random.Generator(np.random.PCG64(4))
    runs = [draw.normal(size=(n, len(FEATURES))) for n in (1, 3, 5, 2)]
    labels = [draw.integers(0, 2, len(r)) for r in runs]
    share = np.array([0.1, 0.2, 0.3, 0.4])
    field = fit(runs, labels, share, rounds=3000, rate=0.01, shrink=0.1)
    step = np.zeros((2, 2))
    for x, y, w in zip(runs, labels, share):
        paths = [tuple(map(int, f"{b:0{len(x)}b}")) for b in range(2 ** len(x))]
        score = np.array([sum((x[i] @ field.weight)[k] for i, k in enumerate(p)) + sum(field.step[a, b] for a, b in zip(p, p[1:])) for p in paths])
        chance = np.exp(score - np.logaddexp.reduce(score))
        for p, c in [*zip(paths, -chance), (tuple(y), 1.0)]:
            for a, b in zip(p, p[1:]):
                step[a, b] += c * w / len(x)
    assert step == pytest.approx(0.1 * field.step, abs=1e-3)


def test_field_learns_and_holds_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2)) == 0
    field = train(docs, labels.where(~held))
    got = line_quality(docs.join(labels.where(held).select("doc_id", F.col("quality").alias("label")), "doc_id"), field).collect()
    judged = [r for r in got if not r.quality.base_failed]
    assert sum(r.quality.kept == (r.label == 1) for r in judged) >= 0.98 * len(judged)
    mixed = [r for r in got if len(set(r.quality.labels)) == 2]
    assert len([r for r in mixed if r.label == 0]) >= 10  # junk with clean lines among it
    assert train(docs, labels.where("false")) is None
    # Boilerplate inside a good text, line by line; twice in the labels, with other labels and texts.
    good = [r.text.split("\n") for r in got if r.label == 1 and r.quality.kept and r.text.count("\n") > 5][:20]
    junk = [x for r in got if r.label == 0 for x in r.text.split("\n") if len(re.findall(r"[#*$%&]{3}", x)) > 5]
    some = [(i, "\n".join([*x[:3], junk[2 * i % len(junk)], junk[(2 * i + 1) % len(junk)], *x[3:]])) for i, x in enumerate(good)]
    marked = line_quality(spark.createDataFrame(some, "doc_id long, text string"), field).collect()
    assert sum(r.quality.labels[3:5] == b"\0\0" and r.quality.kept for r in marked) >= 18
    twice = train(docs.union(docs).union(docs.withColumn("text", F.lit(None).cast("string"))), labels.union(labels).union(labels.withColumn("quality", F.lit(None).cast("int"))))
    again = train(docs.union(docs.withColumn("text", F.lit(None).cast("string"))).repartition(5), labels)
    assert np.array_equal(twice.weight, again.weight) and np.array_equal(twice.step, again.step)


def removed(rows, size):
    places, out = Counter(), []
    for _, text in rows:
        w = words(text)
        places.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    for i, text in rows:
        w = words(text)
        gone = {i + j for i in range(len(w) - size + 1) if places[tuple(w[i : i + size])] > 1 for j in range(size)}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return Counter(out)


@pytest.mark.parametrize("group", [500, 1])
def test_substring_dedup(spark, docs, group):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = substring_dedup(docs, group=group).collect()
    assert Counter((r.doc_id, r.dedup.n_words, r.dedup.n_removed, r.dedup.kept_text) for r in got) == removed(rows, 35)
    assert all(sum(s.length for s in r.dedup.spans) == r.dedup.n_removed for r in got)
    assert substring_dedup(docs.where("false")).count() == 0
    for size, anchor in ((12, 4), (100, 10)):
        other = substring_dedup(docs, window=size, anchor=anchor, group=group).collect()
        assert Counter((r.doc_id, r.dedup.n_words, r.dedup.n_removed, r.dedup.kept_text) for r in other) == removed(rows, size)


@pytest.mark.parametrize("group", [500, 3])
def test_factors_are_true_and_greedy(spark, tmp_path, group):
    """Every factor's words are its source's; shared passages in many contexts, whole copies, and a text that repeats itself."""
    passage, other = prose(45, 21), prose(40, 22)
    texts = [f"{prose(60, 30 + i)} {passage} {prose(20, 90 + i)}" for i in range(12)] + [prose(80, 5)] * 5
    texts += [passage + " " + other, other + " x", prose(50, 7) + " y " + prose(50, 7), None, ""]
    path = str(tmp_path / "d")
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    whole = {r[KEY]: words(r.text) for r in keyed(docs).collect()}
    got = substring_dedup(docs, group=group).collect()
    assert Counter((r.doc_id, r.dedup.n_words, r.dedup.n_removed, r.dedup.kept_text) for r in got) == removed(list(enumerate(texts)), 35)
    for r in got:
        end = 0
        for f in r.dedup.factors:
            size = f.windows + 34
            own, source = words(r.text)[f.start : f.start + size], whole[f.source][f.source_start : f.source_start + size]
            assert own == source and len(own) == size and f.start >= end
            end = f.start + f.windows
    copy = next(r for r in got if r.doc_id == 13)
    assert [(f.start, f.windows) for f in copy.dedup.factors] == [(0, 46)]


def test_substring_dedup_keeps_the_layout(spark, docs):
    for r in substring_dedup(docs, layout="original").collect():
        w = words(r.text)
        gone = {i for s in r.dedup.spans for i in range(s.start, s.start + s.length)}
        assert words(r.dedup.kept_text) == [x for i, x in enumerate(w) if i not in gone]
        assert gone or r.dedup.kept_text == (r.text or "")
        assert r.shard.startswith("x")
        assert all(f.windows > 0 for f in r.dedup.factors)


def plan(tokens, max_repeats):
    """Brute force: how often each source runs, with the exponent found by bisection on the definition."""
    live = {s: n for s, n in tokens.items() if n}
    lo, hi = 0.0, 1.0

    def times(a):
        weight = {s: n**a for s, n in live.items()}
        budget = max(live[s] / w for s, w in weight.items())
        return {s: w * budget / live[s] for s, w in weight.items()}

    if max(times(0.0).values()) <= max_repeats:
        return times(0.0)
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if max(times(mid).values()) > max_repeats else (lo, mid)
    return times(hi)


def test_exponents(spark):
    assert max((900 / n) ** (1 - repeat_exponent(10, 900, 2.0)) for n in (900, 90, 10)) == pytest.approx(2.0)
    assert repeat_exponent(5, 5, 2.0) == 0.0
    totals = [900, 90, 10, 400]
    a = entropy_exponent(spark.createDataFrame([(n,) for n in totals], "total long"), 0.9)
    shares = [n**a / sum(m**a for m in totals) for n in totals]
    assert -sum(p * math.log(p) for p in shares) == pytest.approx(0.9, abs=1e-9)


def test_mixing(spark, docs):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("case when id % 10 = 0 then 'rare' when id % 10 < 4 then 'some' when id = 2999 then 'none' else 'many' end").alias("source"), F.expr("if(id = 2999, '', repeat('word ', cast(1 + id % 7 as int)))").alias("text"), F.lit(9).alias("use"), F.lit(8).alias("uses"), F.lit(7).alias("__source"), F.lit(6).alias("s"))
    got = mix(rows, max_repeats=2.5).collect()
    assert {(r.use, r.uses, r["__source"], r.s) for r in got} == {(9, 8, 7, 6)}
    tokens, blocks = Counter(), Counter()
    where = {r.doc_id: r.mix.block for r in got}
    for r in rows.collect():
        tokens[r.source] += len(r.text.split())
        blocks[r.source, where[r.doc_id]] += len(r.text.split())
    want, uses = plan(tokens, 2.5), defaultdict(Counter)
    assert sorted(where) == list(range(3000))
    for r in got:
        assert r.mix.tokens == len(r.text.split())
        uses[r.source, r.mix.epoch][r.mix.place, r.mix.block] += r.mix.tokens
    for s in tokens:
        times, epochs = want.get(s, 1.0), [e for x, e in uses if x == s]
        assert sorted(epochs) == list(range(max(epochs) + 1)) and math.ceil(times - 1e-9) == len(epochs)
        for e in epochs:
            placed = sorted(uses[s, e])
            assert [p for p, _ in placed] == list(range(len(placed))) and len({b for _, b in placed}) == len(placed)
            assert all(n == blocks[s, b] for (_, b), n in uses[s, e].items())  # whole blocks, each once
            given, budget = sum(uses[s, e].values()), min(1.0, times - e) * tokens[s]
            last = uses[s, e][placed[-1]]
            assert given == tokens[s] if budget == tokens[s] else given - last < budget <= given
    assert [b for _, b in sorted(uses["rare", 0])] != [b for _, b in sorted(uses["rare", 1])]
    odd = mix(docs, max_repeats=1.5)
    assert odd.where("mix.epoch = 0").count() == docs.count() and mix(docs.where("false"), max_repeats=1.5).count() == 0
    assert mix(docs, target_entropy=1.0).where("mix.epoch = 0").count() == docs.count()


def pieces(text):
    find = lambda x, n: re.findall(rf"[^\n]{{1,{n}}}", x)
    return {*find(text[:256], 16), *find(text[256:], 96)}


def edited(docs):
    """(row, next row, edited text) in the contract's order."""
    rows = keyed(docs).collect()
    order = sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r[KEY]))
    for r, n in zip(order, order[1:] + order[:1]):
        t, x = r.text or "", n.text or ""
        yield r, n, t[: len(t) - len(t) // 3] + x[: len(t) // 3]


def read_sketch(told, w):
    """The cells of a published fingerprint, folded to w."""
    width, _, cells = told.partition("|")
    out = defaultdict(lambda: [0, 0, 0])
    for cell in filter(None, cells.split(",")):
        at, n, key, check = cell.split(":")
        part, place = divmod(int(at), int(width))
        c = out[part * w + place % w]
        c[0], c[1], c[2] = c[0] + int(n), c[1] ^ int(key, 16), c[2] ^ int(check, 16)
    return out


def test_fingerprints(spark, docs):
    got = {r.row_key: r for r in version_likeness(docs).collect()}
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    seen = 0
    for r, n, e in edited(docs):
        f, t = got[r[KEY]], r.text or ""
        a, b = pieces(t), pieces(e)
        assert (f.doc_id, f.next_id, f.n_chars, f.edited_sha256) == (r.doc_id, n.doc_id, len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (f.only_text, f.only_edited) == (len(a - b), len(b - a))
        assert f.near_edited == pytest.approx(alike(a, b)) and f.near_next == pytest.approx(alike(a, pieces(n.text or "")))
        # A part of the published cells, folded to one width and subtracted, counts what the versions differ by.
        w = min(int(x.partition("|")[0]) for x in (f.fingerprint, f.edited_fingerprint))
        x, y = read_sketch(f.fingerprint, w), read_sketch(f.edited_fingerprint, w)
        assert sum(x[c][0] - y[c][0] for c in {*x, *y} if c < w) == len(a) - len(b)
        seen += 1
    assert seen == len(got) == docs.count()
    assert len({r.fingerprint for r in got.values() if r.doc_id in (1, 2)}) == 1 and len({r.fingerprint for r in got.values()}) > 8
    assert version_likeness(docs.where("false")).count() == 0


def test_fingerprints_of_short_and_long_texts(spark, tmp_path):
    """Two thirds of a text are unchanged, so a short text on one line is like its edited version; 100,000 lines take no longer than they must."""
    texts = ["".join(chr(97 + x) for x in np.random.Generator(np.random.PCG64(i)).integers(0, 26, n)) for i, n in enumerate([25, 60, 299, 448, 9000])]
    texts.append("\n".join(f"line {i}" for i in range(100_000)))
    path = str(tmp_path / "short.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    short = spark.read.parquet(path)
    began = time.time()
    got = {r.doc_id: r for r in version_likeness(short).collect()}
    assert time.time() - began < 120
    assert all(r.near_edited > 0 and r.near_next == 0 for r in got.values())
    long = next(e for r, _, e in edited(short) if r.doc_id == 5)
    assert got[5].only_text == len(pieces(texts[5]) - pieces(long)) > 30_000


@pytest.mark.parametrize("size", [3, 40, 700])
def test_differences_of_any_sizes(spark, size):
    """Sets of very different sizes, equal ones, and empty ones; small ones often fail to peel at first."""
    draw = np.random.Generator(np.random.PCG64(size))
    rows = []
    for i in range(300):
        a = {int(x) for x in draw.integers(-(2**62), 2**62, int(draw.integers(0, size)))}
        b = {x for x in a if draw.random() < 0.7} | {int(x) for x in draw.integers(-(2**62), 2**62, int(draw.integers(0, size)))} if i % 7 else a
        rows.append((i, 0, sorted(a), sorted(b)))
    got = {r.k: (r.only_a, r.only_b) for r in differences(spark.createDataFrame(rows, "k long, which int, a array<long>, b array<long>"), ["k", "which"]).collect()}
    assert got == {i: (len(set(a) - set(b)), len(set(b) - set(a))) for i, _, a, b in rows if a != b}


def test_token_counts(spark, docs):
    for rule in ("first", "last", "majority", "split"):
        got = token_counts(docs, RANKS, tokenizers.PATTERN, rule=rule).collect()
        assert len(got) == docs.count()
        for r in got:
            assert sum(s.tokens for s in r.tokens.sections) == pytest.approx(r.tokens.total)
            assert "".join((r.text or "")[s.start : s.stop] for s in r.tokens.sections) == (r.text or "")
    ends, a, b = np.array([2, 5, 9]), np.array([0, 4]), np.array([4, 8])
    assert [attribute(ends, a, b, r)[0].tolist() for r in ("first", "last", "majority")] == [[2.0, 1.0], [1.0, 1.0], [2.0, 1.0]]
    counts, crossing, outside = attribute(ends, a, b, "split")
    assert counts.tolist() == pytest.approx([1 + 2 / 3, 1 / 3 + 3 / 4]) and crossing.tolist() == [1, 2] and outside == pytest.approx(0.25)
    given = token_counts(docs, RANKS, tokenizers.PATTERN, sections=F.expr("array(named_struct('start', 1L, 'stop', 3L))")).collect()
    assert all(sum(s.tokens for s in r.tokens.sections) + r.tokens.outside == r.tokens.total for r in given)


def test_token_counts_are_the_tokenizer_s(spark, docs):
    """Totals and first-byte attribution against one encoding of each whole text, token by token."""
    coding, _ = encoder(RANKS, tokenizers.PATTERN)
    for r in token_counts(docs.where("doc_id is null or doc_id <> 11").withColumn("rest", F.lit(1)), RANKS, tokenizers.PATTERN).collect():
        text = r.text or ""
        ids, starts, at = coding.encode_ordinary(text), [], 0
        for i in ids:
            starts.append(at)
            at += len(coding.decode_single_token_bytes(i))
        assert at == len(text.encode()) and r.tokens.total == len(ids) and r.tokens.outside == 0 and r.rest == 1
        bounds = [(len(text[: s.start].encode()), len(text[: s.stop].encode())) for s in r.tokens.sections]
        assert [s.tokens for s in r.tokens.sections] == [sum(a <= x < b for x in starts) for a, b in bounds]
        assert [text[s.start : s.stop] for s in r.tokens.sections] == (re.findall(r"[^\n]*\n|[^\n]+", text) or [""])
    assert token_counts(docs.where("false"), RANKS, tokenizers.PATTERN).count() == 0


def multiset_similarity(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


@pytest.mark.parametrize("weighted", [False, True])
def test_near_duplicates_of_a_table_are_those_of_brute_force(spark, weighted):
    """All links at 0.8 among the documents of a table, sets or multisets; the bands miss 7 in 100,000 at 0.8, so at these few none."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = {r.doc_id: r.class_id for r in near_duplicates(docs, weighted=weighted).collect()}
    grams = {}
    for i, text in rows:
        w = WORDS.findall((text or "").encode())
        own = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
        grams[i] = own if weighted else Counter(dict.fromkeys(own, 1))
    near = {(a, b): s for a, b in itertools.combinations(grams, 2) if (s := multiset_similarity(grams[a], grams[b])) >= 0.5}
    links = [p for p, s in near.items() if s >= 0.8]
    assert links and sum(found[a] == found[b] for a, b in links) >= 0.999 * len(links)
    parent = {i: i for i in grams}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    assert all((found[a] == found[b]) == (top(a) == top(b)) for a, b in near)  # nothing below 0.8 is linked either


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (3, None, None), (4, "u", ""), (5, "v", "é" * 70000), (None, "w", "same"), (6, "z", "only"), (6, "z", "only"), (None, None, "lost"), (None, "q", "lost")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    folder, manifest = warc.write_warc(pages, folder=f"file://{tmp_path}/w", file_bytes=400)
    read = warc.read_warc(spark, folder, manifest)
    got = Counter((r.id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.resolved(read).collect())
    best, first = {"same": 2, "": 4, "only": 6}, set()
    want, bodies = Counter(), Counter()
    for i, _, html in rows:
        t = html or ""
        wins = i == best.get(t, i) and (t not in best or t not in first)
        if wins:
            first.add(t)
            bodies[t] += 1
        want[i, "response" if wins else "revisit", len(t.encode()), warc.sha1(t.encode()), None if wins else best[t]] += 1
    assert got == want and sum(r.records for r in manifest.collect()) == len(rows)
    assert Counter(bytes(r.payload).decode() for r in read.collect() if r.payload is not None) == bodies
    assert all(r.payload_bytes is None for r in read.collect() if r.record_type == "revisit")
    short = warc.read_warc(spark, *warc.write_warc(pages.where("html = 'same'"), min_bytes=5, folder=f"file://{tmp_path}/x"))
    assert {r.record_type for r in short.collect()} == {"response"}
    assert warc.read_warc(spark, *warc.write_warc(pages.where("false"))).count() == 0
    lone = read.where("record_type = 'revisit'")
    with pytest.raises(Exception, match="no response for the revisit"):
        warc.resolved(lone).collect()


def test_warc_reader_is_strict():
    good = warc.member([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:" + warc.sha1(b"abc"))], b"abc")
    assert [r.body for r in warc.read(io.BytesIO(good + good))] == [b"abc", b"abc"]
    plain = gzip.decompress(good)
    for bad in (good[:-9], gzip.compress(plain.replace(b"abc\r\n\r\n", b"abd\r\n\r\n")), gzip.compress(plain.replace(b"Length: 3", b"Length: 2")), gzip.compress(b"junk\r\n\r\n"), b"no gzip at all"):
        with pytest.raises(warc.WarcError):
            list(warc.read(io.BytesIO(bad)))


def test_word_encoder_is_the_tokenizer():
    encoder = WordEncoder(BPE)
    texts = ["a\x0bb  c's 12é ΑΣ σ <|endoftext|>x ٣ ͅ İ ", "", "For\xa0the x\x85y", "don't stop!! it's... 'S A.B.C a-b_c é.è fooꙮ ꙮ bar", "K ﬁ Å <b>x</b> '' a''s", "x\x1cy x\x0cy x\ry", "ABC def.ghí !̸"]
    for some in (texts, texts[:1], texts[3:4]):
        raw = [t.encode() for t in some]
        ids, bounds = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
        for t, a, b in zip(some, bounds[:-1], bounds[1:]):
            assert ids[a:b].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("wanted", [None, {"a": 1.0, "b": 3.0}])
def test_packing(spark, docs, wanted):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    whole, ids_of = Counter(), {}
    for r in docs.collect():
        ids_of[r.shard] = ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        whole[r.doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    rows = pack(docs.withColumn("start", F.lit("mine")).withColumn("rest", F.lit(1)), BPE, keep=("doc_id", "start", "shard", "rest"), length=64, weights=wanted).collect()
    assert {r.input_start for r in rows} == {"mine"}
    end = Counter()
    for r in sorted(rows, key=lambda r: (r.shard, r.start)):  # each id lies in one piece, and its checksum is right
        assert r.start == end[r.shard] and r.ids_crc32 == zlib.crc32(ids_of[r.shard][r.start : r.start + r.length].tobytes())
        end[r.shard] += r.length
    assert end == Counter({s: len(x) for s, x in ids_of.items()})
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append(r)
    for w, pieces in windows.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == 64 or w == max(windows)
    assert sum(r.length for r in rows) == sum(n * k for (_, n, _), k in whole.items())
    starts = Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
    assert starts == Counter({(i, n): k for (i, n, _), k in whole.items()})
    assert pack(docs.where("false"), BPE).count() == 0


def scheduled(totals, weights, length):
    """A schedule, and the pieces of tokens of a source: who has a queue, and tiers of the rest, by definition."""
    whole = sum(totals.values())
    own = {s: n for s, n in totals.items() if (weights.get(s, 0) > 0 if weights else n * length >= 2 * whole)}
    tiers, base = Counter(), {}
    for s in sorted(set(totals) - set(own)):
        t = totals[s].bit_length() - 1
        base[s] = (t, tiers[t], totals[s])
        tiers[t] += totals[s]
    schedule = Schedule(own, weights and {s: weights[s] for s in own}, length, tiers)
    return schedule, lambda s, start, n: schedule.pieces(s, start, n, *base.get(s, ()))


def test_packing_of_very_many_sources(spark):
    """60,000 sources, of which one has a third of all documents: every token once, and the hot source's share in every window."""
    n = 90_000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.expr("if(id % 3 = 0, 'hot', concat('s', id))").alias("source"), F.lit("a few words of text here").alias("text")).repartition(4)
    got = pack(rows, BPE, length=256)
    (size,) = {r.doc_tokens for r in got.select("doc_tokens").distinct().collect()}
    by = got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.countDistinct("start").alias("starts"))
    assert by.where(f"n <> {size} or k <> starts").count() == 0 and by.count() == n
    windows = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sum(F.expr("if(doc_id % 3 = 0, length, 0)")).alias("hot"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count("*").alias("k"), F.countDistinct("offset").alias("offsets")).orderBy("sequence_id").collect()
    assert len(windows) == -(-n * size // 256) and all(w.n == w.end == 256 and w.k == w.offsets and abs(w.hot - 256 / 3) <= 2 for w in windows[:-1])


def test_schedule_keeps_proportions():
    totals = {"=a": 70000, "=b": 20000, "=c": 9990, "=d": 10}
    s, _ = scheduled(totals, None, 100)
    for w in range(0, s.total // 100):
        for q, share in ((1, 0.7), (2, 0.2), (3, 0.0999)):
            assert abs(s.given(q, w) - share * 100 * w) <= 2
    x, _ = scheduled(totals, {"=a": 1, "=b": 1, "=c": 1}, 100)
    assert sum(x.given(q, 10**6) for q in range(4)) == 100000 and abs(x.given(1, 100) - 3333) <= 2



@pytest.mark.parametrize("hot", [False, True])
def test_rare_sources_keep_their_proportions(hot):
    """Over spans of windows every one of 5000 rare sources gives its share, within two turns."""
    totals = {f"=s{i}": 2000 + i % 7 * 500 for i in range(5000)}
    if hot:
        totals["=hot"] = sum(totals.values()) // 2
    s, pieces = scheduled(totals, None, 4096)
    windows, span = -(-s.total // 4096), 500
    for name in [f"=s{i}" for i in range(0, 5000, 250)]:
        given = Counter()
        for _, size, w, _ in pieces(name, 0, totals[name]):
            given[w // span] += size
        for k in range(windows // span):
            assert abs(given[k] - totals[name] * span * 4096 / s.total) <= 4 * 64


@pytest.mark.parametrize("wanted", [None, "uneven"])
def test_schedule_places_every_token_once(wanted):
    totals = {f"={i}": 1 + i * i % 97 * (1 + i % 3) for i in range(400)} | {"=hot": 9000}
    weights = wanted and {f"={i}": (i % 11) * 10.0 ** -(i % 4) for i in range(399)} | {"=hot": 50.0}
    s, pieces = scheduled(totals, weights, 128)
    places = [w * 128 + offset + i for name, n in totals.items() for _, size, w, offset in pieces(name, 0, n) for i in range(size)]
    assert sorted(places) == list(range(s.total))
    if weights:  # single weights count among rare sources, and those without a weight come last
        first = lambda name, n: next(pieces(name, n, 1))[2]
        ten = [name for name in weights if weights[name] == 10]
        got = sum(size for name in ten for _, size, w, _ in pieces(name, 0, totals[name]) if w < 20)
        flow = lambda t: sum(min(totals[name], x * t) for name, x in weights.items())
        t = min((t / 100 for t in range(2000)), key=lambda t: abs(flow(t) - 20 * 128))  # what is left after sources end goes to the others
        assert got == pytest.approx(sum(min(totals[name], 10 * t) for name in ten), abs=2 * len(ten))
        assert first("=399", 0) * 128 + 128 > s.total - sum(totals[n] for n in totals if not weights.get(n))
