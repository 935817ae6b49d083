"""The conversation trie against a brute-force one over lists of turns, and its merge against sorting."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from ledgerloom.llm import trie
from ledgerloom.llm.queries import op11_conversation_prefix_trie
from ledgerloom.llm.trie import TURN, Run, common, conversation_paths, merged, prefix_trie


def turn(x):
    return hashlib.md5(str(x).encode()).digest() + (x % 7).to_bytes(4, "big")


def brute(conversations):
    """{conv_id: [(what tells a turn, bytes), ..]} to the set of rows."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    rows = set()
    for path, own in members.items():
        under = [p for p in members if p[: len(path)] == path]
        children = [p for p in under if len(p) == len(path) + 1]
        leaves = [p for p in under if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in under)]
        saved = sum((len(members[p]) - 1) * p[-1][1] for p in under if p)
        ends = sorted(c for c in own if len(conversations[c]) == len(path))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        rows.add((min(own), len(path), min(members[path[:-1]]) if path else None, len(own), len(children), len(leaves), saved, digest))
    return rows


def test_merging_is_sorting():
    draw = random.Random(4)
    for k in (0, 1, 2, 3, 5, 8, 13):
        rows = [(b"".join(turn(draw.randrange(3)) for _ in range(draw.randrange(6))), i) for i in range(40 * k)]
        draw.shuffle(rows)
        runs = [Run(rows[i::k]) for i in range(k)] + [Run([])] * bool(k)
        out = list(merged(runs))
        assert [x[:2] for x in out] == sorted(rows)
        assert [x[2] for x in out] == [common(a, b[0]) for a, b in zip([b""] + [x[0] for x in out], out, strict=False)]


def check(spark, conversations, ranges, batch=1000):
    rows = [(c, bytearray(b"".join(hashlib.md5(str(t).encode()).digest() + t[1].to_bytes(4, "big") for t in turns))) for c, turns in conversations.items()]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = prefix_trie(spark.createDataFrame(rows, "id long, path binary").repartition(3), ranges=ranges).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found]
    want = brute(conversations)
    assert len(got) == len(want) and set(got) == want


def test_any_ranges_and_runs_give_the_same_trie(spark):
    """Few kinds of turns, so that most nodes are shared, many conversations are equal, and ranges cut them anywhere."""
    draw = random.Random(8)
    kinds = [(f"t{i}", i + 1) for i in range(3)]
    many = {c: [draw.choice(kinds) for _ in range(draw.randrange(6))] for c in draw.sample(range(-500, 5000), 300)}
    many |= {c: kinds[:2] for c in range(10_000, 10_150)}  # a third are copies, more than a range holds
    for ranges, batch in ((1, 1000), (1, 16), (7, 1000), (40, 8)):
        check(spark, many, ranges, batch)


def test_deep_chains_and_few_conversations(spark):
    chain = [(f"c{i}", 2) for i in range(300)]
    check(spark, {5: chain, 6: chain, 7: chain[:150], 8: [*chain[:150], ("x", 1)], 9: chain, 1: []}, 5)
    check(spark, {5: []}, 3)
    check(spark, {5: [], 2: []}, 3)
    assert prefix_trie(spark.createDataFrame([], "id long, path binary")).count() == 0


def test_pieces_of_long_lists_of_ends(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    out = []
    for rows in ([(b"", i) for i in range(20)], [(b"", i) for i in range(20, 45)]):
        here = trie.Range(0)
        for path, id, shared in merged([Run(rows)]):
            here.add(path, id, shared)
        here.end()
        out += [x for x in here.taken().to_pylist() if x["kind"] == trie.ENDS]
    import pyarrow as pa

    (batch,) = trie._hashed(iter([pa.RecordBatch.from_pylist([{"node": x["node"], "ids": x["ids"]} for x in out])]))
    assert batch.column("ends").to_pylist() == [hashlib.sha256(",".join(map(str, range(45))).encode()).hexdigest()]


def test_order_nulls_ties_and_other_columns(spark):
    rows = [(1, 2, "a", "zwei", 0), (1, None, "u", "null first", 0), (1, 1, None, None, 0), (1, 2, "a", "zwei", 0), (1, 2, "b", "auch zwei", 0), (None, 0, "u", "of none", 0), (2, 0, "u", "é😀", 0), (3, 0, "u", "", 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, `id` int").withColumn("p`ath", F.lit(1))
    got = {r.id: bytes(r.path) for r in conversation_paths(turns).collect()}
    t = lambda role, text: hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest() + len(text.encode()).to_bytes(4, "big")
    ties = sorted([t("a", "zwei"), t("a", "zwei"), t("b", "auch zwei")])
    assert got == {1: t("u", "null first") + t("", "") + b"".join(ties), 2: t("u", "é😀"), 3: t("u", "")}
    assert len(got[1]) == 5 * TURN


def test_the_query_on_a_fixture(spark, tmp_path):
    """Rebuilt in plain Python; with groups whose first conversation is absent, turnless results and copies."""
    draw = random.Random(3)
    rows = [(c, t, draw.choice(["user", "assistant"]), draw.choice(["hi", "so what", "é", "", "long " * 30])) for c in draw.sample(range(400), 250) for t in range(draw.choice([1, 2, 3, 5, 9, 12]))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    own = defaultdict(list)
    for c, _, role, text in sorted(rows):
        own[c].append(((role, text), len(text.encode())))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    assert any(not x for x in rebuilt.values())
    got = [tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in op11_conversation_prefix_trie(spark, str(tmp_path)).collect()]
    want = brute(rebuilt)
    assert len(got) == len(want) and set(got) == want


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert op11_conversation_prefix_trie(spark, str(tmp_path)).count() == 0
