"""The pipeline's stages against brute force, each on its own input; and results that don't depend on how a table is split."""

import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm.common import keyed, saved
from ledgerloom.llm.fingerprint import version_likeness
from ledgerloom.llm.neardup import near_duplicates
from ledgerloom.llm.quality import line_quality, train
from ledgerloom.llm.queries import MAX_REPEATS, tokenizer_path
from ledgerloom.llm.substring import substring_dedup

from .test_operators import classes, prose, removed, words

pytest.importorskip("public_tokenizers")
STAGE = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean and junk texts, copies, near copies, shared passages, nulls, empty and long texts, repeated rows, null ids and sources."""
    shared = prose(60, 1)
    texts = [prose(120 + 7 * i, 100 + i) for i in range(24)]
    near = texts[2].split()
    near[50] = "changed"
    texts += [texts[0], texts[0], " ".join(near), texts[3] + "\n" + shared, prose(90, 200) + " " + shared + "\n" + prose(70, 201), prose(30000, 202)]
    junk = [" ".join(f"{w}%%%" if i % 2 else f"{w}###" for i, w in enumerate(prose(100, 300 + k).split())) for k in range(12)]
    rows = [(i, t, "en", f"src{i % 4}" if i % 9 else None) for i, t in enumerate([*texts, *junk])]
    rows += [(200, None, "en", "src0"), (201, "", "en", "src1"), (202, "too short", None, "src1"), (None, prose(100, 400), "en", "src2"), (None, prose(100, 400), "en", "src2"), (203, "again " * 300, "en", "rare"), (5, texts[5], "en", "src1")]
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    n = len(texts)
    spark.createDataFrame([(i, int(i < n), 0) for i in range(n + len(junk)) if i % 3] + [(900, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def rows_of(df):
    assert df.columns == COLUMNS
    return Counter(tuple(r) for r in df.collect())


def test_quality_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    field = train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = Counter(tuple(r[c] for c in COLUMNS) for r in line_quality(docs, field).collect() if r.quality.kept)
    got = rows_of(STAGE["quality_rules"](spark, docs, folder))
    assert got == want
    ids = {i for i, *_ in got}
    assert not ids & {200, 201, 202, 203, *range(30, 42)} and {*range(30), None} <= ids  # junk and base failures go, clean ones stay
    assert rows_of(STAGE["quality_rules"](spark, docs.where("false"), folder)) == Counter()


def test_near_duplicate_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    members = defaultdict(list)
    for group, r in zip(classes([(r[0], r[1]) for r in rows]), rows):
        members[group].append(r)
    want = Counter(min(x, key=lambda r: (r[0] is None, r[0] or 0)) for x in members.values())
    got = rows_of(STAGE["minhash_near_dedup"](spark, docs, folder))
    assert Counter((r[0], r[1]) for r in got.elements()) == Counter((r[0], r[1]) for r in want.elements())
    assert got.total() < len(rows) and rows_of(STAGE["minhash_near_dedup"](spark, docs.where("false"), folder)) == Counter()


def test_substring_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    got = rows_of(STAGE["substring_dedup"](spark, docs, folder))
    kept = Counter((i, " ".join(w.decode() for w in words(t))) for (i, t, *_), n in got.items() for _ in range(n))
    assert kept == Counter({(i, k): n for (i, _, _, k), n in removed([(r[0], r[1]) for r in rows], 35).items()})
    assert all(n == len(t or "") for _, t, _, _, n in got)
    untouched = {r for r in rows if r[0] in (7, 8, 13)}
    assert untouched <= set(got)
    assert rows_of(STAGE["substring_dedup"](spark, docs.where("false"), folder)) == Counter()


def test_mixing_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = Counter(tuple(r) for r in docs.collect())
    got = rows_of(STAGE["temperature_mixing"](spark, docs, folder))
    assert set(got) == set(rows) and all(n <= got[r] <= 2 * n for r, n in rows.items())
    tokens = lambda found: Counter({s: sum(n * len(words(t)) for (_, t, _, x, _), n in found.items() if x == s) for s in {r[3] for r in rows}})
    before, after = tokens(rows), tokens(got)
    most = max(before.values())
    assert all(after[s] == n for s, n in before.items() if n == most) and any(after[s] > n for s, n in before.items())
    assert MAX_REPEATS == 1.5 and rows_of(STAGE["temperature_mixing"](spark, docs.where("false"), folder)) == Counter()


def test_packing_stage(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    encode = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")).encode
    ids = Counter()
    for r in docs.collect():
        found = [*encode(r.text or "", add_special_tokens=False).ids, 2]
        ids[r.doc_id, len(found), zlib.crc32(np.array(found, "<u4").tobytes())] += 1
    got = STAGE["mixture_packing"](spark, docs, folder).collect()
    whole = Counter((r.doc_id, r.doc_tokens, r.ids_crc32) for r in got if r.length == r.doc_tokens)
    assert all(n <= ids[k] for k, n in whole.items()) and sum(r.length for r in got) == sum(k[1] * n for k, n in ids.items())
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    assert sorted(windows) == list(range(len(windows)))
    for w, found in windows.items():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end == 4096 or w == len(windows) - 1
    assert STAGE["mixture_packing"](spark, docs.where("false"), folder).count() == 0


def test_the_whole_pipeline_is_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, folder), name)
    want = Counter(tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect())
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, folder).collect())
    total = lambda found: Counter({i: sum(r[2] * n for r, n in found.items() if r[0] == i) for i in {r[0] for r in found}})
    assert total(got) == total(want) and got.total() > 20


def test_results_do_not_depend_on_how_a_table_is_split(spark, folder):
    """Plans that were made under one number of cores and split size, and run under another."""
    path = f"{folder}/documents.parquet"
    assert len(os.listdir(path)) > 3
    split = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "1k", "spark.sql.leafNodeDefaultParallelism": "7"}
    made = {
        "keys": keyed(spark.read.parquet(path)).select("doc_id", "text", "__row_key"),
        "near": near_duplicates(spark.read.parquet(path)), "substring": substring_dedup(spark.read.parquet(path)).select("doc_id", "dedup.n_removed", "dedup.kept_text"), "prints": version_likeness(spark.read.parquet(path)),
    }
    first = {name: Counter(map(str, df.collect())) for name, df in made.items()}
    for name, value in split.items():
        spark.conf.set(name, value)
    try:
        assert spark.read.parquet(path).rdd.getNumPartitions() > 7
        for name, df in made.items():
            assert Counter(map(str, df.select("*").collect())) == first[name], name
    finally:
        for name in split:
            spark.conf.unset(name)
