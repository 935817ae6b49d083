"""The registered queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import saved, table
from ledgerloom.llm.fingerprint import version_likeness
from ledgerloom.llm.html import main_text
from ledgerloom.llm.mixing import mix
from ledgerloom.llm.neardup import near_duplicates
from ledgerloom.llm.packing import pack
from ledgerloom.llm.quality import line_quality, train
from ledgerloom.llm.secrets import BASE, findings, scan
from ledgerloom.llm.sharding import shard
from ledgerloom.llm.spelling import variant_groups
from ledgerloom.llm.substring import substring_dedup
from ledgerloom.llm.tokens import token_counts
from ledgerloom.llm.trie import conversation_paths, first_turns, prefix_trie, turns_after
from ledgerloom.llm.warc import read_warc, resolved, write_warc


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document, at a Jaccard similarity of 0.8 of word 5-shingles, each weighing as often as it occurs.

    Null and wordless texts are alone; repeated rows share a class, of which one row is the
    representative; null ids are kept. No documents, no rows.
    """
    return near_duplicates(table(spark, sf_dir, "documents"), weighted=True).select("doc_id", "class_id", "class_size", "representative")


def op2_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard by its doc_id (law key), and its slot there.

    A null text has size 1; null and repeated ids share a shard, each row with a slot of its own. No
    documents, no rows.
    """
    raw = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    eight = {s: 1.0 for s in range(8)}
    return shard(docs, ["doc_id"], eight, eight | {8: 1.0})


def op3_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, and the verdict of a field fitted on the labelled documents.

    A null or empty text has no words and fails; without labels of both kinds every line is content.
    Repeated rows get equal results. No documents, no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_quality(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without windows of 35 words that start elsewhere too.

    A null text has no words, and an empty kept text; repeated rows remove each other. No documents,
    no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "dedup.n_words", "dedup.n_removed", F.sha2("dedup.kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)
), twice AS (
  SELECT k FROM windows GROUP BY k HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + j AS p FROM windows SEMI JOIN twice USING (k), range(0, 35) AS r(j)
), each_word AS (
  SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM words)
), kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS t, count(*) AS n FROM each_word e ANTI JOIN gone g USING (doc_id, p) GROUP BY e.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words d LEFT JOIN kept k USING (doc_id)
"""

#: No source is repeated more often than this; see corpus_pipeline.
MAX_REPEATS = 1.5


def op5_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as its source's weight asks, no source over MAX_REPEATS times.

    Null sources are one source; documents without words are dealt like others; a source without
    words is used once; repeated rows are each used. No documents, no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, max_repeats=MAX_REPEATS).select("doc_id", "source", "mix.tokens", "mix.epoch", "mix.block", "mix.place")


def op6_site_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page.

    A null or empty page has an empty text; null urls are one host; repeated pages count once for the
    template, and each has its text. No pages, no rows.
    """
    found = main_text(table(spark, sf_dir, "pages"))
    text = F.array_join("blocks", "\n\n")
    return found.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


def op7_iblt_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how alike they and the next document's are.

    A null text is an empty one; null ids come last in the order; repeated rows are documents each. No
    documents, no rows.
    """
    found = version_likeness(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_id")


def op8_section_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, crossing ones with the line of their first byte.

    A null or empty text has one empty line without tokens; repeated rows have equal counts. No
    documents, no rows.
    """
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_counts(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    section = found.select("doc_id", F.col("tokens.total").alias("doc_tokens"), F.explode("tokens.sections").alias("s"))
    return section.select("doc_id", "doc_tokens", "s.section", F.col("s.start").alias("start_char"), F.col("s.stop").alias("end_char"), F.col("s.tokens").cast("long").alias("n_tokens"), F.col("s.crossing").alias("n_crossing"))


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back.

    A null html is an empty payload; of rows with equal payloads and ids one is the response; null ids
    win over no other. No pages, no rows.
    """
    folder, manifest = write_warc(table(spark, sf_dir, "pages"))
    found = resolved(read_warc(spark, folder, manifest))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: 160 bits of SHA-1 as base32: four characters for five hexadecimal digits.
OP9_SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p
), last AS (
  SELECT h, max(page_id) AS best, count(*) AS times FROM d GROUP BY h
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, CAST(1 + i // 4 * 5 AS BIGINT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN times > 1 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN times > 1 AND page_id <> best THEN best END AS refers_to
FROM d JOIN last USING (h)
"""


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every token of every document goes in sequences of 4096.

    A null or empty text has the end token alone; null sources are one queue; repeated rows are packed
    each. No documents, no rows.
    """
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt with the first turns of one of its group of five.

    Null roles and texts are empty; turns with equal numbers, repeated rows too, follow by digest; rows
    with a null conv_id are of no conversation. No conversations, no rows.
    """
    own = saved(conversation_paths(table(spark, sf_dir, "conversations")), "conversations")
    h = F.crc32(F.col("id").cast("string").cast("binary")) % 9
    heads = own.where("id % 5 = 0").select(F.col("id").alias("of"), first_turns(F.col("path"), F.lit(8)).alias("head"))
    joined = own.withColumns({"of": F.expr("id - id % 5"), "h": h}).join(heads, "of", "left")
    path = F.concat(F.coalesce(first_turns(F.col("head"), F.col("h")), F.lit(b"")), turns_after(F.col("path"), F.col("h")))
    return prefix_trie(saved(joined.select("id", path.alias("path")), "rebuilt"))


OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL
), named AS (
  SELECT conv_id, turn, {'d': md5(concat(octet_length(encode(r)), ':', r, t)), 'n': octet_length(encode(t))} AS v FROM turns
), own AS (
  SELECT conv_id, list(v ORDER BY turn NULLS FIRST, v.d) AS turns, hex(encode(CAST(conv_id AS VARCHAR))) AS x FROM named GROUP BY conv_id
), numbered AS (
  SELECT conv_id, turns, (4294967295 - list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, d: xor(c >> 1, 3988292384 * (c & 1))))) % 9 AS h FROM own
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns FROM numbered a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5
), paths AS (
  SELECT conv_id, len(turns) AS n, turns, list_transform(range(0, len(turns) + 1), lambda d: array_to_string(list_transform(turns[1:d], lambda v: v.d || v.n), '')) AS keys FROM rebuilt
), members AS (
  SELECT conv_id, n, d, keys[d + 1] AS key, CASE WHEN d > 0 THEN keys[d] END AS parent, CASE WHEN d > 0 THEN turns[d].n ELSE 0 END AS size FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM paths)
), nodes AS (
  SELECT key, d, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved, max(n) = d AS leaf,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends FROM members GROUP BY key, d
), sums AS (
  SELECT p.keys[a + 1] AS key, sum(saved) AS saved, count(*) FILTER (leaf) AS leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM nodes) v JOIN paths p USING (conv_id) GROUP BY 1
), children AS (
  SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent
)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(c.n, 0) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
FROM nodes v LEFT JOIN nodes u ON v.parent = u.key LEFT JOIN children c ON c.parent = v.key JOIN sums s ON s.key = v.key
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, an edit planted in every 97th pair of document and word, with their near words, forms and roots.

    A null text has no words; a null doc_id counts as an empty one; repeated rows count each. No
    documents, no rows.
    """
    docs = table(spark, sf_dir, "documents")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    # Deleting never lengthens a run. ASCII runs take the faster function.
    runs = runs.where("length(run) >= 5").withColumn("run", F.when(F.length("run") == F.octet_length("run"), F.lower("run")).otherwise(F.translate("run", upper, upper.lower())))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    place = (F.col("h") % F.length("run")).cast("int")
    edited = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % 97 == 0, edited).otherwise(F.col("run")).alias("word")).where("length(word) >= 5")
    return variant_groups(words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 3")).select("word", "form", "root", "n", "n_near", "form_n")


#: CRC-32 bit by bit over the bytes' hexadecimal digits; near words share what is left with a hole in place of a code point.
OP12_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL
), bytes AS (
  SELECT *, hex(encode(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run))) AS x FROM runs
), hashed AS (
  SELECT run, times, 4294967295 - list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, d: xor(c >> 1, 3988292384 * (c & 1)))) AS h FROM bytes
), words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), holes AS (
  SELECT word, n, substr(word, 1, i) || '_' || substr(word, i + 2) AS hole, substr(word, 1, i) || substr(word, i + 2) AS shorter FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS near, b.n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.shorter = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.shorter = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS m, first(near ORDER BY n DESC, encode(near)) AS near FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN near END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word
), path AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT p.word, f.form FROM path p JOIN forms f ON p.root = f.word WHERE f.form IS NOT NULL
), ends AS (
  SELECT p.word, p.root FROM path p JOIN forms f ON p.root = f.word WHERE f.form IS NULL
)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON f.word = e.word
"""


def op13_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document, by a ledger of its distinct texts that is empty at first.

    A null text is an empty one without spans; repeated rows have equal findings. No documents, no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = findings(docs, scan(docs)).select("rest.doc_id", "spans")
    base = F.array(*(F.lit(r.name) for r in BASE))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_base = F.filter("spans", lambda s: F.array_contains(base, s["rule"]))
    count = lambda name: F.size(F.filter("spans", lambda s: s["rule"] == name)).cast("long").alias(f"n_{name}")
    return found.select("doc_id", *(count(r.name) for r in BASE), F.sha2(listed(of_base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


#: Kinds in their order, with the pattern, the group whose length counts, and that length. RE2 would fold letters beyond ASCII too.
_OP13_RULES = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("forge_token", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
]
#: DuckDB takes patterns and groups as constants only, so each kind has a branch.
_OP13_KIND = """
  SELECT row, {place} AS place, '{name}' AS kind, list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x)) AS gaps,
    list_transform(regexp_extract_all(t, '{pattern}', 0), lambda x: length(x)) AS sizes, list_transform(regexp_extract_all(t, '{pattern}', {group}), lambda x: length(x) >= {least}) AS good
  FROM d WHERE regexp_matches(t, '{pattern}')"""
OP13_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS row FROM documents
), kinds AS ({" UNION ALL ".join(_OP13_KIND.format(place=i, name=n, pattern=p, group=g, least=m) for i, (n, p, g, m) in enumerate(_OP13_RULES))}
), each_match AS (
  SELECT row, place, kind, gaps, sizes, good, unnest(range(1, len(sizes) + 1)) AS i FROM kinds
), spans AS (
  SELECT row, place, kind, list_sum(gaps[1:i]) + list_sum(sizes[1:i]) - sizes[i] AS a, list_sum(gaps[1:i]) + list_sum(sizes[1:i]) AS b FROM each_match WHERE good[i]
), told AS (
  SELECT row, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
    string_agg(concat(kind, ':', CAST(a AS BIGINT), ':', CAST(b AS BIGINT)), ',' ORDER BY a, place) FILTER (place < 3) AS base,
    string_agg(concat(kind, ':', CAST(a AS BIGINT), ':', CAST(b AS BIGINT)), ',' ORDER BY a, place) AS spans
  FROM spans GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (row)
"""


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_rendezvous_sharding": op2_rendezvous_sharding,
    "op3_crf_quality": op3_crf_quality,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_temperature_mixing": op5_temperature_mixing,
    "op6_site_template_removal": op6_site_template_removal,
    "op7_iblt_fingerprint": op7_iblt_fingerprint,
    "op8_section_token_counts": op8_section_token_counts,
    "op9_warc_round_trip": op9_warc_round_trip,
    "op10_mixture_packing": op10_mixture_packing,
    "op11_conversation_prefix_trie": op11_conversation_prefix_trie,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_blob_ledger_secrets": op13_blob_ledger_secrets,
}
ORACLES = {
    "op4_substring_dedup": OP4_SQL,
    "op9_warc_round_trip": OP9_SQL,
    "op11_conversation_prefix_trie": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_blob_ledger_secrets": OP13_SQL,
}
