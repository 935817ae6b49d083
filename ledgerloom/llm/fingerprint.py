"""Invertible Bloom lookup sketches of documents, in DataFrame and SQL functions only.

A text's paragraphs are its lines; long ones are cut every PIECE code points, those at the head of a
text more finely, so that short texts have several too. Where a text is cut depends on
what stands before only, so texts that begin alike are cut alike, and any two sketches can be compared.

A sketch has three parts of w cells; w is the least power of two that isn't below the number of
distinct paragraph digests. A cell holds a count, an XOR of digests and an XOR of check sums; each
digest is added to one cell of each part, at the low bits of a hash. So a sketch folds to any smaller
w by adding up cells, and two sketches are subtracted cell by cell at the smaller w of the two: equal
paragraphs cancel. Peeling takes out the digests of cells that hold one alone, round after round; if
no cell is left, the paragraphs that only one version has are recovered. Otherwise the pair is tried
again with other hashes and four times as many cells, until it peels; after MAX_TRIES an error is
raised (two different digests would have to share all their cells every time).

Cells are sums and XORs, so a cell of a folded or subtracted sketch is the sum over signed digests.
Every step is an aggregation of (document, cell) rows within a document's own partition: work is
linear in the paragraphs, and no row grows with a text but for the list of its digests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import KEY, column, forget, keyed, saved

#: Code points to a piece at most; in the first HEAD code points of a text, FINE.
PIECE, HEAD, FINE = 96, 256, 16
#: Least cells in each part of a sketch, and of one that is tried again.
LEAST, LEAST_AGAIN = 4, 64
ROUNDS, MAX_TRIES = 8, 12
#: Digests whose cells a task sums up at once, in so many tasks at most; a cell is some 150 bytes there.
TASK_DIGESTS, MOST_TASKS = 100_000, 200_000
#: A chain of aggregations in a task needs no second map before each one's own, which takes a page of memory from the start.
ONE_MAP = {"spark.sql.codegen.aggregate.map.twolevel.enabled": "false"}
#: Ranges of the order of documents at least, and rows to one at most; each is numbered by a task.
RANGES, RANGE_ROWS = 200, 1_000_000


def _units(text: str, size: int) -> str:
    return f"regexp_extract_all({text}, '[^\\\\n]{{1,{size}}}', 0)"


def digests(text: str) -> str:
    """Distinct 64-bit digests of a text's paragraphs."""
    units = f"concat({_units(f'substring({text}, 1, {HEAD})', FINE)}, {_units(f'substring({text}, {HEAD + 1})', PIECE)})"
    return f"array_distinct(transform({units}, u -> xxhash64(u)))"


def _width(n: str, least: int = LEAST) -> str:
    return f"cast(pow(2, ceil(log2(greatest({n}, {least})))) as long)"


def _check(key: str) -> str:
    return f"(xxhash64({key}, 1) & 4294967295L)"


def _cell(key: str, w: str, part: str, seed: int) -> str:
    return f"({part} * {w} + (xxhash64({key}, cast({seed} * 3 + 2 + {part} as int)) & ({w} - 1)))"


def _in_cells(rows: DataFrame, by: list[str], seed: int) -> DataFrame:
    """Cells (by, w, id, n, key, check) of rows (by, w, sign, list of digests)."""
    each = rows.select(*by, "w", "sign", F.explode("list").alias("key")).withColumn("part", F.explode(F.expr("array(0, 1, 2)")))
    each = each.select(*by, "w", F.expr(_cell("key", "w", "part", seed)).alias("id"), F.col("sign").alias("n"), "key", F.expr(_check("key")).alias("check"))
    return each.groupBy(*by, "w", "id").agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"))


def _peel(cells: DataFrame, by: list[str], seed: int) -> DataFrame:
    """One round. Rows of kind 0 are cells, of kind 1 digests found alone, of kind 2 how many were found."""
    own = "named_struct('kind', kind, 'id', id, 'n', n, 'key', key, 'check', check)"
    alone = f"kind = 0 and abs(n) = 1 and check = {_check('key')} and id = {_cell('key', 'w', '(id div w)', seed)}"
    found = cells.select(*by, "w", F.expr(f"inline(if({alone}, array({own}, named_struct('kind', 1, 'id', key, 'n', n, 'key', key, 'check', check)), array({own})))"))
    once = found.groupBy(*by, "w", "kind", "id").agg(*(F.max(c).alias(c) for c in ("n", "key", "check")))  # a digest may be alone in several cells
    out = ", ".join(f"named_struct('kind', 0, 'id', {_cell('key', 'w', str(j), seed)}, 'n', -n, 'key', key, 'check', check)" for j in range(3))
    told = "named_struct('kind', 2, 'id', n, 'n', 1L, 'key', 0L, 'check', 0L)"
    moved = once.select(*by, "w", F.expr(f"inline(if(kind = 1, array({out}, {told}), array({own})))"))
    left = moved.groupBy(*by, "w", "kind", "id").agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"))
    return left.where("not (kind = 0 and n = 0 and key = 0 and check = 0)")


def _dealt(rows: DataFrame, digests: str, by: str) -> DataFrame:
    """rows dealt by a key, to as many tasks as follow from the number of digests."""
    total = rows.agg(F.sum(F.expr(digests))).first()[0] or 0
    return rows.repartition(max(1, min(MOST_TASKS, -(-total // TASK_DIGESTS))), by)


def differences(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, only_a, only_b): how many paragraphs either version has alone, by subtracting and peeling sketches.

    pairs: ``by``, which tells pairs apart and whose first column is a single long, and arrays a and b
    of distinct digests, not null. Equal sets give no row; all others give one.
    """
    pairs = pairs.select(*by, "a", "b", F.expr(_width("size(a)")).alias("wa"), F.expr(_width("size(b)")).alias("wb"))
    # At the smaller width, unless the sizes alone tell that it can't hold the difference.
    fold = "if(abs(size(a) - size(b)) <= 2 * least(wa, wb), least(wa, wb), greatest(wa, wb))"
    found, tables = [], []
    for seed in range(MAX_TRIES):
        width = fold if not seed else f"greatest({LEAST_AGAIN}, wa, wb) * {4 ** (seed - 1)}"
        sides = F.inline(F.expr("array(named_struct('sign', 1L, 'list', a), named_struct('sign', -1L, 'list', b))"))
        signed = _dealt(pairs, "size(a) + size(b)", by[0]).select(*by, F.expr(width).alias("w"), sides)
        cells = _in_cells(signed, by, seed).where("not (n = 0 and key = 0 and check = 0)").withColumn("kind", F.lit(0))
        cells = reduce(lambda rows, _: _peel(rows, by, seed), range(ROUNDS), cells)  # noqa: B023
        count = lambda test: F.coalesce(F.sum(F.when(F.expr(test), F.col("n"))), F.lit(0))
        tried = saved(cells.groupBy(*by).agg(count("kind = 2 and id = 1").alias("only_a"), count("kind = 2 and id = -1").alias("only_b"), F.bool_or(F.expr("kind = 0")).alias("failed")), "tried", ONE_MAP)
        found.append(tried.where("not failed").drop("failed"))
        if not tried.where("failed").limit(1).count():
            break
        again = saved(pairs.join(tried.where("failed").select(*by), by, "left_semi"), "again")
        forget(*tables)
        pairs, tables = again, [again]
    else:
        raise RuntimeError(f"sketches that don't peel with {MAX_TRIES} sizes")
    forget(*tables)
    return reduce(DataFrame.union, found)


def sketches(sets: DataFrame, by: list[str]) -> DataFrame:
    """(by[0], fingerprints): for rows (by, list of digests), a map from by[1] to the sketch as text.

    The text is w, a bar, and cell:count:digests:checks of each cell that isn't zero, the last two in
    hexadecimal. A set without digests has no entry in the map.
    """
    rows = sets.select(*by, F.expr(_width("size(list)")).alias("w"), F.lit(1).cast("long").alias("sign"), "list")
    cells = _in_cells(rows, by, 0).select(*by, "w", F.struct(F.col(by[1]).alias("of"), "id", F.concat_ws(":", "id", "n", F.hex("key"), F.hex("check")).alias("cell")).alias("c"))
    told = cells.groupBy(by[0]).agg(F.sort_array(F.collect_list(F.struct("c.of", "w", "c.id", "c.cell"))).alias("cells"))
    one = "filter(cells, x -> x.of = o)"
    return told.select(by[0], F.expr(f"map_from_entries(transform(array_distinct(transform(cells, x -> x.of)), o -> struct(o, concat({one}[0].w, '|', array_join(transform({one}, x -> x.cell), ',')))))").alias("fingerprints"))


def _likeness(a: Column, b: Column, differ: Column) -> Column:
    """Jaccard similarity of two sets of so many paragraphs, of which so many are in one alone; 1 if neither has any."""
    both = a + b
    return F.when(both == 0, F.lit(1.0)).otherwise((both - differ) / (both + differ).cast("double"))


def version_likeness(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of an edited version of it, and how alike they and the next text's are.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or
    all) of the next document, in descending order of id; after the last comes the first. Returns
    id, row_key, next_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next (Jaccard similarities of the paragraphs, from the sketches' differences), and
    only_text and only_edited, the numbers of paragraphs that one of the versions has alone.

    A null text is an empty one, whose sketch has no cells; two empty texts are alike (1). Null ids
    come last, equal ids in the order of the table; each repeated row is a document. A single
    document is its own next. An empty table gives no rows. Columns other than id and text aren't read.
    """
    base = keyed(docs.select(column(id).alias("i"), F.coalesce(column(text).cast("string"), F.lit("")).alias("t")), KEY)
    base = base.select(F.col(KEY).alias("k"), "i", "t")
    # The order of documents: numbered within ranges of ids, the ranges chained by their first rows.
    down = (F.col("i").desc_nulls_last(), F.col("k").asc())
    ranges = max(RANGES, -(-base.count() // RANGE_ROWS))
    ranged = saved(base.select("k", "i", F.length("t").alias("n")).repartitionByRange(ranges, *down).withColumn("r", F.spark_partition_id()), "order")
    within = Window.partitionBy("r").orderBy(*down)
    led = ranged.select("k", "n", "r", F.lead("k").over(within).alias("next"), F.row_number().over(within).alias("at"))
    firsts = led.where("at = 1").select("r", F.col("k").alias("first"))
    chain = firsts.select(F.col("r"), F.coalesce(F.lead("first").over(Window.orderBy("r")), F.first("first").over(Window.orderBy("r"))).alias("after"))  # a row for each range
    led = saved(led.join(chain, "r").select(F.col("k").alias("for"), F.coalesce("next", "after").alias("k"), F.expr("cast(n div 3 as int)").alias("cut")), "next")
    following = base.join(led, "k").select(F.col("for").alias("k"), F.col("i").alias("next_id"), "cut", F.expr("substring(t, 1, cut)").alias("tail"), F.expr(digests("t")).alias("kn"))
    # Both joins are on k and read the same columns, so they read one shuffle of the texts.
    both = base.join(following, "k").select("k", "i", "next_id", "t", "kn", F.expr("concat(substring(t, 1, length(t) - cut), tail)").alias("e"))
    ready = both.select("k", "i", "next_id", F.length("t").cast("long").alias("n_chars"), F.sha2("e", 256).alias("edited_sha256"), F.expr(digests("t")).alias("ka"), F.expr(digests("e")).alias("ke"), "kn")
    ready = saved(ready, "digests")
    forget(ranged, led)
    versions = F.expr("inline(array(named_struct('which', 0, 'a', ka, 'b', ke), named_struct('which', 1, 'a', ka, 'b', kn)))")
    found = differences(ready.select("k", versions), ["k", "which"])
    only = lambda which, c: F.coalesce(F.max(F.when(F.col("which") == which, F.col(c))), F.lit(0))
    found = found.groupBy("k").agg(only(0, "only_a").alias("only_text"), only(0, "only_b").alias("only_edited"), (only(1, "only_a") + only(1, "only_b")).alias("unlike_next"))
    rows = _dealt(ready, "size(ka) + size(ke)", "k")
    told = sketches(rows.select("k", F.expr("inline(array(named_struct('which', 0, 'list', ka), named_struct('which', 1, 'list', ke)))")), ["k", "which"])
    rows = rows.join(found, "k", "left").join(told, "k", "left")
    size = {c: F.size(c) for c in ("ka", "ke", "kn")}
    print_of = lambda which: F.coalesce(F.col("fingerprints")[which], F.lit(f"{LEAST}|"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        F.col("i").alias(id), F.col("k").alias("row_key"), "next_id", "n_chars", "edited_sha256", print_of(0).alias("fingerprint"), print_of(1).alias("edited_fingerprint"),
        _likeness(size["ka"], size["ke"], zero("only_text") + zero("only_edited")).alias("near_edited"), _likeness(size["ka"], size["kn"], zero("unlike_next")).alias("near_next"), zero("only_text").alias("only_text"), zero("only_edited").alias("only_edited"),
    )
