"""The prefix trie of conversations, by a merge of sorted runs that carry common prefix lengths.

A conversation is a path: for each turn 16 bytes of a digest of its role and text, and 4 of the
text's length in bytes. Paths sort by bytes, so conversations with equal first turns stand together.
Spark deals them to ranges of (path, id), balanced however many share a path. In a range, every
batch becomes a sorted run, in which each path has the length of the prefix that it shares with the
one before (LCP). A loser tree merges the runs: of two heads the one that shares more with the last
path merged is the smaller one, and only heads that share equally much are compared, from there on.

The merged stream needs only the path that is open: a node is finished when a path leaves it. A range
finishes all nodes but those on its first and on its last path, which go on in other ranges. Of these
it gives what it has seen; their counts add up, and where two neighbouring ranges share a prefix,
what both have counted is taken back once. What travels between ranges is a path or two for each.

SHA-256 has no mergeable state, so the ids that end at a node which several ranges share are joined in
pieces by these ranges, and the pieces, in order, are hashed by one task as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import column, saved

#: Bytes of a turn in a path: digest and size.
DIGEST, TURN = 16, 20
#: Bytes of paths to a range, about, and ranges at least. A range's runs are in its task's memory.
RANGE_BYTES, RANGES = 16 << 20, 64
#: Ids that are joined to one piece, and rows to a batch of what a task returns.
PIECE, ROWS = 8192, 20_000
#: What a range tells: finished nodes, those whose parent goes on in other ranges, parts of nodes that do, ids that end at these, its first and last path.
FINISHED, CHILD, PART, ENDS, EDGE = range(5)
_OUT = "kind int, range int, node binary, parent binary, piece int, ids string, first binary, final binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
OUT = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in _OUT.split(", "))])
_BACK = pa.schema([("node", pa.binary()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())])
NO_ENDS = hashlib.sha256().hexdigest()


def conversation_paths(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, path) of every conversation, its turns ordered by ``turn``, null first; of equal ones by digest.

    A null role or text is an empty one; repeated rows are turns each. Rows with a null id are of no
    conversation. Other columns aren't read.
    """
    raw = lambda c: F.coalesce(column(c).cast("string"), F.lit(""))
    size = F.octet_length(raw(text))
    of = F.concat(F.octet_length(raw(role)).cast("string"), F.lit(":"), raw(role), raw(text))
    digest = F.concat(F.unhex(F.md5(of.cast("binary"))), F.unhex(F.lpad(F.hex(size), 8, "0")))
    rows = turns.where(column(id).isNotNull()).select(column(id).cast("long").alias("id"), column(turn).alias("turn"), digest.alias("d"))
    listed = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("turn", "d"))).alias("turns"))  # 40 bytes a turn
    return listed.select("id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["d"])), "")).alias("path"))


def first_turns(path: Column, n: Column) -> Column:
    """The path of the first n turns."""
    return F.substring(path, F.lit(1), (n * TURN).cast("int"))


def turns_after(path: Column, n: Column) -> Column:
    """The path of the turns after the first n."""
    return F.substring(path, (n * TURN + 1).cast("int"), F.octet_length(path))


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """How many turns two paths share; they are known to share so many."""
    at, most = known * TURN, min(len(a), len(b))
    while at < most and a[at : at + TURN] == b[at : at + TURN]:
        at += TURN
    return at // TURN


class Run:
    """Sorted (path, id) with the prefix that each shares with the one before."""

    def __init__(self, rows: list[tuple[bytes, int]]):
        rows.sort()
        self.rows, last = rows, b""
        self.shared = []
        for path, _ in rows:
            self.shared.append(common(last, path))
            last = path


def merged(runs: list[Run]) -> Iterator[tuple[bytes, int, int]]:
    """(path, id, LCP with the one before) of all runs, in order, by a loser tree.

    A run's head carries the prefix that it shares with the last path merged. Inside the tree a loser
    carries what it shares with the winner that beat it, which is what was merged last when it is played again.
    """
    k = len(runs)
    if not k:
        return
    width = 1 << (k - 1).bit_length()
    at = [0] * width
    shared = [0] * width  # of each run's head
    losers = [0] * width  # [0] is the winner
    done = [i >= k or not runs[i].rows for i in range(width)]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)."""
        if done[a] or done[b]:
            return (b, a) if done[a] else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)  # the loser shares with the winner what it shares with the last
        x, y = runs[a].rows[at[a]], runs[b].rows[at[b]]
        lcp = common(x[0], y[0], shared[a])
        here = slice(lcp * TURN, (lcp + 1) * TURN)
        winner, loser = (a, b) if (x[0][here], x[1]) < (y[0][here], y[1]) else (b, a)
        shared[loser] = lcp
        return winner, loser

    level = list(range(width))
    node = width // 2
    while len(level) > 1:
        up = []
        for i in range(0, len(level), 2):
            winner, losers[node + i // 2] = play(level[i], level[i + 1])
            up.append(winner)
        level, node = up, node // 2
    winner = level[0]
    while not done[winner]:
        path, id = runs[winner].rows[at[winner]]
        yield path, id, shared[winner]
        at[winner] += 1
        if at[winner] == len(runs[winner].rows):
            done[winner] = True
        else:
            shared[winner] = runs[winner].shared[at[winner]]
        node = (winner + width) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


class Node:
    """An open node: what of its subtree has been seen here. name is set on the first path and on the last."""

    __slots__ = ("bytes", "children", "conv_id", "convs", "ids", "inner", "leaves", "name", "saved", "waiting")

    def __init__(self, size: int, name: bytes | None):
        self.bytes, self.name, self.inner = size, name, name is None
        self.conv_id, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ids, self.waiting = [], []


def below(name: bytes, path: bytes, depth: int) -> bytes:
    """The name of the node at a depth of a path, from that of its parent."""
    return hashlib.md5(name + path[(depth - 1) * TURN : depth * TURN]).digest()


def size_at(path: bytes, depth: int) -> int:
    return int.from_bytes(path[depth * TURN - 4 : depth * TURN], "big") if depth else 0


def joined(ids: list[int]) -> str:
    return ",".join(map(str, ids))


class Range:
    """The nodes of one range of sorted paths: finished ones, and parts of those on its first and last path."""

    def __init__(self, number: int):
        self.number, self.out = number, {name: [] for name in OUT.names}
        self.open: list[Node] = []
        self.first = self.path = b""

    def _row(self, kind: int, **values) -> None:
        values |= {"kind": kind, "range": self.number}
        for name, cells in self.out.items():
            cells.append(values.get(name))

    def _close(self, depth: int, last: bool) -> None:
        """Finish the deepest open node; of one on the first path or the last, tell what is known."""
        node = self.open.pop()
        above = self.open[-1] if self.open else None
        node.leaves += not node.children
        node.saved += (node.convs - 1) * node.bytes
        if above:
            above.conv_id = node.conv_id if above.conv_id is None else min(above.conv_id, node.conv_id)
            above.convs, above.children, above.leaves, above.saved = above.convs + node.convs, above.children + 1, above.leaves + node.leaves, above.saved + node.saved
        own = {"conv_id": node.conv_id, "depth": depth, "n_convs": node.convs, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved}
        if node.inner and not last:
            for row in node.waiting:
                self._row(FINISHED, parent_conv_id=node.conv_id, **row)
            own["ends_sha256"] = hashlib.sha256(joined(node.ids).encode()).hexdigest()
            if above.inner:
                above.waiting.append(own)
            else:
                self._row(CHILD, parent=above.name, **own)
            return
        for row in node.waiting:
            self._row(CHILD, parent=node.name, **row)
        if node.ids and (not node.inner or depth * TURN == len(self.path)):  # more may end there in other ranges
            for i in range(0, len(node.ids), PIECE):
                self._row(ENDS, node=node.name, piece=i // PIECE, ids=joined(node.ids[i : i + PIECE]))
        elif node.ids:
            own["ends_sha256"] = hashlib.sha256(joined(node.ids).encode()).hexdigest()
        self._row(PART, node=node.name, parent=above.name if above else None, **own)

    def add(self, path: bytes, id: int, shared: int) -> None:
        first = not self.open
        if first:
            self.first = path
            self.open.append(Node(0, hashlib.md5().digest()))
        while len(self.open) - 1 > shared:
            self._close(len(self.open) - 1, False)
        self.path = path
        for depth in range(len(self.open), len(path) // TURN + 1):
            self.open.append(Node(size_at(path, depth), below(self.open[-1].name, path, depth) if first else None))
        node = self.open[-1]
        node.conv_id = id if node.conv_id is None else min(node.conv_id, id)
        node.convs += 1
        node.ids.append(id)

    def end(self) -> None:
        if not self.open:
            return
        for depth in range(1, len(self.open)):
            if self.open[depth].name is None:
                self.open[depth].name = below(self.open[depth - 1].name, self.path, depth)
        self._row(EDGE, first=self.first, final=self.path)
        while self.open:
            self._close(len(self.open) - 1, True)

    def taken(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(cells, OUT.field(name).type) for name, cells in self.out.items()], schema=OUT)
        self.out = {name: [] for name in self.out}
        return batch


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, path, id) of one range, in any order: its runs are sorted, merged, and read as a trie."""
    runs, number = [], 0
    for batch in batches:
        if batch.num_rows:
            number = batch.column("range")[0].as_py()
            runs.append(Run(list(zip(batch.column("path").to_pylist(), batch.column("id").to_pylist(), strict=True))))
    here = Range(number)
    for path, id, shared in merged(runs):
        here.add(path, id, shared)
        if len(here.out["kind"]) >= ROWS:
            yield here.taken()
    here.end()
    yield here.taken()


def _taken_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What two neighbouring ranges have both counted, for rows (final, first): the last path of one, the first of the next."""
    for batch in batches:
        out = {"node": [], "n_children": [], "n_leaves": [], "saved_tokens": []}
        for final, first in zip(batch.column("final").to_pylist(), batch.column("first").to_pylist(), strict=True):
            shared, name = common(final, first), hashlib.md5().digest()
            ends, twice = shared * TURN == len(final), sum(size_at(final, d) for d in range(1, shared + 1))
            for depth in range(shared + 1):
                if depth:
                    name = below(name, final, depth)
                for column, value in zip(out.values(), (name, -int(depth < shared), -int(ends), twice), strict=True):
                    column.append(value)
                twice -= size_at(final, depth)
        yield pa.RecordBatch.from_pydict(out, schema=_BACK)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined pieces of each node; rows (node, range, piece, ids) are sorted."""
    at, state, nodes, found = None, None, [], []

    def told() -> None:
        if at is not None:
            nodes.append(at)
            found.append(state.hexdigest())

    for batch in batches:
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if node == at:
                state.update(b",")
            else:
                told()
                at, state = node, hashlib.sha256()
            state.update(ids.encode())
    told()
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found, pa.string())], names=["node", "ends"])


def prefix_trie(paths: DataFrame, range_bytes: int = RANGE_BYTES, ranges: int = RANGES) -> DataFrame:
    """A row for each node of the trie of ``paths``: (id, path), with distinct ids, not null.

    Every distinct sequence of first turns is a node, the root without turns too; the conversations
    that start with it are its members, those without turns of the root alone. Returns, per node:
    conv_id, its smallest member; depth; parent_conv_id, that of its parent (the root's is null);
    n_convs, its members; n_children; n_leaves, the childless nodes of its subtree, itself included;
    saved_tokens, the sum over its subtree of (members - 1) times the bytes of a node's last text;
    ends_sha256, of the comma-joined ids, ascending, of the members that end there.

    Equal paths are members of the same nodes each. No paths, no rows. A conversation's path, 20 bytes
    a turn, is held by one task. Turns are equal if their 128-bit digests and sizes are.
    """
    size = F.octet_length("path") + 32
    parts = max(ranges, -(-(paths.agg(F.sum(size)).first()[0] or 0) // range_bytes))
    dealt = paths.select("id", "path").repartitionByRange(parts, "path", "id").select(F.spark_partition_id().alias("range"), "path", "id")
    told = saved(dealt.mapInArrow(_nodes, _OUT), "nodes")
    of = lambda kind: told.where(F.col("kind") == kind)
    counts = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    edges = of(EDGE).select("final", F.lead("first").over(Window.orderBy("range")).alias("first"))  # a row for each range
    back = edges.where("first is not null").mapInArrow(_taken_back, "node binary, n_children long, n_leaves long, saved_tokens long")
    rows = of(PART).select("node", "parent", "ends_sha256", *counts).unionByName(back, allowMissingColumns=True)
    sums = (F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))
    shared = saved(rows.groupBy("node").agg(F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("ends_sha256").alias("ends_sha256"), *sums), "shared-nodes")
    pieces = of(ENDS).select("node", "range", "piece", "ids").repartition("node").sortWithinPartitions("node", "range", "piece")
    ends = pieces.mapInArrow(_hashed, "node binary, ends string")
    above = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    top = shared.join(ends, "node", "left").join(above, "parent", "left").withColumn("ends_sha256", F.coalesce("ends", "ends_sha256", F.lit(NO_ENDS)))
    # By range too, so that a node with very many children is as many keys as ranges that hold them.
    names = of(PART).select("range", "node").join(shared.select("node", F.col("conv_id").alias("parent_conv_id")), "node").select("range", F.col("node").alias("parent"), "parent_conv_id")
    children = of(CHILD).drop("parent_conv_id").join(names, ["range", "parent"])
    cols = ["conv_id", "depth", "parent_conv_id", *counts[2:], "ends_sha256"]
    return of(FINISHED).select(cols).unionByName(children.select(cols)).unionByName(top.select(cols))
