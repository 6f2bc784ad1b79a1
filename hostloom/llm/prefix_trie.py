"""A prefix trie of conversations, built by union-find over their sorted neighbours.

A conversation is the sequence of its turns, 16 bytes each. Sorted, conversations with a
common beginning are neighbours; an edge between two neighbours is as deep as the beginning
they share (LCP). Edges are taken in descending depth: each joins two components, lifts both to
its depth, one node per turn, and makes (or widens) the branching node there.

A task does this for blocks of its sorted part. Only nodes on the block's first or last
conversation may go on in a neighbouring block: the rest is finished and leaves, and what hung
on those two paths is summed into them. Such contracted forests, two paths each, are
merged by the same union-find: within a task, then :data:`FAN` parts at a time until one is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.llm.common import settled
from hostloom.operators.keyed import join_to_unique

#: Bytes of a turn's digest.
TURN = 16
#: Turns (and conversations) of a block, which is what a task holds at a time besides its longest conversation.
BLOCK = 100_000
#: Forests merged at a time.
FAN = 64
#: Members from which on a parent's children are salted.
HOT = 20_000
#: Most turns that a conversation takes from the first of its hundred.
SHARED = 5

NODE, SPINE, ENDS = 0, 1, 2
FIELDS = [
    ("kind", pa.int32()), ("part", pa.int64()), ("place", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()),
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
    ("path", pa.binary()), ("sizes", pa.list_(pa.int64())), ("own", pa.list_(pa.int64())), ("ids", pa.string()),
]
ARROW = pa.schema(FIELDS)
SCHEMA = (
    "kind int, part bigint, place bigint, key binary, parent_key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, path binary, sizes array<bigint>, own array<bigint>, ids string"
)
OUTPUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes in hex for a turn; the role's length keeps role and text apart."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def own_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's (digest, code points), by turn, null first.

    Equal turn numbers stand in order of the digests. Null roles and texts are empty, rows
    without a conv_id are left out. A conversation is one row, 20 bytes a turn, without its texts.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.col("turn"), turn_digest(role, text).alias("digest"), F.length(text).alias("size"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t.digest.alias("digest"), t.size.alias("size"))).alias("turns"))


def sequences(own: DataFrame) -> DataFrame:
    """``conv_id, path, sizes`` of conversations as they are."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t.digest), ""))
    return own.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["size"].cast("bigint")).alias("sizes"))


def rebuilt(own: DataFrame) -> DataFrame:
    """``conv_id, turns``: h turns of conversation c - c % 100, then c's own after its first h; h = crc32(c) % 6.

    The remainder has the sign of c, as in SQL. At most 199 conversations share a first one.
    """
    first = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("first_id"), F.slice("turns", 1, SHARED).alias("given"))
    both = own.join(first, F.col("conv_id") - F.col("conv_id") % 100 == F.col("first_id"), "left")
    h = (F.crc32(F.col("conv_id").cast("string")) % (SHARED + 1)).cast("int")
    given = F.coalesce(F.slice("given", F.lit(1), h), F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(given, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two conversations share from the start."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        half = (low + high + 1) // 2
        if a[low * TURN : half * TURN] == b[low * TURN : half * TURN]:
            low = half
        else:
            high = half - 1
    return low


def node_keys(path: bytes) -> list[bytes]:
    """A key for every node on a path, from the root on: a digest of the turns so far."""
    so_far, out = hashlib.sha256(), []
    for k in range(0, len(path) + 1, TURN):
        out.append(so_far.copy().digest()[:TURN])
        so_far.update(path[k : k + TURN])
    return out


class Row:
    """A conversation or a path of a contracted forest: its turns, and what hangs on its nodes.

    ``own`` gives by depth [conversations, least conv_id, children, leaves, saved] of what
    hangs on the node but not on a deeper node of a row.
    """

    __slots__ = ("own", "path", "sizes")

    def __init__(self, path: bytes, sizes: Sequence[int], own: dict[int, list[int]]):
        self.path, self.sizes, self.own = path, sizes, own


_NONE = (1 << 63) - 1


class Grown:
    """The trie of sorted rows: parallel lists of nodes, children before parents, the root last."""

    def __init__(self, rows: list[Row]):
        self.rows = rows
        self.lcp = [common(a.path, b.path) for a, b in zip(rows[:-1], rows[1:], strict=True)]
        self.depth, self.row, self.parent, self.ended, self.total = [], [], [], [], []
        count = len(rows)
        root = list(range(count))
        level = [len(r.path) // TURN for r in rows]
        now = [r.own.pop(d, [0, _NONE, 0, 0, 0]) for r, d in zip(rows, level, strict=True)]
        later = [r.own for r in rows]
        heads: list[list[int]] = [[] for _ in rows]
        ended: list[int | None] = list(range(count))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        def finish(c: int) -> int:
            n, low, kids, leaves, saved = now[c]
            kids += len(heads[c])
            size = self.rows[c].sizes[level[c] - 1] if level[c] else 0
            node = len(self.depth)
            self.depth.append(level[c])
            self.row.append(c)
            self.parent.append(-1)
            self.ended.append(ended[c])
            self.total.append([n, low, kids, leaves + (kids == 0), saved + (n - 1) * size])
            for child in heads[c]:
                self.parent[child] = node
            return node

        def lift(c: int, depth: int) -> None:
            while level[c] > depth:
                node = finish(c)
                n, low, _, leaves, saved = self.total[node]
                level[c] -= 1
                here = later[c].pop(level[c], None)
                now[c] = [n, low, 0, leaves, saved] if here is None else [here[0] + n, min(here[1], low), here[2], here[3] + leaves, here[4] + saved]
                heads[c], ended[c] = [node], None

        for k in sorted(range(count - 1), key=lambda k: -self.lcp[k]):
            a, b = find(k), find(k + 1)
            lift(a, self.lcp[k])
            lift(b, self.lcp[k])
            if len(heads[a]) + len(later[a]) < len(heads[b]) + len(later[b]):
                a, b = b, a
            root[b] = a
            x, y = now[a], now[b]
            now[a] = [x[0] + y[0], min(x[1], y[1]), x[2] + y[2], x[3] + y[3], x[4] + y[4]]
            heads[a] += heads[b]
            ended[a] = ended[b] if ended[a] is None else ended[a]
            for d, y in later[b].items():
                x = later[a].get(d)
                later[a][d] = y if x is None else [x[0] + y[0], min(x[1], y[1]), x[2] + y[2], x[3] + y[3], x[4] + y[4]]
            now[b] = heads[b] = later[b] = None
        lift(find(0), 0)
        finish(find(0))

    def open_nodes(self) -> list[bool]:
        """Which nodes lie on the first or the last row and so may go on in a neighbour."""
        least = self.rows[0], self.rows[-1]
        near = [[0] * len(self.rows) for _ in least]
        near[0][0], near[1][-1] = (len(r.path) // TURN for r in least)
        for k, d in enumerate(self.lcp):
            near[0][k + 1] = min(near[0][k], d)
        for k in range(len(self.lcp) - 1, -1, -1):
            near[1][k] = min(near[1][k + 1], self.lcp[k])
        return [d <= near[0][r] or d <= near[1][r] for d, r in zip(self.depth, self.row, strict=True)]

    def contracted(self, is_open: list[bool]) -> list[Row]:
        """The first and the last row with what hangs on their nodes, without that of deeper ones."""
        own = {}
        for k in range(len(self.depth)):
            if is_open[k]:
                n, low, kids, leaves, saved = self.total[k]
                size = self.rows[self.row[k]].sizes[self.depth[k] - 1] if self.depth[k] else 0
                own[k] = [n, low, kids, leaves - (kids == 0), saved - (n - 1) * size]
        for k in own:
            up = self.parent[k]
            if up >= 0:
                n, _, _, leaves, saved = self.total[k]
                mine = own[up]
                mine[0], mine[2], mine[3], mine[4] = mine[0] - n, mine[2] - 1, mine[3] - leaves, mine[4] - saved
        first, last = self.rows[0], self.rows[-1]
        shared = common(first.path, last.path)
        sides = [Row(first.path, first.sizes, {}), Row(last.path, last.sizes, {})]
        for k, values in own.items():
            deep = self.depth[k]
            on_last = deep > shared and self.rows[self.row[k]].path[: deep * TURN] == last.path[: deep * TURN]
            sides[on_last].own[deep] = values
        return sides if first.path != last.path else sides[:1]


class Writer:
    """Output rows by column, handed out as Arrow batches."""

    def __init__(self) -> None:
        self.rows: list[dict] = []

    def node(self, grown: Grown, k: int, known: list[bool], ends: str | None, key: bytes | None, keys: dict[int, list[bytes]]) -> None:
        n, low, kids, leaves, saved = grown.total[k]
        up = grown.parent[k]
        row = {"kind": NODE, "conv_id": low, "depth": grown.depth[k], "n_convs": n, "n_children": kids, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "key": key}
        if up >= 0 and known[up]:
            row["parent_conv_id"] = grown.total[up][1]
        elif up >= 0:
            row["parent_key"] = keys_of(grown, grown.row[up], keys)[grown.depth[up]]
        self.rows.append(row)

    def batch(self) -> pa.RecordBatch:
        out, self.rows = pa.RecordBatch.from_pylist(self.rows, ARROW), []
        return out


def keys_of(grown: Grown, row: int, keys: dict[int, list[bytes]]) -> list[bytes]:
    """Node keys of a row's path, computed once."""
    if row not in keys:
        keys[row] = node_keys(grown.rows[row].path)
    return keys[row]


def spine_rows(forest: list[Row], part: int) -> list[dict]:
    """A contracted forest as output rows; ``own`` holds six numbers a node, the depth first."""
    return [
        {"kind": SPINE, "part": part, "place": k, "path": r.path, "sizes": list(r.sizes), "own": [x for d in sorted(r.own) for x in (d, *r.own[d])]}
        for k, r in enumerate(forest)
    ]


def merged(forests: list[list[Row]], out: Writer, last: bool) -> list[Row]:
    """One forest for several consecutive ones; finished nodes go to ``out``, all of them if these are the last."""
    grown = Grown([r for forest in forests for r in forest])
    is_open = [False] * len(grown.depth) if last else grown.open_nodes()
    known, keys = [not o for o in is_open], {}
    for k in range(len(grown.depth)):
        if known[k]:
            out.node(grown, k, known, None, keys_of(grown, grown.row[k], keys)[grown.depth[k]], keys)
    return [] if last else grown.contracted(is_open)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


NO_ENDS = _sha("")


def plant(batches: Iterator[pa.RecordBatch], block: int, fan: int) -> Iterator[pa.RecordBatch]:
    """Nodes, spines and chunks of ended ids of a sorted part (``conv_id, path, sizes``)."""
    part, out, chunks = TaskContext.get().partitionId(), Writer(), 0
    forests: list[list[Row]] = []
    rows: list[Row] = []
    ids: list[list[int]] = []
    size = 0

    def flush() -> None:
        nonlocal rows, ids, size, chunks
        grown = Grown(rows)
        is_open = grown.open_nodes()
        known, keys = [not o for o in is_open], {}
        for k in range(len(grown.depth)):
            ended = grown.ended[k]
            listed = None if ended is None else ",".join(map(str, ids[ended]))
            if known[k]:
                out.node(grown, k, known, NO_ENDS if listed is None else _sha(listed), None, keys)
            elif listed is not None:
                out.rows.append({"kind": ENDS, "part": part, "place": chunks, "key": keys_of(grown, ended, keys)[-1], "ids": listed})
                chunks += 1
        forests.append(grown.contracted(is_open))
        if len(forests) == fan:
            forests[:] = [merged(forests, out, False)]
        rows, ids, size = [], [], 0

    for batch in batches:
        for conv_id, path, sizes in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if size >= block:
                flush()
                yield out.batch()
            if rows and rows[-1].path == path:
                ids[-1].append(conv_id)
                own = rows[-1].own[len(path) // TURN]
                own[0] += 1
                size += 1
            else:
                rows.append(Row(path, sizes, {len(path) // TURN: [1, conv_id, 0, 0, 0]}))
                ids.append([conv_id])
                size += 1 + len(path) // TURN
    if rows:
        flush()
    if len(forests) > 1:
        forests = [merged(forests, out, False)]
    for forest in forests:
        out.rows += spine_rows(forest, part)
    yield out.batch()


def merge_parts(table: pa.Table, fan: int, last: bool) -> pa.Table:
    """The spines of up to ``fan`` consecutive parts as those of one."""
    found = sorted(table.select(["part", "place", "path", "sizes", "own"]).to_pylist(), key=lambda r: (r["part"], r["place"]))
    forests: dict[int, list[Row]] = {}
    for r in found:
        own = {r["own"][k]: r["own"][k + 1 : k + 6] for k in range(0, len(r["own"]), 6)}
        forests.setdefault(r["part"], []).append(Row(r["path"], r["sizes"], own))
    out = Writer()
    out.rows += spine_rows(merged(list(forests.values()), out, last), found[0]["part"] // fan)
    return pa.Table.from_batches([out.batch()], ARROW)


def merging(fan: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """:func:`merge_parts` as a function of the table alone."""
    return lambda table: merge_parts(table, fan, last)


def digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per key from its chunks of ids, which come in order: no key is ever held whole."""
    now, so_far = None, hashlib.sha256()
    for batch in batches:
        keys, digests = [], []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key == now:
                so_far.update(b",")
            else:
                if now is not None:
                    keys.append(now)
                    digests.append(so_far.hexdigest())
                now, so_far = key, hashlib.sha256()
            so_far.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["key", "ended"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([so_far.hexdigest()], pa.string())], names=["key", "ended"])


def trie(paths: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """The nodes of the trie of ``conv_id, path, sizes``, one row each (:data:`OUTPUT`).

    ``conv_id`` is the smallest member and ``ends_sha256`` digests the members that end at the
    node, ascending. The root has no parent; no conversations, no nodes. Conversations
    without turns are members of the root. Equal conversations spread over tasks, since the
    sort's key ends with conv_id; only ids of chunks, a block's each, meet for their digest.
    """
    ordered = paths.select("conv_id", "path", "sizes").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")

    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return plant(batches, block, fan)

    step = settled(ordered.mapInArrow(planted, SCHEMA))
    chunks = step.where(F.col("kind") == ENDS)
    found, spines = [step.where(F.col("kind") == NODE)], step.where(F.col("kind") == SPINE)
    most = spines.agg(F.max("part")).first()[0] or 0
    last = False
    while not last:
        most //= fan
        last = most == 0
        step = settled(spines.groupBy(F.floor(F.col("part") / fan).alias("group")).applyInArrow(merging(fan, last), SCHEMA))
        found.append(step.where(F.col("kind") == NODE))
        spines = step.where(F.col("kind") == SPINE)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    ended = chunks.select("key", "ids", "part", "place").repartition("key").sortWithinPartitions("key", "part", "place").select("key", "ids").mapInArrow(digest_ends, "key binary, ended string")
    late = every.where("key is not null").join(ended, "key", "left").withColumn("ends_sha256", F.coalesce("ended", F.lit(NO_ENDS))).drop("ended")
    late = settled(late)
    nodes = every.where("key is null").unionByName(late)
    parents = late.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"), F.col("n_children").alias("n"))
    below = nodes.where("parent_key is not null").select("parent_key", *[c for c in OUTPUT if c != "parent_conv_id"])
    named = join_to_unique(below, parents, "parent_key", F.col("conv_id"), hot_rows=HOT).withColumnRenamed("above", "parent_conv_id")
    return nodes.where("parent_key is null").select(OUTPUT).unionByName(named.select(OUTPUT))


def prefix_nodes(conversations: DataFrame, rebuild: bool = True, **options) -> DataFrame:
    """The prefix trie of ``conversations`` (``conv_id, turn, role, text``), rebuilt first unless told otherwise."""
    own = own_turns(conversations)
    if rebuild:
        own = rebuilt(settled(own))
    return trie(sequences(own), **options)
