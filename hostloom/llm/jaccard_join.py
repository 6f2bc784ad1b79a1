"""Documents whose sets of five-word shingles are alike: MinHash LSH forest, then exact checks.

1. Documents with equal sets are one class, named by a hash of the set.
2. Every class has ``TREES`` MinHash signatures, each a path in a prefix trie. A full path
   would hardly ever match; prefixes are shortened until two sets at the threshold meet in
   some tree with the target recall. The classes below one trie node are linked to the least
   one of them (a combined aggregate), so a node with very many is no pairs.
3. Linked classes form components. Within a component every pair is checked on the full sets,
   in blocks of at most about ``SIDE`` by ``SIDE`` classes, so that a component of any size is
   spread over tasks. Blocks return the number of links of each class and a spanning forest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostloom.llm.common import _ITEMS, Block, batched, blocks, perhaps_among, settled, span_hashes, text_array, texts_of, windows_of, words_of

SHINGLE = 5
#: Least Jaccard similarity, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
TREES, DEPTH, RECALL = 16, 8, 0.995
#: Classes on a side of a verification block, and those of small components in one task.
SIDE, TOGETHER = 512, 2_000

_FACTORS = np.random.default_rng(20_011).integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_depth(recall: float = RECALL, similarity: float = NUMERATOR / DENOMINATOR, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix with which sets at ``similarity`` meet in some tree often enough."""
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(block: Block) -> list[np.ndarray]:
    """The sorted different shingles of each text; a shorter text with words is one shingle."""
    words = words_of(block)
    hashes, at = windows_of(words, SHINGLE)
    bounds = np.searchsorted(at, words.first)
    out = []
    for k in range(len(words.first) - 1):
        a, b = words.first[k], words.first[k + 1]
        found = hashes[bounds[k] : bounds[k + 1]] if b - a >= SHINGLE else span_hashes(words.hashes, np.array([a]), np.array([b]), _ITEMS) if b > a else hashes[:0]
        out.append(np.unique(found))
    return out


def class_of(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def paths(found: list[np.ndarray], depth: int) -> np.ndarray:
    """For each set, a hash of each tree's prefix of ``depth`` MinHash values."""
    sizes = np.array([len(x) for x in found])
    some = np.flatnonzero(sizes)
    out = np.zeros((len(found), TREES), np.uint64)
    if not len(some):
        return out
    flat = np.concatenate([found[k] for k in some])
    starts = np.cumsum(sizes[some]) - sizes[some]
    for tree in range(TREES):
        path = np.full(len(some), tree + 1, np.uint64)
        for level in range(depth):
            least = np.minimum.reduceat(flat * _FACTORS[tree * DEPTH + level] >> np.uint64(20), starts)
            path = (path ^ least) * np.uint64(0x9E3779B97F4A7C15)
            path ^= path >> np.uint64(29)
        out[some, tree] = path
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def signatures(docs: DataFrame, depth: int) -> DataFrame:
    """``doc_id, class, n, nodes`` of every row; ``class`` is null for texts without words."""

    def run(batches):
        for batch in batches:
            at = 0
            for block in blocks(text_array(batch.column("text"))):
                found = shingles(block)
                nodes = signed(paths(found, depth))
                n = [len(x) for x in found]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * TREES, pa.int32()), pa.array(nodes.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(n)), pa.array([class_of(x) if len(x) else None for x in found], pa.int64()), pa.array(n, pa.int64()), lists], names=["doc_id", "class", "n", "nodes"])
                at += len(n)

    return texts_of(docs).mapInArrow(run, "doc_id bigint, class bigint, n bigint, nodes array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of all nodes of ``a, b`` edges; the root is the least node.

    Large and small stars in turn: neighbours move to the least one around until every node
    hangs on its root. Each step is written to the shared folder.
    """
    edges = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["k"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = settled(large)
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        held = large.join(low, large["a"] == low["k"])
        small = settled(held.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("k", "m")).distinct())
        moved = small.join(edges, ["a", "b"], "left_anti").isEmpty() and edges.join(small, ["a", "b"], "left_anti").isEmpty()
        edges = small
        if moved:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b")).distinct()


def _links(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Which pairs of sets are alike: exact overlaps by counting shared shingles."""
    both = left if right is None else left + right
    sizes = np.array([len(x) for x in both])
    values, column, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), sizes)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    keep = place[column] >= 0
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(left), len(both if right is None else right)), np.float32)
    for start in range(0, len(shared), 4096):
        a, b = np.searchsorted(column, (start, start + 4096))
        table = np.zeros((len(both), min(4096, len(shared) - start)), np.float32)
        table[row[a:b], column[a:b] - start] = 1
        common += table[: len(left)] @ (table if right is None else table[len(left) :]).T
    common = common.astype(np.int64)  # whole numbers below 2 ** 24: exact as floats
    n, m = sizes[: len(left), None], sizes[None, :] if right is None else sizes[None, len(left) :]
    alike = common * DENOMINATOR >= (n + m - common) * NUMERATOR
    if right is None:
        np.fill_diagonal(alike, False)
    return alike


def _forest(names: np.ndarray, alike: np.ndarray, across: bool) -> np.ndarray:
    """For each row (then column) of a block the least name that links lead to."""
    n = alike.shape[0]
    best = names.copy()
    while True:
        new = best.copy()
        rows, columns = np.nonzero(alike)
        columns = columns + n if across else columns
        np.minimum.at(new, rows, best[columns])
        np.minimum.at(new, columns, best[rows])
        if (new == best).all():
            return best
        best = new


def _verify(table: pa.Table) -> pa.Table:
    """Links of all blocks in a group: ``class, links, least``."""
    keys = list(zip(table["root"].to_pylist(), table["low"].to_pylist(), table["high"].to_pylist(), strict=True))
    names, own = np.array(table["class"].to_pylist(), np.int64), table["block"].to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
    members: dict[tuple, list[int]] = {}
    for i, key in enumerate(keys):
        members.setdefault(key, []).append(i)
    out = []
    for (_, low, high), found in members.items():
        left = [i for i in found if own[i] == low]
        right = [i for i in found if own[i] == high] if high != low else None
        if not left or (right is not None and not right) or len(found) < 2:
            continue
        alike = _links([sets[i] for i in left], None if right is None else [sets[i] for i in right])
        links = np.concatenate([alike.sum(1), alike.sum(0)]) if right is not None else alike.sum(1)
        who = left + (right or [])
        least = _forest(names[who], alike, right is not None)
        out += [(int(names[i]), int(k), int(m)) for i, k, m in zip(who, links, least, strict=True) if k]
    columns = list(zip(*out, strict=True)) or [()] * 3
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["class", "links", "least"])


def verified(docs: DataFrame, classes: DataFrame, parts: DataFrame) -> DataFrame:
    """``class, links, least`` per block of every component ``parts`` (node, root)."""
    sizes = parts.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("root", F.ceil(F.col("size") / SIDE).cast("int").alias("blocks"))
    members = parts.join(sizes, "root").join(classes.select(F.col("class").alias("node"), "rep"), "node")
    members = settled(members.select(F.col("node").alias("class"), "root", "blocks", F.col("rep").alias("doc_id")))
    n = members.count()
    tasks = max(1, -(-n // TOGETHER))

    def sets(batches):
        for batch in batches:
            rows, at, named = [], 0, batch.column("class").to_pylist()
            for block in blocks(text_array(batch.column("text"))):
                for found in shingles(block):
                    if len(found) and class_of(found) == named[at]:
                        rows.append((at, found.tobytes()))
                    at += 1
            take = pa.array([i for i, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("class", "root", "blocks")), pa.array([x for _, x in rows], pa.binary())], names=["class", "root", "blocks", "shingles"])

    wanted = texts_of(docs.where("doc_id is not null")).where(perhaps_among(members, ["doc_id"]))
    full = wanted.join(members, "doc_id").select("class", "root", "blocks", "text").mapInArrow(sets, "class bigint, root bigint, blocks int, shingles binary")
    full = full.dropDuplicates(["class"]).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(tasks))).otherwise(F.xxhash64("root", "low", "high"))
    return dealt.select(group.alias("group"), "root", "low", "high", "block", "class", "shingles").groupBy("group").applyInArrow(_verify, "class bigint, links bigint, least bigint")


def joined(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """``doc_id, class_id, n_copies, n_links, group_id`` of every row of ``docs``.

    ``class_id`` is the least doc_id with the same set of shingles and ``n_copies`` the rows
    with it; ``n_links`` counts the other classes with a similarity of 4/5 or more, found
    with at least the target recall; ``group_id`` is the least doc_id that links lead to.
    Null and empty texts, and rows with a null doc_id, are classes and groups of their own
    (``n_copies`` 1). Repeated rows stay repeated.
    """
    batched(docs.sparkSession)
    rows = settled(signatures(docs, prefix_depth(recall)))
    usable = rows.where("class is not null and doc_id is not null")
    classes = settled(usable.groupBy("class").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("nodes").alias("nodes")))
    nodes = classes.select("class", F.explode("nodes").alias("node"))
    heads = nodes.groupBy("node").agg(F.min("class").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1").select("node", "head")
    parts = components(nodes.join(heads, "node").where("class <> head").select(F.col("class").alias("a"), F.col("head").alias("b")))
    found = settled(verified(docs, classes, parts))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("class").alias("a"), F.col("least").alias("b"))).select(F.col("node").alias("class"), "root")
    named = classes.select("class", "rep", "copies").join(links, "class", "left").join(groups, "class", "left")
    least = named.where("root is not null").groupBy("root").agg(F.min("rep").alias("group_id"))
    named = named.join(least, "root", "left").select("class", "rep", "copies", "links", "group_id")
    own = rows.join(named, (rows["class"] == named["class"]) & rows["doc_id"].isNotNull(), "left")
    return own.select("doc_id", F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("n_copies"), F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "rep", "doc_id").alias("group_id"))


def one_per_group(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs``, all columns, without those that share a group with a smaller doc_id.

    Rows that share a doc_id are one document: they stay or go together. Null ids stay.
    """
    gone = settled(joined(docs, recall).where("group_id < doc_id").select(F.col("doc_id").alias("_hl_id")).distinct())
    test = perhaps_among(gone.select(F.col("_hl_id").alias("doc_id")), ["doc_id"])
    perhaps = F.coalesce(F.col("doc_id").isNotNull() & test, F.lit(False))
    kept = docs.where(perhaps)
    return docs.where(~perhaps).unionByName(kept.join(gone, kept["doc_id"] == gone["_hl_id"], "left_anti"))
