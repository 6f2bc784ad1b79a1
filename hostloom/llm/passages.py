"""Removal of long passages that an earlier document has, by suffix automata of reference shards.

1. Anchors: of every window of ``size`` words, the run of ``GRAM`` words with the least hash.
   Equal windows have equal anchors, so only windows whose anchor another document has too
   can repeat. Anchors are a twentieth of the words.
2. Reference: of every such window, the first document that has it (a combined aggregate, so
   a passage in a third of all documents is no hot group). Stretches of these windows are the
   reference: each repeated window is in it once, whatever the number of copies.
3. Shards: the reference is cut into shards of about ``SHARD`` words. Documents go, stretch by
   stretch, only to the shard of the first document with these windows; each task builds the shard's suffix
   automaton and streams its stretches for matching statistics. A shard that very many
   stretches need is given to several tasks.
4. Words under a match of ``size`` or more words from a smaller document id are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.llm.common import _ITEMS, Words, batched, blocks, mixed, settled, span_hashes, text_array, texts_of, windows_of, words_of

#: Words of a window, and of an anchor inside it.
SIZE, GRAM = 50, 10
#: Reference words of a shard, and windows of documents that one task takes with it.
SHARD, LOAD = 100_000, 1_000_000


def _least_before(values: np.ndarray, width: int) -> np.ndarray:
    """For each stretch of ``width`` values, the place of the least one (the first of equals)."""
    best = np.arange(len(values))
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        a, b = best[:-step], best[step:]
        best = np.where(values[b] < values[a], b, a)
        reach += step
    return best


def anchors(words: Words, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of a block: hash, first word, anchor's hash, anchor's first word."""
    hashes, at = windows_of(words, size)
    if not len(at):
        empty = np.zeros(0, np.int64)
        return hashes, at, np.zeros(0, np.uint64), empty
    starts = np.arange(len(words.starts) - gram + 1)
    grams = mixed(span_hashes(words.hashes, starts, starts + gram, _ITEMS))
    place = _least_before(grams, size - gram + 1)[at]
    return hashes, at, grams[place], place


def _changes(places: np.ndarray) -> np.ndarray:
    """Where another anchor begins: neighbouring windows mostly have the same one."""
    return np.flatnonzero(np.append(True, places[1:] != places[:-1])) if len(places) else np.zeros(0, np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _key(words: Words, text: int) -> int:
    """A hash of a text's words: with the id it names the row."""
    a, b = words.first[text : text + 2]
    return int(_signed(span_hashes(words.hashes, np.array([a]), np.array([b]), _ITEMS))[0])


def anchor_rows(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """``doc_id, anchor``: the different anchors of each document."""

    def run(batches):
        for batch in batches:
            ids, at = batch.column("doc_id"), 0
            for block in blocks(text_array(batch.column("text"))):
                words = words_of(block)
                _, window, hashes, places = anchors(words, size, gram)
                text = np.searchsorted(words.first, window, "right") - 1
                new = _changes(places)
                _, once = np.unique(mixed(hashes[new] + text[new].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
                new = new[once]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(text[new] + at)), pa.array(_signed(hashes[new]))], names=["doc_id", "anchor"])
                at += block.last - block.first

    return texts_of(docs.where("doc_id is not null")).mapInArrow(run, "doc_id bigint, anchor bigint")


CANDIDATES = "doc_id bigint, key bigint, n_words bigint, kept_sha256 string, text string, windows array<bigint>, at array<int>"


def candidates(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """Each row's digest if no window can repeat; else its text, candidate windows and their anchors."""
    rows = anchor_rows(docs, size, gram)
    shared = rows.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("anchor")
    mine = rows.join(shared, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("shared"))  # at most a document's own anchors

    def run(batches):
        for batch in batches:
            shared, at = batch.column("shared"), 0
            for block in blocks(text_array(batch.column("text"))):
                words = words_of(block)
                windows, first, hashes, places = anchors(words, size, gram)
                text = np.searchsorted(words.first, first, "right") - 1
                bounds = np.searchsorted(text, np.arange(block.last - block.first + 1))
                out = []
                for k in range(block.last - block.first):
                    a, b = bounds[k], bounds[k + 1]
                    known = shared[at + k].values
                    keep = np.zeros(0, np.int64)
                    if known is not None and len(known):
                        new = _changes(places[a:b])
                        hit = np.isin(_signed(hashes[a:b][new]), known.to_numpy())
                        keep = a + np.flatnonzero(np.repeat(hit, np.diff(np.append(new, b - a))))
                    n = int(words.first[k + 1] - words.first[k])
                    raw = block.data[block.offsets[k] : block.offsets[k + 1]].tobytes()
                    if len(keep):
                        out.append((_key(words, k), n, None, raw.decode(), _signed(windows[keep]), (first[keep] - words.first[k]).astype(np.int32)))
                    else:
                        out.append((_key(words, k), n, _digest(raw, None), None, None, None))
                columns = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(out)), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "key", "n_words", "kept_sha256", "text", "windows", "at"])
                at += block.last - block.first

    return texts_of(docs).join(mine, "doc_id", "left").mapInArrow(run, CANDIDATES)


def _spans(at: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Stretches of words under windows that begin ``at`` (ascending)."""
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > size) + 1
    return [(int(p[0]), int(p[-1]) + size) for p in np.split(at, cuts)]


def _digest(raw: bytes, removed: np.ndarray | None) -> str:
    """sha256 of the kept words joined by one blank."""
    words = raw.translate(_BLANKS).split(b" ")
    words = [w for w in words if w]
    if removed is not None:
        words = [w for w, gone in zip(words, removed.tolist(), strict=True) if not gone]
    return hashlib.sha256(b" ".join(words)).hexdigest()


_BLANKS = bytes(0x20 if 0x09 <= c <= 0x0D else c for c in range(256))


class Automaton:
    """Suffix automaton over stretches of reference words; every state knows its least document."""

    def __init__(self, stretches: list[tuple[int, list[int]]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.least = [-1], [0], [1 << 63]
        last = 0
        for number, (doc, words) in enumerate(stretches):
            if number:
                last = self._extend(last, ("end", number), 1 << 63)  # a word that nothing else has
            for word in words:
                last = self._extend(last, word, doc)
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            above = self.link[state]
            if self.least[state] < self.least[above]:
                self.least[above] = self.least[state]

    def _extend(self, last: int, word, doc: int) -> int:
        following, link, size = self.next, self.link, self.size
        new = len(size)
        following.append({})
        size.append(size[last] + 1)
        link.append(0)
        self.least.append(doc)
        at = last
        while at >= 0 and word not in following[at]:
            following[at][word] = new
            at = link[at]
        if at >= 0:
            to = following[at][word]
            if size[at] + 1 == size[to]:
                link[new] = to
            else:
                twin = len(size)
                following.append(dict(following[to]))
                size.append(size[at] + 1)
                link.append(link[to])
                self.least.append(1 << 63)
                while at >= 0 and following[at].get(word) == to:
                    following[at][word] = twin
                    at = link[at]
                link[to] = link[new] = twin
        return new

    def matches(self, words: list[int], doc: int, least: int) -> Iterator[int]:
        """Ends of matches of ``least`` words that a document before ``doc`` has."""
        following, link, size, first = self.next, self.link, self.size, self.least
        at = length = 0
        for place, word in enumerate(words):
            while at and word not in following[at]:
                at = link[at]
                length = size[at]
            to = following[at].get(word)
            if to is None:
                continue
            at = to
            length += 1
            if length >= least:
                while size[link[at]] >= least:
                    at = link[at]
                    length = size[at]
                if first[at] < doc:
                    yield place + 1


def reference(rows: DataFrame, first: DataFrame, size: int, shards: int) -> DataFrame:
    """``shard, owner, words``: stretches of windows at the first document that has them."""
    owned = first.groupBy("owner").agg(F.collect_list("window").alias("own"))  # at most a document's own windows

    def run(batches):
        for batch in batches:
            out = []
            for owner, text, own, at, windows in zip(batch.column("owner").to_pylist(), batch.column("text").to_pylist(), batch.column("own"), batch.column("at"), batch.column("windows"), strict=True):
                hit = at.values.to_numpy()[np.isin(windows.values.to_numpy(), own.values.to_numpy())]
                words = words_of(next(blocks(text_array(pa.array([text])))))
                out += [(int(owner), _signed(words.hashes[a:b]).tobytes()) for a, b in _spans(hit, size)]
            columns = list(zip(*out, strict=True)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], names=["owner", "words"])

    texts = rows.where("text is not null").select(F.col("doc_id").alias("owner"), "text", "at", "windows")
    return texts.join(owned, "owner").mapInArrow(run, "owner bigint, words binary").select(_shard("owner", shards).alias("shard"), "owner", "words")


def _shard(owner: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(owner), F.lit(shards))


def repeated(rows: DataFrame, size: int) -> DataFrame:
    """``doc_id, key, gone``: starts and ends of removed stretches of every row that has some."""
    # Reference words are at most the candidate windows and ``size`` more per stretch.
    n = rows.agg(F.sum(F.size("windows").cast("bigint"))).first()[0] or 0
    shards = max(1, -(-n // (2 * SHARD)))
    here = rows.where("text is not null").select("doc_id", "key", F.explode(F.arrays_zip("windows", "at")).alias("w")).select("doc_id", "key", F.col("w.windows").alias("window"), F.col("w.at").alias("at"))
    first = settled(here.groupBy("window").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("most")).where("owner < most").select("window", "owner"))
    stretches = settled(reference(rows, first, size, shards))
    # A stretch goes to the shard of the document that has its windows first, and to no other.
    routed = here.join(first, "window").where("owner < doc_id").groupBy("doc_id", "key", _shard("owner", shards).alias("shard"))
    routes = settled(routed.agg(F.collect_list("at").alias("places")))
    # A shard that many stretches need goes to several tasks.
    tasks = routes.groupBy("shard").agg(F.ceil(F.sum(F.size("places")) / LOAD).cast("int").alias("tasks"))

    def cut(batches):
        for batch in batches:
            out = []
            for doc, key, text, shard, task, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text", "shard", "task")), batch.column("places"), strict=True):
                words = words_of(next(blocks(text_array(pa.array([text])))))
                out += [(shard, task, doc, key, a, _signed(words.hashes[a:b]).tobytes()) for a, b in _spans(np.unique(places.values.to_numpy()), size)]
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["shard", "task", "doc_id", "key", "start", "words"])

    texts = rows.where("text is not null").select("doc_id", "key", "text").dropDuplicates(["doc_id", "key"])
    dealt = routes.join(tasks, "shard").withColumn("task", F.pmod(F.xxhash64("doc_id", "key"), F.col("tasks")).cast("int"))
    queries = dealt.join(texts, ["doc_id", "key"]).select("doc_id", "key", "text", "shard", "task", "places").mapInArrow(cut, "shard bigint, task int, doc_id bigint, key bigint, start int, words binary")
    shares = stretches.join(tasks, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "owner", "words")

    def stream(reference: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if reference.num_rows and queries.num_rows:
            known = Automaton([(owner, np.frombuffer(words, np.int64).tolist()) for owner, words in zip(reference["owner"].to_pylist(), reference["words"].to_pylist(), strict=True)])
            for doc, key, start, words in zip(*(queries[c].to_pylist() for c in ("doc_id", "key", "start", "words")), strict=True):
                ends = np.fromiter(known.matches(np.frombuffer(words, np.int64).tolist(), doc, size), np.int64)
                out += [(doc, key, a + start, b + start) for a, b in _spans(ends - size, size)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "key", "a", "b"])

    found = shares.groupBy("shard", "task").cogroup(queries.groupBy("shard", "task")).applyInArrow(stream, "doc_id bigint, key bigint, a int, b int")
    return found.groupBy("doc_id", "key").agg(F.collect_list(F.struct("a", "b")).alias("gone"))


SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def without_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row of ``docs``.

    A word goes if a window of ``size`` words over it also begins in a document with a
    smaller doc_id; windows are those of the input. Null and empty texts have no words.
    Rows with equal doc_id don't remove each other's words; rows with a null doc_id neither
    lose words nor cost others any. Repeated rows stay repeated.
    """
    if not 0 < gram <= size:
        raise ValueError("an anchor is a part of a window")
    batched(docs.sparkSession)
    rows = settled(candidates(docs, size, gram))
    gone = repeated(rows, size)

    def digest(batches):
        for batch in batches:
            out = []
            for n, plain, text, gone in zip(batch.column("n_words").to_pylist(), batch.column("kept_sha256").to_pylist(), batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                if plain is not None:
                    out.append((0, plain))
                    continue
                removed = np.zeros(n, bool)
                for span in gone or ():
                    removed[span["a"] : span["b"]] = True
                out.append((int(removed.sum()), _digest(text.encode(), removed)))
            columns = list(zip(*out, strict=True)) or [()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    narrow = rows.select("doc_id", "key", "n_words", "kept_sha256", "text")
    return narrow.join(gone, ["doc_id", "key"], "left").mapInArrow(digest, SCHEMA)
