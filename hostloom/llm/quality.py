"""Quality of documents: rule counts and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are compared, one of trusted documents and one of
the raw corpus. A document's score is the mean log ratio of its n-grams, and one threshold
decides for every document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.llm.common import _SPACE, Block, batched, blocks, mixed, per_text, perhaps_among, text_array, texts_of, windows_of, words_of

#: Buckets of hashed n-grams; the size of every model and of what reaches the driver.
BUCKETS = 1 << 16
ORDERS = (3, 4)
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


class Model(NamedTuple):
    """Log ratio of every bucket and the least mean ratio of a kept document."""

    ratio: np.ndarray
    threshold: float


def grams(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every order, the buckets of a block's n-grams and per text the first one's index."""
    data = block.data.astype(np.uint32)
    for order in ORDERS:
        n = len(data) - order + 1
        if n <= 0:
            yield np.zeros(0, np.int64), np.zeros(len(block.offsets), np.int64)
            continue
        code = np.zeros(n, np.uint32)
        for k in range(order):
            code = (code << np.uint32(8)) | data[k : k + n]
        inside = np.ones(n + 1, bool)  # an n-gram stays within its text
        for k in range(1, order):
            cut = block.offsets[1:] - k
            inside[cut[(cut >= 0) & (cut <= n)]] = False
        if len(block.offsets) > 2 and np.diff(block.offsets).min() < order:
            place = np.repeat(block.offsets[1:], np.diff(block.offsets))[:n]
            inside[:n] = np.arange(n) + order <= place
        at = np.flatnonzero(inside[:n])
        spread = code[at] * np.uint32(0x9E3779B1) + np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)
        yield ((spread ^ (spread >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64), np.searchsorted(at, block.offsets)


def gram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n) over all texts: added up within each task before the shuffle."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for block in blocks(text_array(batch.column(0))):
                for found, _ in grams(block):
                    total += np.bincount(found, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    batched(docs.sparkSession)
    return docs.select(text).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def _as_array(counts: DataFrame) -> np.ndarray:
    """Counts on the driver: at most :data:`BUCKETS` rows."""
    out = np.zeros(BUCKETS)
    for row in counts.collect():
        out[row.bucket] = row.n
    return out


#: Log ratios are added as whole numbers of this part of one: a sum doesn't depend on what stands before it.
UNIT = 1 << 32


def mean_ratios(ratio: np.ndarray, block: Block) -> np.ndarray:
    """Mean log ratio of each text's n-grams, 0 where there are none; the same whatever texts share its block."""
    units = np.rint(ratio * UNIT).astype(np.int64)
    total, n = (np.zeros(len(block.offsets) - 1, np.int64) for _ in range(2))
    for found, first in grams(block):
        # Running sums may wrap around; their differences are right all the same.
        sums = np.append(0, np.cumsum(units[found]))
        total += sums[first[1:]] - sums[first[:-1]]
        n += np.diff(first)
    return total / UNIT / np.maximum(n, 1)


def half(doc_id: Column) -> Column:
    """0 or 1, by a hash of the id: the half of its class that a document is in."""
    return F.pmod(F.shiftright(F.xxhash64(doc_id.cast("bigint").cast("string")), 7), F.lit(2))


def labelled(docs: DataFrame, labels: DataFrame, label: str, which: str = "true", of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Every labelled document: ``doc_id, text, label, part``.

    Ids with both labels or none are left out; ``part`` (0 or 1) halves the documents. ``which`` is a
    condition on ``label`` and ``part``. ``of`` makes other columns of ``doc_id, text`` before the
    join, so that these are shuffled instead of texts; some documents without a label pass through it too.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_most")).where("label = _most")
    ids = known.select("doc_id", "label", half(F.col("doc_id")).alias("part")).where(which)
    rows = texts_of(docs).where(perhaps_among(ids, ["doc_id"]))
    return (of(rows) if of else rows).join(ids, "doc_id")


def best_end(good: np.ndarray, bad: np.ndarray, all_good: int, all_bad: int) -> tuple[int, int]:
    """How many of the first entries, one at least, to cut off for the best sum of both classes' rates.

    Of several the least. Also what that gains, in parts of ``all_good * all_bad``: whole numbers, so
    that equal gains are equal whatever stands before.
    """
    gain = np.cumsum(bad * all_good - good * all_bad)
    best = int(np.argmax(gain))
    return best + 1, int(gain[best])


def cut_point(scores: np.ndarray, good: np.ndarray, bad: np.ndarray | None = None, highest: np.ndarray | None = None) -> float:
    """The threshold with the best sum of both classes' rates; of several, the lowest.

    ``good`` tells of each score if its document is; with ``bad``, both count the documents of rising
    stretches of scores, from ``scores`` to ``highest``, that the threshold doesn't divide.
    """
    if bad is None:
        scores, at = np.unique(scores, return_inverse=True)
        good, bad = (np.bincount(at[flags], minlength=len(scores)) for flags in (good, ~good))
        highest = scores
    all_good, all_bad = int(good.sum()), int(bad.sum())
    if not all_good or not all_bad:
        return 0.0 if all_bad else -np.inf
    end, gain = best_end(good, bad, all_good, all_bad)
    if gain <= 0:
        return -np.inf
    return float(highest[end - 1] + scores[end]) / 2 if end < len(scores) else np.inf


def stretches(rows: DataFrame) -> DataFrame:
    """``low, high, good, bad`` of at most two stretches of scores for each part of a range sort of ``score, label``.

    A part is divided where a cut gains most, so the best of all cuts lies between two stretches.
    """
    each = rows.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad"))
    every = each.agg(F.struct(F.sum("good").alias("good"), F.sum("bad").alias("bad"))).scalar()

    def run(batches):
        low, high, good, bad = np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            more, counts = batch.column("score").to_numpy(), [batch.column(name).to_numpy() for name in ("good", "bad")]
            low, high, good, bad = (np.append(x, y) for x, y in ((low, more), (high, more), (good, counts[0]), (bad, counts[1])))
            end, _ = best_end(good, bad, batch.column("all_good")[0].as_py(), batch.column("all_bad")[0].as_py())
            first = np.array([0, end] if end < len(low) else [0])
            low, high, good, bad = low[first], high[np.append(first[1:], len(low)) - 1], np.add.reduceat(good, first), np.add.reduceat(bad, first)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (low, high, good, bad)], names=["low", "high", "good", "bad"])

    parted = each.orderBy("score").select("*", every.getField("good").alias("all_good"), every.getField("bad").alias("all_bad"))
    return parted.mapInArrow(run, "low double, high double, good bigint, bad bigint")


def scored(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``doc_id, score`` of every row of ``doc_id, text``."""

    def run(batches):
        for batch in batches:
            found = [mean_ratios(ratio, block) for block in blocks(text_array(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(found) if found else [], pa.float64())], names=["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id bigint, score double")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Trusted against raw: half of the documents labelled 1 makes the trusted counts, all others labelled the threshold.

    Raw counts are of all documents. Without labelled documents every ratio is 0 and all
    documents pass. At most two rows for each part of a shuffle reach the driver, besides the counts.
    """
    raw = _as_array(gram_counts(docs))
    trusted = _as_array(gram_counts(labelled(docs.where(half(F.col("doc_id")) == 0), labels, "quality", "label = 1 and part = 0")))
    if not trusted.sum():
        return Model(np.zeros(BUCKETS), -np.inf)
    logs = [np.log((counts + 0.5) / (counts.sum() + 0.5 * BUCKETS)) for counts in (trusted, raw)]
    ratio = logs[0] - logs[1]
    rest = labelled(docs, labels, "quality", "label = 0 or part = 1", lambda rows: scored(rows, ratio))
    found = sorted(map(tuple, stretches(rest).collect()))
    low, high = (np.array([r[k] for r in found], float) for k in (0, 1))
    good, bad = (np.array([r[k] for r in found], np.int64) for k in (2, 3))
    return Model(ratio, cut_point(low, good, bad, high))


def repeat_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            if line in seen:
                n += 1
            seen.add(line)
    return n


def rule_counts(block: Block) -> dict[str, np.ndarray]:
    """The rule counts of every text of a block."""
    words = words_of(block)
    n_words = np.diff(words.first)
    heads = (block.data & 0xC0) != 0x80
    hashes, at = windows_of(words, 3)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    repeated = np.zeros(len(words.starts) + 1, bool)
    if len(at):
        keys = mixed(hashes + owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys, kind="stable")
        same = np.append(False, keys[order][1:] == keys[order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order] = same | np.append(same[1:], False)
        for k in range(3):
            repeated[at[twice] + k] = True
    lines = [repeat_lines(block.data[a:b].tobytes()) for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True)]
    return {
        "n_words": n_words,
        "word_chars": per_text(heads & ~_SPACE[block.data], block.offsets),
        "n_symbols": per_text(_SYMBOLS[block.data], block.offsets),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": per_text(repeated[:-1], words.first),
    }


SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, score double"


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """Rule counts, the rules' verdict, the score and the final verdict of every document.

    Null and empty texts have no words and fail the rules. Repeated rows give repeated rows.
    """
    batched(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.ratio, model.threshold))  # BUCKETS numbers

    def run(batches):
        ratio, threshold = shared.value
        for batch in batches:
            ids, at = batch.column("doc_id"), 0
            for block in blocks(text_array(batch.column("text"))):
                found = rule_counts(block)
                failed = (found["n_words"] < 50) | (100 * found["n_repeat_words"] > 50 * found["n_words"])
                score = mean_ratios(ratio, block)
                size = len(score)
                yield pa.RecordBatch.from_arrays([ids.slice(at, size), *(pa.array(x, pa.int64()) for x in found.values()), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)], names=["doc_id", *found, "base_failed", "kept", "score"])
                at += size

    return texts_of(docs).mapInArrow(run, SCHEMA)
