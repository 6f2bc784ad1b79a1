"""Periodic runs of words by string synchronising sets.

A run is a stretch of words with smallest period q, at least twice as long, that can't be
extended. Periods below :data:`DIRECT` are found by comparing the text with itself moved by
that many words. Above, scale t = 4, 8, 16, ... is in charge of periods in [3t, 6t):

* Windows of t words with a period of at most t/3 are set aside; they lie in runs that
  smaller scales have found. Every other window has a hash of its content. A position is
  selected if the least hash among the windows that start in the next t + 1 positions is that
  of the first or of the last one. Equal stretches of 2t words are so selected alike, and any t
  positions hold a selected one unless 3t - 1 words from the first on are highly periodic.
* Two selected positions with the same 2t words at a distance in [3t, 6t) propose that
  distance. Hashes extend it both ways, comparing words confirms it.
* What that omits begins with a whole period inside a highly periodic stretch: two runs of a
  small period q that meet. Their roots are aligned in one way only, which gives the
  distances, q apart each; they are extended and confirmed in the same way.

Documents are handled in blocks, with a word that occurs nowhere else between two of them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hostloom.llm.common import _ITEMS, _MULTIPLIER, Block, blocks, mixed, text_array, words_of

#: The smallest scale, and the least period that the scales are in charge of.
SCALE, DIRECT = 4, 12
#: The least length of a run that is reported.
LEAST = 12

SCHEMA = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


class Stretches:
    """64-bit hashes of stretches of one sequence: equal content, equal hash. Running sums are taken once."""

    def __init__(self, x: np.ndarray):
        up, self.down = _ITEMS.upto(len(x) + 1)
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_MULTIPLIER))

    def windows(self, t: int) -> np.ndarray:
        return mixed((self.sums[t:] - self.sums[:-t]) * self.down[: len(self.sums) - t])


def _moved(x: np.ndarray, q: int) -> np.ndarray:
    """Runs (start, end, period) of period ``q``, smaller periods included, by direct comparison."""
    same = np.zeros(len(x) - q + 2, np.int8)
    same[1:-1] = x[:-q] == x[q:]
    edge = np.diff(same)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + q
    enough = end - start >= 2 * q
    return np.stack([start[enough], end[enough], np.full(enough.sum(), q)], 1)


def _least_of(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by running minima of blocks."""
    pad = -len(x) % width
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, 1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    count = len(x) - width + 1
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])


def _covered(runs: np.ndarray, t: int, count: int) -> np.ndarray:
    """Which of the windows of ``t`` words lie in a run with a period of at most t/3."""
    fits = runs[(runs[:, 2] * 3 <= t) & (runs[:, 1] - runs[:, 0] >= t)]
    steps = np.zeros(count + 1, np.int64)
    np.add.at(steps, fits[:, 0], 1)
    np.add.at(steps, fits[:, 1] - t + 1, -1)
    return np.cumsum(steps[:-1]) > 0


def _selected(hashes: Stretches, t: int, runs: np.ndarray) -> np.ndarray:
    """The synchronising set of scale ``t``."""
    seen = hashes.windows(t) >> np.uint64(1)
    if len(seen) <= t:
        return np.zeros(0, np.int64)
    nothing = np.iinfo(np.uint64).max
    seen[_covered(runs, t, len(seen))] = nothing
    least = _least_of(seen, t + 1)
    return np.flatnonzero((least != nothing) & ((least == seen[: len(least)]) | (least == seen[t:])))


def _proposed(hashes: Stretches, t: int, at: np.ndarray) -> np.ndarray:
    """Pairs (position, distance) of selected positions with equal contexts of 2t words, 3t to 6t apart."""
    if len(at) < 2:
        return np.zeros((0, 2), np.int64)
    context = hashes.of(at, at + 2 * t)
    order = np.argsort(context, kind="stable")
    at, context = at[order], context[order]
    found, live = [], np.arange(len(at) - 1)
    step = 1
    while len(live):
        live = live[live + step < len(at)]
        apart = at[live + step] - at[live]
        near = (context[live + step] == context[live]) & (apart < 6 * t)
        live, apart = live[near], apart[near]
        far = apart >= 3 * t
        found.append(np.stack([at[live[far]], apart[far]], 1))
        step += 1
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _joined(x: np.ndarray, t: int, runs: np.ndarray) -> np.ndarray:
    """Pairs (position, distance) from runs of one small period that meet, for periods in [3t, 6t)."""
    fits = runs[(runs[:, 2] * 3 <= t) & (runs[:, 1] - runs[:, 0] >= 3 * t)]
    fits = fits[np.lexsort((fits[:, 0], fits[:, 2]))]
    out = []
    for (s1, e1, q), (s2, e2, other) in zip(fits[:-1].tolist(), fits[1:].tolist(), strict=True):
        if q != other or s2 > e1:
            continue
        # Where the first run's last root stands in the second run: one place in each period.
        root, second = x[e1 - q : e1], x[s2 : s2 + 2 * q - 1]
        here = next((d for d in np.flatnonzero(second[:q] == root[0]).tolist() if np.array_equal(second[d : d + q], root)), None)
        if here is None:
            continue
        shift = (s2 + here - (e1 - q)) % q
        first = 3 * t + (shift - 3 * t) % q
        for p in range(first, min(6 * t, e1 - s1 + 1, e2 - s2 + 1), q):
            out.append((max(s1, s2 - p), p))
    return np.array(out, np.int64).reshape(-1, 2)


def _alike(hashes: Stretches, a: np.ndarray, b: np.ndarray, most: np.ndarray, ahead: bool) -> np.ndarray:
    """How many words agree from ``a`` and ``b`` on (or before them), ``most`` at most: bisection over hashes."""
    low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
    while (low < high).any():
        half = (low + high + 1) // 2
        if ahead:
            same = hashes.of(a, a + half) == hashes.of(b, b + half)
        else:
            same = hashes.of(a - half, a) == hashes.of(b - half, b)
        low, high = np.where(same, half, low), np.where(same, high, half - 1)
    return low


def _extended(x: np.ndarray, hashes: Stretches, pairs: np.ndarray) -> np.ndarray:
    """The confirmed runs (start, end, period) that proposed pairs lie in."""
    if not len(pairs):
        return np.zeros((0, 3), np.int64)
    at, p = pairs[:, 0], pairs[:, 1]
    ahead = _alike(hashes, at, at + p, len(x) - at - p, True)
    back = _alike(hashes, at, at + p, at, False)
    spans = np.stack([at - back, at + p + ahead, p], 1)
    spans = np.unique(spans[spans[:, 1] - spans[:, 0] >= 2 * p], axis=0)
    good = np.ones(len(spans), bool)
    for k, (s, e, q) in enumerate(spans.tolist()):
        good[k] = np.array_equal(x[s : e - q], x[s + q : e])
    if not good.all():  # a hash collision: compare words along the whole string instead
        again = [_moved(x, q) for q in np.unique(spans[~good, 2]).tolist()]
        return np.concatenate([spans[good], *again])
    return spans


def _smallest(spans: np.ndarray) -> np.ndarray:
    """One row per stretch, with its smallest period: by start, then period."""
    if not len(spans):
        return spans.reshape(0, 3)
    spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
    first = np.ones(len(spans), bool)
    first[1:] = (spans[1:, :2] != spans[:-1, :2]).any(1)
    spans = spans[first]
    return spans[np.lexsort((spans[:, 2], spans[:, 0]))]


def periodic_runs(x: np.ndarray, longest: int | None = None) -> np.ndarray:
    """All runs (start, end, smallest period) of a sequence of integers, at least twice the period long.

    ``longest`` may say that no run is longer, as in a sequence of several texts.
    """
    longest = len(x) if longest is None else longest
    hashes = Stretches(x)
    found = _smallest(np.concatenate([_moved(x, q) for q in range(1, min(DIRECT, len(x) // 2 + 1))] or [np.zeros((0, 3), np.int64)]))
    t = SCALE
    while 6 * t <= longest:
        pairs = _proposed(hashes, t, _selected(hashes, t, found))
        more = _extended(x, hashes, np.concatenate([pairs, _joined(x, t, found)]))
        if len(more):
            found = _smallest(np.concatenate([found, more]))
        t *= 2
    return found


def rewritten(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which original word stands at each place, if the document is one of those that get a period planted.

    With h = crc32 of the id, every tenth document (h % 10 = 0) repeats its words from
    a = (h // 10) % n on with period 1 + (n - a) // (3 + (h // 10) % 8).
    """
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + np.arange(n - a) % p
    return at


def _dropped(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Words that some run contains after its first period."""
    gone = np.zeros(n + 1, np.int64)
    for start, end, q in runs:
        gone[start + q] += 1
        gone[end] -= 1
    return np.cumsum(gone[:-1]) > 0


def _sha(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _rows(block: Block, ids: list[int | None], plant: bool) -> Iterator[tuple]:
    found = words_of(block)
    texts = [block.data[a:b].tobytes().split() for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True)]
    counts = np.diff(found.first)
    hashes = [found.hashes[a:b] for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True)]
    if plant:
        for k, (doc_id, n) in enumerate(zip(ids, counts.tolist(), strict=True)):
            if (at := rewritten(n, doc_id)) is not None:
                hashes[k], texts[k] = hashes[k][at], [texts[k][i] for i in at.tolist()]
    flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
    known = np.unique(flat, return_inverse=True)[1]
    # One word of its own behind each text keeps runs from crossing.
    places = np.arange(len(flat)) + np.repeat(np.arange(len(counts)), counts)
    x = np.zeros(len(flat) + len(counts), np.int64)
    starts = np.append(0, np.cumsum(counts + 1))
    x[starts[1:] - 1] = len(flat) + np.arange(len(counts))
    x[places] = known
    runs = periodic_runs(x, int(counts.max(initial=0)))
    runs = runs[runs[:, 1] - runs[:, 0] >= LEAST]
    bounds = np.searchsorted(runs[:, 0], starts)
    for k, doc_id in enumerate(ids):
        own = [(s - int(starts[k]), e - int(starts[k]), q) for s, e, q in runs[bounds[k] : bounds[k + 1]].tolist()]
        kept = texts[k]
        if own:
            kept = [w for w, gone in zip(kept, _dropped(own, len(kept)).tolist(), strict=True) if not gone]
        yield doc_id, texts[k], own, b" ".join(kept)


def _digest(doc_id: int | None, own: list[tuple[int, int, int]], kept: bytes) -> tuple:
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in own)
    best = min(own, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    longest = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    return doc_id, len(own), *longest, _sha(lines.encode()), _sha(kept)


def run_digests(docs: DataFrame, plant: bool = True) -> DataFrame:
    """Per row of ``docs``: its runs of at least 12 words and its text without their repetitions, as digests.

    ``plant`` rewrites every tenth document first (:func:`rewritten`). Null or empty texts
    have no words and no runs. A null doc_id is kept and nothing is planted in its text.
    Repeated rows give a row each. Texts are handled whole, however long; words are told
    apart by 64-bit hashes.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = [_digest(doc_id, own, kept) for block in blocks(text_array(batch.column(1))) for doc_id, _, own, kept in _rows(block, ids[block.first : block.last], plant)]
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
            columns = zip(*out, strict=True) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], names=names)

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(work, SCHEMA)


def collapsed(docs: DataFrame) -> DataFrame:
    """``doc_id, runs, text`` as they are, nothing planted: each run as (start, length, period), and the text
    without what repeats a run's first period, words joined by one space. Rows as for :func:`run_digests`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = [(doc_id, own, kept) for block in blocks(text_array(batch.column(1))) for doc_id, _, own, kept in _rows(block, ids[block.first : block.last], False)]
            runs = [[{"start": s, "length": e - s, "period": q} for s, e, q in own] for _, own, _ in out]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array(runs, kind), pa.array([r[2].decode() for r in out], pa.string())], names=["doc_id", "runs", "text"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(work, "doc_id bigint, runs array<struct<start bigint, length bigint, period bigint>>, text string")
