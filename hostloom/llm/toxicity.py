"""Toxicity by compression distance.

Two zstandard dictionaries share a base trained on ordinary text and differ in what they end
with: segments typical of toxic or of ordinary documents. A window that the toxic dictionary
compresses better than the ordinary one is suspicious. Windows are single words, the
smallest unit in which offence shows, written four bytes a character so that frame overhead
doesn't hide the difference; equal windows are compressed once. A document's score is a
logistic function of its largest differences, calibrated on labelled documents.

No dictionary is trained on toxic text: the segments are single words chosen by document
frequency. The README has held-out figures of this and of dictionaries trained per class.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.llm.common import batched, text_array, texts_of

#: Labelled documents of each class that the model is fitted on, the first by hash of their id.
SAMPLE = 3000
#: Characters of a sampled document that training reads at most, so that the sample is bounded.
#: Scores always read whole texts.
READ = 50_000
#: Bytes of the shared base dictionary, and of each class's segments at most.
BASE, SEGMENTS = 32_768, 8_192
#: Remembered windows in a worker: less than 100 MB.
MEMORY = 400_000

_WORD = re.compile(r"[^\s.,!?;:|*$%&#<>()\"]+")
_ENCODING = "utf-32-le"


class Model(NamedTuple):
    """Dictionary contents and the logistic weights of :func:`features`."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


def windows(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _bytes(window: str) -> bytes:
    return f" {window} ".encode(_ENCODING, "surrogatepass")


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters(
        window_log=18, hash_log=15, chain_log=15, search_log=6, min_match=5, target_length=64, strategy=zstandard.STRATEGY_LAZY2, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content), compression_params=settings)


class Distances:
    """Compressed length with the ordinary dictionary less that with the toxic one, by window."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)
        self.known: dict[str, int] = {}

    def __call__(self, window: str) -> int:
        found = self.known.get(window)
        if found is None:
            plain = _bytes(window)
            found = len(self.ordinary.compress(plain)) - len(self.toxic.compress(plain))
            if len(self.known) >= MEMORY:
                self.known.clear()
            if len(window) <= 64:
                self.known[window] = found
        return found


def features(distance: Distances, text: str) -> tuple[float, ...]:
    """Of a text's different windows: the largest differences, how many are large, how many there are."""
    found = [distance(w) for w in set(windows(text))]
    best = sorted(found, reverse=True)[:3] + [0, 0, 0]
    return float(best[0]), float(sum(best[1:3])), math.log1p(sum(x >= 6 for x in found)), math.log1p(sum(x >= 4 for x in found)), math.log1p(len(found))


def score(weights: tuple[float, ...], found: tuple[float, ...]) -> float:
    z = weights[0] + sum(w * x for w, x in zip(weights[1:], found, strict=True))
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def _segments(words: list[str]) -> bytes:
    """The first words that fit, the most telling last: close to the text means cheap to refer to."""
    kept, size = [], 8
    for word in words:
        size += len(word.encode(_ENCODING, "surrogatepass")) + 4
        if size > SEGMENTS:
            break
        kept.append(word)
    return f" {' '.join(reversed(kept))} ".encode(_ENCODING, "surrogatepass")


def _telling(of: Counter, other: Counter, n: int, m: int, least: float) -> list[str]:
    """Words in at least ``least`` of one class's documents, by log ratio to the other class."""
    ratio = {w: math.log((k + 0.5) / (n + 1)) - math.log((other[w] + 0.5) / (m + 1)) for w, k in of.items() if k >= max(3, least * n)}
    return sorted(ratio, key=lambda w: (-ratio[w], w))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, shrink: float = 1e-3) -> tuple[float, ...]:
    """Logistic regression by Newton's steps: intercept first, then weights."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink * np.eye(len(w)), x.T @ (y - p) - shrink * w)
        w += np.clip(change, -2, 2)
    return tuple(w.tolist())


def train(rows: list[tuple[str, int]]) -> Model:
    """Dictionaries from one half of the labelled texts, calibration on the other half.

    Copies count once. Without texts of both classes the model scores every text 0 nearly.
    """
    unique = sorted(dict(rows).items(), key=lambda r: (zlib.crc32(r[0].encode("utf-8", "surrogatepass")), r[0]))
    classes = [[t for t, y in unique if y == k] for k in (0, 1)]
    if min(map(len, classes)) < 4:
        return Model(b"", b"", (-35.0, 0.0, 0.0, 0.0, 0.0, 0.0))
    fitted = [c[: max(2, len(c) * 2 // 3)] for c in classes]
    seen = [Counter(w for t in c for w in set(windows(t))) for c in fitted]
    n, m = len(fitted[1]), len(fitted[0])
    toxic = _telling(seen[1], seen[0], n, m, 0.02)
    toxic = [w for w in toxic if math.log((seen[1][w] + 0.5) / (n + 1)) - math.log((seen[0][w] + 0.5) / (m + 1)) > 2.5]
    ordinary = [w for w in _telling(seen[0], seen[1], m, n, 0.006) if w not in toxic]
    ends = _segments(toxic), _segments(ordinary)
    sample = [_bytes(w) for t in fitted[0][:700] for w in windows(t)][:60_000]
    try:
        base = zstandard.train_dictionary(BASE, sample, k=64, d=8, level=6).as_bytes()
    except zstandard.ZstdError:  # too few or too uniform samples for entropy tables
        base = b"".join(sample)[-BASE:]
    model = Model(base + ends[0], base + ends[1][-len(ends[0]) :], ())
    distance = Distances(model.toxic, model.ordinary)
    held = [(t, k) for k, c in enumerate(classes) for t in c[len(fitted[k]) :]]
    x, y = np.array([features(distance, t) for t, _ in held]), np.array([k for _, k in held], float)
    return model._replace(weights=logistic(x, y))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Train on at most ``most`` labelled documents of each class that are not held out.

    The documents are the first by a hash of their id. Ids labelled both ways are left out.
    """
    order = F.xxhash64(F.col("doc_id").cast("string"))
    usable = labels.where(F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id")) != 2))
    one = usable.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most")
    one = one.select("doc_id", "toxic", order.alias("_order"))
    some = [one.where(F.col("toxic") == k).orderBy("_order", "doc_id").limit(most) for k in (0, 1)]
    ids = F.broadcast(some[0].unionByName(some[1]))  # at most 2 * most rows of three numbers
    sample = texts_of(docs).join(ids, "doc_id").where("text is not null")
    rows = sample.select(F.substring("text", 1, READ).alias("text"), "toxic").distinct().collect()
    by_text: dict[str, set[int]] = {}
    for r in rows:
        by_text.setdefault(r.text, set()).add(r.toxic)
    return train([(t, y.pop()) for t, y in by_text.items() if len(y) == 1])


def _scored(docs: DataFrame, model: Model, schema, make):
    """``make(batch, scores)`` over all Arrow batches."""
    batched(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of tens of kB

    def run(batches):
        known = shared.value
        distance = Distances(known.toxic, known.ordinary) if known.toxic else lambda window: 0
        for batch in batches:
            scores = [score(known.weights, features(distance, t)) for t in text_array(batch.column("text")).to_pylist()]
            yield make(batch, np.array(scores, float))

    return docs.mapInArrow(run, schema)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every whole text (null: empty); repeated rows give repeated rows."""
    make = lambda batch, found: pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "score"])
    return _scored(texts_of(docs), model, "doc_id bigint, score double", make)


def without_toxic(docs: DataFrame, model: Model, limit: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose texts score below ``limit``."""
    return _scored(docs, model, docs.schema, lambda batch, found: batch.filter(pa.array(found < limit)))
