"""What several operators of this subpackage share: Arrow batches, words, hashes, shared folders."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch. Texts may be long, so both stay small.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
#: Text bytes that numpy handles at a time; a longer text is a block of its own.
#: Its arrays of numbers take tens of times as many bytes, in every worker.
BLOCK = 1 << 18
#: For Python workers, which outlive tasks and stages: what a task frees goes back to the system, Arrow's memory too.
#: A task has its own core, so a tokenizer starts no threads beside it.
WORKER = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(4 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system", "TOKENIZERS_PARALLELISM": "false"}

#: The white space of the word definition ``[^\x20\x09-\x0D]+``.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def batched(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that Python stages get and what workers hold, and let them import this library."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    home, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if home not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, (known.get("PYTHONPATH", ""), home)))
    for key, value in WORKER.items():
        known.setdefault(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor reaches.

    Only a plain local master may go without that setting, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="hostloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/hostloom-{uuid.uuid4().hex}"


def texts_of(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with the id as the 64-bit integer that Arrow schemas name, whatever integer it is in the table."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def settled(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: a lineage cut that outlives executors."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dense(table: DataFrame, key: str, value: str, bits: int) -> Column:
    """A table of at most ``2 ** bits`` rows as one array, 0 where a key is missing."""
    every = table.sparkSession.range(1 << bits).join(table, F.col("id") == F.col(key), "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce(value, F.lit(0).cast("bigint")).alias("v")))), lambda x: x.v)).scalar()


def top_bits(h: Column, bits: int) -> Column:
    """The highest bits of a 64-bit hash."""
    return F.shiftrightunsigned(h, 64 - bits)


def bit_of(h: Column) -> Column:
    """A 64-bit cell with the bit that the lowest six bits of a hash name."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63).cast("bigint")).cast("int"))


def perhaps_among(keys: DataFrame, columns: Sequence[str], bits: int = 17) -> Column:
    """A test for rows whose ``columns`` may occur in ``keys``: never false for one that does.

    The keys' hashes set bits in a table of ``2 ** bits`` 64-bit cells, whatever their
    number. It keeps most other rows out of the shuffle of an exact join that follows.
    """
    place = F.xxhash64(*columns)
    cells = keys.groupBy(top_bits(place, bits).alias("cell")).agg(F.bit_or(bit_of(place)).alias("bits"))
    return F.element_at(dense(cells, "cell", "bits", bits), (top_bits(place, bits) + 1).cast("int")).bitwiseAND(bit_of(place)) != 0


class Block(NamedTuple):
    """Consecutive texts of a batch: rows [first, last), their bytes and where each begins."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column without nulls (null: empty) and with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def blocks(texts: pa.Array, most: int = BLOCK) -> Iterator[Block]:
    """Cut a text column into blocks of about ``most`` bytes; every text stays whole."""
    if not len(texts):
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield Block(first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * BLOCK)
            self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(size - 1, x, np.uint64)), dtype=np.uint64) for x in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_BYTES, _ITEMS = _Powers(_MULTIPLIER), _Powers(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a finaliser with full avalanche)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers = _BYTES) -> np.ndarray:
    """64-bit hashes of the value sequences [start, end): equal content, equal hash."""
    up, down = powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_MULTIPLIER))


class Words(NamedTuple):
    """Words of a block: byte spans, hashes, and per text the first word's index."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def runs_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true within each text: starts, ends, and per text the first run's index."""
    n = len(inside)
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    edges = offsets[offsets < n]
    opens = inside.copy()
    opens &= ~before[:-1]
    opens[edges] = inside[edges]
    after = np.zeros(n + 1, bool)
    after[:-1] = inside
    closes = inside & ~after[1:]
    tails = offsets[offsets > 0] - 1
    closes[tails] = inside[tails]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words_of(block: Block) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text of a block."""
    starts, ends, first = runs_of(~_SPACE[block.data], block.offsets)
    return Words(starts, ends, span_hashes(block.data, starts, ends), first)


def windows_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` consecutive words of one text, and each window's first word."""
    room = np.repeat(words.first[1:], np.diff(words.first)) - np.arange(len(words.starts)) if len(words.starts) else np.zeros(0, np.int64)
    at = np.flatnonzero(room >= size)
    return span_hashes(words.hashes, at, at + size, _ITEMS), at


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over each text's stretch."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
