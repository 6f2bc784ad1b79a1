"""Token ids as files: frequency-ranked, byte-aligned, with control bytes apart.

A file (Parquet as the container, so that Spark's commit and any shared store work) holds
documents in ascending id order. Of each document it has the number of ids and two byte
strings: control bytes, two bits per id for the length of its code, four ids to a byte, and
data bytes, the ids' frequency ranks in one to four little-endian bytes. Frequent ids are
short, and decoding needs no branch: numpy looks lengths up by control byte.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostloom.llm.common import batched, blocks, settled, shared_folder, text_array, texts_of
from hostloom.llm.pretokens import Vocabulary

VOCABULARY = "byte_bpe_50k.json"
END = 2

#: For each control byte the lengths of its four codes.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
_BYTE = np.arange(4, dtype=np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks below 2**32."""
    ranks = ranks.astype("<u4")
    extra = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = extra
    control = padded[::4] | padded[1::4] << 2 | padded[2::4] << 4 | padded[3::4] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), data[_BYTE <= extra[:, None]].tobytes()


def unpack(n: int, control: bytes, data: bytes) -> np.ndarray:
    """The ``n`` ranks that :func:`pack` was given."""
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    out = np.zeros((n, 4), np.uint8)
    out[_BYTE < sizes[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary, by byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(hidden)}}


def piece_ids(tokenizer, pieces: list[str]) -> list[list[int]]:
    """The ids of each of :func:`hostloom.llm.pretokens.split`'s pieces.

    A piece of characters below U+0100, whose classes are settled, is what a byte-level
    tokenizer's own split would leave, so its model merges the bytes at once; others, and those
    of any other tokenizer, take the whole of it.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    cut = tokenizer.pre_tokenizer
    bytewise = isinstance(cut, ByteLevel) and cut.use_regex and not cut.add_prefix_space and tokenizer.normalizer is None
    plain = [bytewise and (piece.isascii() or max(piece) < "\u0100") for piece in pieces]
    whole = iter(tokenizer.encode_batch_fast([piece for piece, p in zip(pieces, plain, strict=True) if not p], add_special_tokens=False))
    merged, shown = tokenizer.model.tokenize, byte_characters()
    return [[token.id for token in merged(piece.encode().decode("latin-1").translate(shown))] if p else next(whole).ids for piece, p in zip(pieces, plain, strict=True)]


@lru_cache(2)
def _vocabulary(path: str) -> Vocabulary:
    tokenizer = _tokenizer(path)
    return Vocabulary(lambda pieces: piece_ids(tokenizer, pieces))


@lru_cache(2)
def special_tokens(path: str) -> tuple[str, ...]:
    """Strings that the tokenizer cuts out of a text before it splits the rest."""
    return tuple(t.content for t in _tokenizer(path).get_added_tokens_decoder().values())


def document_ids(path: str, texts: pa.Array, end: int):
    """The ids of every text with the end id, in order."""
    vocabulary, special = _vocabulary(path), [s.encode() for s in special_tokens(path)]
    for block in blocks(texts):
        ids, bounds = vocabulary.block_ids(block)
        odd = any(s in block.data.tobytes() for s in special)
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            found = ids[a:b]
            if odd and any(s in (plain := block.data[block.offsets[k] : block.offsets[k + 1]].tobytes()) for s in special):
                found = np.array(_tokenizer(path).encode(plain.decode(), add_special_tokens=False).ids, np.uint32)
            yield np.append(found, np.uint32(end))


def encode(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """``doc_id, n, ids`` with the ids as little-endian 16-bit numbers where all of a text fit, else 32-bit."""
    batched(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        for batch in batches:
            found = list(document_ids(path, text_array(batch.column("text")), end))
            plain = [x.astype("<u2" if x.max() < 1 << 16 else "<u4").tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, found), pa.int64()), pa.array(plain, pa.binary())], names=["doc_id", "n", "ids"])

    return texts_of(docs).mapInArrow(run, "doc_id bigint, n bigint, ids binary")


def _numbers(n: int, plain: bytes) -> np.ndarray:
    return np.frombuffer(plain, "<u2" if len(plain) == 2 * n else "<u4").astype(np.uint32)


def frequencies(ids: DataFrame) -> DataFrame:
    """``id, n``: how often each id occurs, added up within each task before the shuffle."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = [_numbers(n, plain) for n, plain in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            more = np.bincount(np.concatenate([*found, np.zeros(0, np.uint32)]), minlength=len(total))
            more[: len(total)] += total
            total = more
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    return ids.select("n", "ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def by_rank(counts: DataFrame) -> np.ndarray:
    """The ids from most to least frequent, ties by id: at most one per vocabulary entry."""
    rows = counts.collect()
    return np.array([r.id for r in sorted(rows, key=lambda r: (-r.n, r.id))], np.uint32)


def write(ids: DataFrame, ranked: np.ndarray, path: str) -> None:
    """Write the files of ``encode``'s rows below ``path``: every file a range of ids in ascending order.

    Rows with one doc_id are ordered by their ids' bytes; null ids come first.
    """
    spark = ids.sparkSession
    rank = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)  # one number per vocabulary entry

    def run(batches):
        ranks = shared.value
        for batch in batches:
            coded = [pack(ranks[_numbers(n, plain)]) for n, plain in zip(batch.column("n").to_pylist(), batch.column("ids").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), pa.array([c for c, _ in coded], pa.binary()), pa.array([d for _, d in coded], pa.binary())], names=["doc_id", "n", "control", "data"])

    ordered = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, "doc_id bigint, n bigint, control binary, data binary").write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, ranked: np.ndarray) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files.

    ``start`` is the number of ids of all documents before it. Files are ranges of ids, so
    only one number per file has to be added up outside of it.
    """
    batched(spark)
    shared = spark.sparkContext.broadcast(ranked)  # one number per vocabulary entry

    def run(batches):
        ids = shared.value
        for batch in batches:
            crc = [zlib.crc32(ids[unpack(n, c, d)].astype("<u4").tobytes()) for n, c, d in zip(*(batch.column(x).to_pylist() for x in ("n", "control", "data")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), pa.array(crc, pa.int64()), batch.column("file"), batch.column("place")], names=["doc_id", "n_tokens", "ids_crc32", "file", "place"])

    files = spark.read.schema("doc_id bigint, n bigint, control binary, data binary").parquet(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file")
    number = lambda file: (int(file.split("-")[1]), file)  # noqa: E731  Spark's writers name files by task
    before, starts = 0, []
    for file, n in sorted(((r.file, r.n) for r in files.groupBy(name).agg(F.sum("n").alias("n")).collect()), key=lambda x: number(x[0])):
        starts.append((file, before))
        before += n
    rows = files.select("doc_id", "n", "control", "data", name, F.col("_metadata.row_index").alias("place"))
    rows = rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, file string, place bigint")
    here = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("place")) - F.col("n_tokens")
    known = F.broadcast(spark.createDataFrame(starts, "file string, before bigint"))  # one row per file
    return rows.join(known, "file").select("doc_id", (F.col("before") + here).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """Encode all of ``docs``, write the files to the shared folder, and read them back.

    Null and empty texts have only the end id. Rows that share a doc_id follow each other in
    the order of their ids' bytes; rows with a null doc_id come first.
    """
    ids = settled(encode(docs, path, end))
    ranked = by_rank(frequencies(ids))
    files = shared_folder(docs.sparkSession)
    write(ids, ranked, files)
    return read(docs.sparkSession, files, ranked)
