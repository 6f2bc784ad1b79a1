"""Byte-level BPE: exact merges in linear time by backtracking from longest matches.

Bytes map to Latin-1 characters, so that a pyahocorasick automaton over the vocabulary finds
all entries inside a piece in one pass. Encoding takes the longest entry at each place and
falls back to shorter ones where two neighbours could not stand side by side after the
merges; whether they can is a property of the pair alone and is remembered.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from hostloom.llm.common import batched, blocks, text_array, texts_of
from hostloom.llm.pretokens import Vocabulary

RANKS = "byte_bpe_multi_50k.tiktoken"
_NONE = -1
#: Remembered answers on pairs of ids in a worker: less than 100 MB.
PAIRS = 400_000


class Merges:
    """The merges of a rank file: a piece of bytes to ids and back."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.rank = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.size = [len(token) for token in self.token]
        self.automaton = ahocorasick.Automaton()
        for text, rank in self.rank.items():
            self.automaton.add_word(text, rank)
        self.automaton.make_automaton()
        self.shorter = [_NONE] * len(self.token)
        for text, rank in self.rank.items():
            self.shorter[rank] = next((self.rank[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.rank), _NONE)
        self.joined: dict[tuple[int, int], int] = {}
        self.parts = [(rank, rank) for rank in range(len(self.token))]
        self.fits: dict[tuple[int, int], bool] = {}
        for rank in sorted(self.rank.values()):
            self._take_apart(rank)
        self.fits.clear()  # answers given while the table was incomplete

    def _take_apart(self, rank: int) -> None:
        """Find the two entries whose merge makes this one."""
        text = self.token[rank].decode("latin-1")
        left = self.shorter[rank]
        while left != _NONE:
            right = self.rank.get(text[self.size[left] :], _NONE)
            if right != _NONE and left < rank and right < rank and self._apart(left, right):
                self.joined[left, right] = rank
                self.parts[rank] = (left, right)
                return
            left = self.shorter[left]

    def _apart(self, left: int, right: int) -> bool:
        """Whether the merges leave these two side by side.

        Undo the merges of both sides at their common edge, latest first: if a pair met
        there earlier than the merges that hid it, it would have been joined.
        """
        limit = len(self.token) + 1
        while True:
            if self.joined.get((left, right), limit) < limit:
                return False
            if left > right:
                limit = left
                left = self.parts[left][1]
                if left == limit:
                    limit = right + 1
                    right = self.parts[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit = right + 1
                right = self.parts[right][0]
                if right + 1 == limit:
                    limit = left
                    left = self.parts[left][1]
                    if left == limit:
                        return True

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        text = piece.decode("latin-1")
        whole = self.rank.get(text)
        if whole is not None:
            return [whole]
        size, shorter, fits = self.size, self.shorter, self.fits
        longest = [_NONE] * len(text)
        for end, rank in self.automaton.iter(text):
            at = end + 1 - size[rank]
            if longest[at] == _NONE or size[rank] > size[longest[at]]:
                longest[at] = rank
        open_ends = bytearray(b"\1") * (len(text) + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        while at < len(text):
            last = ids[-1] if ids else _NONE
            while token != _NONE:
                end = at + size[token]
                if open_ends[end]:
                    if last == _NONE:
                        break
                    good = fits.get((last, token))
                    if good is None:
                        if len(fits) > PAIRS:
                            fits.clear()
                        good = fits[last, token] = self._apart(last, token)
                    if good:
                        break
                token = shorter[token]
            if token != _NONE:
                ids.append(token)
                at = end
                token = longest[at] if at < len(text) else _NONE
            else:  # nothing fits here: the place is closed and the last token shrinks
                if not ids:
                    raise ValueError("the vocabulary lacks a byte")
                open_ends[at] = 0
                token = ids.pop()
                at -= size[token]
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(2)
def merges(path: str) -> Merges:
    return Merges(path)


@lru_cache(2)
def _vocabulary(path: str) -> Vocabulary:
    table = merges(path)
    return Vocabulary(lambda pieces: [table.encode(piece.encode()) for piece in pieces])


def encoded(path: str, texts: pa.Array) -> Iterator[tuple[np.ndarray, bytes]]:
    """Ids (unsigned 32-bit) and decoded bytes of every text, in order."""
    table, vocabulary = merges(path), _vocabulary(path)
    for block in blocks(texts):
        ids, bounds = vocabulary.block_ids(block)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield ids[a:b], table.decode(ids[a:b].tolist())


def encode_documents(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """All columns of ``docs`` and ``n_tokens``, ``token_ids`` (little-endian unsigned 32 bit), ``decoded``.

    Null and empty texts have no tokens. A column of ``docs`` that has one of the new names
    is replaced. Ids are those of the tiktoken library without special tokens.
    """
    batched(docs.sparkSession)
    path = path or public_tokenizers.path(RANKS)
    kept = [c for c in docs.columns if c not in ("n_tokens", "token_ids", "decoded")]
    schema = docs.select(*kept).schema.add("n_tokens", "long").add("token_ids", "binary").add("decoded", "binary")

    def run(batches):
        for batch in batches:
            found = list(encoded(path, text_array(batch.column(text))))
            new = [pa.array([len(i) for i, _ in found], pa.int64()), pa.array([i.astype("<u4").tobytes() for i, _ in found], pa.binary()), pa.array([d for _, d in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return docs.select(*kept).mapInArrow(run, schema)


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens``, sha256 of the ids as decimals with commas, sha256 of the decoded bytes."""
    batched(docs.sparkSession)
    path = path or public_tokenizers.path(RANKS)

    def run(batches):
        decimal = [str(i).encode() for i in range(len(merges(path).token))]
        for batch in batches:
            rows = [(len(ids), hashlib.sha256(b",".join(map(decimal.__getitem__, ids.tolist()))).hexdigest(), hashlib.sha256(plain).hexdigest()) for ids, plain in encoded(path, text_array(batch.column("text")))]
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts_of(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
