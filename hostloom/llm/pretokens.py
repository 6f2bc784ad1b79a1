"""The public tokenizers' split of text before merges, for blocks of texts at a time.

The pattern (``public_tokenizers.PATTERN``) splits into contractions, letters, numbers and
other characters with one leading blank, and white space. Here runs of one character class
are found with numpy, and one vocabulary look-up serves all equal pieces of a block.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np

from hostloom.llm.common import Block, _Powers, span_hashes

SPACE, LETTER, NUMBER, OTHER = range(4)
#: The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The letters that a contraction takes after the apostrophe.
SHORT, LONG = "stmd", ("re", "ve", "ll")
_CHARS = _Powers(0xA0761D6478BD642F)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            out[code] = LETTER
        elif kind == "N":
            out[code] = NUMBER
    out[WHITE_SPACE] = SPACE
    return out


def split(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin; ``offsets`` are the texts' bounds in code points."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[codes]
    begins = np.ones(n, bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[offsets[offsets < n]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], n)
    is_edge = np.zeros(n + 1, bool)
    is_edge[offsets] = True
    # White space before a word: its last character stands apart, and a blank joins the word.
    before = (kind[starts] == SPACE) & ~is_edge[ends]
    last = ends[before] - 1
    begins[last] = True
    blank = last[codes[last] == 0x20]
    begins[blank + 1] = False
    # An apostrophe alone takes the letters of a contraction.
    lone = starts[(ends - starts == 1) & (codes[starts] == 0x27) & ~is_edge[ends]]
    lone = lone[begins[lone] & (kind[lone + 1] == LETTER)]
    for at in lone.tolist():
        if chr(codes[at + 1]) in SHORT:
            take = 1
        elif at + 2 < n and not is_edge[at + 2] and chr(codes[at + 1]) + chr(codes[at + 2]) in LONG:
            take = 2
        else:
            continue
        begins[at + 1] = False
        if at + 1 + take < n:
            begins[at + 1 + take] = True
    return np.flatnonzero(begins)


class Vocabulary:
    """Ids of pieces, remembered by hash in sorted arrays of bounded size.

    ``encode`` maps a list of distinct pieces to their lists of ids. When more than ``most``
    pieces are held, the memory starts afresh, so a worker's memory stays bounded.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 1_500_000):
        self.encode, self.most = encode, most
        self._reset()

    def _reset(self) -> None:
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.tables = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2)]  # large and recent: hash; start << 24 | length

    def _find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        for known, places in self.tables:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                out[hit] = places[at[hit]]
        return out

    def _add(self, keys: np.ndarray, pieces: list[str]) -> np.ndarray:
        found = self.encode(pieces)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        places = (np.cumsum(lengths) - lengths + self.used) << 24 | lengths
        self.used += len(flat)
        recent = [np.concatenate(x) for x in zip(self.tables[1], (keys, places), strict=True)]
        if len(recent[0]) > 1 << 16:
            recent = [np.concatenate(x) for x in zip(self.tables[0], recent, strict=True)]
            order = np.argsort(recent[0], kind="stable")
            self.tables = [(recent[0][order], recent[1][order]), (keys[:0], places[:0])]
        else:
            order = np.argsort(recent[0], kind="stable")
            self.tables[1] = (recent[0][order], recent[1][order])
        return places

    def block_ids(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, one after the other, and where each text's ids begin."""
        text = block.data.tobytes().decode("utf-8")
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = np.zeros(len(block.data) + 1, np.int64)
        np.cumsum((block.data & 0xC0) != 0x80, out=lead[1:])
        offsets = lead[block.offsets]
        starts = split(codes, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(codes))
        keys, first, which = np.unique(span_hashes(codes, starts, ends, _CHARS), return_index=True, return_inverse=True)
        if sum(len(t[0]) for t in self.tables) > self.most:
            self._reset()
        places = self._find(keys)
        new = np.flatnonzero(places < 0)
        if len(new):
            at = first[new]
            places[new] = self._add(keys[new], [text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        places = places[which]
        counts = places & ((1 << 24) - 1)
        done = np.cumsum(counts)
        ids = self.ids[np.repeat((places >> 24) - (done - counts), counts) + np.arange(int(done[-1]))]
        return ids, np.append(0, done)[np.searchsorted(starts, offsets)]
