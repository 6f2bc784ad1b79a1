"""Benchmark decontamination by templates.

Texts become templates: numbers, names and units turn into typed placeholders, other words
are lower-cased. A document holds an item if at least ``share`` of the item's windows of five
template words occur in it and the values behind the placeholders correspond: an item's
value always becomes the same document value, and different values stay different. That
finds questions asked again with other numbers or names. A second template, blind to case and
with names as plain words, finds copies in other case; a copy in other case with other names
as well is found only if enough windows hold no name.

The benchmark's window hashes are the build side of a broadcast hash join. Its size is
checked: a larger benchmark is taken in parts of at most ``PART`` windows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostloom.llm.common import _ITEMS, Block, batched, blocks, runs_of, span_hashes, text_array, texts_of

#: Template words of a window, and the least share of an item's windows in a document.
SIZE, SHARE = 5, 0.8
#: Windows of one broadcast part of the benchmark: 24 bytes each.
PART = 1_000_000

#: Unit words.
UNITS = (
    "mm cm m km inch inches ft feet foot yard yards mile miles mg g kg t lb lbs oz gram grams kilogram kilograms ton tons ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years km/h mph percent dollar dollars euro euros cent cents usd eur gbp "
    "meter meters metre metres kilometer kilometers kilometre kilometres degree degrees celsius fahrenheit watt watts volt volts"
).split()

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_DIGIT = np.isin(np.arange(256), np.arange(0x30, 0x3A))
_WORD = _DIGIT | np.isin(_LOWER, np.arange(0x61, 0x7B)) | (np.arange(256) >= 0x80)
_UPPER = np.isin(np.arange(256), np.arange(0x41, 0x5B))
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?\n:;\"", np.uint8))
_SEPARATOR = np.isin(np.arange(256), np.frombuffer(b".,", np.uint8))
_PLAIN, _NUMBER, _NAME, _UNIT = range(4)
_PLACEHOLDERS = np.array([0, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x428A2F98D728AE22], np.uint64)


def _lower_table() -> np.ndarray:
    """Lower case of every code point of two or three bytes, if it has as many bytes."""
    table = np.arange(1 << 16, dtype=np.uint32)
    for k in range(0x80, 1 << 16):
        low = "σ" if k == 0x3C2 else chr(k).lower()
        if len(low) == 1 and low != chr(k) and (ord(low) < 0x800) == (k < 0x800) and 0x80 <= ord(low) < 1 << 16:
            table[k] = ord(low)
    return table


_LOWER_WIDE = _lower_table()


def _lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 in lower case, byte for byte in place."""
    lower = _LOWER[data]
    lead = np.flatnonzero(data >= 0xC3)
    two, three = lead[data[lead] < 0xE0], lead[(data[lead] >= 0xE0) & (data[lead] < 0xF0)]
    code = (data[two].astype(np.uint32) & 0x1F) << 6 | data[two + 1] & 0x3F
    low = _LOWER_WIDE[code]
    moved = low != code
    two, low = two[moved], low[moved]
    lower[two], lower[two + 1] = 0xC0 | low >> 6, 0x80 | low & 0x3F
    code = (data[three].astype(np.uint32) & 0x0F) << 12 | (data[three + 1].astype(np.uint32) & 0x3F) << 6 | data[three + 2] & 0x3F
    low = _LOWER_WIDE[code]
    moved = low != code
    three, low = three[moved], low[moved]
    lower[three], lower[three + 1], lower[three + 2] = 0xE0 | low >> 12, 0x80 | low >> 6 & 0x3F, 0x80 | low & 0x3F
    return lower


def _hashes_of(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return span_hashes(data, np.append(0, ends[:-1]), ends)


_UNIT_HASHES = np.sort(_hashes_of(UNITS))


class Templates(NamedTuple):
    """Template words of a block: hashes with placeholders, kinds, values, first word per text."""

    hashes: np.ndarray
    kinds: np.ndarray
    values: np.ndarray
    first: np.ndarray


def templates(block: Block, opening: bool = True) -> tuple[Templates, Templates]:
    """Two templates of every text: with names, and without regard to case.

    A number is a run of digits with inner separators. A unit is one of :data:`UNITS` after a
    number. In the first template a name is a word with a capital that doesn't begin a
    sentence; neighbouring names are one. A text's first word begins a sentence if
    ``opening``. In the second template names are words like all others.
    """
    data = block.data
    inside = _WORD[data]
    if len(data) > 2:
        middle = np.flatnonzero(_SEPARATOR[data[1:-1]] & _DIGIT[data[:-2]] & _DIGIT[data[2:]]) + 1
        inside[middle] = True
        edges = np.isin(middle, block.offsets) | np.isin(middle + 1, block.offsets)
        inside[middle[edges]] = False
    starts, ends, first = runs_of(inside, block.offsets)
    if not len(starts):
        none = Templates(np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, np.uint64), first)
        return none, none
    values = span_hashes(_lowered(data), starts, ends)
    count = lambda flags, a, b: (s := np.append(0, np.cumsum(flags)))[b] - s[a]
    numeric = count(_DIGIT[data] | _SEPARATOR[data], starts, ends) == ends - starts
    head = np.zeros(len(starts), bool)
    head[first[:-1][first[:-1] < first[1:]]] = True
    before = np.append(0, ends[:-1])
    sentence = (count(_STOP[data], np.minimum(before, starts), starts) > 0) & ~head | head & opening
    second = data[np.minimum(starts + 1, len(data) - 1)]
    capital = _UPPER[data[starts]] | ((data[starts] == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    name = capital & ~sentence & ~numeric
    after_number = np.append(False, numeric[:-1]) & ~head
    unit = after_number & ~numeric & (_UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, values), len(_UNIT_HASHES) - 1)] == values)
    kinds = np.where(numeric, _NUMBER, np.where(unit, _UNIT, _PLAIN)).astype(np.int8)
    blind = Templates(np.where(kinds == _PLAIN, values, _PLACEHOLDERS[kinds]), kinds, values, first)
    kinds = np.where(name, _NAME, kinds).astype(np.int8)
    goes_on = name & np.append(False, name[:-1]) & ~head & (starts - before == 1)
    if goes_on.any():
        kept = np.flatnonzero(~goes_on)
        values = np.add.reduceat(values * (1 + goes_on.astype(np.uint64) * np.uint64(2)), kept)
        kinds, first = kinds[kept], np.searchsorted(kept, first)
    return Templates(np.where(kinds == _PLAIN, values, _PLACEHOLDERS[kinds]), kinds, values, first), blind


def _windows(found: Templates, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of windows that hold a plain word."""
    n = np.diff(found.first)
    room = np.repeat(found.first[1:], n) - np.arange(len(found.hashes))
    plain = np.append(0, np.cumsum(found.kinds == _PLAIN))
    at = np.flatnonzero(room >= size)
    at = at[plain[at + size] > plain[at]]
    return span_hashes(found.hashes, at, at + size, _ITEMS), at


class Index(NamedTuple):
    """Windows of benchmark items in one kind of template: sorted hashes, item and word of each; templates by item.

    ``rows`` has the benchmark's row of every item; a row can be two items.
    """

    sizes: tuple[int, ...]
    hashes: np.ndarray
    items: np.ndarray
    words: np.ndarray
    templates: Templates
    totals: np.ndarray
    rows: np.ndarray


class Benchmark(NamedTuple):
    """The items' windows in templates with names and without, and the items' ids."""

    named: Index
    blind: Index
    ids: list


def _index(found: Templates, rows: np.ndarray, size: int) -> Index:
    n = np.diff(found.first)
    parts = []
    sizes = sorted({min(size, int(k)) for k in n if k})
    for k in sizes:
        hashes, at = _windows(found, k)
        item = np.searchsorted(found.first, at, "right") - 1
        keep = np.minimum(n[item], size) == k
        parts.append((hashes[keep], item[keep], (at - found.first[item])[keep]))
    hashes, items, words = (np.concatenate(x) if parts else np.zeros(0, t) for x, t in zip(zip(*parts, strict=True) if parts else ((), (), ()), (np.uint64, np.int64, np.int64), strict=True))
    order = np.argsort(hashes, kind="stable")
    return Index(tuple(sizes), hashes[order], items[order], words[order], found, np.bincount(items, minlength=len(rows)), rows)


def index(rows: list[tuple[int, str]], size: int = SIZE) -> Benchmark:
    """Items shorter than a window are one window of their own length; those without a plain word match nothing.

    An item's first word can begin a sentence of a document or stand inside one, so an item
    that begins with a capital has both templates.
    """
    texts = text_array(pa.array([t for _, t in rows], pa.string()))
    block = next(iter(blocks(texts, 1 << 62)), Block(0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64)))
    (opening, blind), (inside, _) = templates(block), templates(block, False)
    filled = np.flatnonzero(np.diff(inside.first))
    more = filled[inside.kinds[inside.first[filled]] == _NAME]
    taken = [np.arange(*inside.first[k : k + 2]) for k in more.tolist()]
    at = np.concatenate([np.zeros(0, np.int64), *taken])
    first = np.append(opening.first, opening.first[-1] + np.cumsum([len(t) for t in taken]).astype(np.int64))
    both = Templates(*(np.append(x, y[at]) for x, y in zip(opening[:3], inside[:3], strict=True)), first)
    every = np.arange(len(rows))
    return Benchmark(_index(both, np.append(every, more), size), _index(blind, every, size), [i for i, _ in rows])


def _consistent(known: Index, item: int, found: Templates, text: int, item_words: np.ndarray, doc_words: np.ndarray, size: int) -> tuple[bool, int]:
    """Whether the values behind placeholders correspond one to one, and how many differ.

    An item's word in several of the windows stands for the document's word in the last of them.
    """
    span = int(np.diff(known.templates.first)[item])
    k = np.arange(min(size, span))
    against = np.full(span, -1)
    against[(item_words[:, None] + k).ravel()] = (doc_words[:, None] + k).ravel()
    a = np.flatnonzero(against >= 0)
    b = found.first[text] + against[a]
    a += known.templates.first[item]
    slot = known.templates.kinds[a] != _PLAIN
    if not slot.any():
        return True, 0
    pairs = {(int(t), int(x), int(y)) for t, x, y in zip(known.templates.kinds[a][slot], known.templates.values[a][slot], found.values[b][slot], strict=True)}
    there, back = {(t, x) for t, x, _ in pairs}, {(t, y) for t, _, y in pairs}
    return len(pairs) == len(there) == len(back), sum(x != y for _, x, y in pairs)


def _aligned(item_word: np.ndarray, shift: np.ndarray, main: int, first: np.ndarray) -> np.ndarray:
    """One hit for each item window, in the order of both texts; hits are sorted by item window.

    Hits in ``first`` are taken as they are. A window without one takes the hit on the diagonal
    of the window before it, else the one nearest to ``main``, that keeps the order. The
    result ends with the hits of ``first``.
    """
    at = item_word + shift
    fixed = np.flatnonzero(first)
    if len(fixed):
        room = np.append(at[fixed], np.iinfo(np.int64).max)[np.searchsorted(item_word[fixed], item_word)].tolist()
    else:
        room = [np.iinfo(np.int64).max] * len(at)
    sure, chosen, last, drift = set(item_word[fixed].tolist()), [], -1, main
    edges = np.append(np.flatnonzero(np.append(True, item_word[1:] != item_word[:-1])), len(at)).tolist()
    places, shifts, firsts = at.tolist(), shift.tolist(), first.tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if int(item_word[a]) in sure:
            h = next(h for h in range(a, b) if firsts[h])
        else:
            good = [h for h in range(a, b) if last < places[h] < room[h]]
            if not good:
                continue
            h = min(good, key=lambda h: (shifts[h] != drift, abs(shifts[h] - main), shifts[h]))
            chosen.append(h)
        last, drift = places[h], shifts[h]
    return np.append(np.array(chosen, np.int64), fixed)


def _best_copy(known: Index, item: int, found: Templates, text: int, item_word: np.ndarray, shift: np.ndarray, size: int, share: float) -> tuple[int, int] | None:
    """Windows found and values changed of the item's best copy in a text, from its hits sorted by item window.

    A copy lies on one diagonal, or drifts from it by few words where it has no hit there.
    Hits between the item's own repeated windows lie on other diagonals and don't count.
    """
    total, span = int(known.totals[item]), int(np.diff(known.templates.first)[item])
    best = None

    def try_copy(chosen: np.ndarray) -> None:
        nonlocal best
        if len(chosen) < share * total or best is not None and len(chosen) < best[0]:
            return
        good, changed = _consistent(known, item, found, text, item_word[chosen], item_word[chosen] + shift[chosen], size)
        if good and (best is None or (len(chosen), -changed) > (best[0], -best[1])):
            best = len(chosen), changed

    order = np.argsort(shift, kind="stable")
    diagonals, begins, counts = np.unique(shift[order], return_index=True, return_counts=True)
    for k in np.flatnonzero(counts >= share * total).tolist():
        try_copy(order[begins[k] : begins[k] + counts[k]])
        if best == (total, 0):
            return best
    if best and best[0] == total:
        return best
    # Copies with words put in or left out: no single diagonal holds them.
    ends = begins + counts
    for k, s in enumerate(diagonals.tolist()):
        last = int(np.searchsorted(diagonals, s + max(2, span // 5), "right"))
        near = np.sort(order[begins[k] : ends[last - 1]])
        if len(np.unique(item_word[near])) < share * total:
            continue
        words, shifts = item_word[near], shift[near]
        for main in diagonals[k:last].tolist():
            try_copy(near[_aligned(words, shifts, main, shifts == main)])
        base = known.templates.first[item] + words[:, None] + np.arange(min(size, span))
        there = found.first[text] + (words + shifts)[:, None] + np.arange(min(size, span))
        same = (known.templates.values[base] == found.values[there]).all(1)
        if same.any() and not same.all():  # unchanged windows first, where a list's windows repeat
            values, n = np.unique(shifts[same], return_counts=True)
            pure = near[same]
            kept = _aligned(item_word[pure], shift[pure], int(values[np.argmax(n)]), np.zeros(len(pure), bool))
            try_copy(pure[kept])
    return best


def leaks(known: Benchmark, block: Block, size: int = SIZE, share: float = SHARE) -> list[tuple[int, int, int, int, int]]:
    """(text, benchmark row, windows found, windows of the item, values changed) of a block's leaked items.

    An item can be found by several templates; the largest share, then the fewest changes count.
    """
    best = {}
    for index, found in zip((known.named, known.blind), templates(block), strict=True):
        for text, item, n, total, changed in _leaks(index, found, size, share):
            key, old = (text, int(index.rows[item])), best.get((text, int(index.rows[item])))
            if old is None or (n / total, -changed) > (old[0] / old[1], -old[2]):
                best[key] = n, total, changed
    return [(*key, *row) for key, row in sorted(best.items())]


def _leaks(known: Index, found: Templates, size: int, share: float) -> list[tuple[int, int, int, int, int]]:
    hits = []
    for k in known.sizes:
        hashes, at = _windows(found, k)
        low, high = np.searchsorted(known.hashes, hashes), np.searchsorted(known.hashes, hashes, "right")
        some = np.flatnonzero(high > low)
        reach = (high - low)[some]
        where = np.repeat(low[some] - np.append(0, np.cumsum(reach)[:-1]), reach) + np.arange(reach.sum())
        words = np.repeat(at[some], reach)
        text = np.searchsorted(found.first, words, "right") - 1
        hits.append((text, known.items[where], known.words[where], words - found.first[text]))
    if not hits:
        return []
    text, item, item_word, word = (np.concatenate(x) for x in zip(*hits, strict=True))
    out = []
    if not len(text):
        return out
    order = np.lexsort((word, item_word, item, text))
    text, item, item_word, word = text[order], item[order], item_word[order], word[order]
    cuts = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1])))
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(text)).tolist(), strict=True):
        total = int(known.totals[item[a]])
        if len(np.unique(item_word[a:b])) < share * total:
            continue
        best = _best_copy(known, int(item[a]), found, int(text[a]), item_word[a:b], word[a:b] - item_word[a:b], size, share)
        if best:
            out.append((int(text[a]), int(item[a]), best[0], total, best[1]))
    return out


def _parts(benchmark: DataFrame, part: int):
    """The benchmark's index in parts of at most about ``part`` windows; each is small enough to broadcast."""
    rows = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    n = rows.agg(F.sum(F.length("text"))).first()[0] or 0  # a window is longer than one character
    shards = max(1, -(-n // (2 * part)))
    for k in range(shards):
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k) if shards > 1 else rows
        yield index([(r.item_id, r.text) for r in mine.collect()])


FOUND = "doc_id bigint, item_id bigint, n_windows bigint, n_item_windows bigint, n_changed bigint"


def contaminated(docs: DataFrame, benchmark: DataFrame, part: int = PART) -> DataFrame:
    """One row per document and benchmark item that it holds.

    ``n_changed`` counts values that differ (0: the passage itself). Null and empty texts,
    and items without words, match nothing. Repeated documents give repeated rows; repeated
    items are one.
    """
    batched(docs.sparkSession)
    out = None
    for known in _parts(benchmark, part):
        shared = docs.sparkSession.sparkContext.broadcast(known)

        def run(batches, shared=shared):
            known = shared.value
            for batch in batches:
                ids, rows, at = batch.column("doc_id"), [], 0
                for block in blocks(text_array(batch.column("text"))):
                    rows += [(ids[at + t].as_py(), known.ids[i], n, total, changed) for t, i, n, total, changed in leaks(known, block)]
                    at += block.last - block.first
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "n_windows", "n_item_windows", "n_changed"])

        found = texts_of(docs).mapInArrow(run, FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, part: int = PART) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item."""
    batched(docs.sparkSession)
    for known in _parts(benchmark, part):
        shared = docs.sparkSession.sparkContext.broadcast(known)

        def run(batches, shared=shared):
            for batch in batches:
                keep, at = np.ones(batch.num_rows, bool), 0
                for block in blocks(text_array(batch.column("text"))):
                    keep[[at + row[0] for row in leaks(shared.value, block)]] = False
                    at += block.last - block.first
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
