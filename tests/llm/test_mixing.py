"""Systematic mixing, periodic runs and the prefix trie against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hostloom.llm import mixing, prefix_trie, queries, runs
from tests.llm.test_texts import words

# --- mixing ---------------------------------------------------------------------------------


def plain_targets(sizes):
    """Shares by weight, what is over its cap shared again until none is above."""
    keys = sorted(sizes, key=lambda s: (s is None, s))
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(keys)}
    target, stopped, left = dict.fromkeys(keys, 0.0), set(), sum(sizes.values())
    while left > 1e-9:
        free = sum(weight[k] for k in keys if k not in stopped)
        if not free:
            break
        for k in keys:
            if k not in stopped:
                target[k] += left * weight[k] / free
        left = 0.0
        for k in keys:
            if target[k] > 3 * sizes[k]:
                left += target[k] - 3 * sizes[k]
                target[k] = 3.0 * sizes[k]
                stopped.add(k)
    return target


def sources(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string, key int, copy string")


ODD = [
    (1, None, "a", "x", 1, "c"), (2, "", "a", None, None, None), (3, "w " * 5000, "a", "x", 1, "c"), (None, "one two", None, "x", 1, "c"),
    (4, "one two", "b", "x", 1, "c"), (4, "one two", "b", "x", 1, "c"), (5, "a\tb\x0bc", "Z", "x", 1, "c"), (6, "é 😀", "😀", "x", 1, "c"), (7, None, "empty", "x", 1, "c"),
]


def test_targets_and_copies(spark):
    make = random.Random(5)
    rows = [(k, "w " * make.choice([0, 1, 3, 40, 300]), make.choice(["s1", "s2", "s2", "s2", "s3", "s10", None]), "", 0, "") for k in range(900)] + ODD
    got = mixing.taken(sources(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    want = plain_targets(sizes)
    by_size = {}
    for s, n in sizes.items():
        by_size.setdefault(n, []).append(want[s])
    of_source = {}
    for r in got:
        assert any(math.isclose(r.target, t, rel_tol=1e-12, abs_tol=1e-9) for t in by_size[r.source_size])
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        of_source.setdefault((r.source_size, r.target), []).append(r)
    for (_, target), own in of_source.items():
        assert abs(sum(r.taken for r in own) - target) <= 2 * max(r.size for r in own)
    assert math.isclose(sum(want.values()), sum(sizes.values()))


def test_mix_is_the_same_however_dealt(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one = sorted(mixing.taken(docs.repartition(1)).collect())
    assert one == sorted(mixing.taken(docs.repartition(7, "doc_id")).collect())
    assert one != sorted(mixing.taken(docs, seed=12).collect())


def test_mixed_rows_keep_clashing_columns(spark):
    docs = sources(spark, ODD)
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns, "_copy"]
    copies = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    words_taken = {}
    for r in mixing.taken(docs).collect():
        words_taken[r.doc_id] = words_taken.get(r.doc_id, 0) + r.taken
    for r in ODD:
        assert copies.get(r[0], 0) * len(words(r[1])) == words_taken[r[0]]


def test_mix_of_nothing(spark):
    assert mixing.taken(sources(spark, [])).collect() == []
    assert mixing.mixed(sources(spark, [])).collect() == []
    assert [tuple(r) for r in mixing.taken(sources(spark, [(1, None, "a", "", 0, "")])).collect()] == [(1, 0, 0, 0.0, 0)]


# --- runs -----------------------------------------------------------------------------------


def plain_runs(x):
    """Every run by moving the sequence along itself, smallest period first."""
    found = {}
    for p in range(1, len(x) // 2 + 1):
        i = 0
        while i + p < len(x):
            if x[i] != x[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(x) and x[i] == x[i + p]:
                i += 1
            if i + p - start >= 2 * p:
                found.setdefault((start, i + p), p)
    return sorted((s, e, p) for (s, e), p in found.items())


@st.composite
def sequences(draw):
    """Random, periodic, nearly periodic, Fibonacci and Thue-Morse words, and squares of such."""
    small = st.integers(0, draw(st.integers(0, 3)))
    kind = draw(st.integers(0, 5))
    n = draw(st.integers(0, 220))
    if kind == 0:
        return draw(st.lists(small, max_size=n))
    if kind == 1:
        root = draw(st.lists(small, min_size=1, max_size=40))
        x = [root[i % len(root)] for i in range(n)]
        for at in draw(st.lists(st.integers(0, max(0, n - 1)), max_size=3)):
            x[at : at + 1] = [9]
        return x
    if kind == 2:  # runs of one small period that meet
        root = draw(st.lists(small, min_size=1, max_size=4))
        return [root[i % len(root)] for part in draw(st.lists(st.integers(1, 90), max_size=6)) for i in range(part)]
    if kind == 3:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 4:
        return [i.bit_count() % 2 for i in range(n)]
    half = draw(sequences())[:90]
    return half + half + draw(st.lists(small, max_size=5)) + half


@settings(max_examples=300, deadline=None)
@given(sequences())
def test_runs_are_all_runs(x):
    assert sorted(map(tuple, runs.periodic_runs(np.array(x, np.int64)).tolist())) == plain_runs(x)


def plain_run_digest(doc_id, text):
    own = words(text)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and own:
        g, n = h // 10, len(own)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        own = [own[i if i < a else a + (i - a) % p] for i in range(n)]
    found = sorted(((s, e - s, p) for s, e, p in plain_runs(own) if e - s >= 12), key=lambda r: (r[0], r[2]))
    gone = [any(s + p <= i < s + n for s, n, p in found) for i in range(len(own))]
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    longest = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    kept = " ".join(w for w, g in zip(own, gone, strict=True) if not g)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    return (doc_id, len(found), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_run_digests_of_odd_rows(spark):
    make = random.Random(8)
    line = lambda n: " ".join(make.choice("ab cd ef gh".split()) for _ in range(n))
    texts = [None, "", " \n\t", "one", "a " * 12, "a " * 11, "é 😀 " * 30, line(300), line(40) * 4, f"{line(70)}\n" * 3, "x\x0b" * 5000, *(line(make.randrange(1, 120)) for _ in range(150))]
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)] + [(None, "b " * 40, "x", 1), (4, texts[4], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, runs string, n_runs int").repartition(3)
    got = sorted(map(tuple, runs.run_digests(docs).collect()), key=repr)
    assert got == sorted((plain_run_digest(r[0], r[1]) for r in rows), key=repr)
    assert sum(runs.rewritten(len(words(t)), k) is not None for k, t in enumerate(texts)) > 5
    plain = {r.doc_id: r for r in runs.collapsed(docs).collect()}
    assert plain[4].text == "a" and [tuple(x) for x in plain[4].runs] == [(0, 12, 1)]
    assert plain[5].text == ("a " * 11).strip() and plain[0].text == ""
    assert runs.run_digests(docs.limit(0)).collect() == []


def test_runs_query_against_plain_runs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 4000").collect()
    got = {r[0]: tuple(r) for r in queries.QUERIES["op12_synchronised_runs"](spark, small).collect()}
    assert all(got[d.doc_id] == plain_run_digest(d.doc_id, d.text) for d in docs)


# --- trie -----------------------------------------------------------------------------------


def plain_trie(rows, rebuild):
    """``rows``: (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns, key=lambda t: t[:2])] for c, turns in own.items()}
    convs = own
    if rebuild:
        convs = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 6
            convs[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    nodes = {}
    for c, path in convs.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    kids, leaves, saved = ({k: 0 for k in nodes} for _ in range(3))
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(members) - 1) * (len(k[-1][1]) if k else 0)
            leaves[k[:d]] += not kids[k]
    ends = lambda k: ",".join(map(str, sorted(c for c in nodes[k] if len(convs[c]) == len(k))))
    return sorted(
        ((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends(k).encode()).hexdigest()) for k, m in nodes.items()), key=repr
    )


def talk(make, count):
    """Conversations with shared beginnings, equal ones, a hot first turn, and turns without numbers, roles or texts."""
    rows, known = [], []
    for c in range(count):
        path = list(make.choice(known))[: make.randrange(6)] if known and make.random() < 0.6 else []
        path += [(make.choice(["user", "bot", None]), make.choice(["x", "yy", "é😀", "", None, "long " * 300])) for _ in range(make.randrange(1, 5))]
        if make.random() < 0.3:
            path = [("user", "hello"), ("bot", "hi")]
        known.append(path)
        turns = [None, *range(1, len(path))] if make.random() < 0.2 else range(len(path))
        rows += [(c * 37 - 300, t, *p) for t, p in zip(turns, path, strict=True)]
    return rows + [(None, 1, "user", "nobody")] * 2


@pytest.mark.parametrize(("count", "block", "fan"), [(0, 100, 2), (1, 100, 2), (150, 100_000, 64), (150, 7, 64), (90, 1, 2), (60, 3, 3)])
@pytest.mark.parametrize("rebuild", [True, False])
def test_trie(spark, count, block, fan, rebuild):
    rows = talk(random.Random(count + block), count)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn int, role string, text string, path string, depth int").repartition(3)
    got = prefix_trie.prefix_nodes(df, rebuild, block=block, fan=fan)
    assert got.columns == prefix_trie.OUTPUT
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(rows, rebuild)


def test_trie_of_one_long_conversation(spark):
    rows = [(c, t, "user", f"turn {t}") for c in (5, 6) for t in range(3000 - c)]
    got = prefix_trie.prefix_nodes(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), False, block=1000, fan=2).collect()
    assert len(got) == 2996 and sum(r.n_leaves for r in got) == 2996 and max(r.saved_tokens for r in got) == sum(len(f"turn {t}") for t in range(2994))


def test_trie_separates_role_and_text(spark):
    rows = [(1, 0, "a", "bc"), (2, 0, "ab", "c"), (3, 0, "", "abc")]
    got = prefix_trie.prefix_nodes(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string"), False).collect()
    assert sorted(r.conv_id for r in got if r.depth) == [1, 2, 3]


def test_words_are_cut_like_bytes():
    assert [w.decode() for w in "a\x0bb\x1cc d".encode().split()] == re.findall(r"[^\x20\x09-\x0D]+", "a\x0bb\x1cc d")
