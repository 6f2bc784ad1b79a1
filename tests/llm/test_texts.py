"""Operators that judge or rewrite one text at a time, against plain statements of the same."""

import base64
import hashlib
import itertools
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from hostloom.llm import bpe, common, decontaminate, pii, pretokens, quality, token_files, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
POOLS = ["abcdefgst're've'll ", "  \n\t\r\x0b '", ".,!?-_'\"", "éüñçßÀÉ", "0123456789½²", "中文字😀👍🏽", "  　\x85\x1c\x1f", "ľ́٣", " the and 's 't"]


def odd_texts(n=600, seed=1):
    make = random.Random(seed)
    texts = ["".join(make.choice(make.choice(POOLS)) for _ in range(make.randrange(60))) for _ in range(n)]
    return [*texts, "", "a" * 3000, " " * 50, "'", "''s", "x's", "x'st x're x'r", "é" * 500, "\n\n \n x", "x" * 120_000 + " y"]


def frame(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def blocks(texts, most=2000):
    return common.blocks(common.text_array(pa.array(texts, pa.string())), most)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_and_windows():
    texts = odd_texts()
    seen = {}
    for block in blocks(texts):
        found = common.words_of(block)
        hashes, at = common.windows_of(found, 3)
        for k, text in enumerate(texts[block.first : block.last]):
            a, b = found.first[k : k + 2]
            want = words(text)
            assert [block.data[s:e].tobytes().decode() for s, e in zip(found.starts[a:b], found.ends[a:b], strict=True)] == want
            mine = hashes[(at >= a) & (at < b)].tolist()
            assert len(mine) == max(0, len(want) - 2)
            for i, h in enumerate(mine):
                assert seen.setdefault(h, tuple(want[i : i + 3])) == tuple(want[i : i + 3])
    assert len(set(seen.values())) == len(seen)


def test_pretokens_are_those_of_the_pattern():
    pattern, texts = regex.compile(public_tokenizers.PATTERN), odd_texts(1500, 3)
    for block in blocks(texts):
        own = texts[block.first : block.last]
        codes = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32)
        offsets = np.cumsum([0, *map(len, own)])
        assert pretokens.split(codes, offsets).tolist() == [int(o) + m.start() for o, t in zip(offsets, own, strict=False) for m in pattern.finditer(t)]


def test_bpe_is_exact(spark):
    path = public_tokenizers.path(bpe.RANKS)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*odd_texts(), None]
    got = {r.doc_id: r for r in bpe.token_digests(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_keeps_other_columns(spark):
    docs = frame(spark, ["a b", None, ""]).selectExpr("*", "1 as n_tokens", "doc_id as ids")
    out = bpe.encode_documents(docs)
    assert {"ids", "n_tokens", "token_ids", "decoded"} <= set(out.columns) and out.columns.count("n_tokens") == 1
    assert [bytes(r.decoded) for r in out.orderBy("doc_id").collect()] == [b"a b", b"", b""]
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def test_variable_length_codes():
    make = np.random.default_rng(5)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (make.integers(0, 1 << 32, n) >> make.integers(0, 32, n)).astype(np.uint32)
        assert token_files.unpack(n, *token_files.pack(ranks)).tolist() == ranks.tolist()


def test_token_files_round_trip(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    texts = [*odd_texts(300, 7), None, "a<|endoftext|>b"]
    got = {r.doc_id: r for r in token_files.round_trip(frame(spark, texts).repartition(7)).collect()}
    at = 0
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.round_trip(frame(spark, [])).count() == 0


def test_plain_pieces_are_merged_without_the_whole_tokenizer(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    pieces = sorted({*(p for t in odd_texts() for p in regex.findall(public_tokenizers.PATTERN, t)), *map(chr, range(256)), " naïve", " łódź", "０"})
    taken = []

    class Watched:
        normalizer, pre_tokenizer, model = tokenizer.normalizer, tokenizer.pre_tokenizer, tokenizer.model

        def encode_batch_fast(self, some, **options):
            taken.extend(some)
            return tokenizer.encode_batch_fast(some, **options)

    assert token_files.piece_ids(Watched(), pieces) == [tokenizer.encode(p, add_special_tokens=False).ids for p in pieces]
    assert taken == [p for p in pieces if max(p) >= "\u0100"] and " łódź" in taken
    Watched.pre_tokenizer = ByteLevel(add_prefix_space=True)
    taken.clear()
    token_files.piece_ids(Watched(), ["a", " b"])
    assert taken == ["a", " b"] and token_files.piece_ids(Watched(), []) == []
    common.batched(spark)
    assert spark.sparkContext.environment["TOKENIZERS_PARALLELISM"] == "false"


def test_token_files_with_repeated_and_null_ids(spark):
    docs = frame(spark, ["b c", "a", "a"]).selectExpr("case doc_id when 0 then null else 4 end as doc_id", "text", "doc_id as file", "1 as place")
    rows = token_files.round_trip(docs).collect()
    assert sorted((r.start, r.n_tokens, r.doc_id) for r in rows) == [(0, 3, None), (3, 2, 4), (5, 2, 4)]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
GOOD = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": pii.good_card, "phone": pii.good_phone}


def plain_spans(text):
    return {k: [m.span() for m in re.finditer(p, text) if GOOD[k](m.group())] for k, p in PATTERNS.items()}


def test_base_patterns():
    make = random.Random(2)
    for _ in range(8000):
        text = "".join(make.choice("ab@@..1234567890 -+()%é\n") for _ in range(make.randrange(40)))
        assert pii.base_spans(text) == plain_spans(text)
    assert pii.good_card("4111 1111 1111 1111") and not pii.good_card("4111 1111 1111 1112")


@pytest.mark.parametrize("text", ["1" * 300_000, "1." * 100_000, "a" * 300_000 + "@", "1 " * 100_000, "+1" + "(" * 200_000, "@" * 200_000])
def test_patterns_take_linear_time(text):
    pii.base_spans(text)
    pii.chains(text)


def test_field_finds_kinds_and_other_spellings(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = pii.train(pii.labelled_chains(docs))
    texts = [r.text for r in docs.select("text").collect()]
    want = {(i, k, a, b) for i, t in enumerate(texts) for k, found in plain_spans(t).items() for a, b in found}
    got = {(i, *s) for i, found in enumerate(pii.field_spans(field, texts, [[] for _ in texts])) for s in found}
    assert len(got & want) > 0.9 * len(want) and len(got - want) <= 0.05 * len(want)
    assert pii.field_spans(field, ["call (988) 555-2485 now"], [[]]) == [[("phone", 5, 19)]]
    assert pii.field_spans(pii.train([]), ["call (988) 555-2485 now"], [[]]) == [[]]


def test_viterbi_is_the_best_labelling():
    make = np.random.default_rng(3)
    size = len(pii.TAGS)
    field = pii.Field({}, np.zeros((0, size)), pii._allowed() + make.normal(size=(size, size)), make.normal(size=(2, size)))
    scores = make.normal(size=(5, 3, size))
    best = pii.viterbi(field, scores)
    for c in range(5):
        total = lambda t: scores[c, range(3), t].sum() + field.ends[0, t[0]] + pii._FIRST[t[0]] + field.ends[1, t[2]] + field.step[t[0], t[1]] + field.step[t[1], t[2]]  # noqa: B023, E731
        every = [(total(t), t) for t in np.ndindex(size, size, size)]
        assert max(every)[1] == tuple(best[c])


def test_pii_query_columns(spark):
    texts = ["a@b.co and 1.2.3.4", None, "", "+1 (988) 555-2485 é x@y.zz"]
    rows = {r.doc_id: r for r in pii.find(frame(spark, texts), pii.train([])).collect()}
    for i, text in enumerate(texts):
        found = plain_spans(text or "")
        told = ",".join(f"{k}:{a}:{b}" for k, spans in found.items() for a, b in spans)
        assert rows[i].spans == told and rows[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone] == [len(v) for v in found.values()]


def plain_rules(text):
    text = text or ""
    own, seen, again = words(text), set(), 0
    for line in text.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    triples = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    covered = {i + k for i, t in enumerate(triples) if triples.count(t) > 1 for k in range(3)}
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def test_quality_rules(spark):
    make = random.Random(9)
    texts = ["\n".join(" ".join(make.choice(["a", "b", "é#", "|"]) for _ in range(make.randrange(9))) for _ in range(make.randrange(12))) for _ in range(200)] + ["", None, "a b c a b c", "\n\n", "x" * 3000]
    rows = quality.judge(frame(spark, texts), quality.Model(np.zeros(quality.BUCKETS), 0.5)).collect()
    for r in rows:
        want = plain_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not r.kept


def test_quality_ratio_is_the_mean_of_its_ngrams():
    texts = ["abc", "abcd", "", "ab", "abcdabcd", "é", "xyz" * 9]
    ratio = np.random.default_rng(1).normal(size=quality.BUCKETS)
    together = np.concatenate([quality.mean_ratios(ratio, b) for b in blocks(texts, 1 << 20)])
    alone = [float(quality.mean_ratios(ratio, next(blocks([t])))[0]) for t in texts]
    # Exactly the same alone and in a block, or verdicts would change with the partitions.
    assert together.tolist() == alone and alone[2] == alone[3] == 0
    exact = [np.concatenate([ratio[f] for f, _ in quality.grams(next(blocks([t])))]) for t in texts]
    assert np.allclose(alone, [e.mean() if len(e) else 0 for e in exact], atol=1e-9)
    counts = [sum(len(f) for f, _ in quality.grams(next(blocks([t])))) for t in texts]
    assert counts == [sum(max(0, len(t.encode()) - n + 1) for n in quality.ORDERS) for t in texts]


def test_quality_tells_junk_from_text(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = quality.judge(docs, model).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) > 0.95 * len(good) and sum(bad) < 0.2 * len(bad)
    empty = quality.fit(docs.limit(0), labels.limit(0))
    assert empty.threshold == -np.inf


def test_cut_point():
    scores, good = np.array([0.1, 0.2, 0.8, 0.9]), np.array([False, False, True, True])
    assert 0.2 < quality.cut_point(scores, good) <= 0.8
    assert quality.cut_point(scores, np.ones(4, bool)) == -np.inf
    assert quality.cut_point(np.zeros(4), good) in (-np.inf, np.inf)


def test_quality_is_fitted_on_every_labelled_document(spark):
    make, n = random.Random(4), 9000
    texts = ["".join(make.choice("abcdef" if i % 2 else "defghi") for _ in range(make.randrange(9))) for i in range(n)]
    docs, marks = frame(spark, texts).repartition(5), [(i, i % 2) for i in range(n)]
    # Labelled twice, both ways, with no label, without a document, without an id.
    labels = spark.createDataFrame([*marks, (1, 1), (2, 1), (3, 0), (n, 1), (n + 1, 0), (None, 1), (4, None)], "doc_id bigint, quality int")
    rows = quality.labelled(docs, labels, "quality").collect()
    assert sorted((r.doc_id, r.text, r.label) for r in rows) == [(i, texts[i], k) for i, k in marks if i not in (2, 3)]
    assert sorted(r.doc_id for r in rows if r.label == 1 and r.part == 0) == sorted(r.doc_id for r in quality.labelled(docs, labels, "quality", "label = 1 and part = 0").collect())

    def counts(some):
        out = np.zeros(quality.BUCKETS)
        for block in blocks(some, 1 << 18):
            for found, _ in quality.grams(block):
                out += np.bincount(found, minlength=quality.BUCKETS)
        return out

    logs = [np.log((c + 0.5) / (c.sum() + 0.5 * quality.BUCKETS)) for c in (counts([r.text for r in rows if r.label == 1 and r.part == 0]), counts(texts))]
    model, rest = quality.fit(docs, labels), [r for r in rows if r.label == 0 or r.part == 1]
    assert np.array_equal(model.ratio, logs[0] - logs[1])
    scores = np.concatenate([quality.mean_ratios(model.ratio, b) for b in blocks([r.text for r in rest], 1 << 18)])
    assert model.threshold == quality.cut_point(scores, np.array([r.label == 1 for r in rest])) and np.isfinite(model.threshold)


@pytest.mark.parametrize("seed", range(6))
def test_parted_cut_point_is_that_of_all_scores(spark, seed):
    make = random.Random(seed)
    marks = [make.randrange(2) for _ in range(make.choice([2, 40, 900]))]
    rows = [(make.randrange(12) / 4 if seed % 2 else make.gauss(k if seed < 4 else 0, 1), k) for k in marks]
    scores, good = np.array([r[0] for r in rows]), np.array([r[1] == 1 for r in rows])
    cuts = [-np.inf, *((a + b) / 2 for a, b in itertools.pairwise(sorted(set(scores)))), np.inf]
    gains = [int((~good & (scores < c)).sum()) * int(good.sum()) - int((good & (scores < c)).sum()) * int((~good).sum()) for c in cuts]
    want = cuts[gains.index(max(gains))] if good.any() and not good.all() else quality.cut_point(scores, good)
    assert quality.cut_point(scores, good) == want
    batched = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "9"}
    before = {k: spark.conf.get(k) for k in batched}
    try:
        for k, v in batched.items():
            spark.conf.set(k, v)
        found = sorted(map(tuple, quality.stretches(spark.createDataFrame(rows, "score double, label int")).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    low, high, some_good, some_bad = (np.array(x) for x in zip(*found, strict=True))
    assert len(found) <= 14 and quality.cut_point(low, some_good, some_bad, high) == want


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    held = labels.where(toxicity.remainder(labels["doc_id"]) == 2)
    rows = toxicity.scores(docs, model).join(held, "doc_id").collect()
    hit, miss = [r.score >= 0.3 for r in rows if r.toxic == 1], [r.score >= 0.3 for r in rows if r.toxic == 0]
    assert sum(hit) > 0.85 * len(hit) and sum(miss) < 0.05 * len(miss)


def test_toxicity_of_odd_texts(spark):
    model = toxicity.train([("a stupid idiot text", 1), ("good words here", 0)])
    texts = ["", None, "x" * 100_000, "a b"]
    rows = toxicity.scores(frame(spark, texts), model).collect()
    assert len(rows) == 4 and all(0 <= r.score < 0.3 for r in rows)
    assert toxicity.without_toxic(frame(spark, texts).selectExpr("*", "1 as score"), model).count() == 4
    assert toxicity.scores(frame(spark, []), model).count() == 0


QUESTION = "Tom has 12 apples and gives Mary 5 apples, then Tom buys 12 kg of pears in 3 days. How many apples does Mary have?"


@pytest.mark.parametrize(
    ("text", "changed"),
    [
        (f"Before that. {QUESTION} And more.", 0),
        ("Then came Bob who has 20 apples and gives Anna 7 apples, then Bob buys 20 lb of pears in 4 days. How many apples does Anna have?", 6),
        ("Well, Bob has 20 apples and gives Anna 7 apples, then Bob buys 20 lb of pears in 4 days. How many apples does Anna have? Yes.", 6),
        ("Well, Bob has 20 apples and gives Anna 7 apples, then Zed buys 21 lb of pears in 4 days. How many apples does Anna have? Yes.", None),
        ("Nothing of the kind.", None),
        ("", None),
        (None, None),
    ],
)
def test_templates(spark, text, changed):
    items = spark.createDataFrame([(7, QUESTION), (8, None), (9, ""), (7, QUESTION)], "item_id bigint, text string")
    docs = frame(spark, [text])
    for part in (1_000_000, 20):
        rows = decontaminate.contaminated(docs, items, part).collect()
        assert [(r.doc_id, r.item_id, r.n_changed) for r in rows] == ([] if changed is None else [(0, 7, changed)])
        assert decontaminate.clean(docs, items, part).count() == (changed is None)


def test_decontamination_against_plain_search(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    known = [(r.item_id, plain(r.text)) for r in items.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in known if t in plain(r.text)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()} == want
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def found_by_templates(text, item):
    known = decontaminate.index([(7, item)])
    return [(n, total, changed) for block in blocks([text]) for _, _, n, total, changed in decontaminate.leaks(known, block)]


@pytest.mark.parametrize(
    ("item", "other", "changed"),
    [
        ("What is the sum of 5 and 7 and 9 and 11 and 13?", "What is the sum of 6 and 8 and 10 and 12 and 14?", 5),
        ("The room was shared by Anna and Bert and Carl and Dora and Emil.", "The room was shared by Fred and Gina and Hugo and Iris and Jack.", 5),
        ("We saw that in 1990 it was 5, in 1995 it was 7, in 1999 it was 9.", "We saw that in 1980 it was 4, in 1985 it was 6, in 1989 it was 8.", 6),
    ],
)
def test_decontamination_of_lists(item, other, changed):
    for text, want in ((item, 0), (f"Before that. {item} More of it.", 0), (f"{item} {item}", 0), (other, changed)):
        [(n, total, n_changed)] = found_by_templates(text, item)
        assert n == total and n_changed == want
    assert not found_by_templates(re.sub(r"\d+|Anna|Bert|Carl|Dora|Emil", lambda m: "3" if m[0].isdigit() else "Zed", item), item)


def test_decontamination_of_a_list_with_a_word_put_in():
    item = "What is the sum of all the following numbers when they are put together: 5 and 7 and 9 and 11 and 13 and 15 and 17 and 19?"
    for text in (item.replace("they are", "they all are"), item.replace("when they are", "when are")):
        [(n, total, changed)] = found_by_templates(text, item)
        assert 0.8 * total <= n < total and changed == 0


@pytest.mark.parametrize(
    "item",
    [
        "The train from Copenhagen to Berlin was late, so Anna and Bert of Hamburg missed the boat to Oslo.",
        "Ælfred and Øyvind asked Émile how many of the 12 boats in Évian were older than Ünal.",
        "Сколько лодок в Москве и Ζάκυνθος, спросил Łukasz у Nguyễn Ạnh вечером в городе?",
    ],
)
def test_decontamination_in_other_case(item):
    for text in (item.upper(), item.lower(), f"AND THEN SO {item.upper()} AND MORE", f"and then {item.lower()} and more", item.title()):
        [(n, total, changed)] = found_by_templates(text, item)
        assert n == total and changed == 0


@pytest.mark.parametrize("item", ["Where does the river end?", "Where did Anna go then at night?", "Tom has 12 apples and 3 pears."])
def test_decontamination_of_short_items_inside_a_sentence(item):
    for text in (f"And he asked me, {item} Yes.", f"They say {item}", f"Ask Bob {item}"):
        [(n, total, changed)] = found_by_templates(text, item)
        assert n == total
    assert found_by_templates("We know, Bob has 20 apples and 4 pears.", "Tom has 12 apples and 3 pears.") == [(3, 3, 3)]


def test_arrays_of_a_worker_follow_small_blocks(spark):
    texts = common.text_array(pa.array(["some words of a text " * 200] * 800))  # 3 MB
    path = public_tokenizers.path(bpe.RANKS)
    list(bpe.encoded(path, texts[:1]))
    pretokens._CHARS.up = pretokens._CHARS.down = np.ones(1, np.uint64)
    tracemalloc.start()
    n = sum(len(ids) for ids, _ in bpe.encoded(path, texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n and peak < 48 << 20
    common.batched(spark)
    assert spark.sparkContext.environment["ARROW_DEFAULT_MEMORY_POOL"] == "system"
