"""All-words match, the memory of saved searches and the first right result."""

import datetime as dt

from pyspark.sql import functions as F

from hostloom.operators import change as C
from hostloom.operators import logs
from hostloom.operators.matching import all_words

QUERIES = "q bigint, words array<string>"
DOCS = "doc bigint, words array<string>, rank bigint"


def found(spark, queries, docs, k=40):
    out = all_words(spark.createDataFrame(queries, QUERIES), "q", spark.createDataFrame(docs, DOCS), "doc", k)
    return sorted((r.q, r.place, r["doc"]) for r in out.collect())


def test_every_word_must_be_there(spark):
    docs = [(1, ["the", "red", "fox"], 5), (2, ["the", "fox"], 1), (3, ["the", "red"], 2), (4, [], 0), (5, None, 0)]
    queries = [(1, ["fox", "the"]), (2, ["the", "fox"]), (3, ["red", "fox"]), (4, ["the", "owl"]), (5, []), (6, None)]
    assert found(spark, queries, docs) == [(1, 1, 2), (1, 2, 1), (2, 1, 2), (2, 2, 1), (3, 1, 1)]


def test_repeated_documents_and_empty_tables(spark):
    docs = [(1, ["a", "b"], 3), (1, ["a", "b"], 2), (1, ["a"], 9), (2, ["a", "b"], None)]
    assert found(spark, [(7, ["a", "b"])], docs) == [(7, 1, 1), (7, 2, 2)]
    assert found(spark, [], docs) == [] and found(spark, [(7, ["a"])], []) == []


def test_a_common_word_pairs_nothing_but_its_own_query(spark):
    docs = [(i, ["common", f"w{i}"], i) for i in range(3000)]
    queries = [(i, ["common", f"w{i}"]) for i in range(0, 3000, 3)] + [(5000, ["common"])]
    want = [(i, 1, i) for i in range(0, 3000, 3)] + [(5000, p + 1, p) for p in range(40)]
    assert found(spark, queries, docs) == sorted(want)


def test_memory_keeps_the_newest_rows_of_a_hot_search(spark):
    day = dt.datetime(2000, 1, 1)
    seen = spark.range(2000).select(
        F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("id"), F.concat(F.lit("d"), F.col("id").cast("string")).alias("domain"),
        F.lit(day).alias("seen_at"), F.col("id").alias("rank"),
    )
    results = spark.createDataFrame([(0, "d1", 0), (0, "new", 1), (0, "newer", 2)], "id bigint, domain string, rank bigint")
    kept = C.remember_seen(seen, results, F.lit(day + dt.timedelta(days=1)), keep=5)
    rows = [r["domain"] for r in kept.where("id = 0").orderBy("seen_at", "rank").collect()]
    assert rows == ["d1996", "d1997", "d1999", "new", "newer"]
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_first_right_rank_reads_results_once(spark):
    cases = spark.createDataFrame(
        [("a", ["x.com", "y.com"], None, None), ("b", [], ".dk", "cafe"), ("c", None, None, None)],
        "q string, domains array<string>, tld string, category string",
    )
    results = spark.createDataFrame(
        [("a", 1, "notx.com", None), ("a", 2, "www.shop.x.com/p", None), ("a", 3, "y.com", None), ("b", 1, "k.dk", "bar"),
         ("b", 4, "m.dk", None), ("b", 2, "m.se", "cafe"), ("c", 1, "x.com", None), ("b", 11, "cafe.dk", "cafe")],
        "q string, rank int, domain string, category string",
    )
    ranked = logs.first_right_rank(cases, results)
    assert {r.q: r["rank"] for r in ranked.collect()} == {"a": 2, "b": 4, "c": None}
