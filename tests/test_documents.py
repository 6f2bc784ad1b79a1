"""Nested site documents: assembly, and scans that read the leaves a path names; logs read by day."""

import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from hostloom.operators import documents as D
from hostloom.operators import logs
from hostloom.sources.parted import append_once
from hostloom.sources.tables import recent_days

RECORDS = "domain string, native boolean, business struct<source:string, opening_hours:string>, ai_access struct<blocked:array<string>>, status string"
PAGE = "domain string, path string, page struct<page_id:bigint, title:string, content:string>"
ACTION = "domain string, action struct<id:string, endpoint:struct<url:string>>"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    long = "words " * 20
    records = [
        ("a.example", True, ("map", None), (["GPTBot"],), None), ("b.example", False, None, None, "parked"),
        ("c.example", None, ("page", "Mo 9-17"), ([],), None),
    ]
    pages = [("a.example", f"/{'x' * i}", (i, "t", f"page {i}")) for i in range(1, 300)]
    pages += [("a.example", "/", (500, "t", long)), ("a.example", "/", (400, "t", long + "first")), ("a.example", "/", (400, "t", long + "first"))]
    pages += [("c.example", "/bb", (1, "t", "second")), ("c.example", "/aa", (2, None, "Website at c.example")), ("c.example", None, (3, "t", "x")), (None, "/", None)]
    actions = [("a.example", (f"act{i % 9}", (None,))) for i in range(90)] + [("a.example", ("act3", ("https://a.example/do",))), ("c.example", (None, None))]
    path = str(tmp_path_factory.mktemp("documents") / "d")
    made = D.assemble(spark.createDataFrame(records, RECORDS), spark.createDataFrame(pages, PAGE), spark.createDataFrame(actions, ACTION))
    made.write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_schema(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return re.findall(r"ReadSchema: (struct<.*)", plan(df))


def test_documents_are_whole_and_bounded(stored):
    rows = {r.domain: r for r in stored.collect()}
    a, b, c = rows["a.example"], rows["b.example"], rows["c.example"]
    assert sorted(a.pages, key=len) == ["/" + "x" * i for i in range(8)]
    assert a.pages["/"].page_id == 400 and a.pages["/"].content.endswith("first")
    # Of an action's copies the one without an address is the smaller.
    assert [x.id for x in a.actions] == [f"act{i}" for i in range(6)]
    assert b.pages == {} and b.actions == [] and set(c.pages) == {"/aa", "/bb"} and c.actions == []


def test_readiness_reads_from_the_document(stored):
    got = {r.domain: (r.score, r.passed) for r in D.with_readiness(stored).collect()}
    assert got["a.example"] == (85, ["description", "several pages", "actions", "three actions", "own document", "business details"])
    assert got["b.example"] == (0, []) and got["c.example"] == (15, ["business details"])


def test_home_falls_back_to_the_shortest_path(stored):
    got = {r.domain: r.home for r in stored.select("domain", D.home_content().alias("home")).collect()}
    assert got["a.example"].endswith("first") and got["b.example"] is None and got["c.example"] == "Website at c.example"


def test_predicates(stored):
    tests = {"hours": D.states_hours(), "blocks": D.blocks_bots(), "placeholder": D.is_placeholder(), "map": D.comes_from("map")}
    got = sorted((r.predicate, r.domain) for r in D.predicates(stored, tests).collect())
    assert got == [("blocks", "a.example"), ("hours", "c.example"), ("map", "a.example")]


def test_a_path_predicate_reads_its_leaf_only(stored):
    assert read_schema(stored.where(D.is_placeholder()).select("domain")) == ["struct<domain:string,pages:map<string,struct<content:string>>>"]
    assert read_schema(stored.where(D.states_hours()).select("domain")) == ["struct<domain:string,business:struct<opening_hours:string>>"]
    assert read_schema(stored.where(D.blocks_bots()).select("domain")) == ["struct<domain:string,ai_access:struct<blocked:array<string>>>"]
    scores = read_schema(D.with_readiness(stored))[0]
    assert "title" not in scores and "page_id" not in scores and "pages:map<string,struct<content:string,path:string>>" in scores


def test_empty_tables_give_empty_documents(spark, stored):
    none = stored.limit(0)
    assert D.with_readiness(none).count() == 0 and D.predicates(none, {"x": D.is_placeholder()}).count() == 0
    made = D.assemble(spark.createDataFrame([("z.example", True, None, None, None)], RECORDS), spark.createDataFrame([], PAGE), spark.createDataFrame([], ACTION))
    assert made.select("pages", "actions").collect() == [Row(pages={}, actions=[])]


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "l")
    rows = spark.range(960).select(
        "id", F.array(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("domains"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("created_at"),
    )
    append_once(rows, path, "all", "created_at")
    return spark.read.parquet(path), path


def test_recent_days_read_their_partitions_only(spark, log):
    frame, path = log
    as_of = F.lit("2024-01-20 12:30:00").cast("timestamp")
    part = recent_days(frame, as_of, 3)
    assert re.search(r"PartitionFilters: \[.*day#\d+ >= 2024-01-17\).*day#\d+ <= 2024-01-20", plan(part))
    assert {str(r.day) for r in part.select("day").distinct().collect()} == {f"2024-01-{d}" for d in (17, 18, 19, 20)}
    # An operator's result is the same as over the whole log.
    wanted = logs.weighted_demand(frame.where(F.col("created_at") <= as_of), as_of, 3, 1)
    got = logs.weighted_demand(part.where(F.col("created_at") <= as_of), as_of, 3, 1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect())) and got.count() == 7
    assert "PartitionFilters: [isnotnull(day" in plan(got)


def test_a_clock_from_a_table_prunes_too(spark, log):
    frame, _ = log
    clock = spark.createDataFrame([("2024-01-10",), ("2024-01-05",)], "at string").agg(F.max(F.col("at").cast("timestamp")).alias("m")).scalar()
    part = recent_days(frame, clock, 2)
    assert re.search(r"PartitionFilters: \[[^\n]*subquery", plan(part), re.I)
    assert {str(r.day) for r in part.select("day").distinct().collect()} == {"2024-01-08", "2024-01-09", "2024-01-10"}
