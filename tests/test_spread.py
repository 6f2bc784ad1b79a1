"""Narrow tables with much work on every row are dealt to all tasks, and each row's work is done once."""

import pytest
from pyspark.sql import functions as F

from hostloom.functions.text import decode_feed
from hostloom.functions.urls import resolve
from hostloom.operators import shops
from hostloom.operators.pages import manifest_pointers, useful_paths
from hostloom.operators.structured import is_object
from hostloom.plans import catalog, catalog_extract, catalog_pages


def tasks_of(df):
    return df.rdd.getNumPartitions()


@pytest.mark.parametrize("build", ["_business_pages", "_event_pages", "_product_pages", "_shop_feeds", "_listing_pages"])
def test_documents_are_built_by_all_tasks(spark, small, build):
    assert tasks_of(getattr(catalog_extract, build)(spark, small)) >= spark.sparkContext.defaultParallelism


def test_sitemaps_are_built_by_all_tasks(spark, small):
    assert tasks_of(catalog_pages._sitemaps(spark, small)) >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["jsonld_offers", "manifest_pointers"])
def test_queries_without_a_shuffle_run_in_all_tasks(spark, small, name):
    assert tasks_of(catalog.QUERIES[name](spark, small)) >= spark.sparkContext.defaultParallelism


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_feeds_of_both_dialects_are_parsed_in_one_pass(spark):
    feeds = spark.createDataFrame(
        [("a.example", "EUR", '{"products":[{"handle":"h","title":"t","variants":[{"id":1,"price":"2"}]}]}'),
         ("b.example", "EUR", '[{"permalink":"u","name":"n","prices":{"price":"250"}}]'), ("c.example", "EUR", "{}"), ("d.example", "EUR", None)],
        "domain string, currency string, body string",
    )
    items = shops.feed_items(feeds)
    assert sorted((r.domain, r.url, r.price, r.source) for r in items.collect()) == [
        ("a.example", "https://a.example/products/h", 2.0, "products"), ("b.example", "u", 2.5, "store-api"),
    ]
    assert "Union" not in plan_of(items) and plan_of(items).count("parse_json") <= 1


def test_pointers_and_paths_are_worked_out_once(spark):
    docs = spark.createDataFrame([("a.example", '</x/../h.json>; rel="m"', None, None), (None, None, None, None)], "domain string, link_header string, html string, robots string")
    found = manifest_pointers(docs, "m")
    assert [tuple(r) for r in found.collect()] == [("a.example", "https://a.example/h.json", "link-header")]
    assert plan_of(found).count("aggregate(") <= 4
    places = spark.createDataFrame([("a.example", "https://www.a.example/x/menu", 1), ("a.example", "https://b.example/menu", 2), (None, None, 3)], "domain string, url string, pos int")
    assert [tuple(r) for r in useful_paths(places).collect()] == [("a.example", "/x/menu", "offer", 6, 1)]
    assert plan_of(useful_paths(places)).count("arrays_overlap") <= 9


@pytest.mark.parametrize("json, want", [('{"a":{"b":[1]}}', True), ("{}", True), ("[{}]", False), ('"{}"', False), ("1", False), ("null", None), (None, None)])
def test_is_object(one, json, want):
    assert bool(one(is_object(F.try_parse_json("t")), "t string", (json,))) is bool(want)


@pytest.mark.parametrize("path", ["/a/b", "/a/", "/", "/a/../b", "/a/./b/", "/..a/b", "/a/..", "/.well-known/x", "//a"])
def test_paths_without_dot_segments_stay(one, path):
    want = {"/a/../b": "/b", "/a/./b/": "/a/b/", "/a/..": "/"}.get(path, path)
    base = F.lit("https://s.example/p")
    assert one(resolve(F.concat(F.lit("https:"), F.lit("//s.example"), F.col("t")), base), "t string", (path,)).startswith("https://s.example")
    if not path.startswith("//"):
        assert one(resolve(F.col("t"), base), "t string", (path,)) == f"https://s.example{want}"


@pytest.mark.parametrize("text, want", [("a b", "a b"), ("a &amp; b", "a & b"), ("&#65;&oslash;", "Aø"), ("", ""), (None, None)])
def test_decode_feed_leaves_texts_without_entities(one, text, want):
    assert one(decode_feed(F.col("t")), "t string", (text,)) == want
