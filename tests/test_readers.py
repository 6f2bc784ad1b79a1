"""Listings in several formats, each read by the reader row of its source."""

import pytest
from pyspark.sql import functions as F

from hostloom.operators import feeds

AS_OF = F.lit("2024-01-31 00:00:00").cast("timestamp")
PLACE = ("Hall", "Aarhus", "DK", "DKK")
READERS = [
    ("api", "json", None, "$.a.events", {"link": ["$.slug"], "title": ["$.title.text", "$.title"], "start": ["$.when"], "price": ["$.low"], "state": ["$.state"]}, "America/New_York", None, PLACE),
    ("state", "json", "(?s)<script>(.*?)</script>", "$", {"link": ["$.u"], "title": ["$.n"], "start": ["$.s"]}, None, None, PLACE),
    ("cards", "cards", None, "<li>", {"link": ['href="([^"]+)"'], "title": ["(?s)<h3>(.*?)</h3>"], "day": [r"(\d+)\. \w+"], "month": [r"\d+\. (\w+)"], "clock": ["<i>(.*?)</i>"]}, "Europe/Copenhagen", "19:30", PLACE),
]


def events(spark, rows, readers=READERS):
    listings = feeds.read_listings(spark.createDataFrame(rows, "source string, url string, body string"), spark.createDataFrame(readers, feeds.READER))
    found = feeds.listing_events(listings, AS_OF)
    return sorted(tuple(r) for r in found.select("source", "event_url", "name", F.date_format("start_date", "MM-dd HH:mm").alias("at"), "venue", "price", "currency").collect())


def test_three_formats_in_one_plan(spark):
    api = '{"a":{"events":[{"slug":"/1","title":{"text":"A <b>x</b>"},"when":"2024-02-01 18:00","low":"$12.50"},{"slug":"/2","title":"B","when":"1706810400000"},{"slug":"/3","title":"C","when":"2024-02-01","state":"Cancelled"},{"title":"no link","when":"2024-02-01"}]}}'
    state = '<html><script>[{"u":"/s","n":"S","s":"2024-03-01T12:00:00+02:00"},{"u":"/old","n":"O","s":"2023-03-01T12:00:00Z"}]</script>'
    cards = '<ul><li><a href="/c"><h3>Aften &amp; nat</h3></a>5. marts<i>20.15</i><li><a href="/d"><h3>D</h3></a>1. february<li>none<li><a href="/e"><h3>Aflyst: E</h3></a>5. marts'
    got = events(spark, [("api", "https://a.example/f", api), ("state", "https://b.example/", state), ("cards", "https://c.example/x/", cards)])
    assert got == [
        ("api", "https://a.example/1", "A x", "02-01 23:00", "Hall", 12.5, "DKK"),
        ("api", "https://a.example/2", "B", "02-01 18:00", "Hall", None, None),
        ("cards", "https://c.example/c", "Aften & nat", "03-05 19:15", "Hall", None, None),
        ("cards", "https://c.example/d", "D", "02-01 18:30", "Hall", None, None),
        ("state", "https://b.example/s", "S", "03-01 10:00", "Hall", None, None),
    ]


@pytest.mark.parametrize("body", [None, "", "{", "[]", '{"a":{"events":{}}}', '{"a":{"events":[null,1,"x",[]]}}', '{"a":[]}'])
def test_unreadable_bodies_give_no_rows(spark, body):
    assert events(spark, [("api", "https://a.example/", body), ("cards", "https://a.example/", body), ("state", "https://a.example/", body)]) == []


def test_sources_without_a_reader_and_repeated_items(spark):
    twice = '{"a":{"events":[{"slug":"/1","title":"A","when":"2024-02-01T18:00:00Z"},{"slug":"/1","title":"A","when":"2024-02-01T18:00:00Z"}]}}'
    got = events(spark, [("api", "https://a.example/", twice), ("api", "https://a.example/", twice), ("nobody", "https://a.example/", twice), (None, None, twice)])
    assert got == [("api", "https://a.example/1", "A", "02-01 18:00", "Hall", None, None)]


def test_one_scan_and_no_python(spark, small):
    from hostloom.plans.catalog_extract import listings_by_reader

    plan = listings_by_reader(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "EvalPython" not in plan and "NestedLoop" not in plan
