"""Inputs that once ended or corrupted a job."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hostloom.functions.times import known_zone, next_date, wall_time
from hostloom.operators import feeds, structured
from hostloom.operators.feeds import calendar_time
from hostloom.operators.queues import complete_requests
from hostloom.plans.catalog import QUERIES
from hostloom.sources.writers import changed_rows, guarded_patch, upsert


@pytest.mark.parametrize(
    ("name", "zone"),
    [("Europe/Berlin", "Europe/Berlin"), ('"Europe/Berlin"', "Europe/Berlin"), ("Romance Standard Time", "Europe/Paris"), ("Nowhere/Else", "UTC"), ("", "UTC"), (None, "UTC")],
)
def test_zones(one, name, zone):
    assert one(known_zone(F.col("z")), "z string", (name,)) == zone


def test_calendar_times_with_odd_zones(one):
    at = lambda params: one(calendar_time(F.lit(params), F.lit("20240110T120000"), F.lit(None).cast("string")).cast("string"))
    assert at(";TZID=Romance Standard Time") == at(';TZID="Europe/Paris"') == "2024-01-10 11:00:00"
    assert at(";TZID=Not a zone") == at("") == "2024-01-10 12:00:00"


@pytest.mark.parametrize(("month", "day", "good"), [(2, 31, False), (2, 29, True), (4, 31, False), (13, 1, False), (12, 31, True)])
def test_dates_that_may_not_exist(one, month, day, good):
    made = wall_time(F.lit(2024), F.lit(month), F.lit(day), F.lit("10:00"), F.lit("UTC"))
    assert (one(made) is not None) == good
    assert one(wall_time(F.lit(2023), F.lit(2), F.lit(29), F.lit("10:00"), F.lit("UTC"))) is None
    one(next_date(F.lit(month), F.lit(day), F.lit("10:00"), F.lit("UTC"), F.lit(dt.datetime(2023, 5, 1))))


def test_batches_with_repeated_keys(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    batch = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (3, "z")], "k int, v string")
    assert sorted(map(tuple, upsert(stored, batch, "k", ["v"]).collect())) == [(1, "y"), (2, "b"), (3, "z")]
    assert sorted(map(tuple, changed_rows(stored, batch, "k", ["v"]).collect())) == [(1, "y"), (3, "z")]
    assert sorted(map(tuple, guarded_patch(stored, batch, "k", ["v"], F.lit(True)).collect())) == [(1, "y"), (2, "b")]


def test_requests_with_several_outcomes(spark):
    queue = spark.createDataFrame([("a", "r", None, None)], "domain string, requested_at string, done_at string, outcome string")
    outcomes = spark.createDataFrame([("a", "ok"), ("a", "failed")], "domain string, outcome string")
    assert [r.outcome for r in complete_requests(queue, outcomes, F.lit("now")).collect()] == ["ok"]


def test_hosts_of_more_than_100000_pages(spark, tmp_path):
    pages = [(5, "https://first.example.com/a"), (99_999, "https://last.example.org/"), (100_000, "https://next.example.org/"), (3_000_000, "https://late.example.com/")]
    spark.createDataFrame(pages, "page_id bigint, url string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = QUERIES["ranked_admissible_hosts"](spark, str(tmp_path)).collect()
    assert {(r.domain, r["rank"]) for r in rows} == {(u.split("/")[2], k + 1) for k, u in pages}


def json_ld(value):
    return f'<html><script type="application/ld+json">{json.dumps(value)}</script></html>'


@pytest.mark.parametrize("levels", [0, 1, 5, 10, 40])
def test_json_ld_below_many_lists_and_graphs(spark, levels):
    node, event = {"@type": "Restaurant", "name": "Deep", "telephone": "1"}, {"@type": "Event", "name": "Late [show] {", "startDate": "2024-02-01T10:00:00Z"}
    for k in range(levels):
        node = [{"@type": "WebPage", "name": f"p{k}", "@graph": [node]}, k, None] if k % 2 else [[node], "text"]
        event = {"@graph": [event]} if k % 3 == 1 else [event]
    pages = spark.createDataFrame([("https://a.example/", json_ld([node, {"@type": "Place", "event": event}]))], "url string, html string")
    as_of = F.lit("2024-01-10 00:00:00").cast("timestamp")
    assert [(r["name"], r.telephone) for r in structured.page_business(pages, as_of).collect()] == [("Deep", "1")]
    assert [r["name"] for r in structured.page_events(pages, as_of).collect()] == ["Late [show] {"]


def test_json_ld_in_document_order(spark):
    value = [{"name": "a", "@graph": [{"name": "b"}, [[{"name": "c", "@graph": {"name": "d"}}]], {"name": "e"}]}, [[[{"name": "f"}]]], {"name": "g", "@graph": None}, {"name": "h", "@graph": 3}]
    pages = spark.createDataFrame([(json_ld(value) + json_ld({"name": "i"}) + '<script type="application/ld+json">{</script>',)], "html string")
    names = F.transform(structured.json_nodes(F.col("html")), lambda n: structured.text_at(n, "name"))
    assert pages.select(names.alias("n")).first().n == list("abcdefghi")


def test_event_limits_count_per_row_and_shuffle_nothing(spark):
    as_of = F.lit("2024-01-10 00:00:00").cast("timestamp")
    listed = [{"@type": "Event", "name": f"e{k}", "startDate": f"2024-0{1 + k % 3}-15T10:00:00Z" if k else "2020-01-01"} for k in range(9)]
    pages = spark.createDataFrame([("https://a.example/", json_ld(listed))] * 2 + [("https://b.example/", None), ("https://b.example/", "")], "url string, html string")
    events = structured.page_events(pages, as_of, limit=3)
    assert sorted((r.pos, r["name"]) for r in events.collect()) == [(k, f"e{k}") for k in (1, 1, 2, 2, 3, 3)]
    body = "".join(f"BEGIN:VEVENT\nSUMMARY:c{k}\nDTSTART;TZID=Europe/Paris:202401{10 + k}T100000\nURL:\nEND:VEVENT\n" for k in range(9))
    calendars = spark.createDataFrame([("f", body), ("f", body.replace("\n", "\r\n")), ("f", None), ("g", "")], "feed_url string, body string")
    dates = feeds.calendar_events(calendars, as_of, limit=2)
    rows = dates.collect()
    assert sorted((r.pos, r["name"], r.venue, r.url) for r in rows) == [(k, f"c{k}", None, f"f#c{k}") for k in (0, 0, 1, 1)]
    for frame in (events, dates):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan
