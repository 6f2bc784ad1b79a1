"""Readers and writers on temporary folders."""

import json

from pyspark.sql import functions as F

from hostloom import schemas
from hostloom.operators import feeds, pages, shops
from hostloom.sources import tables as R
from hostloom.sources import writers as K


def test_versioned_merge(spark, tmp_path):
    table = K.VersionedTable(spark, str(tmp_path / "t"))
    assert not table.exists()
    table.replace(spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, name string, n int"))
    table.merge(spark.createDataFrame([(2, "B"), (3, None)], "id int, name string"), "id", ["name"])
    rows = sorted(map(tuple, table.read().collect()))
    assert rows == [(1, "a", 10), (2, "B", 20), (3, None, None)]
    assert table.version() == 2
    table.merge(spark.createDataFrame([(2, "B"), (3, None)], "id int, name string"), "id", ["name"])
    assert sorted(map(tuple, table.read().collect())) == rows  # merging again changes nothing
    table.delete(F.col("n") == 10)
    assert sorted(r["id"] for r in table.read().collect()) == [2, 3]  # NULL does not meet the condition


def test_supplied_null_overwrites(spark):
    stored = spark.createDataFrame([(1, "a", "x")], "id int, name string, other string")
    new = spark.createDataFrame([(1, None)], "id int, name string")
    assert list(map(tuple, K.upsert(stored, new, "id", ["name"]).collect())) == [(1, None, "x")]
    assert K.changed_rows(stored, new, "id", ["name"]).count() == 1


def test_insert_ignore(spark):
    stored = spark.createDataFrame([("u", 1, "old")], "url string, d int, name string")
    new = spark.createDataFrame([("u", 1, "new"), ("u", 2, "b"), ("u", 2, "a")], "url string, d int, name string")
    assert list(map(tuple, K.insert_ignore(stored, new, ["url", "d"], F.col("name")).collect())) == [("u", 2, "a")]


def test_state(spark, tmp_path):
    path = str(tmp_path / "state")
    assert K.load_state(spark, path, "cursor") is None
    K.save_state(spark, path, "cursor", "5")
    K.save_state(spark, path, "bytes", "9")
    K.save_state(spark, path, "cursor", "6")
    assert K.load_state(spark, path, "cursor") == "6" and K.load_state(spark, path, "bytes") == "9"


def test_history_report_export_and_backup(spark, tmp_path):
    rows = spark.createDataFrame([("u", 1.0, "2024-01-01 10:00:00"), ("u", 2.0, "2024-01-02 10:00:00")], "url string, p double, t string")
    K.append_history(rows.withColumn("observed_at", F.to_timestamp("t")), str(tmp_path / "h"))
    day = R.by_day(spark, str(tmp_path / "h"), "2024-01-02", "2024-01-03")
    assert day.count() == 1
    assert "PartitionFilters: [isnotnull(day" in day._jdf.queryExecution().executedPlan().toString()
    K.save_report(spark.createDataFrame([("w1", 1), ("w2", 2)], "week string, n int"), str(tmp_path / "r"))
    K.save_report(spark.createDataFrame([("w2", 3)], "week string, n int"), str(tmp_path / "r"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "r")).select("week", "n").collect()} == {("w1", 1), ("w2", 3)}
    K.export_urls(spark.range(25).select(F.concat(F.lit("u"), "id").alias("url")), str(tmp_path / "e"), total=20, per_file=6)
    assert spark.read.text(str(tmp_path / "e")).count() == 20
    files = [f for f in (tmp_path / "e").iterdir() if f.name.startswith("part")]
    assert max(len(f.read_text().splitlines()) for f in files) <= 6
    manifest = K.backup({"a": spark.range(3), "b": spark.range(4)}, str(tmp_path / "b"), "2024-01-31")
    assert {tuple(r) for r in manifest.collect()} == {("a", 3), ("b", 4)}


def test_snapshot(spark, tmp_path):
    sites = spark.createDataFrame([("a", 2, None), ("b", 1, None), ("c", 3, "parked"), ("d", None, None)], "domain string, popularity_rank int, status string")
    events = spark.createDataFrame([("u1", "2024-02-01"), ("u2", "2024-01-31")], "url string, start_date string")
    K.snapshot(sites, events, str(tmp_path / "s"), site_limit=1, event_limit=1)
    assert [r["domain"] for r in spark.read.json(str(tmp_path / "s/sites")).collect()] == ["b"]
    assert [r["url"] for r in spark.read.json(str(tmp_path / "s/events")).collect()] == ["u2"]


def test_text_sources(spark, tmp_path):
    (tmp_path / "ranks.csv").write_text("1,A.com \n2,b.org\n3,nodot\n")
    ranks = pages.ranked_domains(R.ranked_list(spark, str(tmp_path / "ranks.csv")), max_rank=2)
    assert {tuple(r) for r in ranks.select("rank", "domain").collect()} == {(1, "a.com"), (2, "b.org")}
    (tmp_path / "shops.json").write_text('{"_about": "text", "dk": ["a.dk", "www.b.dk"]}')
    seeds = shops.seed_domains(R.seed_lists(spark, str(tmp_path / "shops.json")))
    assert [r["domain"] for r in seeds.orderBy("pos").collect()] == ["a.dk", "b.dk"]
    (tmp_path / "cases.json").write_text('[{"q": "x", "domains": ["a.dk"]}, {"q": "y", "tld": ".dk"}]')
    assert R.benchmark_cases(spark, str(tmp_path / "cases.json")).count() == 2
    robots = tmp_path / "robots"
    robots.mkdir()
    (robots / "a.txt").write_text("User-agent: *\nDisallow: /x\n")
    bodies = R.text_files(spark, str(robots)).select(F.lit("a").alias("host"), F.lit(200).alias("status"), "body")
    asked = spark.createDataFrame([("a", "/x/1"), ("a", "/y"), ("b", "/x")], "host string, path string")
    assert {(r["host"], r["path"]): r["allowed"] for r in feeds.crawl_permissions(bodies, asked, "bot").collect()} == {
        ("a", "/x/1"): False, ("a", "/y"): True, ("b", "/x"): True,
    }


def test_map_elements(spark, tmp_path):
    element = {"tags": {"name": "Cafe", "website": "cafe.dk/x/", "amenity": "cafe", "dog": "yes"}, "center": {"lat": 1.5, "lon": 2.5}}
    (tmp_path / "m.json").write_text(json.dumps({"elements": [element, {"tags": {"name": "No site"}}]}))
    found = R.map_elements(spark, str(tmp_path / "m.json")).withColumn("city", F.lit("Aarhus")).withColumn("country", F.lit("dk"))
    rows = feeds.places(found).collect()
    assert len(rows) == 1 and rows[0]["domain"] == "cafe.dk" and rows[0]["path"] == "/x" and rows[0]["lat"] == 1.5 and rows[0]["features"] == ["dogs"]


def test_older_tables_stay_readable(spark):
    old = spark.createDataFrame([("u", 1.0)], "url string, price double")
    assert "price_eur" in R.with_missing(old, schemas.ITEM_PRICES).columns


def test_latest_snapshot_reads_one_day(spark, tmp_path):
    for day, n in (("2024-01-01", 1), ("2024-01-08", 2), ("2024-01-15", 3)):
        spark.createDataFrame([("t", n)], "name string, bytes int").withColumn("taken_on", F.lit(day).cast("date")).write.mode("append").partitionBy("taken_on").parquet(str(tmp_path / "z"))
    assert R.latest_snapshot(spark, str(tmp_path / "z"), "2024-01-15").select("bytes").collect()[0][0] == 2
