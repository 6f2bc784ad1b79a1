"""Label joins with a label or an artist that a third of both sides share."""

import pytest
from pyspark.sql import functions as F

from hostloom.operators import feeds, keyed
from hostloom.operators.feeds import host_and_parents


def test_suffixes(one):
    assert one(host_and_parents(F.lit("a.b.c"))) == ["a.b.c", "b.c", "c"]
    assert one(host_and_parents(F.lit("a.b.c"), itself=False)) == ["b.c", "c"]
    assert one(host_and_parents(F.lit("c"), itself=False)) == [] and one(host_and_parents(F.lit(""))) == [""]


def agree(domain, host):
    return host == domain or host.endswith("." + domain) or domain.endswith("." + host)


def test_hosts_against_all_pairs(spark):
    hosts = ["cafe.example", "www.cafe.example", "en.cafe.example", "a.en.cafe.example", "xcafe.example", "example", "cafe.test", "other.test", None]
    names = [("Café" if i % 3 else f"n{i}", hosts[i % 9]) for i in range(40)] + [("CAFÉ", "cafe.example"), (None, "cafe.example")]
    entities = [("café" if i % 3 else f"N{i}", f"q{i}", None if hosts[-1 - i % 9] is None else f"https://{hosts[-1 - i % 9]}/x") for i in range(40)]
    entities += [("café", "q0", None), (None, "q9", "https://cafe.example")]
    got = feeds.match_websites(spark.createDataFrame(names, "name string, domain string"), spark.createDataFrame(entities, "label string, entity string, website string"))

    def bare(host):
        return host[4:] if host.startswith("www.") else host

    wanted = {
        (n, bare(d), e) for n, d in names if n and d for label, e, w in entities if label and w and n.lower() == label.lower()
        and agree(bare(d), bare(w[8:].split("/")[0]))
    }
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == wanted


def test_a_shared_label_pairs_nothing_by_itself(spark):
    names = spark.range(20_000).select(F.lit("Café").alias("name"), F.concat(F.lit("c"), F.col("id").cast("string"), F.lit(".example")).alias("domain"))
    entities = spark.range(20_000).select(
        F.upper(F.lit("Café")).alias("label"), F.col("id").cast("string").alias("entity"), F.concat(F.lit("https://www.c"), F.col("id").cast("string"), F.lit(".example/")).alias("website")
    )
    found = feeds.match_websites(names, entities)
    assert found.count() == 20_000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and all("=" in line for line in plan.splitlines() if "Join Inner" in line)


@pytest.mark.parametrize("share", [2, 1_000])
def test_hot_left_join(spark, share):
    left = spark.range(3_000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"))
    unique = spark.createDataFrame([("hot", 1), ("k7", 2), ("unused", 3)], "k string, v int")
    got = keyed.join_hot_left(left, unique, "k", F.col("id"), share=share).select("id", "k", "v")
    want = left.join(unique, "k", "left").select("id", "k", "v")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 3_000
    with pytest.raises(ValueError):
        keyed.join_hot_left(left, unique, "k", F.col("id"), share=1_000_000)


def test_hot_left_join_spreads_the_hot_key(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(9_000).select("id", F.lower(F.lit("HOT")).alias("x"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("h"), (F.col("id") * 0).cast("string"))).alias("k"))
        unique = spark.createDataFrame([("h0", 1)], "k string, v int")
        sizes = keyed.join_hot_left(left, unique, "k", F.col("id")).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert max(r["count"] for r in sizes) < 6_000


def test_genres_of_a_hot_artist(spark):
    events = spark.range(600).select(
        "id", F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"),
        F.when(F.col("id") % 3 == 0, "The Band – 40 years").when(F.col("id") % 3 == 1, "Chess").alias("name"), F.lit(None).cast("string").alias("description"),
    )
    entities = spark.createDataFrame([("THE BAND", ["doom metal"]), ("the band", ["doom metal"]), (None, ["x"])], "label string, genres array<string>")
    earlier = events.where("id = 1").select("url", F.lit("x. Genre: old. y").alias("description"))
    got = {r.id: r.description for r in feeds.add_genres(events, earlier, entities).select("id", "description").collect()}
    assert len(got) == 600 and got[0] == "Genre: doom metal (metal)." and got[1] == "Genre: old." and got[4] is None and got[2] is None
