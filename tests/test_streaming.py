"""Streams give what the batch operators give on the same rows."""

import pytest
from pyspark.sql import functions as F

from hostloom.operators import change, logs
from hostloom.plans import roles
from hostloom.streaming import stateful, windows


def replay(spark, df, tmp_path, build, name, files=6, order="created_at", mode="append"):
    """Write a frame as time-ordered files, stream them one by one, return the result."""
    source = str(tmp_path / f"{name}-in")
    ranged = df.repartitionByRange(files, order)
    ranged.sortWithinPartitions(order).write.parquet(source)
    paths = sorted((tmp_path / f"{name}-in").glob("*.parquet"))
    ordered = str(tmp_path / f"{name}-ordered")
    for i, path in enumerate(paths):
        spark.read.parquet(str(path)).coalesce(1).write.mode("append").parquet(f"{ordered}/b={i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{ordered}/*")
    query = (
        build(stream).writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"{name}-ckpt")).trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    assert query.exception() is None
    return spark.table(name)


@pytest.fixture(scope="module")
def log(spark, small):
    return roles.searches(spark, small)


def test_hourly_hits_match_batch(spark, log, tmp_path):
    hits = log.select(F.col("kind").alias("key"), F.col("created_at").alias("at"), F.lit(1).alias("hits"))
    streamed = replay(spark, hits, tmp_path, lambda s: windows.hourly_hits(s, 1), "hits", order="at").collect()
    batch = hits.groupBy("key", F.date_trunc("hour", "at").alias("hour")).agg(F.sum("hits").alias("hits")).collect()
    last = max(r["hour"] for r in batch)
    assert {tuple(r) for r in streamed if r["hour"] < last} == {tuple(r) for r in batch if r["hour"] < last}


def test_hourly_alerts_match_batch(spark, log, tmp_path):
    problems = log.select(F.col("kind").alias("key"), F.col("created_at").alias("at"))
    streamed = {tuple(r) for r in replay(spark, problems, tmp_path, windows.hourly_alerts, "alerts", order="at").collect()}
    batch = {tuple(r) for r in change.hourly_alerts(problems).select("key", "hour", "first_at", "times").collect()}
    assert streamed <= batch
    assert len(batch - streamed) < 30  # windows still open behind the two-hour watermark


def test_minute_usage_and_latency_run(spark, log, tmp_path):
    usage = replay(spark, log, tmp_path, lambda s: windows.minute_usage(s, warn_at=1), "usage")
    per_minute = log.groupBy("api_key", F.date_trunc("minute", "created_at").alias("minute")).agg(F.count(F.lit(1)).alias("searches"))
    assert usage.join(per_minute, ["api_key", "minute", "searches"], "left_anti").count() == 0
    latency = replay(spark, log, tmp_path, lambda s: windows.hourly_latency(s, min_samples=1), "latency").collect()
    exact = {r["hour"]: r for r in logs.hourly_slo(log, min_samples=1).collect()}
    assert latency and all(exact[r["hour"]]["n"] == r["n"] for r in latency)


def test_sessions_hold_the_research_pairs(spark, log, tmp_path):
    sessions = replay(spark, log, tmp_path, lambda s: windows.search_sessions(s, gap="2 hours"), "sessions")
    assert sessions.where(F.col("searches") < 2).count() == 0
    demand = replay(spark, log, tmp_path, lambda s: windows.daily_demand(s, days=3, recent_days=1), "demand_stream")
    assert demand.count() > 0


def test_price_alerts_match_batch(spark, small, tmp_path):
    stateful.use_state_store(spark)
    observations = roles.price_log(spark, small).drop("item_id")
    streamed = replay(spark, observations, tmp_path, stateful.price_alerts, "prices", order="observed_at", mode="update")
    drops = {tuple(r) for r in streamed.where("kind = 'price_drop'").select("url", "observation_id", "price_eur").collect()}
    assert drops == {tuple(r) for r in change.price_drops(observations).select("url", "observation_id", "price_eur").collect()}
    back = sorted(tuple(r) for r in streamed.where("kind = 'back_in_stock'").select("url", "observation_id").collect())
    assert back == sorted(tuple(r) for r in change.restocks(observations).select("url", "observation_id").collect())


def test_late_prices_match_batch(spark, small, tmp_path):
    """Micro-batches in an order up to sixty days off, and a last row far ahead that closes everything."""
    stateful.use_state_store(spark)
    observations = roles.price_log(spark, small).drop("item_id")
    end = spark.sql("SELECT 'end' AS url, 0L AS observation_id, 1D AS price_eur, true AS available, TIMESTAMP '2030-01-01' AS observed_at")
    jitter = F.pmod(F.xxhash64("observation_id"), F.lit(60)).cast("int")
    mixed = observations.unionByName(end).withColumn("arrives", F.date_add("observed_at", jitter))
    streamed = replay(spark, mixed, tmp_path, lambda s: stateful.late_price_alerts(s.drop("arrives"), "61 days", 5000), "late_prices", files=4, order="arrives")
    drops = sorted(tuple(r) for r in streamed.where("kind = 'price_drop'").select("url", "observation_id", "previous_price_eur", "price_eur").collect())
    assert drops == sorted(tuple(r) for r in change.price_drops(observations).select("url", "observation_id", "prev_price_eur", "price_eur").collect())
    back = sorted(tuple(r) for r in streamed.where("kind = 'back_in_stock'").select("url", "observation_id").collect())
    assert back == sorted(tuple(r) for r in change.restocks(observations).select("url", "observation_id").collect())


def test_an_older_price_that_comes_late_alarms_nobody(spark, tmp_path):
    stateful.use_state_store(spark)
    rows = [("a", 1, 10.0, True, 1, 1), ("a", 3, 20.0, True, 3, 2), ("a", 2, 5.0, False, 2, 3), ("a", 4, 19.0, True, 4, 4), ("end", 0, 1.0, True, 900, 5), ("end", 1, 1.0, True, 901, 6), ("a", 9, 1.0, True, 2, 7)]  # the last one is years too late
    frame = spark.createDataFrame(rows, "url string, observation_id bigint, price_eur double, available boolean, day int, arrives int")
    frame = frame.withColumn("observed_at", F.timestamp_seconds(F.col("day") * 86_400)).drop("day")
    streamed = replay(spark, frame, tmp_path, lambda s: stateful.late_price_alerts(s.drop("arrives"), "3 days"), "late_one", order="arrives")
    assert sorted((r["kind"], r["observation_id"], r["previous_price_eur"]) for r in streamed.collect()) == [("back_in_stock", 3, 5.0), ("price_drop", 4, 20.0)]


def test_an_earlier_hour_that_comes_late_is_told(spark, tmp_path):
    stateful.use_state_store(spark)
    frame = spark.createDataFrame([("k", 5, 1), ("k", 3, 2), ("k", 3, 3), ("k", 4, 4), ("k", 90, 5), ("k", 5, 6)], "key string, hour int, arrives int")
    frame = frame.withColumn("at", F.timestamp_seconds(F.col("hour") * 3600 + F.col("arrives"))).drop("hour")
    streamed = replay(spark, frame, tmp_path, lambda s: stateful.immediate_alerts(s.drop("arrives")), "late_hours", order="arrives", mode="update")
    assert sorted(int(r["hour"].timestamp()) // 3600 for r in streamed.collect()) == [3, 4, 5, 90]


def test_immediate_alerts_match_batch(spark, log, tmp_path):
    stateful.use_state_store(spark)
    problems = log.select(F.col("kind").alias("key"), F.col("created_at").alias("at"))
    streamed = replay(spark, problems, tmp_path, stateful.immediate_alerts, "immediate", order="at", mode="update")
    got = {tuple(r) for r in streamed.select("key", "hour", "first_at").collect()}
    assert got == {tuple(r) for r in change.hourly_alerts(problems).select("key", "hour", "first_at").collect()}


def test_page_watch_first_check_is_silent_and_phrases_alert_once(spark, tmp_path):
    stateful.use_state_store(spark)
    rows = [
        (1, "change", "a", None, 1), (1, "change", "b", None, 2), (1, "change", "c", None, 3),
        (2, "appears", "a", False, 1), (2, "appears", "b", True, 2), (2, "appears", "c", False, 3), (2, "appears", "d", True, 4),
        (3, "disappears", "a", True, 1), (3, "disappears", "b", False, 2),
    ]
    reads = spark.createDataFrame(rows, "id bigint, watch_for string, text_hash string, seen boolean, t int").select(
        "id", "watch_for", "text_hash", "seen", F.timestamp_seconds("t").alias("checked_at")
    )
    streamed = replay(spark, reads, tmp_path, stateful.page_alerts, "pages_stream", files=3, order="checked_at", mode="update")
    got = sorted((r["id"], r["checked_at"].second) for r in streamed.collect())
    assert got == [(1, 2), (1, 3), (2, 2), (3, 2)]
