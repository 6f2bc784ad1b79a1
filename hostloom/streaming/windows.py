"""Windowed aggregates over log streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How long a window waits for late rows.
LOG_DELAY = "10 minutes"
ALERT_DELAY = "2 hours"


def hourly_latency(searches: DataFrame, min_samples: int = 20, limit_ms: int = 3000, delay: str = LOG_DELAY) -> DataFrame:
    """p50, p95 and the breach flag of every closed hour with enough samples.

    The percentiles of a stream are approximate; the error is below one sample for
    hours with fewer than ``accuracy`` samples.
    """
    stats = (
        searches.withWatermark("created_at", delay)
        .groupBy(F.window("created_at", "1 hour"))
        .agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("duration_ms", [0.5, 0.95], 100_000).alias("_p"))
    )
    return stats.where(F.col("n") >= min_samples).select(
        F.col("window.start").alias("hour"), "n", F.col("_p")[0].alias("p50_ms"), F.col("_p")[1].alias("p95_ms"), (F.col("_p")[1] > limit_ms).alias("breach")
    )


def minute_usage(searches: DataFrame, warn_at: int = 48, delay: str = LOG_DELAY) -> DataFrame:
    """Minutes in which a key made at least ``warn_at`` searches."""
    return (
        searches.where(F.col("api_key").isNotNull())
        .withWatermark("created_at", delay)
        .groupBy("api_key", F.window("created_at", "1 minute"))
        .agg(F.count(F.lit(1)).alias("searches"))
        .where(F.col("searches") >= warn_at)
        .select("api_key", F.col("window.start").alias("minute"), "searches")
    )


def hourly_hits(hits: DataFrame, limit: int, delay: str = LOG_DELAY) -> DataFrame:
    """Counters at or over a limit per clock hour."""
    return (
        hits.withWatermark("at", delay)
        .groupBy("key", F.window("at", "1 hour"))
        .agg(F.sum("hits").alias("hits"))
        .where(F.col("hits") >= limit)
        .select("key", F.col("window.start").alias("hour"), "hits")
    )


def hourly_alerts(problems: DataFrame, delay: str = ALERT_DELAY) -> DataFrame:
    """One alert per problem and clock hour, once the hour is closed."""
    return (
        problems.withWatermark("at", delay)
        .groupBy("key", F.window("at", "1 hour"))
        .agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("times"))
        .select("key", F.col("window.start").alias("hour"), "first_at", "times")
    )


def daily_demand(searches: DataFrame, days: int = 30, recent_days: int = 7, first: int = 5, delay: str = "1 day") -> DataFrame:
    """Weighted demand per domain in a window that slides by a day.

    Appearances are counted by day first, and only these counts go into the ``days`` windows
    that hold the day: a search is one row, not one row a window.
    """
    shown = searches.withWatermark("created_at", delay).select("created_at", F.explode(F.slice("domains", 1, first)).alias("domain"))
    daily = shown.groupBy(F.window("created_at", "1 day").alias("day"), "domain").agg(F.count(F.lit(1)).alias("n"))
    slides = daily.groupBy(F.window(F.window_time("day"), f"{days} days", "1 day").alias("w"), "domain", F.col("day.start").alias("day_start"))
    recent = F.col("day_start") >= F.col("w.end") - F.make_dt_interval(days=F.lit(recent_days))
    # A day is one row of a window, so this aggregate only deals the counts out; the last one adds them up.
    dealt = slides.agg(F.sum("n").alias("n")).select("w", "domain", (F.col("n") * F.when(recent, 2).otherwise(1)).alias("score"))
    return dealt.groupBy("w", "domain").agg(F.sum("score").alias("score")).select(F.col("w.end").alias("until"), "domain", "score")


def search_sessions(searches: DataFrame, gap: str = "90 seconds", delay: str = LOG_DELAY) -> DataFrame:
    """Sessions of searches by one person, candidates for searching again."""
    return (
        searches.withWatermark("created_at", delay)
        .groupBy("api_key", F.session_window("created_at", gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("searches"))
        .where(F.col("searches") >= 2)
        .select("api_key", F.col("s.start").alias("started_at"), F.col("s.end").alias("ended_at"), "searches")
    )
