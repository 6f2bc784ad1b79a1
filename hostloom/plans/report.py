"""The weekly report: what the index holds and what people searched for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostloom.functions.patterns import percent


def weekly_activity(searches: DataFrame, clicks: str = "click") -> DataFrame:
    """Searches, visits and click-through per week with the change on the week before.

    One pass over the log; the window runs over one row per week.
    """
    weekly = searches.groupBy(F.to_date(F.date_trunc("week", "created_at")).alias("week")).agg(
        F.count(F.lit(1)).alias("searches"),
        F.count_if(F.col("kind") == clicks).alias("visits_sent"),
        F.count_if(F.col("result_count") == 0).alias("without_results"),
        F.count_if(F.col("tier") == "test").alias("tests"),
    )
    weekly = weekly.withColumn("click_through_percent", percent(F.col("visits_sent"), F.col("searches")))
    by_week = Window.orderBy("week")
    for name in ("searches", "visits_sent", "click_through_percent"):
        change = F.col(name) - F.lag(name).over(by_week)
        weekly = weekly.withColumn(f"{name}_change", F.floor(change * 10 + 0.5) / 10)
    return weekly


def site_counts(sites: DataFrame, week_start: Column) -> DataFrame:
    """Filtered counts over the site table in one aggregate."""
    visible = F.col("status").isNull()
    readable = visible & (F.col("action_count") > 0)
    return sites.agg(
        F.count_if(visible).alias("sites"),
        F.count_if(readable).alias("readable"),
        F.count_if(F.col("native")).alias("native"),
        F.count_if(visible & (F.col("action_count") == 0)).alias("minimal"),
        F.count_if(F.col("has_business")).alias("with_business"),
        F.count_if(F.col("has_hours")).alias("with_hours"),
        F.count_if(F.col("first_seen_at") >= week_start).alias("new_sites"),
    ).withColumn("readable_percent", percent(F.col("readable"), F.col("sites")))


def category_counts(sites: DataFrame, k: int = 12) -> DataFrame:
    """Readable sites per category, largest first."""
    return (
        sites.where(F.col("status").isNull() & (F.col("action_count") > 0) & F.col("category").isNotNull())
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("sites"))
        .orderBy(F.desc("sites"), "category")
        .limit(k)
    )


def language_counts(sites: DataFrame) -> DataFrame:
    """Visible sites per language."""
    return sites.where(F.col("status").isNull()).groupBy("language").agg(F.count(F.lit(1)).alias("sites"))


def city_categories(sites: DataFrame, min_sites: int = 1, hidden=("adult", "gambling")) -> DataFrame:
    """Sites per city and category together with the totals per city (rollup)."""
    shown = sites.where(F.col("city").isNotNull() & ~F.coalesce(F.col("category").isin(*hidden), F.lit(False)))
    return (
        shown.rollup("city", "category")
        .agg(F.count(F.lit(1)).alias("sites"), F.grouping_id().alias("level"))
        .where((F.col("level") < 3) & (F.col("sites") >= min_sites))
        .select("city", "category", "sites", F.when(F.col("level") == 1, "city").otherwise("city and category").alias("scope"))
    )


def top_cities(sites: DataFrame, k: int = 10, hidden=("adult", "gambling")) -> DataFrame:
    """Cities with the most sites."""
    totals = city_categories(sites, hidden=hidden).where(F.col("scope") == "city")
    return totals.select("city", "sites").orderBy(F.desc("sites"), "city").limit(k)


def blocked_share(audit: DataFrame) -> DataFrame:
    """Among sites with a checked robots.txt: how many block at least one bot."""
    return audit.agg(
        F.count_if(F.col("robots_txt").isNotNull()).alias("checked"),
        F.count_if(F.size("blocked") > 0).alias("blocking"),
    ).withColumn("blocking_percent", percent(F.col("blocking"), F.col("checked")))


def against_previous(reports: DataFrame, measures: list[str]) -> DataFrame:
    """Every report with the change of its measures since the latest earlier report."""
    by_week = Window.orderBy("week")
    out = reports
    for name in measures:
        change = F.col(name) - F.lag(name).over(by_week)
        out = out.withColumn(f"{name}_change", F.floor(change * 10 + 0.5) / 10)
    return out
