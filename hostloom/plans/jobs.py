"""The three main jobs, put together from operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.functions.text import content_hash, html_to_text
from hostloom.functions.urls import trimmed_path
from hostloom.operators import change, logs, pages, shops, sites
from hostloom.operators.keyed import keep_first, settle
from hostloom.plans import report


def build_sites(corpus: DataFrame, ranks: DataFrame, indexed: DataFrame, skipped: DataFrame, rules=None, **admission) -> DataFrame:
    """Ranked domains the index lacks, with a record read from their home page.

    ``corpus`` has (page_id, url, domain, html). The HTML stays in its scan: every page
    is read in its own row, and only the short records meet in the pick of one page
    per domain. Parked and error pages give no record.
    """
    wanted = sites.not_indexed(pages.ranked_domains(ranks, **admission), indexed, skipped)
    todo = corpus.join(wanted.select("domain", "rank"), "domain")
    text = html_to_text(F.col("html"), "summary")
    live = settle(todo, text.alias("_text")).where(~pages.is_parked_or_error(F.col("_text")))
    base = live.withColumn("path", trimmed_path(F.col("url"))).withColumn("content_hash", content_hash(F.col("_text"))).drop("_text", "url")
    records = sites.site_names(pages.page_metadata(base))
    found = pages.page_actions(base.select("page_id", "domain", "html"), rules=rules)
    actions = found.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "name", "url"))).alias("actions"))
    joined = records.join(actions, "page_id", "left")
    best = keep_first(joined, ["domain"], F.length("path"), F.col("page_id"))
    usable = F.coalesce(F.size("actions"), F.lit(0)) > 0
    return best.withColumn("conversion", F.when(usable, "heuristic").otherwise("minimal"))


def refresh_shops(items: DataFrame, stored: DataFrame, watches: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Feed items to what has to be written: changes, history rows, watch states, alerts."""
    changes = shops.price_changes(items, stored)
    checked = change.check_watches(watches, items)
    return {
        "changes": changes,
        "history": shops.history_rows(changes, now),
        "watches": checked,
        "alerts": change.alerts(checked, now),
    }


def weekly_report(index: DataFrame, searches: DataFrame, clicks: DataFrame, as_of: Column) -> DataFrame:
    """One report row with nested figures, ready for ``writers.save_report``.

    Every list in the row is a top-k of at most twelve entries.
    """
    week_ago = as_of - F.make_dt_interval(days=F.lit(7))
    recent = searches.where(logs.since_days(F.col("created_at"), as_of, 7))

    def listed(top: DataFrame, name: str, count: str) -> Column:
        entries = F.array_sort(F.collect_list(F.struct((-F.col(count)).alias("minus"), F.col(name).alias("name"))))
        return top.agg(F.transform(entries, lambda e: F.struct(e["name"].alias("name"), (-e["minus"]).alias("count")))).scalar()

    visits = clicks.where(F.col("day") >= F.to_date(week_ago)).agg(F.coalesce(F.sum("clicks"), F.lit(0)).alias("v")).scalar()
    counts = report.site_counts(index, week_ago).withColumn("searches", recent.agg(F.count(F.lit(1)).alias("n")).scalar()).withColumn("visits_sent", visits)
    figures = counts.withColumn("click_through_percent", report.percent(F.col("visits_sent"), F.col("searches")))
    return figures.select(
        F.date_format(as_of, "yyyy-MM-dd").alias("week"),
        F.struct(*figures.columns).alias("figures"),
        listed(report.category_counts(index), "category", "sites").alias("categories"),
        listed(report.top_cities(index), "city", "sites").alias("cities"),
        listed(logs.top_queries(recent, min_count=3, k=10, max_length=40), "query", "searches").alias("top_queries"),
        listed(logs.appearances(recent).orderBy(F.desc("appearances"), "domain").limit(10), "domain", "appearances").alias("top_sites"),
    )
