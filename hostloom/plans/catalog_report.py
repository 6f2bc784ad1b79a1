"""Catalogue: the weekly report."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostloom.operators.logs import since_days
from hostloom.plans import report, roles
from hostloom.plans.registry import query
from hostloom.plans.roles import AS_OF, as_of

_NOW = f"TIMESTAMP '{AS_OF}'"


@query(
    "weekly_activity_report",
    """WITH w AS (SELECT date_trunc('week', created_at) AS week, count(*) AS searches,
           count(*) FILTER (kind = 'click') AS visits_sent, count(*) FILTER (result_count = 0) AS without_results,
           count(*) FILTER (tier = 'test') AS tests FROM searches GROUP BY 1),
         p AS (SELECT *, floor(visits_sent * 1000.0 / searches + 0.5) / 10 AS click_through_percent FROM w)
       SELECT strftime(week, '%Y-%m-%d') AS week, searches, visits_sent, without_results, tests, click_through_percent,
         floor((searches - lag(searches) OVER o) * 10.0 + 0.5) / 10 AS searches_change,
         floor((visits_sent - lag(visits_sent) OVER o) * 10.0 + 0.5) / 10 AS visits_sent_change,
         floor((click_through_percent - lag(click_through_percent) OVER o) * 10 + 0.5) / 10 AS click_through_percent_change
       FROM p WINDOW o AS (ORDER BY week)""",
)
def weekly_activity_report(spark, sf):
    return report.weekly_activity(roles.searches(spark, sf)).withColumn("week", F.col("week").cast("string"))


@query(
    "index_counts",
    f"""SELECT *, floor(readable * 1000.0 / sites + 0.5) / 10 AS readable_percent FROM (
          SELECT count(*) FILTER (status IS NULL) AS sites, count(*) FILTER (status IS NULL AND action_count > 0) AS readable,
            count(*) FILTER (native) AS native, count(*) FILTER (status IS NULL AND action_count = 0) AS minimal,
            count(*) FILTER (has_business) AS with_business, count(*) FILTER (has_hours) AS with_hours,
            count(*) FILTER (first_seen_at >= {_NOW} - INTERVAL 7 DAY) AS new_sites FROM sites)""",
)
def index_counts(spark, sf):
    return report.site_counts(roles.sites(spark, sf), as_of() - F.make_dt_interval(days=F.lit(7)))


@query(
    "category_counts",
    """SELECT category, count(*) AS sites FROM sites WHERE status IS NULL AND action_count > 0 GROUP BY category
       ORDER BY sites DESC, category LIMIT 12""",
)
def category_counts(spark, sf):
    return report.category_counts(roles.sites(spark, sf))


@query("language_counts", "SELECT language, count(*) AS sites FROM sites WHERE status IS NULL GROUP BY language")
def language_counts(spark, sf):
    return report.language_counts(roles.sites(spark, sf))


@query(
    "city_category_rollup",
    """SELECT city, category, count(*) AS sites, CASE WHEN grouping(category) = 1 THEN 'city' ELSE 'city and category' END AS scope
       FROM sites WHERE category <> 'machinery' GROUP BY ROLLUP (city, category)
       HAVING grouping(city) = 0 AND count(*) >= 3""",
)
def city_category_rollup(spark, sf):
    return report.city_categories(roles.sites(spark, sf), min_sites=3, hidden=("machinery",))


@query("top_cities", "SELECT city, count(*) AS sites FROM sites GROUP BY city ORDER BY sites DESC, city LIMIT 10")
def top_cities(spark, sf):
    return report.top_cities(roles.sites(spark, sf))


@query(
    "visits_per_site",
    f"""SELECT domain, CAST(sum(clicks) AS BIGINT) AS visits FROM link_clicks
        WHERE day >= CAST({_NOW} - INTERVAL 7 DAY AS DATE) GROUP BY domain""",
)
def visits_per_site(spark, sf):
    clicks = roles.link_clicks(spark, sf)
    recent = clicks.where(since_days(F.col("day").cast("timestamp"), as_of(), 7))
    return recent.groupBy("domain").agg(F.sum("clicks").alias("visits"))
