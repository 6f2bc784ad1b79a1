"""Catalogue: nested site documents, written as a table and read by path; logs read by day."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostloom.functions.patterns import first_group
from hostloom.operators import documents as D
from hostloom.operators import logs
from hostloom.plans import jobs, roles
from hostloom.plans.registry import query, shared
from hostloom.plans.roles import AS_OF, as_of, table
from hostloom.sources.parted import append_once, shared_folder
from hostloom.sources.tables import recent_days

_NOW = f"TIMESTAMP '{AS_OF}'"

# --- nested documents -----------------------------------------------------------------------


def _documents(spark, sf):
    """Documents assembled from ``pages``, written to the shared folder and opened again."""
    page = F.col("page_id")
    crawled = roles.crawled(spark, sf)
    path = F.when(page % 5 == 0, F.lit("/")).otherwise(F.regexp_extract("url", "^[A-Za-z]+://[^/?#]*(/[^?#]*)", 1))
    content = F.when(page % 7 == 0, F.concat(F.lit("Website at "), "domain")).otherwise(first_group(F.col("html"), "<h1>([^<]*)<"))
    pages = crawled.select("domain", path.alias("path"), F.struct(page.alias("page_id"), first_group(F.col("html"), "<title>([^<]*)<").alias("title"), content.alias("content")).alias("page"))
    language = F.regexp_extract("html", 'lang="([a-z]+)"', 1)
    actions = crawled.select("domain", F.struct(language.alias("id"), F.struct(F.when(F.col("url").startswith("https:"), F.col("domain")).alias("url")).alias("endpoint")).alias("action"))
    n, secure = F.count(F.lit(1)), F.count_if(F.col("url").startswith("https:"))
    totals = crawled.groupBy("domain").agg(n.alias("n"), secure.alias("secure"), F.min("page_id").alias("first"))
    records = totals.select(
        "domain",
        (F.col("secure") >= 2).alias("native"),
        F.when(F.col("n") % 2 == 0, F.struct(
            F.when(F.col("first") % 3 == 0, "map").otherwise("page").alias("source"), F.when(F.col("n") % 4 == 0, F.concat(F.lit("Mo-Fr "), F.col("n").cast("string"))).alias("opening_hours"),
        )).alias("business"),
        F.when(F.col("first") % 2 == 0, F.struct(F.filter(F.array(F.when(F.col("n") > 2, "GPTBot"), F.when(F.col("secure") > 2, "CCBot")), lambda b: b.isNotNull()).alias("blocked"))).alias("ai_access"),
        F.when(F.col("first") % 11 == 0, "parked").alias("status"),
        (as_of() - F.make_dt_interval(days=(F.col("first") % 20).cast("int"))).alias("first_seen_at"),
    )
    stored = shared_folder(spark)
    D.assemble(records, pages, actions, most_pages=4, most_actions=3).write.parquet(stored)
    return spark.read.parquet(stored)


shared(
    "document_pages",
    r"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY path <> '/', length(path), path) AS place FROM (
          SELECT DISTINCT ON (domain, path) domain, path, content FROM (
            SELECT page_id, domain, CASE WHEN page_id % 5 = 0 THEN '/' ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*(/[^?#]*)', 1) END AS path,
              CASE WHEN page_id % 7 = 0 THEN 'Website at ' || domain ELSE regexp_extract(html, '<h1>([^<]*)<', 1) END AS content FROM crawled)
          ORDER BY domain, path, page_id)) WHERE place <= 4""",
)
shared(
    "document_actions",
    r"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY id) AS place FROM (
          SELECT domain, regexp_extract(html, 'lang="([a-z]+)"', 1) AS id, bool_and(url LIKE 'https:%') AS callable FROM crawled GROUP BY ALL)) WHERE place <= 3""",
)
shared(
    "document_records",
    f"""SELECT domain, secure >= 2 AS native, n % 2 = 0 AS has_business, n % 4 = 0 AS has_hours, n % 2 = 0 AND f % 3 = 0 AS from_map, f % 2 = 0 AS checked,
          f % 2 = 0 AND (n > 2 OR secure > 2) AS blocking, CASE WHEN f % 11 = 0 THEN 'parked' END AS status, {_NOW} - to_days(CAST(f % 20 AS INTEGER)) AS first_seen_at,
          (SELECT count(*) FROM document_pages p WHERE p.domain = t.domain) AS page_count, (SELECT count(*) FROM document_actions a WHERE a.domain = t.domain) AS action_count,
          (SELECT coalesce(bool_or(callable), false) FROM document_actions a WHERE a.domain = t.domain) AS callable,
          (SELECT arg_min(content, place) FROM document_pages p WHERE p.domain = t.domain) AS home,
          (SELECT any_value(content) FROM document_pages p WHERE p.domain = t.domain AND path = '/') AS slash
        FROM (SELECT domain, count(*) AS n, count(*) FILTER (url LIKE 'https:%') AS secure, min(page_id) AS f FROM crawled GROUP BY 1) t""",
)


@query(
    "document_scores",
    """SELECT domain, CAST(score AS INTEGER) AS score, CASE WHEN score >= 80 THEN 'ready' WHEN score >= 45 THEN 'partly ready' ELSE 'not ready yet' END AS label, passed FROM (
         SELECT domain, c1 * 15 + c2 * 15 + c3 * 15 + c4 * 10 + c5 * 15 + c6 * 15 + c7 * 15 AS score,
           concat_ws(', ', CASE WHEN c1 = 1 THEN 'description' END, CASE WHEN c2 = 1 THEN 'several pages' END, CASE WHEN c3 = 1 THEN 'actions' END, CASE WHEN c4 = 1 THEN 'three actions' END,
             CASE WHEN c5 = 1 THEN 'own document' END, CASE WHEN c6 = 1 THEN 'executable actions' END, CASE WHEN c7 = 1 THEN 'business details' END) AS passed
         FROM (SELECT domain, CAST(length(home) > 80 AND home NOT LIKE 'Website at %' AS INTEGER) AS c1, CAST(page_count >= 3 AS INTEGER) AS c2, CAST(action_count >= 1 AS INTEGER) AS c3,
           CAST(action_count >= 3 AS INTEGER) AS c4, CAST(native AS INTEGER) AS c5, CAST(native AND callable AS INTEGER) AS c6, CAST(has_business AS INTEGER) AS c7 FROM document_records))""",
)
def document_scores(spark, sf):
    return D.with_readiness(_documents(spark, sf)).withColumn("passed", F.array_join("passed", ", "))


@query(
    "document_predicates",
    """SELECT 'opening hours' AS predicate, domain FROM document_records WHERE has_hours UNION ALL SELECT 'blocks bots', domain FROM document_records WHERE blocking
       UNION ALL SELECT 'placeholder', domain FROM document_records WHERE slash LIKE 'Website at %' UNION ALL SELECT 'from the map', domain FROM document_records WHERE from_map""",
)
def document_predicates(spark, sf):
    tests = {"opening hours": D.states_hours(), "blocks bots": D.blocks_bots(), "placeholder": D.is_placeholder(), "from the map": D.comes_from("map")}
    return D.predicates(_documents(spark, sf), tests)


@query(
    "index_totals",
    f"""SELECT *, floor(readable * 1000.0 / sites + 0.5) / 10 AS readable_percent, floor(blocking_bots * 1000.0 / checked_access + 0.5) / 10 AS blocking_percent FROM (
          SELECT count(*) FILTER (status IS NULL) AS sites, count(*) FILTER (status IS NULL AND action_count > 0) AS readable, count(*) FILTER (native) AS native,
            count(*) FILTER (status IS NULL AND action_count = 0) AS minimal, count(*) FILTER (has_business) AS with_business, count(*) FILTER (has_hours) AS with_hours,
            count(*) FILTER (checked) AS checked_access, count(*) FILTER (blocking) AS blocking_bots, count(*) FILTER (first_seen_at >= {_NOW} - INTERVAL 7 DAY) AS new_sites,
            (SELECT count(*) FROM part) AS items, (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM orders WHERE o_orderdate >= DATE '1998-01-01') AS upcoming_events,
            (SELECT count(*) FROM searches WHERE created_at >= {_NOW} - INTERVAL 7 DAY) AS searches FROM document_records)""",
)
def index_totals(spark, sf):
    # Orders stand for events; the clock of that table is moved to the catalogue's.
    late = F.datediff(F.col("o_orderdate"), F.lit("1998-01-01").cast("date"))
    events = table(spark, sf, "orders").select((as_of() + F.make_dt_interval(days=late)).alias("start_date"))
    return D.index_totals(_documents(spark, sf), table(spark, sf, "part"), table(spark, sf, "pages"), events, roles.searches(spark, sf), as_of())


# --- logs by day ----------------------------------------------------------------------------


def daily_log(spark, sf):
    """The search log as a history by day, opened again."""
    path = shared_folder(spark)
    append_once(roles.searches(spark, sf), path, "all", "created_at")
    return spark.read.parquet(path)


@query(
    "daily_demand_pruned",
    f"""SELECT domain, CAST(sum(w) AS BIGINT) AS score FROM (
          SELECT unnest(domains[1:5]) AS domain, CASE WHEN created_at >= {_NOW} - INTERVAL 3 DAY THEN 2 ELSE 1 END AS w
          FROM searches WHERE created_at >= {_NOW} - INTERVAL 10 DAY) GROUP BY domain""",
)
def daily_demand_pruned(spark, sf):
    return logs.weighted_demand(recent_days(daily_log(spark, sf), as_of(), 10), as_of(), 10, 3)


@query(
    "hourly_slo_pruned",
    f"""SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, n, list_extract(v, CAST(least(floor(n * 0.5), n - 1) AS INTEGER) + 1) AS p50_ms, list_extract(v, CAST(least(floor(n * 0.95), n - 1) AS INTEGER) + 1) AS p95_ms
        FROM (SELECT date_trunc('hour', created_at) AS hour, count(*) AS n, list_sort(list(duration_ms)) AS v FROM searches
          WHERE created_at >= {_NOW} - INTERVAL 4 DAY AND duration_ms IS NOT NULL GROUP BY 1) WHERE n >= 2""",
)
def hourly_slo_pruned(spark, sf):
    recent = recent_days(daily_log(spark, sf), as_of(), 4).where(logs.since_days(F.col("created_at"), as_of(), 4))
    return logs.hourly_slo(recent, min_samples=2).select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", "p50_ms", "p95_ms")


@query(
    "weekly_report_pruned",
    f"""SELECT (SELECT count(*) FROM searches WHERE created_at >= {_NOW} - INTERVAL 7 DAY) AS searches, (SELECT CAST(sum(clicks) AS BIGINT) FROM link_clicks WHERE day >= DATE '2024-01-24') AS visits_sent,
          (SELECT string_agg(q || '=' || n, ' ' ORDER BY n DESC, q) FROM (SELECT query AS q, count(*) AS n FROM searches WHERE created_at >= {_NOW} - INTERVAL 7 DAY GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, q LIMIT 10)) AS top_queries""",
)
def weekly_report_pruned(spark, sf):
    recent = recent_days(daily_log(spark, sf), as_of(), 7)
    clicks = recent.where(F.col("kind") == "click").groupBy(F.col("domains")[0].alias("domain"), "day").agg(F.count(F.lit(1)).alias("clicks"))
    row = jobs.weekly_report(roles.sites(spark, sf), recent, clicks, as_of())
    top = F.array_join(F.transform("top_queries", lambda e: F.concat(e["name"], F.lit("="), e["count"].cast("string"))), " ")
    return row.select("figures.searches", "figures.visits_sent", top.alias("top_queries"))
