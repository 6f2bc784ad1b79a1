"""Catalogue: the main jobs from end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostloom.functions.urls import host_of, without_www
from hostloom.operators.change import audience, recipients
from hostloom.plans import jobs, roles
from hostloom.plans.catalog_change import _feed, _stored, _watches
from hostloom.plans.catalog_pages import _RULES
from hostloom.plans.registry import query
from hostloom.plans.roles import AS_OF, as_of, table

_NOW = f"TIMESTAMP '{AS_OF}'"


@query(
    "bulk_build",
    r"""WITH todo AS (SELECT page_id, domain, html, length(regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*(/[^?#]*)?', 1), '/+$', '')) AS depth FROM crawled
          WHERE domain NOT LIKE '%.net' AND domain NOT LIKE 'm.%' AND domain NOT LIKE 'spam-farm%'),
        home AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY depth, page_id) AS r FROM todo),
        hit AS (
          SELECT page_id, 0 AS o, 'book' AS id FROM links_cte WHERE regexp_matches(lower(href), '/(the|and)(/?$|\?)') OR regexp_matches(label, '(?i)^(the)$')
          UNION SELECT page_id, 1, 'shop' FROM links_cte WHERE regexp_matches(lower(href), '/(que|des)(/|$)') OR regexp_matches(label, '(?i)^(que|des)$')
          UNION SELECT page_id, 2, 'contact' FROM links_cte WHERE regexp_matches(lower(href), '/(para|los)(/|$)') OR regexp_matches(label, '(?i)^(para|los)$')
          UNION SELECT page_id, 3, 'help' FROM links_cte WHERE regexp_matches(lower(href), '/(und|der)(/|$)') OR regexp_matches(label, '(?i)^(und|die)$')),
        acts AS (SELECT page_id, string_agg(id, ' ' ORDER BY o) AS actions FROM hit GROUP BY page_id)
        SELECT domain, page_id, lower(regexp_extract(html, '(?i)<html[^>]+lang=["'']([a-z]{2})', 1)) AS language, coalesce(actions, '') AS actions,
          CASE WHEN actions IS NULL THEN 'minimal' ELSE 'heuristic' END AS conversion
        FROM home LEFT JOIN acts USING (page_id) WHERE r = 1""",
)
def bulk_build(spark, sf):
    pages = table(spark, sf, "pages")
    domain = without_www(host_of(F.col("url")))
    ranks = pages.select((F.col("page_id") + 1).alias("rank"), domain.alias("domain"))
    indexed = pages.select(domain.alias("domain")).where(F.col("domain").startswith("m.")).distinct()
    skipped = pages.select(domain.alias("domain")).where(F.col("domain").startswith("spam-farm")).distinct()
    built = jobs.build_sites(roles.crawled(spark, sf), ranks, indexed, skipped, rules=_RULES, skipped_suffixes=(".net",))
    shown = F.array_join(F.transform("actions", lambda a: a["id"]), " ")
    return built.select("domain", "page_id", "language", F.coalesce(shown, F.lit("")).alias("actions"), "conversion")


@query(
    "shop_refresh",
    """SELECT 'change ' || CASE WHEN s.url IS NULL THEN 'new' WHEN abs(s.price_eur - f.price_eur) >= 0.01 THEN 'changed' ELSE 'unchanged' END AS measure, count(*) AS rows
         FROM feed_prices f LEFT JOIN stored_prices s USING (url) GROUP BY 1
       UNION ALL SELECT 'history', count(*) FROM feed_prices f LEFT JOIN stored_prices s USING (url) WHERE s.url IS NULL OR abs(s.price_eur - f.price_eur) >= 0.01
       UNION ALL SELECT 'watches', count(*) FROM watch_rows JOIN feed_prices USING (url)
       UNION ALL SELECT 'alert price_drop', count(*) FROM watch_rows w JOIN feed_prices f USING (url)
         WHERE notify_price AND f.price_eur < last_price - 0.01 AND (target IS NULL OR f.price_eur <= target) AND f.available
       UNION ALL SELECT 'alert back_in_stock', count(*) FROM watch_rows w JOIN feed_prices f USING (url) WHERE notify_stock AND NOT last_available AND f.available""",
)
def shop_refresh(spark, sf):
    parts = jobs.refresh_shops(_feed(spark, sf).select("url", "price_eur", "available"), _stored(spark, sf), _watches(spark, sf), as_of())
    count = F.count(F.lit(1)).alias("rows")
    return (
        parts["changes"].groupBy(F.concat(F.lit("change "), "change").alias("measure")).agg(count)
        .unionByName(parts["history"].agg(F.lit("history").alias("measure"), count))
        .unionByName(parts["watches"].agg(F.lit("watches").alias("measure"), count))
        .unionByName(parts["alerts"].groupBy(F.concat(F.lit("alert "), "kind").alias("measure")).agg(count))
    )


@query(
    "weekly_report_row",
    f"""SELECT '2024-01-31' AS week, (SELECT count(*) FROM sites WHERE status IS NULL) AS sites, (SELECT count(*) FROM searches WHERE created_at >= {_NOW} - INTERVAL 7 DAY) AS searches,
          (SELECT CAST(sum(clicks) AS BIGINT) FROM link_clicks WHERE day >= DATE '2024-01-24') AS visits_sent,
          (SELECT string_agg(q || '=' || n, ' ' ORDER BY n DESC, q) FROM (SELECT query AS q, count(*) AS n FROM searches WHERE created_at >= {_NOW} - INTERVAL 7 DAY GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, q LIMIT 10)) AS top_queries,
          (SELECT string_agg(c || '=' || n, ' ' ORDER BY n DESC, c) FROM (SELECT city AS c, count(*) AS n FROM sites GROUP BY 1 ORDER BY n DESC, c LIMIT 10)) AS cities""",
)
def weekly_report_row(spark, sf):
    row = jobs.weekly_report(roles.sites(spark, sf), roles.searches(spark, sf), roles.link_clicks(spark, sf), as_of())
    shown = lambda c: F.array_join(F.transform(c, lambda e: F.concat(e["name"], F.lit("="), e["count"].cast("string"))), " ")
    return row.select("week", "figures.sites", "figures.searches", "figures.visits_sent", shown("top_queries").alias("top_queries"), shown("cities").alias("cities"))


@query(
    "alert_recipients",
    """SELECT s.domain, 'k' || user_id || '@mail.example' AS email FROM sites s JOIN (SELECT DISTINCT user_id FROM events) e ON s.owner_key = 'k' || e.user_id""",
)
def alert_recipients(spark, sf):
    accounts = table(spark, sf, "events").select("user_id").distinct().select(
        F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key_hash"), F.concat(F.lit("k"), F.col("user_id").cast("string"), F.lit("@mail.example")).alias("email")
    )
    return recipients(roles.sites(spark, sf).select("domain", "owner_key"), accounts).select("domain", "email")


@query(
    "newsletter_audience",
    """SELECT 'c' || c_custkey || '@mail.example' AS email FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING' ORDER BY email LIMIT 90""",
)
def newsletter_audience(spark, sf):
    stamp = F.lit(AS_OF).cast("timestamp")
    readers = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@mail.example")).alias("email"),
        F.when(F.col("c_acctbal") > 0, stamp).alias("confirmed_at"), F.when(F.col("c_mktsegment") == "BUILDING", stamp).alias("unsubscribed_at"),
    )
    return audience(readers, 90)
