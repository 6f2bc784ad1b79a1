"""Catalogue: prices, change detection, alerts, retention and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostloom.functions import hours as H
from hostloom.functions.urls import host_of
from hostloom.operators import change as C
from hostloom.operators import shops
from hostloom.operators.logs import due
from hostloom.operators.pages import links_of, page_language
from hostloom.functions.text import page_title
from hostloom.plans import report, roles
from hostloom.plans.registry import query, shared
from hostloom.plans.roles import AS_OF, as_of, table
from hostloom.sources import writers as K

_NOW = f"TIMESTAMP '{AS_OF}'"
_TIE = "observed_at, observation_id, price_eur, available"
#: The price log runs from 1995 to late 2001; the feed of the catalogue is what came after this day.
FEED_START = "2001-06-01"
STORED_FROM = "2000-12-01"
#: Clock of the price catalogue.
PRICE_NOW = "2001-11-05 00:00:00"


def _feed_edge():
    return F.lit(FEED_START).cast("timestamp")


# --- prices ---------------------------------------------------------------------------------


@query(
    "price_drop_alerts",
    f"""SELECT url, strftime(observed_at, '%Y-%m-%d') AS day, observation_id, before, price_eur, CAST(floor((before - price_eur) / before * 100 + 0.5) AS INTEGER) AS percent_off
        FROM (SELECT *, lag(price_eur) OVER (PARTITION BY url ORDER BY {_TIE}) AS before FROM price_log)
        WHERE price_eur < before - 0.01 AND available""",
)
def price_drop_alerts(spark, sf):
    drops = C.price_drops(roles.price_log(spark, sf))
    return drops.select("url", F.date_format("observed_at", "yyyy-MM-dd").alias("day"), "observation_id", F.col("prev_price_eur").alias("before"), "price_eur", "percent_off")


@query(
    "back_in_stock",
    f"""SELECT url, strftime(observed_at, '%Y-%m-%d') AS day, observation_id FROM (
          SELECT *, lag(available) OVER (PARTITION BY url ORDER BY {_TIE}) AS before FROM price_log) WHERE NOT before AND available""",
)
def back_in_stock(spark, sf):
    back = C.restocks(roles.price_log(spark, sf))
    return back.select("url", F.date_format("observed_at", "yyyy-MM-dd").alias("day"), "observation_id")


shared("stored_prices", f"SELECT DISTINCT ON (url) * FROM price_log WHERE observed_at >= TIMESTAMP '{STORED_FROM}' AND observed_at < TIMESTAMP '{FEED_START}' ORDER BY url, observed_at DESC, observation_id DESC, price_eur DESC, available DESC")
shared("feed_prices", f"SELECT DISTINCT ON (url) * FROM price_log WHERE observed_at >= TIMESTAMP '{FEED_START}' ORDER BY url, observed_at DESC, observation_id DESC, price_eur DESC, available DESC")


def _stored(spark, sf):
    # The store holds half a year, so items without a price in it are new to the feed.
    return shops.latest_offers(roles.price_log(spark, sf).where(F.col("observed_at") >= F.lit(STORED_FROM).cast("timestamp")), _feed_edge())


def _feed(spark, sf):
    return shops.latest_offers(roles.price_log(spark, sf).where(F.col("observed_at") >= _feed_edge()))


@query(
    "price_changes",
    """SELECT f.url, f.price_eur, s.price_eur AS previous_price_eur, CASE WHEN s.url IS NULL THEN 'new' WHEN abs(s.price_eur - f.price_eur) >= 0.01 THEN 'changed'
       ELSE 'unchanged' END AS change FROM feed_prices f LEFT JOIN stored_prices s USING (url)""",
)
def price_changes(spark, sf):
    return shops.price_changes(_feed(spark, sf).select("url", "price_eur"), _stored(spark, sf))


@query(
    "price_history_rows",
    """SELECT f.url, f.price_eur FROM feed_prices f LEFT JOIN stored_prices s USING (url) WHERE s.url IS NULL OR abs(s.price_eur - f.price_eur) >= 0.01""",
)
def price_history_rows(spark, sf):
    changes = shops.price_changes(_feed(spark, sf).select("url", "price_eur"), _stored(spark, sf))
    return shops.history_rows(changes, _feed_edge()).select("url", "price_eur")


_WATCHES = """SELECT item_id AS id, url, CASE WHEN item_id % 4 = 0 THEN price_eur * 0.9 END AS target, price_eur AS last_price,
    CASE WHEN item_id % 9 <> 0 THEN available END AS last_available, item_id % 10 <> 0 AS notify_price,
    CASE WHEN item_id % 3 <> 0 THEN item_id % 5 <> 0 END AS notify_stock FROM stored_prices WHERE price_eur < 2500"""
shared("watch_rows", _WATCHES)


def _watches(spark, sf):
    k = F.regexp_extract("url", r"(\d+)$", 1).cast("bigint")
    return _stored(spark, sf).where(F.col("price_eur") < 2500).select(
        k.alias("id"), "url", F.when(k % 4 == 0, F.col("price_eur") * 0.9).alias("target_price_eur"), F.col("price_eur").alias("last_price_eur"),
        F.when(k % 9 != 0, F.col("available")).alias("last_available"), (k % 10 != 0).alias("notify_price"),
        F.when(k % 3 != 0, k % 5 != 0).alias("notify_stock"),
    )


@query(
    "watch_checks",
    """SELECT id, coalesce(notify_stock AND NOT last_available AND f.available, false) AS back_in_stock,
         coalesce(notify_price AND f.price_eur < last_price - 0.01 AND (target IS NULL OR f.price_eur <= target) AND f.available, false) AS price_drop,
         f.price_eur AS last_price_eur, CASE WHEN notify_stock IS NOT NULL THEN f.available ELSE last_available END AS last_available
       FROM watch_rows w JOIN feed_prices f USING (url)""",
)
def watch_checks(spark, sf):
    checked = C.check_watches(_watches(spark, sf), _feed(spark, sf))
    return checked.select("id", "back_in_stock", "price_drop", "last_price_eur", "last_available")


@query(
    "watch_alerts",
    """SELECT kind, CAST(id AS VARCHAR) AS key FROM (
         SELECT id, 'back_in_stock' AS kind FROM watch_rows w JOIN feed_prices f USING (url) WHERE notify_stock AND NOT last_available AND f.available
         UNION ALL SELECT id, 'price_drop' FROM watch_rows w JOIN feed_prices f USING (url)
           WHERE notify_price AND f.price_eur < last_price - 0.01 AND (target IS NULL OR f.price_eur <= target) AND f.available)""",
)
def watch_alerts(spark, sf):
    return C.alerts(C.check_watches(_watches(spark, sf), _feed(spark, sf)), as_of()).select("kind", "key")


@query(
    "price_history_thin",
    f"""SELECT url, observation_id, price_eur, strftime(observed_at, '%Y-%m-%d') AS day FROM price_log WHERE observed_at >= TIMESTAMP '{PRICE_NOW}' - INTERVAL 30 DAY
        UNION ALL SELECT url, observation_id, price_eur, strftime(observed_at, '%Y-%m-%d') FROM (
          SELECT *, row_number() OVER (PARTITION BY url, date_trunc('week', observed_at) ORDER BY observed_at DESC, observation_id DESC, price_eur DESC, available DESC) AS r
          FROM price_log WHERE observed_at < TIMESTAMP '{PRICE_NOW}' - INTERVAL 30 DAY) WHERE r = 1""",
)
def price_history_thin(spark, sf):
    thin = shops.thin_history(roles.price_log(spark, sf), F.lit(PRICE_NOW).cast("timestamp"))
    return thin.select("url", "observation_id", "price_eur", F.date_format("observed_at", "yyyy-MM-dd").alias("day"))


@query(
    "daily_new_cap",
    """WITH r AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS place FROM orders)
       SELECT o_orderkey, day FROM r WHERE place <= 4 - CASE WHEN CAST(substring(day, 9) AS INTEGER) % 3 = 0 THEN 2 WHEN CAST(substring(day, 9) AS INTEGER) % 3 = 1 THEN 5 ELSE 0 END""",
)
def daily_new_cap(spark, sf):
    new = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    third = F.dayofmonth(F.col("day").cast("date")) % 3
    used = new.select("day").distinct().where(third < 2).withColumn("used", F.when(third == 0, 2).otherwise(5))
    return shops.within_daily_cap(new, "day", [F.col("o_orderkey")], 4, used)


@query(
    "eur_prices",
    """SELECT url, price_eur AS price, CASE item_id % 4 WHEN 0 THEN 'dkk' WHEN 1 THEN 'USD' WHEN 2 THEN 'eur' ELSE 'XXX' END AS currency,
         CASE item_id % 4 WHEN 0 THEN floor(price_eur / 7.46 * 100 + 0.5) / 100 WHEN 1 THEN floor(price_eur / 1.08 * 100 + 0.5) / 100
           WHEN 2 THEN floor(price_eur / 1.0 * 100 + 0.5) / 100 END AS in_euro FROM price_log""",
)
def eur_prices(spark, sf):
    from hostloom.operators.keyed import rule_table

    rates = rule_table(spark, [("DKK", 7.46), ("USD", 1.08)], "currency string, rate double")
    k = F.col("item_id") % 4
    currency = F.when(k == 0, "dkk").when(k == 1, "USD").when(k == 2, "eur").otherwise("XXX")
    items = roles.price_log(spark, sf).select("url", F.col("price_eur").alias("price"), currency.alias("currency"))
    return shops.with_euro(items, rates).withColumnRenamed("price_eur", "in_euro")


# --- pages ----------------------------------------------------------------------------------


def _second_version(text, doc):
    """Text without its last line for every third document."""
    return F.when(doc % 3 == 0, F.regexp_replace(text, r"\n[^\n]*$", "")).otherwise(text)


@query(
    "page_watch",
    r"""WITH v AS (SELECT doc_id, text AS a, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '\n[^\n]*$', '') ELSE text END AS b,
            CASE doc_id % 4 WHEN 0 THEN 'appears' WHEN 1 THEN 'disappears' ELSE 'change' END AS watch_for, 'the' AS phrase FROM documents),
        n AS (SELECT *, regexp_replace(lower(a), '\s+', ' ', 'g') AS x, regexp_replace(lower(b), '\s+', ' ', 'g') AS y FROM v),
        s AS (SELECT *, CASE WHEN doc_id % 11 <> 0 THEN sha256(x) END AS last_hash, contains(x, phrase) <> (doc_id % 5 = 0) AS last_seen FROM n)
        SELECT doc_id AS id, watch_for, coalesce(CASE watch_for WHEN 'change' THEN last_hash <> sha256(y) WHEN 'appears' THEN contains(y, phrase) AND NOT last_seen
          ELSE NOT contains(y, phrase) AND last_seen END, false) AS happened,
          coalesce(CASE watch_for WHEN 'change' THEN last_hash <> sha256(y) WHEN 'appears' THEN contains(y, phrase) AND NOT last_seen
          ELSE NOT contains(y, phrase) AND last_seen END, false) AND (doc_id % 7 <> 0 OR watch_for = 'change') AS alert FROM s""",
)
def page_watch(spark, sf):
    from hostloom.functions.text import content_hash, watch_text

    doc = F.col("doc_id")
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("d"), doc.cast("string")).alias("url"), "text")
    seen = watch_text(F.col("text"))
    watches = docs.select(
        doc.alias("id"), "url", F.when(doc % 4 == 0, "appears").when(doc % 4 == 1, "disappears").otherwise("change").alias("watch_for"),
        F.lit("THE").alias("phrase"), F.when(doc % 11 != 0, content_hash(seen)).alias("last_hash"),
        (seen.contains("the") != (doc % 5 == 0)).alias("last_seen"), F.when(doc % 7 == 0, as_of()).alias("alerted_at"),
    )
    now = docs.select("url", _second_version(F.col("text"), doc).alias("text"))
    return C.check_pages(watches, now).select("id", "watch_for", "happened", "alert")


@query(
    "site_diffs",
    """WITH l AS (SELECT page_id, url, html, title, list_filter(list_transform(range(len(h)), lambda i: h[i + 1]), lambda x: true) AS h, lang FROM (
           SELECT page_id, url, html, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
             regexp_extract_all(html, '(?is)<a[^>]+href=["'']([^"''#]+)["''][^>]*>(.*?)</a>', 1) AS h,
             lower(regexp_extract(html, '(?i)<html[^>]+lang=["'']([a-z]{2})', 1)) AS lang FROM pages)),
         v AS (SELECT page_id, list_sort(list_distinct(h)) AS was, list_sort(list_distinct(list_concat(
             list_filter(list_transform(range(len(h)), lambda i: CASE WHEN (page_id * 31 + i) % 7 <> 0 THEN h[i + 1] END), lambda x: x IS NOT NULL), CASE WHEN page_id % 9 = 0 THEN ['/new-' || page_id] ELSE [] END))) AS now,
             page_id % 5 = 0 AS renamed, page_id % 6 = 0 AS signup, lang FROM l),
         d AS (SELECT *, list_sort(list_filter(now, lambda x: NOT list_contains(was, x))) AS added, list_sort(list_filter(was, lambda x: NOT list_contains(now, x))) AS removed FROM v)
       SELECT page_id, renamed, array_to_string(added, ' ') AS added, array_to_string(removed, ' ') AS removed, signup AS new_action,
         (len(added) > 0)::INTEGER + (len(removed) > 0)::INTEGER + renamed::INTEGER + signup::INTEGER AS statements
       FROM d WHERE len(added) > 0 OR len(removed) > 0 OR renamed OR signup""",
)
def site_diffs(spark, sf):
    page = F.col("page_id")
    pages = table(spark, sf, "pages").select(
        "page_id", F.trim(page_title(F.col("html"))).alias("title"), page_language(F.col("html")).alias("lang"),
        F.transform(links_of(F.col("html")), lambda link: link["href"]).alias("h"),
    )
    kept = F.filter("h", lambda _, i: (page * 31 + i) % 7 != 0)
    fresh = F.when(page % 9 == 0, F.array(F.concat(F.lit("/new-"), page.cast("string")))).otherwise(F.array().cast("array<string>"))
    titled = lambda hrefs: F.map_from_entries(F.transform(F.array_distinct(hrefs), lambda h: F.struct(h, h)))
    signup = F.map_filter(F.create_map(F.lit("sign_up"), F.lit("Sign up"), F.lit("book"), F.lit("Book")), lambda k, _: (k == "book") | (page % 6 == 0))
    versions = pages.select(
        page.cast("string").alias("domain"), F.lit("Old").alias("old_name"), F.when(page % 5 == 0, "New").otherwise("Old").alias("new_name"),
        titled(F.col("h")).alias("old_pages"), titled(F.concat(kept, fresh)).alias("new_pages"),
        F.create_map(F.lit("book"), F.lit("Book")).alias("old_actions"), signup.alias("new_actions"),
    )
    diffs = C.describe_changes(versions)
    statements = sum((F.when(c, 1).otherwise(0) for c in (F.col("renamed"), F.size("pages_added") > 0, F.size("pages_removed") > 0, F.size("actions_added") > 0)), F.lit(0))
    return diffs.select(
        F.col("domain").cast("bigint").alias("page_id"), "renamed", F.array_join("pages_added", " ").alias("added"), F.array_join("pages_removed", " ").alias("removed"),
        (F.size("actions_added") > 0).alias("new_action"), statements.alias("statements"),
    )


@query(
    "diff_sentences",
    """SELECT c_custkey AS site_id, concat_ws('. ', CASE WHEN c_custkey % 2 = 0 THEN 'Renamed from Old to ' || c_name END,
         CASE WHEN c_custkey % 3 = 0 THEN 'New pages: "P1", "P2", "P3", "P4" and 1 more' END, CASE WHEN c_custkey % 5 = 0 THEN 'Page gone: /gone' END,
         CASE WHEN c_custkey % 4 = 0 THEN 'Retitled: "Same" → "' || c_name || '"' END, CASE WHEN c_custkey % 7 = 0 THEN 'New action: Shop' END) || '.' AS description
       FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0 OR c_custkey % 7 = 0""",
)
def diff_sentences(spark, sf):
    k = F.col("c_custkey")
    only = lambda test, *pairs: F.map_filter(F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in pairs]), lambda a, _: (a == "/same") | test)
    versions = table(spark, sf, "customer").select(
        k.cast("string").alias("domain"), F.lit("Old").alias("old_name"), F.when(k % 2 == 0, F.col("c_name")).otherwise("Old").alias("new_name"),
        only(k % 5 == 0, "/same", "Same", "/gone", "").alias("old_pages"),
        only(k % 3 == 0, "/same", F.when(k % 4 == 0, F.col("c_name")).otherwise("Same"), *[x for i in range(1, 6) for x in (f"/p{i}", f"P{i}")]).alias("new_pages"),
        F.create_map(F.lit("book"), F.lit("Book")).alias("old_actions"),
        F.map_filter(F.create_map(F.lit("book"), F.lit("Book"), F.lit("shop"), F.lit("Shop")), lambda a, _: (a == "book") | (k % 7 == 0)).alias("new_actions"),
    )
    return C.describe_changes(versions).select(F.col("domain").cast("bigint").alias("site_id"), "description")


# --- saved searches and site watch ----------------------------------------------------------

shared(
    "hits",
    """SELECT DISTINCT k AS id, 'c' || user_id || '.example' AS domain, user_id AS rank FROM ev WHERE event_type = 'click'""",
)


def _hits(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    clicks = table(spark, sf, "events").where(F.col("event_type") == "click")
    return clicks.select(k.alias("id"), F.concat(F.lit("c"), F.col("user_id").cast("string"), F.lit(".example")).alias("domain"), F.col("user_id").alias("rank")).distinct()


def _seen(spark, sf):
    """Saved searches remember their results from sites with an even number, in order of names."""
    earlier = as_of() - F.make_dt_interval(days=F.lit(20))
    return _hits(spark, sf).where(F.col("rank") % 2 == 0).select("id", "domain", earlier.alias("seen_at"), F.lit(0).cast("long").alias("rank"))


def _saved(spark, sf):
    checked = F.when(F.col("id") % 6 != 0, as_of() - F.make_dt_interval(days=F.lit(20)))
    return _seen(spark, sf).select("id").distinct().withColumn("checked_at", checked)


@query(
    "saved_search_news",
    f"""SELECT id, domain, rank FROM hits h JOIN sites s USING (domain) WHERE rank % 2 <> 0 AND id % 6 <> 0
          AND EXISTS (SELECT 1 FROM hits x WHERE x.id = h.id AND x.rank % 2 = 0) AND first_seen_at >= {_NOW} - INTERVAL 21 DAY
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, domain) <= 10""",
)
def saved_search_news(spark, sf):
    return C.saved_search_news(_saved(spark, sf), _seen(spark, sf), _hits(spark, sf), roles.sites(spark, sf))


@query(
    "saved_search_memory",
    """WITH e AS (SELECT id, list_sort(list(DISTINCT domain)) AS seen FROM hits WHERE rank % 2 = 0 GROUP BY id),
         n AS (SELECT id, list(domain ORDER BY rank) AS fresh FROM hits GROUP BY id),
         a AS (SELECT id, list_concat(seen, list_filter(fresh, lambda d: NOT list_contains(seen, d))) AS l FROM e JOIN n USING (id))
       SELECT id, array_to_string(l[greatest(len(l) - 9, 1):], ' ') AS seen FROM a""",
)
def saved_search_memory(spark, sf):
    seen = _seen(spark, sf)
    results = _hits(spark, sf).join(seen.select("id"), "id", "left_semi")
    kept = C.remember_seen(seen, results, as_of(), keep=10)
    order = F.array_sort(F.collect_list(F.struct("seen_at", "rank", "domain")))  # ten rows a search at most
    return kept.groupBy("id").agg(F.array_join(F.transform(order, lambda r: r["domain"]), " ").alias("seen"))


@query(
    "site_change_alerts",
    """SELECT domain, changes FROM (SELECT 'c' || c_custkey || '.example' AS domain, concat_ws(' | ',
         CASE WHEN c_acctbal >= 0 AND c_custkey % 3 = 0 THEN 'Opening hours changed to: Mo, Tu 10:00–18:00' END,
         CASE WHEN c_custkey % 5 = 0 AND NOT (c_acctbal >= 0 AND c_custkey % 2 = 0) THEN 'Broken link: https://b.example' END,
         CASE WHEN c_custkey % 7 = 0 AND c_custkey % 4 > 0 THEN CASE WHEN c_custkey % 4 = 1 THEN '1 price changed' ELSE (c_custkey % 4) || ' prices changed' END END) AS changes
       FROM customer) WHERE changes <> ''""",
)
def site_change_alerts(spark, sf):
    k = F.col("c_custkey")
    domain = F.concat(F.lit("c"), k.cast("string"), F.lit(".example"))
    none = F.lit(None).cast("array<struct<`from`:string,`to`:string,closed:boolean,opens:string,closes:string>>")
    hours = lambda t: H.parse_hours(F.lit(t))
    links = lambda test: F.when(test, F.array(F.lit("https://b.example"))).otherwise(F.array().cast("array<string>"))
    customers = table(spark, sf, "customer")
    now = customers.select(
        domain.alias("domain"), F.when(k % 3 == 0, hours("Mo,Tu 10:00-18:00")).when(k % 3 == 1, hours("Mo 09:00-17:00")).alias("hours"), none.alias("special"), links(k % 5 == 0).alias("broken")
    )
    before = customers.where(F.col("c_acctbal") >= 0).select(domain.alias("domain"), hours("Mo 09:00-17:00").alias("hours"), none.alias("special"), links(k % 2 == 0).alias("broken"))
    counts = customers.select(domain.alias("domain"), F.when(k % 7 == 0, k % 4).otherwise(0).alias("changed_prices"))
    out = C.site_changes(now, before, counts)
    return out.select("domain", F.array_join("changes", " | ").alias("changes"))


# --- availability ---------------------------------------------------------------------------


@query(
    "unreachable_sites",
    """WITH c AS (SELECT 'c' || user_id || '.example' AS domain, ts, CASE WHEN event_type IN ('error', 'signup') THEN 'down' ELSE 'ok' END AS o FROM events),
         l AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts DESC, o DESC) AS r FROM c)
       SELECT domain FROM l WHERE r <= 2 GROUP BY domain HAVING count(*) = 2 AND count(*) FILTER (o = 'down') = 2""",
)
def unreachable_sites(spark, sf):
    error = F.when(F.col("event_type") == "error", "connect ECONNREFUSED").when(F.col("event_type") == "signup", "getaddrinfo ENOTFOUND x").when(F.col("event_type") == "view", "timeout")
    checks = table(spark, sf, "events").select(
        F.concat(F.lit("c"), F.col("user_id").cast("string"), F.lit(".example")).alias("domain"), F.col("ts").cast("timestamp").alias("checked_at"),
        F.when(C.check_outcome(F.lit(503), error) == "down", "down").otherwise("ok").alias("outcome"),
    )
    return C.unreachable_sites(checks)


@query(
    "dead_links",
    """SELECT 'c' || c_custkey || '.example' AS domain, CAST((c_custkey % 4 = 0)::INTEGER + (c_custkey % 3 = 0)::INTEGER AS INTEGER) AS removed,
         CASE WHEN c_custkey % 4 = 0 THEN 'book' ELSE 'book=https://c' || c_custkey || '.example/b' END || ' ' || CASE WHEN c_custkey % 3 = 0 THEN 'call' ELSE 'call=https://c' || c_custkey || '.example/c' END AS actions
       FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 3 = 0""",
)
def dead_links(spark, sf):
    k = F.col("c_custkey")
    domain = F.concat(F.lit("c"), k.cast("string"), F.lit(".example"))
    link = lambda tail: F.concat(F.lit("https://"), domain, F.lit(tail))
    act = lambda id_, url: F.struct(F.lit(id_).alias("id"), url.alias("url"))
    customers = table(spark, sf, "customer")
    sites = customers.select(domain.alias("domain"), F.array(act("book", link("/b")), act("call", F.when(k % 3 == 0, "not a url").otherwise(link("/c")))).alias("actions"))
    status = customers.select(link("/b").alias("url"), F.when(k % 8 == 0, 404).when(k % 4 == 0, 410).when(k % 2 == 0, 503).otherwise(200).alias("status"))
    cleaned = C.drop_dead_links(sites, status)
    shown = F.transform("actions", lambda a: F.concat_ws("=", a["id"], a["url"]))
    return cleaned.select("domain", "removed", F.array_join(shown, " ").alias("actions"))


@query(
    "hourly_alerts",
    """SELECT key, strftime(hour, '%Y-%m-%d %H:%M') AS hour, epoch_us(first_at) AS first_us, times FROM (
         SELECT event_type AS key, date_trunc('hour', ts) AS hour, min(ts) AS first_at, count(*) AS times FROM events WHERE event_type <> 'view' GROUP BY ALL)""",
)
def hourly_alerts(spark, sf):
    problems = table(spark, sf, "events").where(F.col("event_type") != "view").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    return C.hourly_alerts(problems).select("key", F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), F.unix_micros("first_at").alias("first_us"), "times")


@query(
    "platform_limits",
    """SELECT event_type AS key, count(*) AS hits, CASE event_type WHEN 'error' THEN 2 ELSE 3 END AS "limit" FROM events
       WHERE ts >= TIMESTAMP '2024-01-20 11:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00' AND event_type IN ('error', 'view')
       GROUP BY event_type HAVING count(*) >= CASE event_type WHEN 'error' THEN 2 ELSE 3 END""",
)
def platform_limits(spark, sf):
    hits = table(spark, sf, "events").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.lit(1).alias("hits"))
    return C.platform_limits(hits, F.lit("2024-01-20 12:00:00").cast("timestamp"), {"error": 2, "view": 3})


# --- retention ------------------------------------------------------------------------------


def _counters(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.concat(F.when(F.col("event_type") == "view", "tool_day:").otherwise("hour:"), F.col("user_id").cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("window_start")
    )


_COUNTERS = "SELECT event_id, CASE WHEN event_type = 'view' THEN 'tool_day:' ELSE 'hour:' END || user_id AS key, ts AS window_start FROM events"
shared("counters", _COUNTERS)


@query(
    "retention_counts",
    f"""SELECT 'usage_counters' AS "table", 'short counters, kept two days' AS reason, count(*) FILTER (window_start < {_NOW} - INTERVAL 2 DAY AND key NOT LIKE 'tool_day%') AS rows FROM counters
        UNION ALL SELECT 'usage_counters', 'daily tool counters, kept five weeks', count(*) FILTER (window_start < {_NOW} - INTERVAL 35 DAY AND key LIKE 'tool_day%') FROM counters
        UNION ALL SELECT 'crawl_queue', 'crawl requests done a month ago', count(*) FILTER (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1998-08-01' - INTERVAL 30 DAY) FROM orders""",
)
def retention_counts(spark, sf):
    queue = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp")).alias("done_at"))
    return C.retention_counts(_counters(spark, sf), "usage_counters", as_of()).unionByName(
        C.retention_counts(queue, "crawl_queue", F.lit("1998-08-01").cast("timestamp"))
    )


@query(
    "retention_keep",
    f"SELECT event_id FROM counters WHERE NOT (window_start < {_NOW} - INTERVAL 2 DAY AND key NOT LIKE 'tool_day%')",
)
def retention_keep(spark, sf):
    return C.retained(_counters(spark, sf), "usage_counters", as_of()).select("event_id")


@query(
    "event_retention",
    f"""WITH e AS (SELECT p_partkey AS k, {_NOW} + to_days(CAST(p_partkey % 300 - 20 AS INTEGER)) AS s, CASE WHEN p_partkey % 3 = 0 THEN {_NOW} + to_days(CAST(p_partkey % 300 - 10 AS INTEGER)) END AS e, p_partkey % 5 = 0 AS lib FROM part)
        SELECT k AS item_id FROM e WHERE NOT coalesce(e IS NULL AND s < {_NOW} - INTERVAL 1 DAY, false) AND NOT coalesce(e < {_NOW} - INTERVAL 1 DAY, false)
          AND NOT (lib AND s > {_NOW} + INTERVAL 42 DAY) AND NOT s > {_NOW} + INTERVAL 183 DAY""",
)
def event_retention(spark, sf):
    k = F.col("p_partkey")
    shift = lambda days: as_of() + F.make_dt_interval(days=days.cast("int"))
    events = table(spark, sf, "part").select(
        k.alias("item_id"), shift(k % 300 - 20).alias("start_date"), F.when(k % 3 == 0, shift(k % 300 - 10)).alias("end_date"),
        F.when(k % 5 == 0, "Library event").when(k % 5 == 1, "Concert").alias("description"),
    )
    return C.retained(events, "events", as_of()).select("item_id")


@query(
    "cleared_hidden",
    "SELECT domain, CASE WHEN status IS NULL THEN 2 ELSE 0 END AS pages, CASE WHEN status IS NULL THEN 1 ELSE 0 END AS actions FROM sites",
)
def cleared_hidden(spark, sf):
    sites = roles.sites(spark, sf).select(
        "domain", "status", F.create_map(F.lit("/"), F.col("home"), F.lit("/a"), F.col("name")).alias("pages"), F.array(F.col("name")).alias("actions")
    )
    return C.clear_hidden(sites).select("domain", F.size("pages").alias("pages"), F.size("actions").alias("actions"))


@query(
    "sweepable_sites",
    f"""SELECT domain FROM sites WHERE conversion = 'minimal' AND owner_key IS NULL AND first_seen_at < {_NOW} - INTERVAL 30 DAY
          AND domain NOT IN (SELECT unnest(domains) FROM searches)""",
)
def sweepable_sites(spark, sf):
    return C.sweepable(roles.sites(spark, sf), roles.searches(spark, sf), as_of())


@query(
    "due_counts",
    f"""SELECT * FROM (SELECT count(*) FILTER (updated_at < {_NOW} - INTERVAL 14 DAY) AS products, count(*) FILTER (updated_at < {_NOW} - INTERVAL 90 DAY) AS subpages,
          count(*) FILTER (refreshed_at < {_NOW} - INTERVAL 30 DAY) AS bots, count(*) FILTER (updated_at < {_NOW} - INTERVAL 180 DAY) AS stale FROM sites)""",
)
def due_counts(spark, sf):
    count = lambda c, days: F.count_if(due(F.col(c), as_of(), days))
    return roles.sites(spark, sf).agg(
        count("updated_at", 14).alias("products"), count("updated_at", 90).alias("subpages"), count("refreshed_at", 30).alias("bots"), count("updated_at", 180).alias("stale")
    )


@query(
    "holiday_gaps",
    f"""WITH h AS (SELECT n_nationkey AS c, CAST({_NOW} AS DATE) + CAST(n_nationkey % 14 AS INTEGER) AS d, 'Day of ' || n_name AS n FROM nation)
        SELECT 'c' || c_custkey || '.example' AS domain, strftime(d, '%Y-%m-%d') AS holiday, n AS holiday_name FROM customer JOIN h ON c = c_nationkey
        WHERE d BETWEEN DATE '2024-02-04' AND DATE '2024-02-11' AND NOT (c_custkey % 3 = 0 AND d BETWEEN DATE '2024-02-05' AND DATE '2024-02-07')""",
)
def holiday_gaps(spark, sf):
    k = F.col("c_custkey")
    special = F.when(k % 3 == 0, F.array(F.struct(F.lit("2024-02-05").alias("from"), F.lit("2024-02-07").alias("to"))))
    sites = table(spark, sf, "customer").select(F.concat(F.lit("c"), k.cast("string"), F.lit(".example")).alias("domain"), F.col("c_nationkey").alias("country"), special.alias("special"))
    holidays = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("country"), F.date_add(F.to_date(as_of()), (F.col("n_nationkey") % 14).cast("int")).alias("date"), F.concat(F.lit("Day of "), "n_name").alias("name")
    )
    return C.holiday_gaps(sites, holidays, as_of())


# --- merges ---------------------------------------------------------------------------------


def _stored_customers(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", F.floor(F.col("c_acctbal") * 100 + 0.5).cast("bigint").alias("cents"))


def _incoming(spark, sf):
    k = F.col("c_custkey")
    fresh = _stored_customers(spark, sf).where(F.col("c_mktsegment").isin("FURNITURE", "HOUSEHOLD"))
    changed = fresh.select((k + F.when(k % 9 == 0, 1_000_000).otherwise(0)).alias("c_custkey"), F.when(k % 2 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("c_name"), F.when(k % 5 != 0, F.col("cents")).alias("cents"))
    return changed


shared(
    "batch",
    """SELECT c_custkey + CASE WHEN c_custkey % 9 = 0 THEN 1000000 ELSE 0 END AS c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || '!' ELSE c_name END AS c_name,
         CASE WHEN c_custkey % 5 <> 0 THEN CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT) END AS cents FROM customer WHERE c_mktsegment IN ('FURNITURE', 'HOUSEHOLD')""",
)
shared("kept", "SELECT c_custkey, c_name, c_mktsegment, CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT) AS cents FROM customer")


@query(
    "upsert_merge",
    """SELECT coalesce(k.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NOT NULL THEN b.c_name ELSE k.c_name END AS c_name, c_mktsegment,
         CASE WHEN b.c_custkey IS NOT NULL THEN b.cents ELSE k.cents END AS cents FROM kept k FULL JOIN batch b ON k.c_custkey = b.c_custkey""",
)
def upsert_merge(spark, sf):
    return K.upsert(_stored_customers(spark, sf), _incoming(spark, sf), "c_custkey", ["c_name", "cents"])


@query(
    "changed_rows",
    """SELECT b.* FROM batch b LEFT JOIN kept k USING (c_custkey) WHERE k.c_custkey IS NULL OR b.c_name IS DISTINCT FROM k.c_name OR b.cents IS DISTINCT FROM k.cents""",
)
def changed_rows(spark, sf):
    return K.changed_rows(_stored_customers(spark, sf), _incoming(spark, sf), "c_custkey", ["c_name", "cents"])


@query(
    "insert_ignore",
    """WITH n AS (SELECT 'u' || (o_custkey % 400) AS url, strftime(o_orderdate, '%Y-%m') AS start, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL)
       SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderstatus = 'F' AND 'u' || (o.o_custkey % 400) = n.url AND strftime(o.o_orderdate, '%Y-%m') = n.start)""",
)
def insert_ignore(spark, sf):
    rows = table(spark, sf, "orders").select(F.concat(F.lit("u"), (F.col("o_custkey") % 400).cast("string")).alias("url"), F.date_format("o_orderdate", "yyyy-MM").alias("start"), "o_orderkey", "o_orderstatus")
    stored = rows.where(F.col("o_orderstatus") == "F")
    new = rows.where(F.col("o_orderstatus") != "F").drop("o_orderstatus")
    return K.insert_ignore(stored, new, ["url", "start"], F.col("o_orderkey"))


@query(
    "guarded_patch",
    """SELECT c_custkey, CASE WHEN floor(c_acctbal * 100 + 0.5) > 300000 AND c_custkey % 4 <> 1 AND c_mktsegment <> 'FURNITURE' THEN 'patched ' || c_custkey ELSE c_name END AS c_name FROM customer""",
)
def guarded_patch(spark, sf):
    k = F.col("c_custkey")
    stored = _stored_customers(spark, sf).withColumn("updated_at", k % 4)
    patches = stored.where(F.col("cents") > 300_000).select("c_custkey", F.concat(F.lit("patched "), k.cast("string")).alias("c_name"), F.when(k % 4 == 1, 99).otherwise(k % 4).alias("updated_at"))
    guard = (F.col("updated_at") == F.col("patch_updated_at")) & (F.col("c_mktsegment") != "FURNITURE")
    return K.guarded_patch(stored, patches, "c_custkey", ["c_name"], guard).select("c_custkey", "c_name")


# --- reports --------------------------------------------------------------------------------


@query(
    "score_history",
    """WITH w AS (SELECT strftime(date_trunc('week', created_at), '%Y-%m-%d') AS week, count(*) AS sites, count(DISTINCT api_key) AS keys FROM searches GROUP BY 1)
       SELECT week, sites, keys, floor((sites - lag(sites) OVER (ORDER BY week)) * 10.0 + 0.5) / 10 AS sites_change FROM w""",
)
def score_history(spark, sf):
    weeks = roles.searches(spark, sf).groupBy(F.date_format(F.date_trunc("week", "created_at"), "yyyy-MM-dd").alias("week")).agg(
        F.count(F.lit(1)).alias("sites"), F.countDistinct("api_key").alias("keys")
    )
    return report.against_previous(weeks, ["sites"])


@query(
    "page_hosts_read",
    r"SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host, count(*) AS pages FROM pages WHERE url LIKE 'https://%' GROUP BY 1",
)
def page_hosts_read(spark, sf):
    from hostloom.sources.tables import parquet

    rows = parquet(spark, f"{sf}/pages.parquet", ["url"], F.col("url").startswith("https://"))
    return rows.groupBy(host_of(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"))
