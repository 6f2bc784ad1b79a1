"""Catalogue: site records and index upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostloom.functions.text import content_hash
from hostloom.functions.urls import bare_host, host_of
from hostloom.operators import sites as S
from hostloom.operators.pages import page_metadata
from hostloom.operators.matching import closest_names, tokens, vocabulary
from hostloom.plans import roles
from hostloom.plans.catalog_pages import _squeeze
from hostloom.plans.registry import query, shared
from hostloom.plans.roles import table


def scored_sites(spark, sf):
    """Site role with its readiness score."""
    return S.with_readiness(roles.sites(spark, sf).withColumn("executable", F.col("site_id") % 22 == 0))


shared(
    "scored",
    """SELECT *, (CASE WHEN c1 THEN 15 ELSE 0 END) + (CASE WHEN c2 THEN 15 ELSE 0 END) + (CASE WHEN c3 THEN 15 ELSE 0 END)
         + (CASE WHEN c4 THEN 10 ELSE 0 END) + (CASE WHEN c5 THEN 15 ELSE 0 END) + (CASE WHEN c6 THEN 15 ELSE 0 END)
         + (CASE WHEN c7 THEN 15 ELSE 0 END) AS score,
         list_filter([CASE WHEN c1 THEN 'description' END, CASE WHEN c2 THEN 'several pages' END, CASE WHEN c3 THEN 'actions' END,
           CASE WHEN c4 THEN 'three actions' END, CASE WHEN c5 THEN 'own document' END, CASE WHEN c6 THEN 'executable actions' END,
           CASE WHEN c7 THEN 'business details' END], lambda x: x IS NOT NULL) AS passed
       FROM (SELECT *, length(home) > 80 AND NOT home LIKE 'Website at %' AS c1, page_count >= 3 AS c2, action_count >= 1 AS c3,
         action_count >= 3 AS c4, native AS c5, native AND site_id % 22 = 0 AS c6, has_business AS c7 FROM sites)""",
)


@query(
    "site_scores",
    """SELECT domain, CAST(score AS INTEGER) AS score, CASE WHEN score >= 80 THEN 'ready' WHEN score >= 45 THEN 'partly ready'
       ELSE 'not ready yet' END AS label, array_to_string(passed, ', ') AS passed FROM scored""",
)
def site_scores(spark, sf):
    return scored_sites(spark, sf).select("domain", "score", "label", F.array_join("passed", ", ").alias("passed"))


@query(
    "score_movers",
    """WITH b AS (SELECT domain, score - (site_id * 31 % 40) + 10 AS before FROM scored WHERE conversion <> 'minimal')
       SELECT domain, CAST(score AS INTEGER) AS now, CAST(before AS INTEGER) AS before FROM scored JOIN b USING (domain)
       WHERE score > before ORDER BY score - before DESC, domain LIMIT 20""",
)
def score_movers(spark, sf):
    now = scored_sites(spark, sf)
    before = now.where(F.col("conversion") != "minimal").select(
        "domain", (F.col("score") - (F.col("site_id") * 31 % 40) + 10).cast("int").alias("score")
    )
    return S.score_movers(now, before)


shared(
    "peers",
    """SELECT s.domain, s.category, s.score, s.passed, s.city, p.domain AS peer, p.score AS peer_score, p.passed AS peer_passed,
         p.native AS peer_native, p.has_business AS peer_business, p.city = s.city AS same_city
       FROM scored s JOIN scored p ON p.category = s.category AND p.domain <> s.domain
       WHERE s.category <> 'furniture' AND p.status IS NULL AND p.action_count > 0""",
)
shared(
    "best_peers",
    """SELECT * FROM (
         SELECT *, row_number() OVER (PARTITION BY domain ORDER BY peer_score DESC, peer) AS r FROM (
           SELECT *, count(*) FILTER (same_city) OVER (PARTITION BY domain) >= 2 AS is_local,
             count(*) FILTER (peer_native) OVER (PARTITION BY domain) >= 5 AS own_enough FROM peers)
         WHERE CASE WHEN is_local THEN same_city WHEN own_enough THEN peer_native ELSE peer_native OR peer_business END)
       WHERE r <= 5""",
)


def _compared(spark, sf):
    return S.peer_comparison(scored_sites(spark, sf), hidden=("furniture",))


@query(
    "peer_comparison",
    """SELECT domain, category, any_value(CASE WHEN is_local THEN city END) AS city, CAST(any_value(score) AS INTEGER) AS score,
         CAST(count(*) FILTER (peer_score > score) + 1 AS INTEGER) AS rank, CAST(count(*) + 1 AS INTEGER) AS total,
         string_agg(peer, ' ' ORDER BY r) AS peers FROM best_peers GROUP BY domain, category""",
)
def peer_comparison(spark, sf):
    return _compared(spark, sf).withColumn("peers", F.array_join("peers", " ")).drop("missing")


@query(
    "peers_have",
    """SELECT domain, c AS "check", count(*) AS peers FROM (SELECT domain, passed, unnest(peer_passed) AS c FROM best_peers)
       WHERE NOT list_contains(passed, c) GROUP BY ALL""",
)
def peers_have(spark, sf):
    return S.they_have(_compared(spark, sf))


# A reduced dictionary whose words occur in the generated texts.
_WORDS = [
    ("adult", ["nicht", "quex"]),
    ("dental", ["edth", "para los"]),
    ("cafe", ["lely", "pour"]),
    ("shop", ["the", "and", "with"]),
    ("social", ["que", "les"]),
]
_BROAD = ("shop", "social")


@query(
    "categorise_documents",
    """WITH w AS (SELECT unnest(['adult', 'adult', 'dental', 'dental', 'cafe', 'cafe', 'shop', 'shop', 'shop', 'social', 'social']) AS category,
           unnest([0, 0, 1, 1, 2, 2, 3, 3, 3, 4, 4]) AS ord,
           unnest(['nicht', 'quex', 'edth', 'para los', 'lely', 'pour', 'the', 'and', 'with', 'que', 'les']) AS word),
         d AS (SELECT doc_id, 'www.' || source || 'lely' || (doc_id % 7) || CASE doc_id % 23 WHEN 0 THEN '.gov' WHEN 1 THEN '.news' ELSE '.example' END AS domain,
           lower(CASE WHEN doc_id % 5 = 0 THEN text ELSE source END) AS name, CASE WHEN doc_id % 31 = 5 THEN 'website at x' ELSE lower(text) END AS pages,
           CASE WHEN doc_id % 17 = 3 THEN 'Dentist' END AS type FROM documents),
         s AS (SELECT doc_id, category, ord, sum(len(regexp_extract_all(pages, '(^|[^a-z])' || word || '([^a-z]|$)'))
             + 2 * len(regexp_extract_all(name, '(^|[^a-z])' || word || '([^a-z]|$)'))
             + CASE WHEN length(word) >= 4 AND contains(regexp_replace(domain, '^www\\.', ''), replace(word, ' ', '')) THEN 1 ELSE 0 END) AS score,
             any_value(length(pages) < 400) AS short FROM d, w GROUP BY ALL),
         b AS (SELECT doc_id, arg_max(category, score * 100 - ord) AS category FROM s
           WHERE score >= CASE WHEN category IN ('shop', 'social') THEN CASE WHEN short THEN 2 ELSE 3 END ELSE CASE WHEN short THEN 1 ELSE 2 END END
           GROUP BY doc_id)
       SELECT d.doc_id, CASE WHEN type = 'Dentist' THEN 'dental' WHEN domain LIKE '%.gov' THEN 'government' WHEN domain LIKE '%.news' THEN 'news_media'
         WHEN pages = 'website at x' THEN 'cafe' ELSE b.category END AS found_category FROM d LEFT JOIN b USING (doc_id)""",
)
def categorise_documents(spark, sf):
    return _categorised(spark, sf).select("doc_id", "found_category")


def _categorised(spark, sf):
    doc = F.col("doc_id")
    ending = F.when(doc % 23 == 0, ".gov").when(doc % 23 == 1, ".news").otherwise(".example")
    records = table(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit("www."), "source", F.lit("lely"), (doc % 7).cast("string"), ending).alias("domain"),
        F.when(doc % 5 == 0, F.col("text")).otherwise(F.col("source")).alias("name"),
        F.when(doc % 31 == 5, "website at x").otherwise(F.col("text")).alias("page_text"),
        F.lit("").alias("action_text"),
        F.lit("").alias("action_ids"),
        F.when(doc % 17 == 3, "Dentist").alias("business_type"),
    )
    return S.categorise(records, _WORDS, broad=_BROAD)


@query(
    "category_fill",
    """SELECT 'c' || c_custkey || '.example' AS domain, CASE WHEN c_custkey % 4 = 1 THEN '' END AS category,
         CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE '' END AS new_category FROM customer
       WHERE c_custkey % 4 IN (0, 1) AND NOT (c_custkey % 4 = 1 AND c_custkey % 3 <> 0)""",
)
def category_fill(spark, sf):
    k = F.col("site_id")
    stored = roles.sites(spark, sf).withColumn("category_", F.when(k % 4 == 1, "").when(k % 4 > 1, F.col("category")))
    found = stored.select("domain", F.when(k % 3 == 0, F.col("category")).alias("found_category"))
    return S.fill_categories(stored.select("domain", F.col("category_").alias("category")), found)


@query(
    "label_overlay",
    """SELECT 'd' || doc_id AS domain, lang AS category, CASE WHEN quality = 1 THEN 'en' WHEN toxic = 1 THEN 'bad' ELSE 'de' END AS label
       FROM documents JOIN labels USING (doc_id)
       WHERE NOT (quality <> 1 AND toxic = 1) AND lang <> CASE WHEN quality = 1 THEN 'en' ELSE 'de' END""",
)
def label_overlay(spark, sf):
    key = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("domain")
    docs = table(spark, sf, "documents").select(key, F.col("lang").alias("category"))
    label = F.when(F.col("quality") == 1, "en").when(F.col("toxic") == 1, "bad").otherwise("de")
    return S.accept_labels(docs, table(spark, sf, "labels").select(key, label.alias("label")), ("en", "de", "fr"))


@query(
    "duplicate_documents",
    """WITH h AS (SELECT doc_id, substring(sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))), 1, 32) AS text_hash, n_chars FROM documents),
         o AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_hash ORDER BY n_chars DESC, doc_id) AS duplicate_of FROM h)
       SELECT doc_id, text_hash, duplicate_of FROM o WHERE doc_id <> duplicate_of""".replace("\\\\", "\\"),
)
def duplicate_documents(spark, sf):
    text = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", content_hash(text).alias("text_hash"))
    return S.duplicate_copies(docs, "doc_id", "text_hash", -F.col("n_chars"))


def _twin_hosts(spark, sf):
    """Hosts of the corpus, and a ``www.`` or bare twin of those with an even page id."""
    pages = table(spark, sf, "pages").select("page_id", host_of(F.col("url")).alias("domain"))
    flags = [
        F.when(F.col("page_id") % 3 == 0, "k1").alias("owner_key"),
        (F.col("page_id") % 5 == 0).alias("native"),
        F.when(F.col("page_id") % 8 == 7, "parked").alias("status"),
    ]
    twin = F.when(F.col("domain").startswith("www."), F.expr("substring(domain, 5)")).otherwise(F.concat(F.lit("www."), "domain"))
    twins = pages.where(F.col("page_id") % 2 == 0).select((F.col("page_id") + 1).alias("page_id"), twin.alias("domain"))
    rows = pages.unionByName(twins).select("page_id", "domain", *flags)
    from hostloom.operators.keyed import keep_first

    return keep_first(rows, ["domain"], F.col("page_id"), F.col("owner_key"), F.col("native"))


shared(
    "twin_hosts",
    r"""SELECT domain, arg_min({'o': CASE WHEN page_id % 3 = 0 THEN 'k1' END, 'n': page_id % 5 = 0,
          's': CASE WHEN page_id % 8 = 7 THEN 'parked' END}, page_id) AS f FROM (
        SELECT page_id, h AS domain FROM (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS h FROM pages)
        UNION ALL SELECT page_id + 1, CASE WHEN h LIKE 'www.%' THEN substring(h, 5) ELSE 'www.' || h END FROM (
          SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS h FROM pages) WHERE page_id % 2 = 0)
        GROUP BY domain""",
)


@query(
    "host_variants",
    """SELECT w.domain, b.domain AS duplicate_of FROM twin_hosts w JOIN twin_hosts b ON w.domain = 'www.' || b.domain
       WHERE w.f.s IS NULL AND b.f.s IS NULL AND NOT ((w.f.o IS NOT NULL OR w.f.n) AND NOT (b.f.o IS NOT NULL OR b.f.n))""",
)
def host_variants(spark, sf):
    return S.www_copies(_twin_hosts(spark, sf))


@query(
    "slash_copies",
    """SELECT 'c' || c_custkey || '.example/' || CASE WHEN c_custkey % 2 = 0 THEN 'en' ELSE '' END AS domain,
         'c' || c_custkey || '.example' AS duplicate_of FROM customer WHERE c_custkey % 3 = 1 AND c_custkey % 17 <> 0""",
)
def slash_copies(spark, sf):
    k = F.col("c_custkey")
    domain = F.concat(F.lit("c"), k.cast("string"), F.lit(".example"), F.when(k % 3 == 1, F.when(k % 2 == 0, "/en").otherwise("/")).otherwise(""))
    stored = table(spark, sf, "customer").select(domain.alias("domain"), F.when(k % 17 == 0, "parked").alias("status"))
    return S.slash_copies(stored)


@query(
    "redirect_duplicates",
    """WITH r AS (SELECT 'c' || c_custkey || '.example' AS domain, CASE c_custkey % 4 WHEN 0 THEN 'www.c' || c_custkey || '.example'
           WHEN 1 THEN 'shop.c' || c_custkey || '.example' WHEN 2 THEN 'www.c' || (c_custkey + 700) || '.example'
           ELSE 'c' || (c_custkey // 2) || '.example' END AS target, c_custkey FROM customer)
       SELECT domain, regexp_replace(target, '^www\\.', '') AS duplicate_of FROM r
       WHERE c_custkey % 4 >= 2 AND regexp_replace(target, '^www\\.', '') <> domain AND regexp_replace(target, '^www\\.', '') IN (SELECT domain FROM sites)""".replace("\\\\", "\\"),
)
def redirect_duplicates(spark, sf):
    k = F.col("c_custkey")
    name = lambda n: F.concat(F.lit("c"), n.cast("string"), F.lit(".example"))
    target = (
        F.when(k % 4 == 0, F.concat(F.lit("www."), name(k)))
        .when(k % 4 == 1, F.concat(F.lit("shop."), name(k)))
        .when(k % 4 == 2, F.concat(F.lit("www."), name(k + 700)))
        .otherwise(name(F.floor(k / 2)))
    )
    redirects = table(spark, sf, "customer").select(name(k).alias("domain"), target.alias("target"))
    indexed = roles.sites(spark, sf).select(
        F.when(F.col("site_id") % 2 == 0, F.concat(F.lit("www."), "domain")).otherwise(F.col("domain")).alias("domain")
    )
    return S.redirect_duplicates(redirects, indexed)


@query(
    "rank_updates",
    """WITH r AS (SELECT 'c' || c_custkey || '.example' AS domain, c_custkey * 17 % 5000 + 1 AS rank FROM customer WHERE c_mktsegment <> 'MACHINERY'),
         s AS (SELECT CASE WHEN site_id % 3 = 0 THEN 'www.' || domain ELSE domain END AS domain, popularity_rank FROM sites)
       SELECT s.domain, popularity_rank, r.rank AS new_rank FROM s LEFT JOIN r ON r.domain = regexp_replace(s.domain, '^www\\.', '')
       WHERE r.rank IS DISTINCT FROM popularity_rank""".replace("\\\\", "\\"),
)
def rank_updates(spark, sf):
    k = F.col("c_custkey")
    ranks = table(spark, sf, "customer").where(F.col("c_mktsegment") != "MACHINERY").select(
        F.concat(F.lit("c"), k.cast("string"), F.lit(".example")).alias("domain"), (k * 17 % 5000 + 1).alias("rank")
    )
    stored = roles.sites(spark, sf).select(
        F.when(F.col("site_id") % 3 == 0, F.concat(F.lit("www."), "domain")).otherwise(F.col("domain")).alias("domain"), "popularity_rank"
    )
    return S.rank_updates(stored, ranks)


@query(
    "not_indexed",
    """SELECT DISTINCT 'c' || (o_custkey * 2) || '.example' AS domain FROM orders
       WHERE 'c' || (o_custkey * 2) || '.example' NOT IN (SELECT domain FROM sites) AND 'c' || (o_custkey * 2) || '.example' NOT IN (SELECT 'c' || (c_custkey * 2) || '.example' FROM customer WHERE c_acctbal < 0)""",
)
def not_indexed(spark, sf):
    domain = F.concat(F.lit("c"), (F.col("o_custkey") * 2).cast("string"), F.lit(".example")).alias("domain")
    orders = table(spark, sf, "orders")
    poor = table(spark, sf, "customer").where(F.col("c_acctbal") < 0)
    skipped = poor.select(F.concat(F.lit("c"), (F.col("c_custkey") * 2).cast("string"), F.lit(".example")).alias("domain"))
    return S.not_indexed(orders.select(domain).distinct(), roles.sites(spark, sf), skipped)


@query(
    "wanted_missing",
    "SELECT domain FROM sites WHERE site_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '1998-06-01')",
)
def wanted_missing(spark, sf):
    recent = table(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("1998-06-01").cast("date"))
    have = recent.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(".example")).alias("domain"))
    return S.not_indexed(roles.sites(spark, sf).select("domain"), have)


def _full_records(spark, sf):
    """Site records with page maps and action lists."""
    k = F.col("site_id")
    key = k.cast("string")
    page = lambda title, content: F.struct(title.alias("title"), content.alias("content"))
    action = lambda id_, url: F.struct(
        F.lit(id_).alias("id"), url.alias("url"), F.array(F.lit("Book "), F.lit("book"), F.lit("  table  for ")).alias("intent")
    )
    link = F.concat(F.lit("https://"), F.col("domain"), F.lit("/book"))
    return roles.sites(spark, sf).select(
        "domain", "site_id", "owner_key", "native",
        F.map_from_arrays(
            F.array(F.lit("/"), F.lit("/about"), F.lit("/empty"), F.lit("/copy")),
            F.array(
                page(F.col("name"), F.col("home")),
                page(F.lit("About"), F.concat(F.lit("About site "), key)),
                page(F.when(k % 2 == 0, F.col("domain")).otherwise(F.lit("Titled")), F.lit(" ")),
                page(F.lit("Copy"), F.when(k % 3 == 0, F.col("home")).otherwise(F.concat(F.lit("Other "), key))),
            ),
        ).alias("pages"),
        F.array(action("book", link), action("book", F.when(k % 4 == 0, link)), action("call", F.lit(None).cast("string"))).alias("actions"),
    )


@query(
    "slim_sites",
    """SELECT domain, concat_ws(' ', '/', '/about', CASE WHEN site_id % 3 <> 0 THEN '/copy' END, CASE WHEN site_id % 2 <> 0 THEN '/empty' END) AS paths,
         CASE WHEN site_id % 4 = 0 THEN 'book call' ELSE 'book book call' END AS action_ids, 'book table for' AS first_intents
       FROM sites WHERE owner_key IS NULL AND NOT native AND (site_id % 2 = 0 OR site_id % 3 = 0 OR site_id % 4 = 0)""",
)
def slim_sites(spark, sf):
    slim = S.slim_sites(_full_records(spark, sf), min_saved=40)
    return slim.select(
        "domain",
        F.array_join(F.array_sort(F.map_keys("slim_pages")), " ").alias("paths"),
        F.array_join(F.transform("slim_actions", lambda a: a["id"]), " ").alias("action_ids"),
        F.array_join(F.element_at("slim_actions", 1)["intent"], " ").alias("first_intents"),
    )


@query(
    "byte_profile",
    """WITH b AS (SELECT length('["' || lower(c_mktsegment) || '","' || c_name || '"]') AS a, length('{"n":' || c_custkey || '}') AS o FROM customer)
       SELECT 'labels' AS "column", CAST(sum(a) AS BIGINT) AS bytes, count(*) AS rows FROM b UNION ALL SELECT 'facts', CAST(sum(o) AS BIGINT), count(*) FROM b""",
)
def byte_profile(spark, sf):
    nested = table(spark, sf, "customer").select(
        F.array(F.lower("c_mktsegment"), "c_name").alias("labels"), F.struct(F.col("c_custkey").alias("n")).alias("facts")
    )
    return S.byte_profile(nested, ["labels", "facts"])


@query(
    "site_records",
    """WITH m AS (SELECT page_id, domain, """
    + _squeeze("replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&quot;', '\"')")
    + """ AS title, lower(regexp_extract(html, '(?i)<html[^>]+lang=["'']([a-z]{2})', 1)) AS language FROM crawled),
         n AS (SELECT *, trim(string_split_regex(title, '\\s[|\\-–—:·]\\s')[1]) AS own, string_split(regexp_replace(domain, '^www\\.', ''), '.')[1] AS label FROM m),
         o AS (SELECT *, substring(CASE WHEN own <> '' AND length(own) <= 60 THEN own ELSE upper(label[1]) || label[2:] END, 1, 80) AS name FROM n)
       SELECT page_id, domain, name, language, CASE WHEN language <> 'en' THEN name ELSE substring(title, 1, 120) END AS title,
         language <> 'en' AS foreign_line FROM o""".replace("\\\\", "\\"),
)
def site_records(spark, sf):
    records = S.site_names(page_metadata(roles.crawled(spark, sf).drop("url")))
    return records.select("page_id", "domain", "name", "language", "title", F.col("content").contains("-language website at ").alias("foreign_line"))


@query(
    "best_sources",
    """SELECT 'c' || c_custkey || '.example' AS domain, CASE WHEN c_custkey % 3 = 0 THEN 'homepage' WHEN c_custkey % 2 = 0 THEN 'rendered'
         ELSE 'sitemap' END AS source FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0 OR c_custkey % 5 = 1""",
)
def best_sources(spark, sf):
    k = F.col("site_id")
    options = F.array(
        F.struct(F.lit(0).alias("source_order"), F.lit("homepage").alias("source"), F.when(k % 3 == 0, 2).otherwise(0).alias("action_count")),
        F.struct(F.lit(1).alias("source_order"), F.lit("rendered").alias("source"), F.when(k % 2 == 0, 1).otherwise(0).alias("action_count")),
        F.struct(F.lit(2).alias("source_order"), F.lit("sitemap").alias("source"), F.when(k % 5 == 1, 3).otherwise(0).alias("action_count")),
    )
    rows = roles.sites(spark, sf).select("domain", F.explode(options).alias("o")).select("domain", "o.*")
    return S.best_source(rows).select("domain", "source")


@query(
    "minimal_records",
    """SELECT 'c' || c_custkey || '.example' AS domain, 'C' || c_custkey AS name,
         CASE WHEN c_custkey % 2 = 0 THEN 'Website at c' || c_custkey || '.example' ELSE 'See ' || replace(c_name, '#', ' ') || ' now' END AS content FROM customer""",
)
def minimal_records(spark, sf):
    raw = F.when(F.col("site_id") % 2 == 1, F.concat(F.lit("Title: x\nSee [**"), "name", F.lit("**](https://a.example) now")))
    record = S.minimal_record(F.col("domain"), raw)
    return roles.sites(spark, sf).select(record.alias("r")).select("r.domain", "r.name", "r.content")


@query(
    "recrawl_outcomes",
    """SELECT outcome, count(*) AS sites FROM (SELECT CASE WHEN page_id % 7 = 0 THEN 'unchanged (not modified)'
         WHEN page_id % 5 = 0 THEN 'unchanged (same text)' WHEN page_id % 11 = 0 THEN 'blocked' WHEN page_id % 3 = 0 THEN 'unchanged'
         WHEN page_id % 4 = 0 THEN 'kept existing' ELSE 'refreshed' END AS outcome FROM pages) GROUP BY outcome""",
)
def recrawl_outcomes(spark, sf):
    i = F.col("page_id")
    text_hash = content_hash(F.col("html"))
    label = S.freshness(
        i % 7 == 0,
        text_hash,
        F.when(i % 5 == 0, text_hash).otherwise("old"),
        F.when(i % 11 != 0, content_hash(F.concat("html", F.lit("x")))),
        F.when(i % 3 == 0, content_hash(F.concat("html", F.lit("x")))).otherwise("old"),
        F.when(i % 4 == 0, 0).otherwise(2),
    )
    return S.outcome_tally(table(spark, sf, "pages").select(label.alias("outcome")))


@query(
    "search_vocabulary",
    """SELECT word, count(*) AS sites FROM (SELECT DISTINCT p_partkey, unnest(string_split(regexp_replace(lower(concat_ws(' ', p_name, p_brand, p_type)),
         '[^a-z]+', ' ', 'g'), ' ')) AS word FROM part) WHERE length(word) >= 3 GROUP BY word""",
)
def search_vocabulary(spark, sf):
    return vocabulary(table(spark, sf, "part"), ["p_name", "p_brand", "p_type"])


@query(
    "closest_names",
    """WITH n AS (SELECT DISTINCT unnest(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')) AS name FROM documents),
         q AS (SELECT DISTINCT substring(name, 1, 4) || substring(name, 6) AS query FROM n WHERE length(name) = 9),
         m AS (SELECT query, name, levenshtein(query, name) AS distance FROM q, n WHERE length(name) BETWEEN 7 AND 9 AND levenshtein(query, name) = 1)
       SELECT query, arg_min(name, name) AS name, 1 AS distance FROM m GROUP BY query""",
)
def closest_name_queries(spark, sf):
    names = table(spark, sf, "documents").select(F.explode(tokens(F.col("text"))).alias("name")).distinct()
    typos = names.where(F.length("name") == 9).select(
        F.concat(F.substring("name", 1, 4), F.expr("substring(name, 6)")).alias("query")
    ).distinct()
    return closest_names(typos, names)


@query(
    "appearing_sites",
    "SELECT id, len(domains) AS shown FROM searches WHERE list_contains(domains, 'c7.example')",
)
def appearing_sites(spark, sf):
    log = roles.searches(spark, sf)
    return log.where(S.has_all(F.col("domains"), "c7.example")).select("id", F.size("domains").cast("bigint").alias("shown"))


@query(
    "corpus_hosts",
    "SELECT domain, count(*) AS pages FROM crawled GROUP BY domain",
)
def corpus_hosts(spark, sf):
    return table(spark, sf, "pages").groupBy(bare_host(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("pages"))
