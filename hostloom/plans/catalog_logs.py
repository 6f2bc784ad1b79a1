"""Catalogue: log analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostloom.operators import logs, queues
from hostloom.operators.change import cohort_without
from hostloom.operators.matching import all_words, tokens
from hostloom.plans import roles
from hostloom.plans.registry import query, shared
from hostloom.plans.roles import AS_OF, as_of, table

_NOW = f"TIMESTAMP '{AS_OF}'"
#: The log's queries have no host-name tail, so the pattern only has to be stated.
_DOMAIN_TAIL = r"\.[a-z]{2,}$"


@query(
    "top_queries",
    r"""SELECT query, count(*) AS searches FROM (SELECT lower(trim(query)) AS query FROM text_queries)
        WHERE query <> '' AND length(query) <= 40 AND NOT regexp_matches(query, '[@/:]|\d{4,}|^\[object |\.[a-z]{2,}$')
        GROUP BY query HAVING count(*) >= 3 ORDER BY searches DESC, query LIMIT 10""",
)
def top_queries(spark, sf):
    return logs.top_queries(roles.text_queries(spark, sf), min_count=3, k=10, max_length=40, domain_like=_DOMAIN_TAIL)


@query(
    "top_search_queries",
    f"""SELECT lower(query) AS query, count(*) AS searches FROM searches WHERE created_at >= {_NOW} - INTERVAL 7 DAY
        GROUP BY 1 ORDER BY searches DESC, query LIMIT 150""",
)
def top_search_queries(spark, sf):
    recent = roles.searches(spark, sf).where(logs.since_days(F.col("created_at"), as_of(), 7))
    return logs.top_queries(recent, k=150, domain_like=r"^\S+\.[a-z]{2,}$", max_words=8)


shared(
    "research_pairs_cte",
    """SELECT api_key, id, from_query, query AS to_query, gap FROM (
         SELECT *, lag(query) OVER w AS from_query, epoch_us(created_at) - lag(epoch_us(created_at)) OVER w AS gap
         FROM searches WINDOW w AS (PARTITION BY api_key ORDER BY created_at, id))
       WHERE gap <= 90000000 AND len(list_intersect(string_split(query, ' '), string_split(from_query, ' '))) > 0""",
)


@query("research_pairs", "SELECT api_key, id, from_query, to_query, gap / 1e6 AS gap_seconds FROM research_pairs_cte")
def research_pairs(spark, sf):
    return logs.research_pairs(roles.searches(spark, sf))


@query(
    "research_rate",
    """SELECT s AS searches, a AS again, floor(a * 1000.0 / s + 0.5) / 10 AS rate_percent
       FROM (SELECT count(*) AS s FROM searches), (SELECT count(*) AS a FROM research_pairs_cte)""",
)
def research_rate(spark, sf):
    log = roles.searches(spark, sf)
    return logs.research_rate(log, logs.research_pairs(log))


def _long_gap_pairs(spark, sf):
    # Two hours instead of 90 seconds: the generated log is thin.
    return logs.reformulations(logs.research_pairs(roles.searches(spark, sf), gap_seconds=7200, chunk="day"))


shared(
    "reformulated",
    """SELECT from_query, to_query, count(*) AS times FROM (
         SELECT *, lag(query) OVER w AS from_query, query AS to_query,
           epoch_us(created_at) - lag(epoch_us(created_at)) OVER w AS gap
         FROM searches WINDOW w AS (PARTITION BY api_key ORDER BY created_at, id))
       WHERE gap <= 7200000000 AND from_query <> to_query
         AND len(list_intersect(string_split(query, ' '), string_split(from_query, ' '))) > 0
       GROUP BY ALL""",
)


@query("reformulations", "SELECT from_query, to_query, times FROM reformulated")
def reformulations(spark, sf):
    return _long_gap_pairs(spark, sf)


@query(
    "search_misses",
    """SELECT * FROM (
         (SELECT query, count(*) AS searches, 'zero_results' AS kind FROM searches WHERE result_count = 0
          GROUP BY query ORDER BY searches DESC, query LIMIT 50)
         UNION ALL
         (SELECT query, count(*) AS searches, 'no_clicks' FROM searches
          WHERE query NOT IN (SELECT query FROM searches WHERE kind = 'click') GROUP BY query
          HAVING count(*) >= 5 ORDER BY 2 DESC, 1 LIMIT 30)
         UNION ALL
         (SELECT from_query, times, 'reformulated' FROM reformulated WHERE times >= 2
          ORDER BY 2 DESC, 1 LIMIT 50))""",
)
def search_misses(spark, sf):
    log = roles.searches(spark, sf)
    return logs.search_misses(log, log.where(F.col("kind") == "click").select("query"), _long_gap_pairs(spark, sf))


@query(
    "site_guesses",
    r"""WITH q AS (SELECT DISTINCT query FROM text_queries WHERE length(query) > 3),
        t AS (SELECT unnest(['com', 'io', 'ai', 'co', 'app', 'dk', 'net', 'org']) AS tld, unnest(range(8)) AS try_no)
        SELECT query, CAST(try_no AS INTEGER) AS try_no, regexp_replace(query, '[\s''&.]+', '', 'g') || '.' || tld AS candidate
        FROM q, t""",
)
def site_guesses(spark, sf):
    names = roles.text_queries(spark, sf).select("query").where(F.length("query") > 3).distinct()
    return logs.site_guesses(names)


@query(
    "site_demand",
    f"""SELECT domain, CAST(sum(w) AS BIGINT) AS score FROM (
          SELECT unnest(domains[1:5]) AS domain, CASE WHEN created_at >= {_NOW} - INTERVAL 7 DAY THEN 2 ELSE 1 END AS w
          FROM searches WHERE created_at >= {_NOW} - INTERVAL 30 DAY) GROUP BY domain""",
)
def site_demand(spark, sf):
    return logs.weighted_demand(roles.searches(spark, sf), as_of())


@query(
    "domain_appearances",
    """SELECT domain, count(*) AS appearances FROM (SELECT unnest(domains[1:5]) AS domain FROM searches)
       GROUP BY domain ORDER BY appearances DESC, domain LIMIT 10""",
)
def domain_appearances(spark, sf):
    return logs.appearances(roles.searches(spark, sf)).orderBy(F.desc("appearances"), "domain").limit(10)


shared(
    "demand",
    f"""SELECT domain, CAST(sum(w) AS BIGINT) AS score FROM (
          SELECT unnest(domains[1:5]) AS domain, CASE WHEN created_at >= {_NOW} - INTERVAL 7 DAY THEN 2 ELSE 1 END AS w
          FROM searches WHERE created_at >= {_NOW} - INTERVAL 30 DAY) GROUP BY domain""",
)


@query(
    "refresh_queue",
    f"""WITH j AS (
          SELECT d.domain, d.score, s.category,
            date_diff('day', greatest(s.updated_at, s.refreshed_at), {_NOW}) AS age,
            CASE WHEN d.score >= 30 THEN 2 WHEN d.score >= 10 THEN 7 WHEN d.score >= 3 THEN 21 END AS every
          FROM demand d LEFT JOIN (SELECT * FROM sites WHERE status IS NULL) s USING (domain)),
        o AS (SELECT domain, score, coalesce(age / CASE WHEN category IN ('machinery') THEN 1.0 ELSE every END, 1e9) AS overdue
          FROM j WHERE every IS NOT NULL)
        SELECT domain, score, round(overdue, 6) AS overdue, round(overdue * score, 4) AS priority FROM o WHERE overdue >= 1""",
)
def refresh_queue(spark, sf):
    # Hidden sites do not count as indexed, so unknown sites occur.
    known = roles.sites(spark, sf).where(F.col("status").isNull())
    out = queues.refresh_queue(logs.weighted_demand(roles.searches(spark, sf), as_of()), known, as_of(), daily=("machinery",))
    return out.select("domain", "score", F.round("overdue", 6).alias("overdue"), F.round("priority", 4).alias("priority"))


@query(
    "top_refresh",
    f"""SELECT domain, 5001 - popularity_rank AS score,
          round(date_diff('day', greatest(updated_at, refreshed_at), {_NOW}) / 30.0, 6) AS overdue
        FROM sites WHERE status IS NULL AND owner_key IS NULL AND popularity_rank <= 5000
          AND greatest(updated_at, refreshed_at) < {_NOW} - INTERVAL 30 DAY""",
)
def top_refresh(spark, sf):
    out = queues.top_refresh(roles.sites(spark, sf), as_of())
    return out.withColumn("overdue", F.round("overdue", 6))


@query(
    "stale_sites",
    f"""SELECT domain, popularity_rank FROM sites WHERE status IS NULL AND owner_key IS NULL AND popularity_rank <= 50000
        AND updated_at < {_NOW} - INTERVAL 180 DAY ORDER BY popularity_rank, domain LIMIT 500""",
)
def stale_sites(spark, sf):
    return queues.stale_sites(roles.sites(spark, sf), as_of())


@query(
    "due_sites",
    f"""SELECT domain, updated_at::VARCHAR AS updated_at FROM sites
        WHERE domain IN (SELECT domain FROM demand WHERE score >= 10) AND updated_at < {_NOW} - INTERVAL 90 DAY""",
)
def due_sites(spark, sf):
    wanted = logs.weighted_demand(roles.searches(spark, sf), as_of()).where(F.col("score") >= 10)
    out = queues.due_sites(roles.sites(spark, sf), wanted, "updated_at", as_of(), 90)
    return out.select("domain", F.col("updated_at").cast("string").alias("updated_at"))


@query(
    "conversion_backlog",
    f"""SELECT domain, conversion, CAST(tier AS INTEGER) AS tier, popularity_rank FROM (
          SELECT *, CASE WHEN conversion = 'heuristic' AND home LIKE '%-language website at%' THEN 1
              WHEN (action_count = 0 OR conversion = 'heuristic') AND category NOT IN ('machinery') THEN 2 END AS tier
          FROM sites WHERE updated_at < {_NOW} AND status IS NULL AND owner_key IS NULL)
        WHERE tier IS NOT NULL ORDER BY tier, popularity_rank NULLS LAST, updated_at, domain LIMIT 1000""",
)
def conversion_backlog(spark, sf):
    rows = queues.conversion_backlog(roles.sites(spark, sf), as_of(), hidden=("machinery",))
    return rows.orderBy(*queues.backlog_order()).limit(1000).select("domain", "conversion", "tier", "popularity_rank")


@query(
    "open_requests",
    """SELECT 'o' || o_orderkey AS domain, o_orderdate::VARCHAR AS requested_at FROM orders WHERE o_orderstatus = 'O'
       ORDER BY o_orderdate, 'o' || o_orderkey LIMIT 200""",
)
def open_requests(spark, sf):
    queue = table(spark, sf, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("domain"),
        F.col("o_orderdate").cast("timestamp").alias("requested_at"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate").cast("timestamp")).alias("done_at"),
    )
    return queues.oldest_requests(queue, 200).select("domain", F.col("requested_at").cast("string").alias("requested_at"))


@query(
    "queue_outcomes",
    """SELECT outcome, count(*) AS requests FROM (
         SELECT CASE WHEN k % 10 = 9 THEN CASE WHEN k % 3 <> 0 THEN 'not public' ELSE 'no such domain' END
           WHEN k % 13 = 0 THEN 'claimed (owner edits it)' WHEN k % 11 = 0 THEN 'native'
           WHEN k % 9 = 0 THEN 'robots.txt disallows' WHEN k % 4 = 1 THEN 'heuristic'
           WHEN k % 4 = 2 THEN 'unreachable' ELSE 'minimal' END AS outcome
         FROM (SELECT o_orderkey AS k FROM orders)) GROUP BY outcome""",
)
def queue_outcomes(spark, sf):
    k = F.col("o_orderkey")
    label = queues.queue_outcome(
        F.concat(F.lit("o"), k.cast("string"), F.lit(".example")),
        exists=k % 3 != 0,
        public=k % 10 != 9,
        claimed=k % 13 == 0,
        has_manifest=k % 11 == 0,
        allowed=k % 9 != 0,
        fetched=k % 4 != 2,
        conversion=F.when(k % 4 == 1, "heuristic"),
    )
    return table(spark, sf, "orders").groupBy(label.alias("outcome")).agg(F.count(F.lit(1)).alias("requests"))


@query(
    "queue_completed",
    """SELECT coalesce(outcome, 'open') AS outcome, count(*) AS requests, count(done) AS finished FROM (
         SELECT CASE WHEN o_orderstatus = 'P' THEN 'full' WHEN o_orderstatus = 'F' THEN 'minimal' END AS outcome,
           CASE WHEN o_orderstatus = 'P' OR o_orderstatus = 'F' THEN 1 END AS done FROM orders) GROUP BY 1""",
)
def queue_completed(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("domain"),
        F.col("o_orderstatus").alias("state"),
        F.col("o_orderdate").cast("timestamp").alias("requested_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp")).alias("done_at"),
        F.when(F.col("o_orderstatus") == "F", "minimal").alias("outcome"),
    )
    results = orders.where(F.col("state") == "P").select("domain", F.lit("full").alias("outcome"))
    done = queues.complete_requests(orders.drop("state"), results, as_of())
    return done.groupBy(F.coalesce("outcome", F.lit("open")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("requests"), F.count("done_at").alias("finished")
    )


_PCT = """SELECT {keys} count(*) AS n, list_sort(list(duration_ms))[least(CAST(floor(count(*) * 0.5) AS BIGINT), count(*) - 1) + 1] AS p50_ms,
  list_sort(list(duration_ms))[least(CAST(floor(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1] AS p95_ms{more}
  FROM searches"""


@query(
    "latency_percentiles",
    _PCT.format(
        keys="kind,",
        more=", list_sort(list(duration_ms))[least(CAST(floor(count(*) * 0.99) AS BIGINT), count(*) - 1) + 1] AS p99_ms",
    )
    + " GROUP BY kind",
)
def latency_percentiles(spark, sf):
    return logs.latency_percentiles(roles.searches(spark, sf), ["kind"])


@query(
    "hourly_slo",
    f"""SELECT hour::VARCHAR AS hour, n, p50_ms, p95_ms, p95_ms > 3000 AS breach FROM (
        {_PCT.format(keys="date_trunc('hour', created_at) AS hour,", more="")} GROUP BY 1) WHERE n >= 20""",
)
def hourly_slo(spark, sf):
    return logs.hourly_slo(roles.searches(spark, sf)).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


@query(
    "busiest_minutes",
    f"""SELECT api_key, max(n) AS busiest, count(*) FILTER (n >= 2) AS close_minutes FROM (
          SELECT api_key, date_trunc('minute', created_at) AS m, count(*) AS n FROM searches
          WHERE created_at >= {_NOW} - INTERVAL 30 DAY GROUP BY 1, 2) GROUP BY api_key HAVING max(n) >= 2""",
)
def busiest_minutes(spark, sf):
    # The generated log has at most two searches of a key in one minute.
    return logs.busiest_minutes(roles.searches(spark, sf), as_of(), 30, warn_at=2)


@query(
    "bot_totals_top3",
    """WITH b AS (SELECT domain, bot, CAST(sum(hits) AS BIGINT) AS hits FROM bot_hits GROUP BY ALL)
       SELECT domain, bot, hits, CAST(row_number() OVER w AS INTEGER) AS place,
         CAST(sum(hits) OVER (PARTITION BY domain) AS BIGINT) AS total
       FROM b WINDOW w AS (PARTITION BY domain ORDER BY hits DESC, bot) QUALIFY place <= 3""",
)
def bot_totals_top3(spark, sf):
    return logs.bot_totals(roles.bot_hits(spark, sf))


_WANTS = {"viewing": "view|click", "buying": "purchase", "help": "error", "joining": "signup"}


@query(
    "unmet_needs",
    """WITH asked AS (SELECT unnest(domains) AS domain, query FROM searches),
       labelled AS (
         SELECT domain, 'viewing' AS label FROM asked WHERE regexp_matches(query, 'view|click')
         UNION ALL SELECT domain, 'buying' FROM asked WHERE regexp_matches(query, 'purchase')
         UNION ALL SELECT domain, 'help' FROM asked WHERE regexp_matches(query, 'error')
         UNION ALL SELECT domain, 'joining' FROM asked WHERE regexp_matches(query, 'signup')),
       offered AS (
         SELECT domain, 'viewing' AS label FROM sites WHERE page_count >= 3
         UNION ALL SELECT domain, 'buying' FROM sites WHERE action_count >= 2
         UNION ALL SELECT domain, 'help' FROM sites WHERE has_hours)
       SELECT domain, label, count(*) AS searches FROM labelled l
       WHERE NOT EXISTS (SELECT 1 FROM offered o WHERE o.domain = l.domain AND o.label = l.label)
       GROUP BY ALL HAVING count(*) >= 2""",
)
def unmet_needs(spark, sf):
    sites = roles.sites(spark, sf)
    has = F.array_compact(
        F.array(
            F.when(F.col("page_count") >= 3, F.lit("viewing")),
            F.when(F.col("action_count") >= 2, F.lit("buying")),
            F.when(F.col("has_hours"), F.lit("help")),
        )
    )
    return logs.unmet_needs(roles.searches(spark, sf), sites.select("domain", F.explode(has).alias("label")), _WANTS)


@query(
    "month_projection",
    f"""SELECT count(*) AS searches, CAST(sum(duration_ms) AS BIGINT) AS total_ms,
          round(sum(duration_ms) / 3600000.0 * 2, 6) AS gb_hours,
          round(sum(duration_ms) / 3600000.0 * 2 / (30.0 / 31.0), 6) AS projected,
          sum(duration_ms) / 3600000.0 * 2 / (30.0 / 31.0) / 360 >= 0.9 AS warn
        FROM searches WHERE created_at >= TIMESTAMP '2024-01-01' AND created_at < {_NOW} AND tier <> 'test'""",
)
def month_projection(spark, sf):
    out = logs.month_projection(roles.searches(spark, sf), as_of())
    return out.withColumn("gb_hours", F.round("gb_hours", 6)).withColumn("projected", F.round("projected", 6))


@query(
    "size_growth",
    """WITH now AS (SELECT source AS name, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY source),
         old AS (SELECT source AS name, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents
           WHERE doc_id % 3 <> 0 AND source <> 'src3' GROUP BY source),
         g AS (SELECT name, now.bytes, now.bytes - coalesce(old.bytes, 0) AS grown FROM now LEFT JOIN old USING (name))
       SELECT name, bytes, grown, round(grown / 2.0, 6) AS bytes_per_week,
         round(CASE WHEN grown > 0 THEN (200000 - bytes) / (grown / 2.0) END, 6) AS weeks_left,
         concat_ws(', ', CASE WHEN bytes >= 160000 THEN 'nearly full' END,
           CASE WHEN grown > 0 AND (200000 - bytes) / (grown / 2.0) < 6 THEN 'fills up soon' END) AS warnings
       FROM g""",
)
def size_growth(spark, sf):
    docs = table(spark, sf, "documents")
    size = F.sum("n_chars").alias("bytes")
    now = docs.groupBy(F.col("source").alias("name")).agg(size)
    before = docs.where((F.col("doc_id") % 3 != 0) & (F.col("source") != "src3")).groupBy(F.col("source").alias("name")).agg(size)
    out = logs.size_growth(now, before, 200_000, elapsed_days=14)
    return out.select(
        "name", "bytes", "grown", F.round("bytes_per_week", 6).alias("bytes_per_week"),
        F.round("weeks_left", 6).alias("weeks_left"), F.array_join("warnings", ", ").alias("warnings"),
    )


@query(
    "biggest_sources",
    """SELECT source AS name, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY source
       ORDER BY bytes DESC, name LIMIT 5""",
)
def biggest_sources(spark, sf):
    sizes = table(spark, sf, "documents").groupBy(F.col("source").alias("name")).agg(F.sum("n_chars").alias("bytes"))
    return sizes.orderBy(F.desc("bytes"), "name").limit(5)


@query(
    "sizes_by_schema",
    """SELECT lang AS schema_name, CAST(sum(b) AS BIGINT) AS bytes, count(*) AS tables, lang = 'en' AS own FROM (
         SELECT lang, source, sum(n_chars) AS b FROM documents GROUP BY ALL) GROUP BY lang""",
)
def sizes_by_schema(spark, sf):
    sizes = table(spark, sf, "documents").groupBy(F.col("lang").alias("schema_name"), "source").agg(F.sum("n_chars").alias("bytes"))
    return logs.table_sizes(sizes, own_schema="en")


@query(
    "monthly_messages",
    """WITH c AS (SELECT count(*) AS claimed FROM sites WHERE owner_key IS NOT NULL AND coalesce(
           CASE WHEN site_id % 3 = 0 THEN false WHEN site_id % 3 = 1 THEN true END, true)),
         a AS (SELECT count(*) AS alerts FROM text_queries), w AS (SELECT count(*) AS watches FROM part)
       SELECT claimed, alerts, watches, round(CAST(claimed * 4.3 + claimed * 3 + alerts * 4 + watches * 2 AS DOUBLE), 4) AS messages
       FROM c, a, w""",
)
def monthly_messages(spark, sf):
    flag = F.when(F.col("site_id") % 3 == 0, False).when(F.col("site_id") % 3 == 1, True)
    sites = roles.sites(spark, sf).withColumn("score_emails", flag)
    out = logs.monthly_messages(sites, roles.text_queries(spark, sf), table(spark, sf, "part"))
    return out.withColumn("messages", F.round("messages", 4))


@query(
    "referral_counts",
    """SELECT 'r' || (o_custkey % 40) AS code, count(*) AS joined, count(*) FILTER (o_orderstatus = 'F') AS credited
       FROM orders WHERE o_orderdate >= DATE '1998-02-01' AND o_orderdate < DATE '1998-03-01' GROUP BY 1""",
)
def referral_counts(spark, sf):
    signups = table(spark, sf, "orders").select(
        F.concat(F.lit("r"), (F.col("o_custkey") % 40).cast("string")).alias("code"),
        (F.col("o_orderstatus") == "F").alias("credited"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )
    return logs.referral_counts(signups, F.lit("1998-03-15").cast("timestamp"))


@query(
    "welcome_cohort",
    """WITH paid AS (SELECT DISTINCT lower('U' || user_id || '@Mail.example') AS email FROM events
           WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-25')
       SELECT DISTINCT 'u' || user_id || '@mail.example' AS email FROM events
       WHERE event_type = 'signup' AND ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-25'
         AND 'u' || user_id || '@mail.example' NOT IN (SELECT email FROM paid)""",
)
def welcome_cohort(spark, sf):
    events = table(spark, sf, "events").withColumn("joined_at", F.col("ts").cast("timestamp"))
    day = logs.exact_day(F.col("joined_at"), as_of(), 7)
    paid = events.where((F.col("event_type") == "purchase") & day).select(
        F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit("@Mail.example")).alias("email")
    )
    readers = events.where((F.col("event_type") == "signup") & day).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@mail.example")).alias("email")
    )
    return cohort_without(readers, paid)


def _requests(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf, "events").select(
        F.when(k % 25 == 0, 500).when(k % 11 == 0, 429).otherwise(200).alias("status"),
        (k % 6).alias("results"),
        (k % 12 != 0).alias("message"),
        F.array_compact(F.array(F.when(k % 2 == 0, F.lit("slow")), F.when(k % 5 == 0, F.lit("partial")))).alias("codes"),
        F.create_map(
            F.lit("plain"), (k * 3).cast("double"), F.col("event_type"), F.floor(F.col("value") * 10).cast("double")
        ).alias("timing"),
    )


@query(
    "request_summary",
    """WITH r AS (SELECT CASE WHEN k % 25 = 0 THEN 500 WHEN k % 11 = 0 THEN 429 ELSE 200 END AS status,
           k % 6 AS results, k % 12 <> 0 AS message, k FROM ev)
       SELECT 'requests' AS measure, '' AS key, count(*) AS requests FROM r
       UNION ALL SELECT 'with_results', '', count(*) FROM r WHERE results > 0
       UNION ALL SELECT 'with_message_only', '', count(*) FROM r WHERE results <= 0 AND message
       UNION ALL SELECT 'silent', '', count(*) FROM r WHERE results <= 0 AND NOT message
       UNION ALL SELECT 'status', CAST(status AS VARCHAR), count(*) FROM r GROUP BY status
       UNION ALL SELECT 'notice', 'slow', count(*) FROM r WHERE k % 2 = 0
       UNION ALL SELECT 'notice', 'partial', count(*) FROM r WHERE k % 5 = 0""",
)
def request_summary(spark, sf):
    return logs.request_summary(_requests(spark, sf)).select("measure", "key", "requests")


@query(
    "part_timings",
    """WITH p AS (SELECT 'plain' AS part, CAST(k * 3 AS DOUBLE) AS ms FROM ev
         UNION ALL SELECT event_type, floor(value * 10) FROM ev)
       SELECT part, CAST(floor(sum(ms) / count(*) + 0.5) AS BIGINT) AS avg_ms, count(*) AS samples,
         list_sort(list(ms))[least(CAST(floor(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1] AS p95_ms
       FROM p GROUP BY part""",
)
def part_timings(spark, sf):
    return logs.part_timings(_requests(spark, sf)).select("part", "avg_ms", "samples", "p95_ms")


@query(
    "fresh_missing",
    f"""SELECT DISTINCT query FROM text_queries WHERE query NOT IN (
          SELECT query FROM text_queries WHERE turn > 0 AND conv_id * 7 % 60 <= 25)""",
)
def fresh_missing(spark, sf):
    asked = roles.text_queries(spark, sf)
    age = (F.col("conv_id") * 7 % 60).cast("int")
    known = asked.where(F.col("turn") > 0).select("query", (as_of() - F.make_dt_interval(days=age)).alias("updated_at"))
    return queues.fresh_missing(asked.select("query").distinct(), known, as_of())


@query(
    "expansion_candidates",
    """SELECT query, CAST(min(source) AS INTEGER) AS source FROM (
         SELECT DISTINCT query, 0 AS source FROM text_queries WHERE turn = 0
         UNION ALL SELECT DISTINCT query, 1 FROM text_queries
         UNION ALL SELECT c || ' ' || n_name, 2 FROM nation, (SELECT unnest(['hotel', 'cafe']) AS c)) GROUP BY query""",
)
def expansion_candidates(spark, sf):
    asked = roles.text_queries(spark, sf)
    cities = table(spark, sf, "nation").select(F.col("n_name").alias("city"))
    local = queues.local_searches(cities, ["hotel", "cafe"])
    return queues.union_first([asked.where(F.col("turn") == 0), asked, local])


shared(
    "wanted_words",
    """SELECT item_id, unnest(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '),
         lambda x: length(x) >= 4))) AS w FROM benchmark""",
)
shared(
    "word_hits",
    """SELECT item_id, doc_id FROM wanted_words JOIN (
         SELECT DISTINCT doc_id, unnest(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')) AS w FROM documents) USING (w)
       GROUP BY item_id, doc_id HAVING count(*) = (SELECT count(*) FROM wanted_words n WHERE n.item_id = wanted_words.item_id)""",
)


def _word_matches(spark, sf, k):
    wanted = table(spark, sf, "benchmark").select("item_id", tokens(F.col("text"), 4).alias("words"))
    docs = table(spark, sf, "documents").select(F.col("doc_id"), tokens(F.col("text"), 4).alias("words"), F.col("doc_id").alias("rank"))
    return all_words(wanted, "item_id", docs, "doc_id", k=k)


@query(
    "all_words_match",
    """SELECT item_id, doc_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS INTEGER) AS place FROM word_hits QUALIFY place <= 40""",
)
def all_words_match(spark, sf):
    return _word_matches(spark, sf, 40)


@query(
    "retrieval_metrics",
    """WITH shown AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM word_hits QUALIFY rank <= 10),
         judged AS (SELECT s.item_id, rank, contains(d.text, b.text) OR (b.item_id % 3 = 0 AND d.lang = 'fr') AS right_one
           FROM shown s JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)),
         ranked AS (SELECT CASE WHEN item_id % 4 = 0 THEN 'local' WHEN item_id % 4 = 1 THEN 'foreign' ELSE 'topic' END AS kind, item_id < 20 AS is_original,
             (SELECT min(rank) FROM judged j WHERE j.item_id = b.item_id AND right_one) AS rank FROM benchmark b),
         scoped AS (SELECT 'all' AS scope, rank FROM ranked UNION ALL SELECT kind, rank FROM ranked UNION ALL SELECT 'original', rank FROM ranked WHERE is_original)
       SELECT scope, count(*) AS queries, floor(count(*) FILTER (rank = 1) * 1000.0 / count(*) + 0.5) / 10 AS hit_at_1,
         floor(count(*) FILTER (rank <= 5) * 1000.0 / count(*) + 0.5) / 10 AS hit_at_5,
         floor(sum(coalesce(1.0 / rank, 0)) / count(*) * 1000 + 0.5) / 1000 AS mrr
       FROM scoped GROUP BY scope""",
)
def retrieval_metrics(spark, sf):
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("golden"))
    shown = _word_matches(spark, sf, 10).join(table(spark, sf, "documents"), "doc_id").join(items, "item_id")
    q = F.concat(F.lit("q"), F.col("item_id").cast("string"))
    host = F.when(F.col("text").contains(F.col("golden")), F.concat(F.lit("www.d"), F.col("item_id").cast("string"), F.lit(".example"))).when(
        F.col("lang") == "fr", F.concat(F.lit("x"), F.col("doc_id").cast("string"), F.lit(".test"))
    )
    results = shown.select(
        q.alias("q"), F.col("place").alias("rank"), F.coalesce(host, F.lit("other.invalid")).alias("domain"), F.lit(None).cast("string").alias("category")
    )
    cases = items.select(
        q.alias("q"),
        F.array(F.concat(F.lit("d"), F.col("item_id").cast("string"), F.lit(".example"))).alias("domains"),
        F.when(F.col("item_id") % 3 == 0, ".test").alias("tld"),
        F.lit(None).cast("string").alias("category"),
        F.when(F.col("item_id") % 4 == 0, "local").when(F.col("item_id") % 4 == 1, "foreign").otherwise("topic").alias("kind"),
        (F.col("item_id") < 20).alias("is_original"),
    )
    return logs.retrieval_metrics(logs.first_right_rank(cases, results))


@query(
    "query_kinds",
    r"""WITH q AS (SELECT conv_id, turn, text AS q, conv_id % 5 = 0 AS dom, conv_id % 7 = 0 AS loc FROM text_queries),
        c AS (SELECT CASE WHEN dom THEN 'site' || conv_id || '.com' ELSE q END AS q, loc FROM q)
        SELECT kind, count(*) AS cases FROM (SELECT CASE WHEN regexp_matches(q, '(?i)^\S+\.[a-z]{2,}(/\S*)?$') THEN 'domain'
          WHEN loc THEN 'local' WHEN regexp_matches(q, '[^\x00-\x7f]') THEN 'foreign'
          WHEN len(string_split_regex(q, '\s+')) <= 3 THEN 'name' ELSE 'topic' END AS kind FROM c) GROUP BY kind""",
)
def query_kinds(spark, sf):
    q = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("site"), F.col("conv_id").cast("string"), F.lit(".com"))).otherwise(
        F.col("text")
    )
    none = F.lit(None).cast("string")
    kind = logs.query_kind(q, F.array(F.lit("a.example")), F.when(F.col("conv_id") % 7 == 0, ".dk"), none, none)
    return roles.text_queries(spark, sf).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("cases"))
