"""Search, click and bot logs: trends, misses, demand, latency, usage, capacity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.functions.patterns import BLANK, BLANK_CHARS, collapse, percent, strip_blank, words
from hostloom.operators.keyed import floor_index_percentiles, previous_row, rule_table, top_per_group

# --- time ranges ----------------------------------------------------------------------------


def since_days(column: Column, as_of: Column, days: int) -> Column:
    """Rolling window: the last ``days`` days up to ``as_of``."""
    return column >= as_of - F.make_dt_interval(days=F.lit(days))


def exact_day(column: Column, as_of: Column, days_ago: int) -> Column:
    """One whole UTC day, ``days_ago`` days before the day of ``as_of``."""
    start = F.date_trunc("day", as_of) - F.make_dt_interval(days=F.lit(days_ago))
    return (column >= start) & (column < start + F.make_dt_interval(days=F.lit(1)))


def previous_month(column: Column, as_of: Column) -> Column:
    """The calendar month before the month of ``as_of``."""
    this = F.date_trunc("month", as_of)
    return (column >= F.add_months(this, -1).cast("timestamp")) & (column < this)


def due(checked_at: Column, as_of: Column, days: int) -> Column:
    """Never checked, or checked more than ``days`` days ago."""
    return checked_at.isNull() | (checked_at < as_of - F.make_dt_interval(days=F.lit(days)))


# --- query text -----------------------------------------------------------------------------


def query_key(column: Column) -> Column:
    """Lower-case, trimmed form under which searches are counted."""
    return strip_blank(F.lower(column))


def is_plain_query(query: Column, max_length: int = 60, domain_like: str | None = None, max_words: int | None = None) -> Column:
    """Plain words only: no addresses, long numbers or serialised objects.

    ``domain_like`` is an extra pattern for queries that are host names.
    """
    ok = (query != "") & (F.length(query) <= max_length) & ~query.rlike(r"[@/:]|\d{4,}|^\[object ")
    if domain_like:
        ok = ok & ~query.rlike(domain_like)
    if max_words:
        ok = ok & (F.size(F.split(query, f"{BLANK}+")) <= max_words)
    return ok


def top_queries(df: DataFrame, min_count: int = 1, k: int | None = None, weight: Column | None = None, **plain) -> DataFrame:
    """Most frequent plain queries; ties are ordered alphabetically."""
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = (
        df.select(query_key(F.col("query")).alias("query"), *([weight.alias("_w")] if weight is not None else []))
        .where(is_plain_query(F.col("query"), **plain))
        .groupBy("query")
        .agg((amount if weight is None else F.sum("_w")).alias("searches"))
        .where(F.col("searches") >= min_count)
    )
    if k is None:
        return counted
    return counted.orderBy(F.desc("searches"), "query").limit(k)


def appearances(searches: DataFrame, first: int = 5) -> DataFrame:
    """How often each domain came up among the first results."""
    return (
        searches.select(F.explode(F.slice("domains", 1, first)).alias("domain"))
        .groupBy("domain")
        .agg(F.count(F.lit(1)).alias("appearances"))
    )


def weighted_demand(searches: DataFrame, as_of: Column, days: int = 30, recent_days: int = 7, first: int = 5) -> DataFrame:
    """Demand score per domain: recent appearances count twice."""
    recent = since_days(F.col("created_at"), as_of, recent_days)
    return (
        searches.where(since_days(F.col("created_at"), as_of, days))
        .select(F.explode(F.slice("domains", 1, first)).alias("domain"), F.when(recent, 2).otherwise(1).alias("_w"))
        .groupBy("domain")
        .agg(F.sum("_w").alias("score"))
    )


def search_misses(searches: DataFrame, clicks: DataFrame, rewrites: DataFrame, caps=(50, 30, 50), popular: int = 5) -> DataFrame:
    """Searches that went wrong, by kind: nothing found, nothing opened, rewritten."""
    zero = top_queries(searches.where(F.col("result_count") == 0), k=caps[0])
    often = top_queries(searches, min_count=popular)
    unopened = (
        often.join(clicks.select(query_key(F.col("query")).alias("query")).distinct(), "query", "left_anti")
        .orderBy(F.desc("searches"), "query")
        .limit(caps[1])
    )
    again = (
        rewrites.where((F.col("times") >= 2) & is_plain_query(F.col("from_query")))
        .select(F.col("from_query").alias("query"), F.col("times").alias("searches"))
        .orderBy(F.desc("searches"), "query")
        .limit(caps[2])
    )
    return (
        zero.withColumn("kind", F.lit("zero_results"))
        .unionByName(unopened.withColumn("kind", F.lit("no_clicks")))
        .unionByName(again.withColumn("kind", F.lit("reformulated")))
    )


#: Words dropped before a site name is guessed from a query, and the suffixes tried.
GUESS_STOP_WORDS = r"(?<![A-Za-z0-9_])(?:tickets?|near me|online|official|website|app|login|prices?|opening hours)(?![A-Za-z0-9_])"
GUESS_TLDS = ("com", "io", "ai", "co", "app", "dk", "net", "org")


def site_guesses(queries: DataFrame, tlds: Sequence[str] = GUESS_TLDS) -> DataFrame:
    """Candidate domains for short name-like queries, in the order they are tried."""
    name = collapse(F.regexp_replace("query", GUESS_STOP_WORDS, " "))
    label = F.regexp_replace(F.col("_name"), rf"[{BLANK_CHARS}'&.]+", "")
    return (
        queries.withColumn("_name", name)
        .where((F.col("_name") != "") & (F.size(F.split("_name", " ")) <= 3))
        .withColumn("_label", label)
        .select(*queries.columns, F.posexplode(F.array(*[F.lit(t) for t in tlds])).alias("try_no", "_tld"), "_label")
        .withColumn("candidate", F.concat_ws(".", "_label", "_tld"))
        .drop("_tld", "_label")
    )


# --- repeated searches ----------------------------------------------------------------------


def research_pairs(searches: DataFrame, gap_seconds: int = 90, chunk: str = "hour") -> DataFrame:
    """The same person searching again within the gap with overlapping words."""
    ordered = previous_row(
        searches.select("api_key", "id", "query", "created_at"),
        ["api_key"],
        ["created_at", "id"],
        ["query", "created_at"],
        F.date_trunc(chunk, "created_at"),
    )
    gap = F.unix_micros("created_at") - F.unix_micros("prev_created_at")
    tokens = F.split(query_key(F.col("query")), f"{BLANK}+")
    before = F.split(query_key(F.col("prev_query")), f"{BLANK}+")
    return ordered.where((gap <= gap_seconds * 1_000_000) & F.arrays_overlap(tokens, before)).select(
        "api_key", "id", F.col("prev_query").alias("from_query"), F.col("query").alias("to_query"), (gap / 1e6).alias("gap_seconds")
    )


def reformulations(pairs: DataFrame) -> DataFrame:
    """Rewritten queries with the number of times each rewrite happened."""
    return (
        pairs.where(F.col("from_query") != F.col("to_query")).groupBy("from_query", "to_query").agg(F.count(F.lit(1)).alias("times"))
    )


def research_rate(searches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Share of searches that were followed by another one straight away."""
    totals = searches.agg(F.count(F.lit(1)).alias("searches"))
    again = pairs.agg(F.count(F.lit(1)).alias("again"))
    return totals.select("searches", again.select("again").scalar().alias("again")).withColumn(
        "rate_percent", F.coalesce(percent(F.col("again"), F.col("searches")), F.lit(0.0))
    )


# --- latency and usage ----------------------------------------------------------------------

LATENCY = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}


def latency_percentiles(df: DataFrame, keys: Sequence[str], value: str = "duration_ms", shares=None) -> DataFrame:
    """Exact latency percentiles per group."""
    return floor_index_percentiles(df, keys, value, shares or LATENCY)


def hourly_slo(searches: DataFrame, min_samples: int = 20, limit_ms: int = 3000) -> DataFrame:
    """Hourly p50 and p95, with the breach flag, for hours with enough samples."""
    hours = searches.withColumn("hour", F.date_trunc("hour", "created_at"))
    stats = latency_percentiles(hours, ["hour"], shares={"p50_ms": 0.5, "p95_ms": 0.95})
    return stats.where(F.col("n") >= min_samples).withColumn("breach", F.col("p95_ms") > limit_ms)


def busiest_minutes(searches: DataFrame, as_of: Column, days: int, warn_at: int) -> DataFrame:
    """Per key: the busiest minute and the number of minutes at or over the warning line.

    Counts per (key, minute) are combined before the shuffle, so a key that makes a
    third of all searches still ends up as one row per minute.
    """
    per_minute = (
        searches.where(since_days(F.col("created_at"), as_of, days) & F.col("api_key").isNotNull())
        .groupBy("api_key", F.date_trunc("minute", "created_at").alias("minute"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return (
        per_minute.groupBy("api_key")
        .agg(F.max("_n").alias("busiest"), F.count_if(F.col("_n") >= warn_at).alias("close_minutes"))
        .where(F.col("busiest") >= warn_at)
    )


def bot_totals(hits: DataFrame, top: int = 3) -> DataFrame:
    """Visits per site and bot with the site total, for the site's busiest bots."""
    by_bot = hits.groupBy("domain", "bot").agg(F.sum("hits").alias("hits"))
    totals = by_bot.groupBy("domain").agg(F.sum("hits").alias("total"))
    best = top_per_group(by_bot, ["domain"], [F.desc("hits"), F.col("bot")], top, rank_as="place")
    return best.join(totals, "domain")


#: What people ask for and the words that show it.
WANTS = {
    "booking": words("book", "booking", "reserve", "reservation", "appointment", "table for"),
    "prices": words("price", "prices", "pricing", "cost", "how much", "cheap"),
    "ordering or delivery": words("order", "delivery", "deliver", "takeaway", "take away"),
    "opening hours": words("open", "opening", "hours", "closing"),
    "contact details": words("contact", "phone", "call", "email"),
}


def unmet_needs(searches: DataFrame, offered: DataFrame, wants: dict[str, str] | None = None, min_count: int = 2) -> DataFrame:
    """Things searched for on a site that the site does not offer.

    ``offered`` has one row per (domain, label) the site does offer. The anti-join
    runs after the counts, on at most one row per site and label.
    """
    wants = wants or WANTS
    asked = F.array_compact(F.array(*[F.when(F.col("query").rlike(p), F.lit(label)) for label, p in wants.items()]))
    return (
        searches.select(F.explode("domains").alias("domain"), asked.alias("_labels"))
        .select("domain", F.explode("_labels").alias("label"))
        .groupBy("domain", "label")
        .agg(F.count(F.lit(1)).alias("searches"))
        .where(F.col("searches") >= min_count)
        .join(offered, ["domain", "label"], "left_anti")
    )


# --- capacity -------------------------------------------------------------------------------


def month_projection(searches: DataFrame, as_of: Column, memory_gb: float = 2.0, quota: float = 360.0) -> DataFrame:
    """Compute time used this month and where it is heading."""
    start = F.date_trunc("month", as_of)
    end = F.add_months(start, 1).cast("timestamp")
    elapsed = (F.unix_micros(as_of) - F.unix_micros(start)) / (F.unix_micros(end) - F.unix_micros(start))
    used = F.col("total_ms") / 3_600_000 * memory_gb
    return (
        searches.where((F.col("created_at") >= start) & (F.col("created_at") < as_of) & F.col("duration_ms").isNotNull())
        .where(F.col("tier") != "test")
        .agg(F.count(F.lit(1)).alias("searches"), F.sum("duration_ms").alias("total_ms"))
        .select(
            "searches",
            "total_ms",
            used.alias("gb_hours"),
            F.when(elapsed > 0.05, used / elapsed).alias("projected"),
            F.when(elapsed > 0.05, used / elapsed / quota >= 0.9).otherwise(False).alias("warn"),
        )
    )


def size_growth(now: DataFrame, before: DataFrame, limit_bytes: int, elapsed_days: float, warn_share: float = 0.8, warn_weeks: float = 6.0) -> DataFrame:
    """Growth per table between two size snapshots, and weeks until the limit."""
    weeks = max(1.0, elapsed_days / 7.0)
    old = before.select("name", F.col("bytes").alias("_old"))
    grown = now.join(old, "name", "left").select(
        "name", "bytes", (F.col("bytes") - F.coalesce(F.col("_old"), F.lit(0))).alias("grown")
    )
    per_week = F.col("grown") / F.lit(weeks)
    left = F.when(per_week > 0, (F.lit(limit_bytes) - F.col("bytes")) / per_week)
    return grown.select(
        "name",
        "bytes",
        "grown",
        per_week.alias("bytes_per_week"),
        left.alias("weeks_left"),
        F.array_compact(
            F.array(
                F.when(F.col("bytes") >= F.lit(limit_bytes) * warn_share, F.lit("nearly full")),
                F.when(left < warn_weeks, F.lit("fills up soon")),
            )
        ).alias("warnings"),
    )


def monthly_messages(sites: DataFrame, alerts: DataFrame, watches: DataFrame) -> DataFrame:
    """Estimated messages a month from claimed sites, search alerts and watches."""
    claimed = sites.where(F.col("owner_key").isNotNull() & F.coalesce(F.col("score_emails"), F.lit(True)))
    return claimed.agg(F.count(F.lit(1)).alias("claimed")).select(
        "claimed",
        alerts.agg(F.count(F.lit(1)).alias("n")).scalar().alias("alerts"),
        watches.agg(F.count(F.lit(1)).alias("n")).scalar().alias("watches"),
    ).withColumn("messages", F.col("claimed") * 4.3 + F.col("claimed") + F.col("claimed") * 2 + F.col("alerts") * 4 + F.col("watches") * 2)


def table_sizes(sizes: DataFrame, own_schema: str = "public") -> DataFrame:
    """Bytes inside and outside the index's own schema, per schema."""
    return sizes.groupBy("schema_name").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("tables")).withColumn(
        "own", F.col("schema_name") == own_schema
    )


def referral_counts(conversions: DataFrame, as_of: Column) -> DataFrame:
    """Sign-ups and credited sign-ups per referral code in the previous month."""
    return (
        conversions.where(previous_month(F.col("created_at"), as_of))
        .groupBy("code")
        .agg(F.count(F.lit(1)).alias("joined"), F.count_if(F.col("credited")).alias("credited"))
    )


# --- request logs ---------------------------------------------------------------------------


def request_summary(rows: DataFrame) -> DataFrame:
    """Counters of a request log in long form: (measure, key, requests)."""
    total = rows.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("results") > 0).alias("with_results"),
        F.count_if((F.col("results") <= 0) & F.col("message")).alias("with_message_only"),
        F.count_if((F.col("results") <= 0) & ~F.col("message")).alias("silent"),
    )
    names = ["requests", "with_results", "with_message_only", "silent"]
    totals = total.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.lit("").alias("key"), F.col(n).alias("requests")) for n in names])).alias("r")
    ).select("r.*")
    status = rows.groupBy(F.col("status").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("requests"))
    notices = rows.select(F.explode("codes").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("requests"))
    return (
        totals.unionByName(status.withColumn("measure", F.lit("status")))
        .unionByName(notices.withColumn("measure", F.lit("notice")))
    )


def part_timings(rows: DataFrame) -> DataFrame:
    """Average and p95 of each named part of the response time."""
    parts = rows.select(F.explode("timing").alias("part", "ms"))
    means = parts.groupBy("part").agg(F.floor(F.sum("ms") / F.count("ms") + 0.5).cast("bigint").alias("avg_ms"))
    tail = floor_index_percentiles(parts, ["part"], "ms", {"p95_ms": 0.95}, count_as="samples")
    return means.join(tail, "part")


# --- search quality -------------------------------------------------------------------------

#: Words of shopping searches.
SHOPPING_WORDS = words(
    "shoes?", "sneakers?", "headphones", "desk", "furniture", "monitor", "laptop", "bike", "jacket", "kaufen", "buy",
    "zapatos", "sko", "löbesko", "løbesko", "laufschuhe",
)


def query_kind(query: Column, domains: Column, tld: Column, category: Column, language: Column) -> Column:
    """What sort of search a benchmark case is."""
    return (
        F.when(query.rlike(r"(?i)^\S+\.[a-z]{2,}(?:/\S*)?$"), "domain")
        .when((F.coalesce(tld, F.lit("")) != "") | (F.coalesce(category, F.lit("")) != ""), "local")
        .when((F.coalesce(language, F.lit("")) != "") | query.rlike(r"[^\x00-\x7f]"), "foreign")
        .when(query.rlike(SHOPPING_WORDS), "shopping")
        .when((F.coalesce(F.size(domains), F.lit(0)) <= 2) & (F.size(F.split(query, f"{BLANK}+")) <= 3), "name")
        .otherwise("topic")
    )


def first_right_rank(cases: DataFrame, results: DataFrame, top: int = 10) -> DataFrame:
    """Rank of the first right result of every case, NULL when none is right.

    Right means: the host is an expected domain or below it, or it ends in the
    expected TLD and its category agrees or is unknown. Results meet their case in one
    equi-join, so ``results`` is computed once; both tests are then made inside the row.
    """
    from hostloom.functions.urls import host_suffixes, without_www

    host = without_www(F.split("domain", "/")[0])
    shown = results.where(F.col("rank") <= top).select("q", "rank", "category", host.alias("_host"))
    expected = cases.select("q", F.transform("domains", without_www).alias("_domains"), "tld", F.col("category").alias("_want"))
    by_domain = F.arrays_overlap(host_suffixes(F.col("_host")), F.col("_domains"))
    by_tld = F.col("_host").endswith(F.col("tld")) & (
        F.col("_want").isNull() | F.col("category").isNull() | (F.col("category") == F.col("_want"))
    )
    right = F.coalesce(by_domain, F.lit(False)) | F.coalesce(by_tld, F.lit(False))
    best = shown.join(expected, "q").where(right).groupBy("q").agg(F.min("rank").alias("rank"))
    return cases.join(best, "q", "left")


def retrieval_metrics(ranked: DataFrame) -> DataFrame:
    """hit@1, hit@5 and MRR overall, per kind and for the original set: grouping sets."""
    sets = ranked.groupingSets([[], ["kind"], ["is_original"]], "kind", "is_original").agg(
        F.grouping_id().alias("_level"),
        F.count(F.lit(1)).alias("queries"),
        F.count_if(F.col("rank") == 1).alias("_one"),
        F.count_if(F.col("rank") <= 5).alias("_five"),
        F.sum(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("_mrr"),
    )
    level = F.when(F.col("_level") == 3, F.lit("all")).when(F.col("_level") == 1, F.col("kind"))
    return (
        sets.where((F.col("_level") != 2) | F.col("is_original"))
        .select(
            F.coalesce(level, F.lit("original")).alias("scope"),
            "queries",
            percent(F.col("_one"), F.col("queries")).alias("hit_at_1"),
            percent(F.col("_five"), F.col("queries")).alias("hit_at_5"),
            (F.floor(F.col("_mrr") / F.col("queries") * 1000 + 0.5) / 1000).alias("mrr"),
        )
    )


def query_rules(spark, rows) -> DataFrame:
    """Benchmark cases given as (q, domains, tld, category, language) tuples."""
    return rule_table(spark, rows, "q string, domains array<string>, tld string, category string, language string")
