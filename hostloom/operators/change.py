"""Change detection, alerts and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.functions.hours import canonical_hours, hours_line, special_line

from hostloom.functions.text import content_hash, watch_text
from hostloom.operators.keyed import fence, keep_first, previous_row, top_per_group

# --- price and stock watches ----------------------------------------------------------------


def percent_off(before: Column, now: Column) -> Column:
    """Whole per cent a price fell by."""
    return F.floor((before - now) / before * 100 + 0.5).cast("int")


def is_price_drop(now: Column, before: Column, target: Column, available: Column, notify: Column) -> Column:
    """The price fell by more than a cent, reached the target and the item is to be had."""
    fell = before.isNotNull() & (now < before - 0.01)
    hit = target.isNull() | (now <= target)
    return fell & hit & available & F.coalesce(notify, F.lit(True))


def check_watches(watches: DataFrame, items: DataFrame) -> DataFrame:
    """Every watch whose item was read: its alerts and its next state.

    ``watches`` has (id, url, target_price_eur, last_price_eur, last_available,
    notify_price, notify_stock), ``items`` (url, price_eur, available). The state
    moves on whether or not anything is worth an alert.
    """
    available = F.coalesce("available", F.lit(True))
    joined = watches.join(items.select("url", "price_eur", "available"), "url")
    drop = is_price_drop(F.col("price_eur"), F.col("last_price_eur"), F.col("target_price_eur"), available, F.col("notify_price"))
    restock = F.coalesce("notify_stock", F.lit(False)) & F.coalesce(~F.col("last_available"), F.lit(False)) & available
    return joined.select(
        "id",
        "url",
        F.coalesce(restock, F.lit(False)).alias("back_in_stock"),
        F.coalesce(drop, F.lit(False)).alias("price_drop"),
        F.when(drop, percent_off(F.col("last_price_eur"), F.col("price_eur"))).alias("percent_off"),
        F.coalesce("price_eur", "last_price_eur").alias("last_price_eur"),
        F.when(F.col("notify_stock").isNotNull(), available).otherwise(F.col("last_available")).alias("last_available"),
    )


def alerts(checked: DataFrame, at: Column) -> DataFrame:
    """Outbox rows (kind, key, payload, at) of watch results."""
    payload = F.to_json(F.struct("url", "last_price_eur", "percent_off"))
    kinds = F.array_compact(
        F.array(F.when(F.col("back_in_stock"), F.lit("back_in_stock")), F.when(F.col("price_drop"), F.lit("price_drop")))
    )
    return checked.select(F.explode(kinds).alias("kind"), F.col("id").cast("string").alias("key"), payload.alias("payload"), at.alias("at"))


_OBSERVED = ["observed_at", "observation_id", "price_eur", "available"]


def price_drops(observations: DataFrame, chunk: str = "quarter") -> DataFrame:
    """Price drops along each item's history: every observation against the one before.

    An item with a third of all observations is cut at ``chunk`` of its time line, so
    no task sees more than one chunk of it.
    """
    ordered = previous_row(observations, ["url"], _OBSERVED, ["price_eur"], F.date_trunc(chunk, "observed_at"))
    none = F.lit(None)
    drop = is_price_drop(F.col("price_eur"), F.col("prev_price_eur"), none, F.col("available"), none.cast("boolean"))
    return ordered.where(drop).select(
        "url", "observed_at", "observation_id", "prev_price_eur", "price_eur", percent_off(F.col("prev_price_eur"), F.col("price_eur")).alias("percent_off")
    )


def restocks(observations: DataFrame, chunk: str = "quarter") -> DataFrame:
    """Observations at which an item that was sold out is to be had again."""
    ordered = previous_row(observations, ["url"], _OBSERVED, ["available"], F.date_trunc(chunk, "observed_at"))
    return ordered.where(~F.col("prev_available") & F.col("available")).select("url", "observed_at", "observation_id")


# --- page watches ---------------------------------------------------------------------------


def check_pages(watches: DataFrame, texts: DataFrame) -> DataFrame:
    """Page watches against the text read now: what happened and the next state.

    ``watches`` has (id, url, watch_for, phrase, last_hash, last_seen, alerted_at). The
    first check only records. Watches for a phrase alert once, watches for change
    every time.
    """
    joined = watches.join(texts.select("url", watch_text(F.coalesce("text", F.lit(""))).alias("_t")), "url").select(
        "*", content_hash(F.col("_t")).alias("new_hash"), F.when(F.col("phrase").isNotNull(), F.col("_t").contains(F.lower("phrase"))).alias("new_seen")
    )
    changed = (F.col("watch_for") == "change") & F.col("last_hash").isNotNull() & (F.col("last_hash") != F.col("new_hash"))
    appeared = (F.col("watch_for") == "appears") & F.col("new_seen") & ~F.col("last_seen")
    gone = (F.col("watch_for") == "disappears") & ~F.col("new_seen") & F.col("last_seen")
    happened = F.coalesce(changed, F.lit(False)) | F.coalesce(appeared, F.lit(False)) | F.coalesce(gone, F.lit(False))
    return joined.select(
        "id", "url", "watch_for", happened.alias("happened"),
        (happened & (F.col("alerted_at").isNull() | (F.col("watch_for") == "change"))).alias("alert"),
        F.col("new_hash").alias("last_hash"), F.col("new_seen").alias("last_seen"),
    )


# --- saved searches -------------------------------------------------------------------------


def saved_search_news(saved: DataFrame, seen: DataFrame, results: DataFrame, sites: DataFrame, k: int = 10) -> DataFrame:
    """Results of a saved search that are new to the index since its last check.

    ``saved`` has (id, checked_at), ``seen`` (id, domain), ``results`` (id, domain, rank).
    A first check is silent; a site that merely moved up is not news.
    """
    unseen = results.join(seen.select("id", "domain"), ["id", "domain"], "left_anti")
    known = unseen.join(sites.select("domain", "first_seen_at"), "domain").join(saved.select("id", "checked_at"), "id")
    fresh = known.where(F.col("first_seen_at") >= F.col("checked_at") - F.make_dt_interval(days=F.lit(1)))
    return top_per_group(fresh.select("id", "domain", "rank"), ["id"], [F.col("rank"), F.col("domain")], k)


def remember_seen(seen: DataFrame, results: DataFrame, as_of: Column, keep: int = 400) -> DataFrame:
    """The next memory of every search: what was seen plus the new results, the newest ``keep`` rows.

    The memory is a table of (id, domain, seen_at, rank), one row per site that a search
    has shown; a site keeps the time it was first shown. No list is ever collected: the
    first sighting is a map-side combined aggregate and the cut is made per map task
    before its shuffle, so a task reads at most ``keep`` rows of a search from each task
    before it. Rows of one check are ordered by rank, then domain; a NULL rank is oldest.
    """
    new = results.select("id", "domain", as_of.alias("seen_at"), F.col("rank").cast("long").alias("rank"))
    old = seen.select("id", "domain", "seen_at", F.col("rank").cast("long").alias("rank"))
    first = keep_first(old.unionByName(new), ["id", "domain"], F.col("seen_at"), F.col("rank"))
    newest = [F.desc("seen_at"), F.desc("rank"), F.desc("domain")]
    return top_per_group(first, ["id"], newest, keep)


# --- site watch -----------------------------------------------------------------------------


def site_changes(sites: DataFrame, remembered: DataFrame, price_counts: DataFrame) -> DataFrame:
    """What changed on watched sites since the last check, in words.

    ``sites`` has (domain, hours, special, broken), ``remembered`` the same with the
    state of the last check, ``price_counts`` (domain, changed_prices).
    """
    old = remembered.select(
        "domain", F.lit(True).alias("_known"), F.col("hours").alias("_hours"), F.col("special").alias("_special"), F.col("broken").alias("_broken")
    )
    joined = sites.join(old, "domain", "left").join(price_counts, "domain", "left")
    line = lambda c: F.coalesce(hours_line(F.col(c)), F.lit(""))
    special = lambda c: F.coalesce(special_line(F.col(c)), F.lit(""))
    newly = F.array_except("broken", F.coalesce("_broken", F.array().cast("array<string>")))
    n = F.coalesce("changed_prices", F.lit(0))
    lines = F.concat(
        F.array_compact(
            F.array(
                F.when(F.col("_known") & F.col("hours").isNotNull() & (line("hours") != line("_hours")), F.concat(F.lit("Opening hours changed to: "), line("hours"))),
                F.when(F.col("_known") & F.col("special").isNotNull() & (special("special") != special("_special")), F.concat(F.lit("Holiday hours: "), special("special"))),
            )
        ),
        F.transform(newly, lambda u: F.concat(F.lit("Broken link: "), u)),
        F.array_compact(F.array(F.when(n > 0, F.concat(n.cast("string"), F.when(n == 1, " price changed").otherwise(" prices changed"))))),
    )
    return joined.select("domain", lines.alias("changes")).where(F.size("changes") > 0)


# --- differences between two versions of a site ---------------------------------------------


def describe_changes(versions: DataFrame) -> DataFrame:
    """Differences a visitor would care about, as arrays and in words.

    ``versions`` has (domain, old_name, new_name, old_pages, new_pages as map from path
    to title, old_actions, new_actions as map from id to name). Page texts do not count.
    """
    keys = lambda c: F.array_sort(F.map_keys(c))
    staged = fence(versions).select(
        "*",
        F.array_except(keys("new_pages"), keys("old_pages")).alias("pages_added"),
        F.array_except(keys("old_pages"), keys("new_pages")).alias("pages_removed"),
        F.filter(
            F.array_intersect(keys("new_pages"), keys("old_pages")),
            lambda p: (F.element_at("old_pages", p) != "") & (F.element_at("new_pages", p) != "") & (F.element_at("old_pages", p) != F.element_at("new_pages", p)),
        ).alias("pages_retitled"),
        F.array_except(keys("new_actions"), keys("old_actions")).alias("actions_added"),
        F.array_except(keys("old_actions"), keys("new_actions")).alias("actions_removed"),
    )
    title = lambda pages, p: F.coalesce(F.concat(F.lit('"'), F.substring(F.when(F.element_at(pages, p) != "", F.element_at(pages, p)), 1, 60), F.lit('"')), p)
    plural = lambda c, one, many: F.when(F.size(c) > 1, many).otherwise(one)

    def listed(c: str, pages: str) -> Column:
        named = F.array_join(F.transform(F.slice(c, 1, 4), lambda p: title(pages, p)), ", ")
        return F.concat(named, F.when(F.size(c) > 4, F.concat(F.lit(" and "), (F.size(c) - 4).cast("string"), F.lit(" more"))).otherwise(""))

    names = lambda c, actions: F.array_join(F.transform(c, lambda i: F.coalesce(F.element_at(actions, i), i)), ", ")
    retitled = F.array_join(
        F.transform(F.slice("pages_retitled", 1, 3), lambda p: F.concat(title("old_pages", p), F.lit(" → "), title("new_pages", p))), "; "
    )
    renamed = (F.col("old_name") != "") & (F.col("new_name") != "") & (F.col("old_name") != F.col("new_name"))
    some = lambda c: F.size(c) > 0
    lines = F.array_compact(
        F.array(
            F.when(renamed, F.concat(F.lit("Renamed from "), "old_name", F.lit(" to "), "new_name")),
            F.when(some("pages_added"), F.concat(plural("pages_added", "New page: ", "New pages: "), listed("pages_added", "new_pages"))),
            F.when(some("pages_removed"), F.concat(plural("pages_removed", "Page gone: ", "Pages gone: "), listed("pages_removed", "old_pages"))),
            F.when(some("pages_retitled"), F.concat(F.lit("Retitled: "), retitled)),
            F.when(some("actions_added"), F.concat(plural("actions_added", "New action: ", "New actions: "), names("actions_added", "new_actions"))),
            F.when(some("actions_removed"), F.concat(F.lit("No longer offered: "), names("actions_removed", "old_actions"))),
        )
    )
    return (
        staged.withColumn("_lines", lines)
        .where(F.size("_lines") > 0)
        .select(
            "domain", renamed.alias("renamed"), "pages_added", "pages_removed", "pages_retitled", "actions_added", "actions_removed",
            F.concat(F.array_join("_lines", ". "), F.lit(".")).alias("description"),
        )
    )


# --- availability ---------------------------------------------------------------------------


def unreachable_sites(checks: DataFrame) -> DataFrame:
    """Sites whose last two checks both failed to connect.

    ``checks`` has (domain, checked_at, outcome); only "down" counts, refusals and
    server errors do not. The window keeps two rows per site before the shuffle.
    """
    last = top_per_group(checks, ["domain"], [F.desc("checked_at"), F.desc("outcome")], 2)
    return (
        last.groupBy("domain").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("outcome") == "down").alias("_down")).where((F.col("_n") == 2) & (F.col("_down") == 2)).select("domain")
    )


def check_outcome(status: Column, error: Column) -> Column:
    """Outcome of one check: only a missing host or a refused connection is "down"."""
    return (
        F.when(error.rlike("ENOTFOUND|ECONNREFUSED"), "down").when(error.isNotNull(), "ok").when(status.isin(404, 410), "gone").otherwise("ok")
    )


def drop_dead_links(sites: DataFrame, links: DataFrame) -> DataFrame:
    """Remove the link of actions that answer 404 or 410 or are no URL at all.

    ``sites`` has (domain, actions array<struct<id, url>>), ``links`` (url, status). Only
    dead links travel back to their site; a link without a verdict stays.
    """
    valid = F.col("url").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    listed = sites.select("domain", F.explode("actions").alias("a")).select("domain", F.col("a.url").alias("url")).where(F.col("url").isNotNull()).distinct()
    dead = links.where(F.col("status").isin(404, 410)).select("url").distinct()
    broken = listed.where(valid).join(dead, "url", "left_semi").select("domain", "url").unionByName(listed.where(~valid).select("domain", "url"))
    per_site = broken.groupBy("domain").agg(F.collect_set("url").alias("_dead"))
    cleaned = F.transform(
        "actions", lambda a: F.when(F.array_contains("_dead", a["url"]), a.withField("url", F.lit(None).cast("string"))).otherwise(a)
    )
    return sites.join(per_site, "domain").select("domain", cleaned.alias("actions"), F.size("_dead").alias("removed"))


# --- once per problem and hour --------------------------------------------------------------


def hourly_alerts(problems: DataFrame, key: str = "key", at: str = "at") -> DataFrame:
    """One alert per problem and clock hour: the first occurrence, with the count."""
    return problems.groupBy(key, F.date_trunc("hour", at).alias("hour")).agg(F.min(at).alias("first_at"), F.count(F.lit(1)).alias("times"))


# --- retention ------------------------------------------------------------------------------

#: Tables, columns, days and conditions of retention. Rows: (table, age column, days kept, extra condition, reason).
RETENTION = [
    ("checks", "created_at", 30, None, "checks of endpoints, kept a month"),
    ("site_diffs", "detected_at", 180, None, "differences between versions, kept half a year"),
    ("item_prices", "observed_at", 365, None, "observed prices, kept a year"),
    ("searches", "created_at", 365, None, "logged searches, kept a year"),
    ("action_log", "created_at", 365, None, "logged actions, kept a year"),
    ("crawl_queue", "done_at", 30, None, "crawl requests done a month ago"),
    ("used_tokens", "used_at", 30, None, "tokens used a month ago"),
    ("search_cache", "expires_at", 0, None, "cached answers past their time"),
    ("query_reformulations", "updated_at", 180, None, "reformulated queries, kept half a year"),
    ("name_websites", "checked_at", 90, None, "websites looked up by name, kept a quarter"),
    ("search_misses", "checked_at", 60, None, "searches without a hit, kept two months"),
    ("site_scores", "week", 56, None, "scores of more than eight weeks ago"),
    ("events", "start_date", 1, "end_date IS NULL", "one-day events that began before yesterday"),
    ("events", "end_date", 1, None, "longer events that ended before yesterday"),
    ("events", "start_date", -42, "description LIKE '%ibrary%'", "library dates beyond six weeks"),
    ("events", "start_date", -183, None, "dates beyond half a year"),
    ("usage_counters", "window_start", 2, "key NOT LIKE 'tool_day%'", "short counters, kept two days"),
    ("usage_counters", "window_start", 35, "key LIKE 'tool_day%'", "daily tool counters, kept five weeks"),
    ("rate_limits", "window_start", 1, None, "windows of rate limits, kept a day"),
    ("blocked", "until", 1, None, "blocks that have run out"),
    ("action_messages", "created_at", 365, None, "sent messages, kept a year"),
    ("uptime_checks", "checked_at", 90, None, "reachability checks, kept a quarter"),
]


def expired(rule: tuple, as_of: Column) -> Column:
    """Rows a retention rule removes. Negative days mean too far ahead, not too old."""
    _, column, days, extra, _ = rule
    edge = as_of - F.make_dt_interval(days=F.lit(days))
    test = F.col(column) < edge if days >= 0 else F.col(column) > edge
    if extra:
        test = test & F.expr(extra)
    return F.coalesce(test, F.lit(False))


def retention_counts(df: DataFrame, table: str, as_of: Column, rules: Sequence[tuple] = RETENTION) -> DataFrame:
    """Dry run: rows each rule of a table would remove, in one pass."""
    mine = [r for r in rules if r[0] == table]
    counts = df.agg(*[F.count_if(expired(r, as_of)).alias(f"r{i}") for i, r in enumerate(mine)])
    listed = F.array(*[F.struct(F.lit(r[4]).alias("reason"), F.col(f"r{i}").alias("rows")) for i, r in enumerate(mine)])
    return counts.select(F.explode(listed).alias("x")).select(F.lit(table).alias("table"), "x.reason", "x.rows")


def retained(df: DataFrame, table: str, as_of: Column, rules: Sequence[tuple] = RETENTION) -> DataFrame:
    """Rows no rule of the table removes."""
    for rule in rules:
        if rule[0] == table:
            df = df.where(~expired(rule, as_of))
    return df


def clear_hidden(sites: DataFrame) -> DataFrame:
    """Empty the pages and actions of hidden sites; their rows stay."""
    hidden = F.col("status").isNotNull()
    empty = lambda c: F.when(hidden, F.lit(None)).otherwise(F.col(c))
    pages = F.coalesce(empty("pages"), F.create_map().cast(sites.schema["pages"].dataType))
    actions = F.coalesce(empty("actions"), F.array().cast(sites.schema["actions"].dataType))
    return sites.withColumn("pages", pages).withColumn("actions", actions)


def sweepable(sites: DataFrame, searches: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Minimal sites older than a month that never came up in a search.

    The searched domains are made distinct before the join, so a popular domain is
    one row.
    """
    searched = searches.select(F.explode("domains").alias("domain")).distinct()
    old = sites.where((F.col("conversion") == "minimal") & F.col("owner_key").isNull() & (F.col("first_seen_at") < as_of - F.make_dt_interval(days=F.lit(days))))
    return old.join(searched, "domain", "left_anti").select("domain")


# --- holidays and cohorts -------------------------------------------------------------------


def holiday_gaps(sites: DataFrame, holidays: DataFrame, as_of: Column, first: int = 4, last: int = 11) -> DataFrame:
    """Public holidays soon that a business has no special hours for.

    ``sites`` has (domain, country, special), ``holidays`` (country, date, name). Dates
    are cut to the coming week before the join on the country.
    """
    ahead = (F.unix_micros(F.col("date").cast("timestamp")) - F.unix_micros(as_of)) / 86_400_000_000.0
    soon = holidays.where(ahead.between(first, last)).select("country", F.date_format("date", "yyyy-MM-dd").alias("holiday"), F.col("name").alias("holiday_name"))
    covered = F.coalesce(F.exists("special", lambda s: (s["from"] <= F.col("holiday")) & (s["to"] >= F.col("holiday"))), F.lit(False))
    return sites.join(soon, "country").where(~covered).select("domain", "holiday", "holiday_name")


def cohort_without(readers: DataFrame, paying: DataFrame) -> DataFrame:
    """Distinct readers who are not paying customers too, by lower-case address."""
    lowered = F.lower("email").alias("email")
    return readers.select(lowered).distinct().join(paying.select(lowered).distinct(), "email", "left_anti")


def hours_outcomes(stored: DataFrame, read: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored hours against hours read again: same, differ, no hours or failed.

    ``read`` lists the sites that answered, ``fresh`` what was found on them.
    """
    answered = read.select("domain", F.lit(True).alias("_read"))
    joined = stored.join(answered, "domain", "left").join(fresh.select("domain", "fresh_hours"), "domain", "left")
    outcome = (
        F.when(F.col("_read").isNull(), "failed")
        .when(F.coalesce(F.size("fresh_hours"), F.lit(0)) <= 0, "no hours")
        .when(canonical_hours(F.col("fresh_hours")) == canonical_hours(F.col("opening_hours")), "same")
        .otherwise("differ")
    )
    return joined.select("domain", outcome.alias("outcome"))


def platform_limits(hits: DataFrame, as_of: Column, limits: dict[str, int]) -> DataFrame:
    """Counters of the last hour at or over their limit."""
    recent = hits.where((F.col("at") >= as_of - F.make_dt_interval(hours=F.lit(1))) & (F.col("at") < as_of))
    sums = recent.groupBy("key").agg(F.sum("hits").alias("hits"))
    rule = None
    for name, limit in limits.items():
        rule = F.when(F.col("key") == name, limit) if rule is None else rule.when(F.col("key") == name, limit)
    return sums.withColumn("limit", rule).where(F.col("hits") >= F.col("limit"))




def recipients(rows: DataFrame, accounts: DataFrame, key: str = "owner_key") -> DataFrame:
    """Rows with the address of the account that owns them; rows without an account drop out."""
    return rows.join(accounts.select(F.col("key_hash").alias(key), "email"), key)


def audience(readers: DataFrame, per_run: int) -> DataFrame:
    """Confirmed readers who have not left, as many as one run may write to."""
    active = readers.where(F.col("confirmed_at").isNotNull() & F.col("unsubscribed_at").isNull())
    return active.select("email").orderBy("email").limit(per_run)
