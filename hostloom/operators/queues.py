"""What to fetch or refresh next: demand, age and backlog order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.operators.logs import due

NEVER = 1e9


def refresh_days(score: Column) -> Column:
    """Days between refreshes by demand; NULL when there is too little demand."""
    return F.when(score >= 30, 2).when(score >= 10, 7).when(score >= 3, 21)


def last_check(updated: Column, refreshed: Column) -> Column:
    """The later of the last change and the last check."""
    return F.greatest(updated, refreshed)


def age_days(since: Column, as_of: Column) -> Column:
    """Age in days with fractions."""
    return (F.unix_micros(as_of) - F.unix_micros(since)) / 86_400_000_000.0


def refresh_queue(demand: DataFrame, sites: DataFrame, as_of: Column, daily=("news_media", "events")) -> DataFrame:
    """Sites overdue for their demand, most overdue times demand first.

    A site the index does not hold yet is overdue without bound.
    """
    known = sites.select(
        "domain", last_check(F.col("updated_at"), F.col("refreshed_at")).alias("_last"), F.col("category").alias("_category")
    )
    interval = F.when(F.coalesce(F.col("_category").isin(*daily), F.lit(False)), 1).otherwise(refresh_days(F.col("score")))
    return (
        demand.where(refresh_days(F.col("score")).isNotNull())
        .join(known, "domain", "left")
        .withColumn("overdue", F.coalesce(age_days(F.col("_last"), as_of) / interval, F.lit(NEVER)))
        .where(F.col("overdue") >= 1)
        .withColumn("priority", F.col("overdue") * F.col("score"))
        .select("domain", "score", "overdue", "priority")
    )


def top_refresh(sites: DataFrame, as_of: Column, max_rank: int = 5000, days: int = 30) -> DataFrame:
    """Best-known sites not checked for a month, with their overdue factor."""
    seen = last_check(F.col("updated_at"), F.col("refreshed_at"))
    return (
        sites.where(F.col("status").isNull() & F.col("owner_key").isNull() & (F.col("popularity_rank") <= max_rank))
        .where(seen < as_of - F.make_dt_interval(days=F.lit(days)))
        .select("domain", (F.lit(max_rank + 1) - F.col("popularity_rank")).alias("score"), (age_days(seen, as_of) / days).alias("overdue"))
    )


def stale_sites(sites: DataFrame, as_of: Column, max_rank: int = 50_000, days: int = 180, k: int = 500) -> DataFrame:
    """Popular sites without an update for half a year, best-known first."""
    return (
        sites.where(F.col("status").isNull() & F.col("owner_key").isNull() & (F.col("popularity_rank") <= max_rank))
        .where(F.col("updated_at") < as_of - F.make_dt_interval(days=F.lit(days)))
        .orderBy("popularity_rank", "domain")
        .limit(k)
        .select("domain", "popularity_rank")
    )


def due_sites(sites: DataFrame, wanted: DataFrame, checked_column: str, as_of: Column, days: int) -> DataFrame:
    """Indexed sites among the wanted ones whose check is due."""
    return sites.join(wanted.select("domain").distinct(), "domain", "left_semi").where(due(F.col(checked_column), as_of, days))


def conversion_backlog(sites: DataFrame, run_start: Column, with_model: bool = True, hidden=("adult", "gambling")) -> DataFrame:
    """Sites to convert again, in order: foreign summaries, popular ones, old minimal ones.

    Only the tier, rank and date travel to the sort; ties break on the domain.
    """
    open_rows = sites.where((F.col("updated_at") < run_start) & F.col("status").isNull() & F.col("owner_key").isNull())
    minimal = F.col("action_count") == 0
    if not with_model:
        return open_rows.where(minimal).select(
            "domain", "conversion", F.lit(3).alias("tier"), F.lit(None).cast("bigint").alias("popularity_rank"), "updated_at"
        )
    foreign = (F.col("conversion") == "heuristic") & F.col("home").like("%-language website at%")
    allowed = F.col("category").isNull() | ~F.col("category").isin(*hidden)
    wanted = (minimal | (F.col("conversion") == "heuristic")) & allowed
    tier = F.when(foreign, 1).when(wanted, 2)
    return open_rows.withColumn("tier", tier).where(F.col("tier").isNotNull()).select(
        "domain", "conversion", "tier", "popularity_rank", "updated_at"
    )


def backlog_order() -> list[Column]:
    """Sort order of :func:`conversion_backlog`."""
    return [F.asc("tier"), F.asc_nulls_last("popularity_rank"), F.asc("updated_at"), F.asc("domain")]


def oldest_requests(queue: DataFrame, k: int) -> DataFrame:
    """First-in-first-out: open requests, oldest first."""
    return queue.where(F.col("done_at").isNull()).orderBy("requested_at", "domain").limit(k)


def queue_outcome(domain: Column, exists: Column, public: Column, claimed: Column, has_manifest: Column,
                  allowed: Column, fetched: Column, conversion: Column) -> Column:
    """Outcome label of a crawl request, in the order the checks are made."""
    valid = domain.rlike(r"^[a-z0-9.-]+\.[a-z]{2,}$") & public
    return (
        F.when(~valid & ~exists, "no such domain")
        .when(~valid, "not public")
        .when(claimed, "claimed (owner edits it)")
        .when(has_manifest, "native")
        .when(~allowed, "robots.txt disallows")
        .when(conversion.isNotNull(), conversion)
        .when(~fetched, "unreachable")
        .otherwise("minimal")
    )


def complete_requests(queue: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Write outcomes back to the queue; requests without an outcome stay open. Of several outcomes the greatest counts."""
    done = outcomes.groupBy("domain").agg(F.max("outcome").alias("_outcome"))
    return queue.join(done, "domain", "left").select(
        "domain",
        "requested_at",
        F.when(F.col("_outcome").isNotNull(), now).otherwise(F.col("done_at")).alias("done_at"),
        F.coalesce("_outcome", "outcome").alias("outcome"),
    )


def fresh_missing(queries: DataFrame, expansions: DataFrame, as_of: Column, days: int = 25) -> DataFrame:
    """Queries without a fresh expansion."""
    fresh = expansions.where(F.col("updated_at") >= as_of - F.make_dt_interval(days=F.lit(days))).select("query").distinct()
    return queries.join(fresh, "query", "left_anti")


def union_first(frames: list[DataFrame], key: str = "query") -> DataFrame:
    """Distinct union that remembers the first source of every key."""
    out = None
    for position, frame in enumerate(frames):
        part = frame.select(key, F.lit(position).alias("source"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.min("source").alias("source"))


def local_searches(cities: DataFrame, categories: list[str]) -> DataFrame:
    """Every category in every city; the categories are a list people write."""
    listed = F.explode(F.array(*[F.lit(c) for c in categories]))
    return cities.select(listed.alias("_category"), "city").select(F.concat_ws(" ", "_category", "city").alias("query"))
