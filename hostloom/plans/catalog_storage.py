"""Tables on disk and streams, run as a whole: written, changed, read back, drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostloom.plans import roles
from hostloom.plans.registry import query
from hostloom.sources.parted import PartedTable, append_once, shared_folder
from hostloom.sources.tables import by_day
from hostloom.streaming import drain, windows

# --- merges and deletes by part -------------------------------------------------------------


@query(
    "parted_merge",
    """WITH counted AS (SELECT o_custkey AS id, count(*) AS orders, max(o_totalprice) AS top_price FROM orders GROUP BY 1)
    SELECT coalesce(c_custkey, id) AS id, c_name AS name, c_acctbal AS balance, orders, top_price
    FROM customer FULL JOIN counted ON c_custkey = id WHERE c_acctbal IS NULL OR c_acctbal >= 0""",
)
def parted_merge(spark, sf_dir):
    """Customers in 16 parts; their order counts are merged in, those in debt deleted, the rest read back."""
    stored = PartedTable(spark, shared_folder(spark), "id", parts=16)
    customers = roles.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    stored.replace(customers.select("*", F.lit(None).cast("bigint").alias("orders"), F.lit(None).cast("double").alias("top_price")))
    counted = roles.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("top_price"))
    stored.merge(counted, ["orders", "top_price"])
    stored.delete(F.col("balance") < 0)
    return stored.read()


@query("parted_retention", "SELECT id, kind, duration_ms FROM searches WHERE created_at >= TIMESTAMP '2024-01-11' AND NOT (kind = 'error' AND created_at < TIMESTAMP '2024-01-15')")
def parted_retention(spark, sf_dir):
    """A log by day: whole days go without touching a file, failed searches of the oldest days are rewritten away."""
    stored = PartedTable(spark, shared_folder(spark), "id", part=F.date_format("created_at", "yyyy-MM-dd"))
    stored.replace(roles.searches(spark, sf_dir).select("id", "kind", "duration_ms", "created_at"))
    stored.drop([day for day in stored.parts() if day < "2024-01-11"])
    stored.delete((F.col("kind") == "error") & (F.col("created_at") < F.lit("2024-01-15").cast("timestamp")))
    return stored.read().select("id", "kind", "duration_ms")


@query(
    "history_runs",
    """SELECT id, kind, CASE WHEN created_at < TIMESTAMP '2024-01-16' THEN 'early' ELSE 'late' END AS run
    FROM searches WHERE created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-21'""",
)
def history_runs(spark, sf_dir):
    """A history of two runs, the second of which was tried twice, read for some days."""
    path, log = shared_folder(spark), roles.searches(spark, sf_dir).select("id", "kind", "created_at")
    middle = F.lit("2024-01-16").cast("timestamp")
    append_once(log.where(F.col("created_at") < middle), path, "early", "created_at")
    for _ in range(2):
        append_once(log.where(F.col("created_at") >= middle), path, "late", "created_at")
    return by_day(spark, path, "2024-01-10", "2024-01-21").select("id", "kind", F.col("run").cast("string").alias("run"))


# --- streams --------------------------------------------------------------------------------


def _log_stream(spark, sf_dir):
    return roles.searches_of(drain.files(spark, f"{sf_dir}/events.parquet"))


@query(
    "stream_hourly_hits",
    """SELECT kind AS key, date_trunc('hour', created_at) AS hour, count(*) AS hits FROM searches
    WHERE date_trunc('hour', created_at) + INTERVAL 1 HOUR <= (SELECT max(date_trunc('millisecond', created_at)) FROM searches) - INTERVAL 10 MINUTE
    GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def stream_hourly_hits(spark, sf_dir):
    """Kinds of search with two or more in a closed clock hour, from the log as a stream."""
    log = _log_stream(spark, sf_dir).select(F.col("kind").alias("key"), F.col("created_at").alias("at"), F.lit(1).cast("bigint").alias("hits"))
    return drain.drained(windows.hourly_hits(log, 2))


@query(
    "stream_minute_usage",
    """SELECT api_key, date_trunc('minute', created_at) AS minute, count(*) AS searches FROM searches
    WHERE date_trunc('minute', created_at) + INTERVAL 1 MINUTE <= (SELECT max(date_trunc('millisecond', created_at)) FROM searches) - INTERVAL 10 MINUTE
    GROUP BY 1, 2""",
)
def stream_minute_usage(spark, sf_dir):
    """Searches per key in closed minutes, from the log as a stream."""
    return drain.drained(windows.minute_usage(_log_stream(spark, sf_dir), warn_at=1))


@query(
    "stream_daily_demand",
    """WITH shown AS (SELECT CAST(created_at AS DATE) AS day, unnest(domains[1:5]) AS domain FROM searches
    ), daily AS (SELECT day, domain, count(*) AS n FROM shown GROUP BY 1, 2
    ), dealt AS (SELECT day, domain, n, unnest(range(1, 8)) AS k FROM daily)
    SELECT CAST(day + CAST(k AS INTEGER) AS TIMESTAMP) AS until, domain, CAST(sum(n * CASE WHEN k <= 2 THEN 2 ELSE 1 END) AS BIGINT) AS score FROM dealt
    WHERE CAST(day + CAST(k AS INTEGER) AS TIMESTAMP) <= (SELECT max(date_trunc('millisecond', created_at)) FROM searches) - INTERVAL 1 DAY
    GROUP BY 1, 2""",
)
def stream_daily_demand(spark, sf_dir):
    """Demand per domain in closed windows of seven days that slide by a day, the last two twice, from the log as a stream."""
    return drain.drained(windows.daily_demand(_log_stream(spark, sf_dir), days=7, recent_days=2))
