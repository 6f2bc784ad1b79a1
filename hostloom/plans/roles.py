"""The driver's tables in the roles of a website index.

Each function derives a log, a site table or a feed from the given tables with plain
column arithmetic; the SQL next to it states the same derivation for the comparison.
Every row of the source table is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostloom.functions.patterns import first_group
from hostloom.functions.urls import bare_host
from hostloom.plans.registry import shared

#: The clock of the catalogue: the log covers 2024-01-01 to 2024-01-30.
AS_OF = "2024-01-31 00:00:00"


def as_of() -> Column:
    """The catalogue clock as a timestamp."""
    return F.lit(AS_OF).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same rows dealt out evenly, for queries that do much work on every row.

    Splits go by bytes, and a narrow table has many rows in few bytes: its one or two row groups
    would give one or two tasks whatever the cluster. Only the columns in use are shuffled.
    """
    return table(spark, sf_dir, name).repartition(3 * spark.sparkContext.defaultParallelism)


# --- logs -----------------------------------------------------------------------------------


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a search log."""
    return searches_of(table(spark, sf_dir, "events"))


def searches_of(events: DataFrame) -> DataFrame:
    """The same of a table or a stream of events."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.col("event_type"), F.lit(" "), (k % 20).cast("string")).alias("query"),
        F.array(
            F.concat(F.lit("c"), F.col("user_id").cast("string"), F.lit(".example")),
            F.concat(F.lit("c"), ((F.col("user_id") * 7 + k) % 150).cast("string"), F.lit(".example")),
        ).alias("domains"),
        (k % 6).alias("result_count"),
        F.floor(F.col("value") * 100 + 0.5).cast("bigint").alias("duration_ms"),
        F.when(k % 10 == 0, "test").otherwise("free").alias("tier"),
        F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("api_key"),
        F.col("event_type").alias("kind"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


shared("ev", "SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
shared(
    "searches",
    """SELECT event_id AS id, event_type || ' ' || (k % 20) AS query,
         ['c' || user_id || '.example', 'c' || ((user_id * 7 + k) % 150) || '.example'] AS domains,
         k % 6 AS result_count, CAST(floor(value * 100 + 0.5) AS BIGINT) AS duration_ms,
         CASE WHEN k % 10 = 0 THEN 'test' ELSE 'free' END AS tier, 'k' || user_id AS api_key,
         event_type AS kind, ts AS created_at
       FROM ev""",
)


def link_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks per site and day, from the ``click`` events."""
    return (
        searches(spark, sf_dir)
        .where(F.col("kind") == "click")
        .groupBy(F.col("domains")[0].alias("domain"), F.to_date("created_at").alias("day"))
        .agg(F.count(F.lit(1)).alias("clicks"))
    )


shared(
    "link_clicks",
    """SELECT domains[1] AS domain, CAST(created_at AS DATE) AS day, count(*) AS clicks
       FROM searches WHERE kind = 'click' GROUP BY ALL""",
)


def bot_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as visits of crawlers: the event type names the bot."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("c"), F.col("user_id").cast("string"), F.lit(".example")).alias("domain"),
        F.to_date("ts").alias("day"),
        F.concat(F.col("event_type"), F.lit("bot")).alias("bot"),
        F.lit(1).cast("bigint").alias("hits"),
    )


shared(
    "bot_hits",
    """SELECT 'c' || user_id || '.example' AS domain, CAST(ts AS DATE) AS day,
         event_type || 'bot' AS bot, CAST(1 AS BIGINT) AS hits FROM events""",
)


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening words of user turns as free-text searches."""
    words = F.split(F.regexp_replace(F.col("text"), r"[\s,.]+", " "), " ")
    return (
        table(spark, sf_dir, "conversations")
        .where(F.col("role") == "user")
        .select("conv_id", "turn", F.lower(words[0]).alias("query"), "text")
    )


shared(
    "text_queries",
    r"""SELECT conv_id, turn, lower(string_split(regexp_replace(text, '[\s,.]+', ' ', 'g'), ' ')[1]) AS query, text
        FROM conversations WHERE role = 'user'""",
)


# --- sites ----------------------------------------------------------------------------------


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as site records; the nation stands for the city."""
    key = F.col("c_custkey")
    home = F.when(key % 5 == 0, F.concat(F.lit("Website at c"), key.cast("string"))).otherwise(
        F.concat(F.lit("The shop of "), F.col("c_name"), F.lit(" sells goods for the "), F.col("c_mktsegment"),
                 F.lit(" trade and answers questions about orders and delivery."))
    )
    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat(F.lit("c"), key.cast("string"), F.lit(".example")).alias("domain"),
            key.alias("site_id"),
            F.col("c_name").alias("name"),
            F.lower("c_mktsegment").alias("category"),
            F.col("n_name").alias("city"),
            F.col("n_regionkey").cast("bigint").alias("region"),
            F.when(key % 7 != 0, key * 13 % 9973 + 1).alias("popularity_rank"),
            (key % 11 == 0).alias("native"),
            F.when(key % 13 == 0, F.concat(F.lit("k"), (key % 150).cast("string"))).alias("owner_key"),
            F.when(key % 17 == 0, "parked").when(key % 19 == 0, "unreachable").alias("status"),
            F.element_at(
                F.array(*[F.lit(x) for x in ("en", "de", "fr", "es", "nl")]), (key % 5 + 1).cast("int")
            ).alias("language"),
            F.when(key % 4 == 0, "minimal").when(key % 4 == 1, "heuristic").otherwise("full").alias("conversion"),
            (key % 5).alias("action_count"),
            (key % 4 + 1).alias("page_count"),
            home.alias("home"),
            (key % 3 == 0).alias("has_business"),
            (key % 6 == 0).alias("has_hours"),
            F.floor(F.col("c_acctbal") * 100 + 0.5).cast("bigint").alias("cents"),
            (as_of() - F.make_dt_interval(days=(key * 37 % 400).cast("int"))).alias("updated_at"),
            (as_of() - F.make_dt_interval(days=(key * 53 % 90).cast("int"))).alias("refreshed_at"),
            (as_of() - F.make_dt_interval(days=(key * 29 % 60).cast("int"))).alias("first_seen_at"),
        )
    )


shared(
    "sites",
    f"""SELECT 'c' || c_custkey || '.example' AS domain, c_custkey AS site_id, c_name AS name, lower(c_mktsegment) AS category,
          n_name AS city, CAST(n_regionkey AS BIGINT) AS region,
          CASE WHEN c_custkey % 7 <> 0 THEN c_custkey * 13 % 9973 + 1 END AS popularity_rank,
          c_custkey % 11 = 0 AS native,
          CASE WHEN c_custkey % 13 = 0 THEN 'k' || (c_custkey % 150) END AS owner_key,
          CASE WHEN c_custkey % 17 = 0 THEN 'parked' WHEN c_custkey % 19 = 0 THEN 'unreachable' END AS status,
          ['en', 'de', 'fr', 'es', 'nl'][c_custkey % 5 + 1] AS language,
          CASE WHEN c_custkey % 4 = 0 THEN 'minimal' WHEN c_custkey % 4 = 1 THEN 'heuristic' ELSE 'full' END AS conversion,
          c_custkey % 5 AS action_count, c_custkey % 4 + 1 AS page_count,
          CASE WHEN c_custkey % 5 = 0 THEN 'Website at c' || c_custkey ELSE 'The shop of ' || c_name || ' sells goods for the '
            || c_mktsegment || ' trade and answers questions about orders and delivery.' END AS home,
          c_custkey % 3 = 0 AS has_business, c_custkey % 6 = 0 AS has_hours,
          CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT) AS cents,
          TIMESTAMP '{AS_OF}' - to_days(CAST(c_custkey * 37 % 400 AS INTEGER)) AS updated_at,
          TIMESTAMP '{AS_OF}' - to_days(CAST(c_custkey * 53 % 90 AS INTEGER)) AS refreshed_at,
          TIMESTAMP '{AS_OF}' - to_days(CAST(c_custkey * 29 % 60 AS INTEGER)) AS first_seen_at
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)


# --- pages ----------------------------------------------------------------------------------


def crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as a crawled corpus."""
    return table(spark, sf_dir, "pages").select("page_id", "url", "html", bare_host(F.col("url")).alias("domain"))


shared(
    "crawled",
    r"""SELECT page_id, url, html,
          regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.', '') AS domain FROM pages""",
)


# --- shops ----------------------------------------------------------------------------------


def price_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as price observations: unit price at the ship date."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("https://shop.example/p/"), F.col("l_partkey").cast("string")).alias("url"),
        F.col("l_partkey").alias("item_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("observation_id"),
        (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100).alias("price_eur"),
        (F.col("l_returnflag") != "R").alias("available"),
        F.col("l_shipdate").cast("timestamp").alias("observed_at"),
    )


shared(
    "price_log",
    """SELECT 'https://shop.example/p/' || l_partkey AS url, l_partkey AS item_id,
         l_orderkey * 10 + l_linenumber AS observation_id,
         floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price_eur,
         l_returnflag <> 'R' AS available, l_shipdate AS observed_at FROM lineitem""",
)


def first_link(html: Column) -> Column:
    """First link target of a page, for derived feeds."""
    return first_group(html, 'href="([^"]*)"')
