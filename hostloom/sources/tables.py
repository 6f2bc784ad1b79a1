"""Readers of the files a website index works with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hostloom import schemas


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """A table with its projection and predicate; both reach the Parquet scan."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def by_day(spark: SparkSession, path: str, start: str, end: str, day: str = "day") -> DataFrame:
    """Days ``[start, end)`` of a day-partitioned log; other partitions are not read."""
    return spark.read.parquet(path).where((F.col(day) >= F.lit(start).cast("date")) & (F.col(day) < F.lit(end).cast("date")))


def recent_days(log: DataFrame, as_of: Column, days: int, day: str = "day") -> DataFrame:
    """The last days of a day-partitioned log up to ``as_of``, in whole days; older and later partitions are not read.

    ``as_of`` may be a constant or a scalar subquery over another table: both prune. An
    operator's own condition on the time of day still decides at the edges.
    """
    first = F.to_date(as_of - F.make_dt_interval(days=F.lit(days)))
    return log.where((F.col(day) >= first) & (F.col(day) <= F.to_date(as_of)))


def ranked_list(spark: SparkSession, path: str) -> DataFrame:
    """``rank,domain`` text without a header."""
    return spark.read.schema("rank bigint, domain string").csv(path)


def seed_lists(spark: SparkSession, path: str) -> DataFrame:
    """Seed files, one JSON object per file, as text for ``shops.seed_domains``."""
    return spark.read.text(path, wholetext=True)


def benchmark_cases(spark: SparkSession, path: str) -> DataFrame:
    """Search benchmark cases from a JSON array file, in file order."""
    return spark.read.schema(schemas.BENCHMARK_CASE).json(path, multiLine=True)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files (robots.txt, sitemaps, guides, calendars) as (path, body)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def map_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of map extracts: tags stay a map, positions keep the file order."""
    raw = spark.read.schema(schemas.MAP_EXTRACT).json(path, multiLine=True)
    return raw.select(F.posexplode("elements").alias("pos", "e")).select("pos", "e.*")


def json_bodies(spark: SparkSession, path: str) -> DataFrame:
    """JSON files kept as text for the feed readers, which parse without failing."""
    return text_files(spark, path)


def crawled_pages(spark: SparkSession, path: str) -> DataFrame:
    """The page corpus: (url, html) and whatever else the table carries."""
    return spark.read.parquet(path)


def dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small dimension (rates, holidays, genres, cities) from CSV with a header."""
    return spark.read.schema(schema).csv(path, header=True)


def latest_snapshot(spark: SparkSession, path: str, before: str, column: str = "taken_on") -> DataFrame:
    """The snapshot taken last before a day, from a table partitioned by that column.

    The latest day is a subquery over partition values, so only that day is read.
    """
    rows = spark.read.parquet(path).where(F.col(column) < F.lit(before).cast("date"))
    return rows.where(F.col(column) == rows.agg(F.max(column).alias("m")).scalar())


def with_missing(df: DataFrame, schema: str) -> DataFrame:
    """Columns of a schema the table lacks, as typed NULLs: older files stay readable."""
    have = set(df.columns)
    extra = [F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema).fields if f.name not in have]
    return df.select("*", *extra)
