"""Writers: versioned Parquet tables, histories, state, snapshots, exports.

Parquet has no ``MERGE``. A merge is a join that yields the next version of the table;
:class:`VersionedTable` writes it beside the old one and then moves the version by a rename,
so readers see one version or the other and a lost executor only repeats a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostloom.sources.merges import changed_rows, guarded_patch, insert_ignore, one_per_key, upsert  # noqa: F401  (part of this module's face)
from hostloom.sources.parted import Versions, append_once

# --- tables on disk -------------------------------------------------------------------------


class VersionedTable:
    """A small Parquet table that every change rewrites; a large one is a :class:`~hostloom.sources.parted.PartedTable`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, f"{self.path}/_versions")

    def version(self) -> int | None:
        """Number of the current version, None before the first write."""
        return self.versions.latest()[0] or None

    def exists(self) -> bool:
        """Whether anything was written yet."""
        return self.version() is not None

    def read(self) -> DataFrame:
        """The current version."""
        return self.spark.read.parquet(f"{self.path}/{self.versions.latest()[1]}")

    def replace(self, df: DataFrame, partition_by: Sequence[str] = (), base: int | None = None) -> int:
        """Write the version after ``base`` (the current one), then point to it. Old versions stay readable.

        Raises ClashError if another writer has moved on from ``base`` meanwhile.
        """
        base = (self.version() or 0) if base is None else base
        name = f"v={base + 1}-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.path}/{name}")
        return self.versions.add(base, name)

    def merge(self, new: DataFrame, key: str, supplied: Sequence[str]) -> int:
        """Upsert a batch into the table; into nothing, it becomes the table."""
        base = self.version()
        if base is None:
            return self.replace(one_per_key(new, key).select(key, *supplied), base=0)
        return self.replace(upsert(self.read(), new, key, supplied), base=base)

    def delete(self, condition: Column) -> int:
        """Next version without the rows that meet the condition; NULL does not meet it."""
        base = self.version()
        return self.replace(self.read().where(~F.coalesce(condition, F.lit(False))), base=base)


def append_history(rows: DataFrame, path: str, at: str = "observed_at", run: str | None = None) -> None:
    """Append to a history table partitioned by run and day. With a run name, a repeated run is there once."""
    append_once(rows, path, run or uuid.uuid4().hex, at)


def save_state(spark: SparkSession, path: str, key: str, value: str) -> None:
    """Remember one value of a job; the table has one row per id."""
    table = VersionedTable(spark, path)
    row = spark.createDataFrame([(key, value)], "id string, value string")
    if table.exists():
        table.merge(row, "id", ["value"])
    else:
        table.replace(row)


def load_state(spark: SparkSession, path: str, key: str) -> str | None:
    """The remembered value of a job, None if there is none."""
    table = VersionedTable(spark, path)
    if not table.exists():
        return None
    rows = table.read().where(F.col("id") == key).select("value").take(1)
    return rows[0][0] if rows else None


def save_report(report: DataFrame, path: str, week: str = "week") -> None:
    """Write report rows, replacing the partition of their week only."""
    report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(week).parquet(path)


def snapshot(sites: DataFrame, events: DataFrame, path: str, site_limit: int = 5000, event_limit: int = 6000) -> None:
    """Compact JSON of the best-known sites and the next events, for use when all else fails."""
    best = sites.where(F.col("status").isNull() & F.col("popularity_rank").isNotNull()).orderBy("popularity_rank", "domain").limit(site_limit)
    soon = events.orderBy("start_date", "url").limit(event_limit)
    best.coalesce(1).write.mode("overwrite").json(f"{path}/sites")
    soon.coalesce(1).write.mode("overwrite").json(f"{path}/events")


def backup(tables: dict[str, DataFrame], path: str, date: str) -> DataFrame:
    """Copy tables under one date and return the manifest (table, rows)."""
    spark = next(iter(tables.values())).sparkSession
    manifest = None
    for name, df in tables.items():
        target = f"{path}/date={date}/{name}"
        df.write.mode("overwrite").parquet(target)
        rows = spark.read.parquet(target).agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
        manifest = rows if manifest is None else manifest.unionByName(rows)
    manifest.write.mode("overwrite").parquet(f"{path}/date={date}/_manifest")
    return manifest


def export_urls(urls: DataFrame, path: str, total: int = 50_000, per_file: int = 10_000) -> None:
    """Export a URL list in files of at most ``per_file`` rows."""
    urls.select("url").distinct().orderBy("url").limit(total).write.mode("overwrite").option("maxRecordsPerFile", per_file).text(path)


def outbox(alerts: DataFrame, path: str, run: str | None = None) -> None:
    """Append alerts for whatever delivers them; with a run name, a repeated run is there once."""
    append_history(alerts, path, at="at", run=run)
