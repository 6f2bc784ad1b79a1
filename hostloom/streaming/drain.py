"""Run a stream over what is there and hand back its result as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hostloom.sources.parted import shared_folder


def files(spark: SparkSession, path: str, at_a_time: int = 1) -> DataFrame:
    """A stream over the Parquet files of a table, some files a micro-batch.

    The last letter stands in brackets: a path without a pattern has to be a folder, and a
    table may be one file.
    """
    path = path.rstrip("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", at_a_time).parquet(f"{path[:-1]}[{path[-1]}]")


def drained(stream: DataFrame) -> DataFrame:
    """All that an append stream yields for its present input: for windows, those the watermark has closed.

    Checkpoint and result lie in the shared folder, so a lost executor costs a task.
    """
    folder = shared_folder(stream.sparkSession)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
