"""Judge results as a stream: files arrive in a folder, each is handled once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rawi.sources.files import parsed_output

#: Batch states as providers name them, and what they mean here.
STATES = {"validating": "in_progress", "queued": "in_progress", "in_progress": "in_progress", "finalizing": "in_progress", "completed": "completed", "ended": "completed", "failed": "failed", "expired": "failed", "cancelled": "failed"}


def state(c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])[F.lower(c)], F.lit("unknown"))


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed result lines of the files in a folder as they come."""
    lines = spark.readStream.text(folder)
    return parsed_output(lines.select("value", F.col("_metadata.file_modification_time").alias("arrived"), F.col("_metadata.file_path").alias("file")))


def collect_available(spark: SparkSession, folder: str, out: str, checkpoint: str) -> None:
    """Append all results that have arrived since the last call to a Parquet table.

    The checkpoint remembers which files are done, so a job that is stopped or
    called again goes on where it was.
    """
    query = arrivals(spark, folder).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_per_item(spark: SparkSession, out: str) -> DataFrame:
    """One row per custom id of the collected results: that of the file that came last, by name among files of one time."""
    return spark.read.parquet(out).groupBy("custom_id").agg(F.max_by("content", F.struct("arrived", "file", "content")).alias("content"))
