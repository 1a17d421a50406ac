"""Captured pages as a stream: an extension for runs that are still being written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.functions.urls import canonical
from pagemill.functions.urls import host as url_host
from pagemill.sources.captures import METADATA

MEDIA_EVENTS = "page string, src string, tag string, width int, height int, seen_at timestamp"


def stream_metadata(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Metadata files as they appear below path."""
    reader = spark.readStream.schema(METADATA).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch)
    return reader.json(f"{path}/*/metadata.json").withColumn("arrived_at", F.current_timestamp())


def new_assets(media: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Media elements (MEDIA_EVENTS) whose source, without query and fragment, is new on its page within the watermark."""
    keyed = media.withColumn("asset_key", canonical(F.col("src"))).withWatermark("seen_at", lateness)
    return keyed.dropDuplicatesWithinWatermark(["page", "asset_key"])


def host_counts(metadata: DataFrame, every: str = "10 minutes", lateness: str = "30 minutes", at: str = "arrived_at") -> DataFrame:
    """Pages and seconds by host, status and time window."""
    known = metadata.withWatermark(at, lateness).withColumn("host", F.coalesce(url_host(F.col("url")), F.lit("unknown")))
    return known.groupBy(F.window(at, every).alias("window"), "host", "status").agg(F.count(F.lit(1)).alias("pages"), F.sum("elapsed_seconds").alias("seconds"))


def write_stream(frame: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Parquet files as batches complete; with its checkpoint the query goes on where it stopped, writing each row once."""
    return frame.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).start(path)
