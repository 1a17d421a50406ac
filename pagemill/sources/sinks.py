"""Writing results: records by host, metadata and summaries by run, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.config import NAME_KEY, SPECS_KEY, STATUS_KEY


def records_for_output(records: DataFrame) -> DataFrame:
    """Records with the field names of the output format."""
    variants = F.transform("variants", lambda v: F.struct(v["model"].alias("model"), v["specs"].alias(SPECS_KEY)))
    return records.select("host", F.col("url").alias("URL"), F.col("status").alias(STATUS_KEY), F.col("product_name").alias(NAME_KEY), variants.alias("variants"))


def write_records(records: DataFrame, path: str) -> None:
    """One folder of JSON lines for each true host; an error if the path exists.

    Rows are dealt by host, and Spark splits a host into as many writers as its bytes ask for, and puts small ones together
    (spark.sql.adaptive.advisoryPartitionSizeInBytes).
    """
    records_for_output(records).hint("rebalance", F.col("host")).write.mode("errorifexists").partitionBy("host").json(path)


def write_metadata(metadata: DataFrame, path: str) -> None:
    """Metadata by run as JSON lines; seconds with one decimal, null fields left out."""
    metadata.withColumn("elapsed_seconds", F.round("elapsed_seconds", 1)).write.mode("append").partitionBy("run").json(path)


def write_manifests(pages: DataFrame, manifest: DataFrame, path: str) -> None:
    """One line of JSON for each page (run, folder) with its assets in order; a page without assets has an empty array.

    manifest: run, folder, asset_no, file, tag, src, alt, frame_index, width, height (see assets.asset_manifest).
    """
    one = F.struct("asset_no", "file", "tag", "src", "alt", "frame_index", "width", "height")
    own = manifest.groupBy("run", "folder").agg(F.transform(F.sort_array(F.collect_list(one)), lambda a: a.dropFields("asset_no")).alias("assets"))
    none = F.array().cast(own.schema["assets"].dataType)
    out = pages.select("run", "folder").distinct().join(own, ["run", "folder"], "left").withColumn("assets", F.coalesce("assets", none))
    out.write.mode("append").partitionBy("run").json(path)


def write_image_texts(texts: DataFrame, path: str) -> None:
    """The text of every image that was read (run, path, text, mtime), empty ones included, so that none is read again."""
    texts.select("run", "path", F.coalesce("text", F.lit("")).alias("text"), "mtime").write.mode("append").partitionBy("run").parquet(path)


def write_failures(failures: DataFrame, texts_path: str) -> None:
    """What could not be read (run, path, mtime, attempt, error), in the table of failures beside the texts."""
    failures.select("run", "path", "mtime", "attempt", "error").write.mode("append").partitionBy("run").parquet(texts_path.rstrip("/") + "_errors")


def compact_image_texts(spark: SparkSession, path: str, to: str) -> None:
    """The last text of each image of each run, written to a new path: reading needs no choice among older ones then."""
    texts = spark.read.schema("path string, text string, mtime timestamp, run string").parquet(path)
    newest = texts.groupBy("run", "path").agg(F.max_by(F.struct("text", "mtime"), "mtime").alias("last"))
    newest.select("run", "path", "last.*").hint("rebalance", F.col("run")).write.mode("errorifexists").partitionBy("run").parquet(to)


def write_combined_texts(texts: DataFrame, path: str) -> None:
    """The texts of a product's images joined in order, as one row for each product (run, product, text)."""
    texts.select("run", "product", "text").write.mode("append").partitionBy("run").parquet(path)


def capture_summary(pages: DataFrame, order: str = "number") -> DataFrame:
    """url and status of all pages of a run, errors included, in order."""
    return pages.select(order, "url", F.coalesce("status", F.lit("error")).alias("status")).orderBy(order).select("url", "status")


def write_documents(pages: DataFrame, path: str, text: str = "context") -> None:
    """folder and document, as Parquet by run."""
    pages.select("run", "folder", F.col(text).alias("text")).write.mode("append").partitionBy("run").parquet(path)
