"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master without that setting gets a temporary folder; a cluster without it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-pagemill-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to a table of its own in the shared folder and read it back.

    This cuts the lineage: later stages survive the loss of executors without recomputing df.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, load: int, each: int) -> DataFrame:
    """df dealt evenly to tasks of about each of a load, but to as many as Spark has cores where there is so much.

    A small file is one task of Spark's, however much work its rows are.
    """
    return df.repartition(max(math.ceil(load / each), min(load, df.sparkSession.sparkContext.defaultParallelism), 1))
