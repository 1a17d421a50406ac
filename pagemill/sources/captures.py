"""Reading captured pages: URL lists, metadata, documents, images and texts of a run, and finding runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions.text import strip
from pagemill.functions.urls import host, host_slug, is_excluded
from pagemill.operators.keywords import first_category
from pagemill.operators.records import legacy_context

METADATA = (
    "url string, status string, title string, final_url string, table_count int, ocr_asset_count int, product_selector string, context_file string, elapsed_seconds double"
)
ASSETS = "file string, tag string, src string, alt string, frame_index int, width int, height int"
#: Buckets of the order in which rows are numbered.
BUCKETS = 256


def read_target_urls(spark: SparkSession, path: str) -> DataFrame:
    """``pos`` and ``url`` of a text file with one URL per line; blank lines and lines that begin with ``#`` are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("pos", "line"))
    url = strip(F.col("line"))
    return raw.select("pos", url.alias("url")).where((url != "") & ~url.startswith("#"))


def numbered(df: DataFrame, order: str, name: str = "number", buckets: int = BUCKETS) -> DataFrame:
    """df with the rank (from 1) of each row by a numeric column of distinct values.

    Rows are dealt into buckets by approximate quantiles, counted, and ranked within their bucket, so no task
    sees all rows. Nulls come first, in one bucket. Equal values are ranked by a hash of the whole row.
    """
    cuts = sorted(set(df.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.001)))
    bucket = F.lit(0)
    if cuts:
        limits = F.array(*[F.lit(float(c)) for c in cuts])
        bucket = F.when(F.col(order).isNull(), F.lit(-1)).otherwise(F.size(F.filter(limits, lambda c: c <= F.col(order))))
    dealt = df.withColumn("bucket_", bucket)
    counts = dealt.groupBy("bucket_").agg(F.count(F.lit(1)).alias("n_"))  # one row for each bucket
    starts = counts.select("bucket_", (F.sum("n_").over(Window.orderBy("bucket_")) - F.col("n_")).alias("at_"))
    ranked = dealt.withColumn("in_", F.row_number().over(Window.partitionBy("bucket_").orderBy(order, F.xxhash64(*[f"`{c}`" for c in df.columns]))))
    return ranked.join(F.broadcast(starts), "bucket_").withColumn(name, F.col("at_") + F.col("in_")).drop("bucket_", "in_", "at_")


def without_domains(urls: DataFrame, domains: list[str] | DataFrame | None = None) -> DataFrame:
    """The URLs whose host holds none of domains: a list, or a table of any size (category, position, keyword)."""
    if not isinstance(domains, DataFrame):
        return urls.where(~is_excluded(F.col("url"), domains))
    named = urls.select(F.struct(*[F.col(f"`{c}`") for c in urls.columns]).alias("row_"), F.coalesce(host(F.col("url")), F.lit("")).alias("host_"))
    kept = first_category(named, domains.where("keyword <> ''").withColumn("keyword", F.lower("keyword")), "host_").where("keyword IS NULL")
    return kept.select(*[F.col(f"row_.`{c}`").alias(c) for c in urls.columns])


def capture_plan(urls: DataFrame, order: str = "pos", domains: list[str] | DataFrame | None = None) -> DataFrame:
    """The URLs to capture, without excluded domains, with ``number`` and ``folder``."""
    kept = numbered(without_domains(urls, domains), order)
    return kept.withColumn("folder", F.concat(F.col("number").cast("string"), F.lit("_"), host_slug(F.col("url"))))


def folder_of(path: Column) -> Column:
    """The folder of a file, percent-decoded."""
    return F.element_at(F.split(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "/"), -2)


def read_metadata(spark: SparkSession, run: str) -> DataFrame:
    """Metadata of all pages of a run with their ``folder``; an error if there is none. Blocked pages have nulls."""
    found = spark.read.schema(METADATA).option("multiLine", True).json(f"{run}/*/metadata.json")
    return found.withColumn("folder", folder_of(F.col("_metadata.file_path")))


def read_documents(spark: SparkSession, run: str, name: str) -> DataFrame:
    """``folder`` and ``text`` of one file of every page of a run; an empty table if no page has it."""
    try:
        raw = spark.read.text(f"{run}/*/{name}", wholetext=True)
    except Exception as error:  # noqa: BLE001  Spark has no narrower type for it
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "folder string, text string")
    return raw.select(folder_of(F.col("_metadata.file_path")).alias("folder"), F.col("value").alias("text"))


def read_assets(spark: SparkSession, run: str) -> DataFrame:
    """The assets in the manifests of a run, with their ``folder``."""
    return spark.read.schema(ASSETS).option("multiLine", True).json(f"{run}/*/assets.json").withColumn("folder", folder_of(F.col("_metadata.file_path")))


def read_images(spark: SparkSession, run: str) -> DataFrame:
    """``path``, ``mtime`` and ``is_product`` of the images of a run, in assets folders or product pictures; contents are not read.

    The order of images is by is_product, then path.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][nN][gG]").load(run)
    own = found.select("path", F.col("modificationTime").alias("mtime"))
    # assets come before product pictures, each by path
    own = own.withColumn("is_product", F.endswith("path", F.lit("/product.png")))
    return own.where(F.rlike("path", F.lit(r"/assets/[^/]+$")) | F.endswith("path", F.lit("/product.png")))


def read_image_texts(spark: SparkSession, path: str, run: str) -> DataFrame:
    """``path``, ``text`` and ``mtime`` of the images of a run whose texts were written; an empty table if none were."""
    try:
        return spark.read.schema("path string, text string, mtime timestamp, run string").parquet(path).where(F.col("run") == run).drop("run")
    except Exception as error:  # noqa: BLE001  Spark has no narrower type for it
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "path string, text string, mtime timestamp")


def read_failures(spark: SparkSession, texts_path: str, run: str | None = None) -> DataFrame:
    """``path``, ``mtime``, ``attempt`` and ``error`` of all failed attempts of a run, or with ``run`` those of all runs; an empty table if none failed."""
    schema = "path string, mtime timestamp, attempt int, error string, run string"
    try:
        found = spark.read.schema(schema).parquet(texts_path.rstrip("/") + "_errors")
    except Exception as error:  # noqa: BLE001  Spark has no narrower type for it
        if "PATH_NOT_FOUND" not in str(error):
            raise
        found = spark.createDataFrame([], schema)
    return found if run is None else found.where(F.col("run") == run).drop("run")


def with_context(metadata: DataFrame, context: DataFrame, merged: DataFrame | None = None, old: dict[str, DataFrame] | None = None) -> DataFrame:
    """metadata with ``context``: the merged document if there is one, else the page's own, else what older runs had."""
    out = metadata.join(context.select("folder", F.col("text").alias("context_")), "folder", "left")
    names = ("product_dom", "tables", "dom")
    for name in names:
        frame = (old or {}).get(name)
        out = out.join(frame.select("folder", F.col("text").alias(f"{name}_")), "folder", "left") if frame is not None else out.withColumn(f"{name}_", F.lit(""))
    own = legacy_context(F.col("context_"), F.col("product_dom_"), F.col("tables_"), F.col("dom_"))
    if merged is not None:
        out = out.join(merged.select("folder", F.col("text").alias("merged_")), "folder", "left")
        own = F.coalesce(F.nullif(F.col("merged_"), F.lit("")), own)
    return out.withColumn("context", own).drop("context_", "merged_", *[f"{n}_" for n in names])


def run_name(at: Column) -> Column:
    """The name of a run that began at a time."""
    return F.concat(F.lit("capture_"), F.date_format(at, "yyyyMMdd_HHmmss"))


def latest_run(runs: DataFrame, run: str = "run") -> DataFrame:
    """The rows of the last run by name; an error if there is no run."""
    names = runs.where(F.startswith(run, F.lit("capture_")))
    last = names.agg(F.max(run)).first()[0]
    if last is None:
        raise FileNotFoundError("no run named capture_*")
    return names.where(F.col(run) == last)


def next_free_name(existing: DataFrame, base: str, run: str = "run") -> str:
    """base, or base(1), base(2), …: the first that is not among the runs."""
    taken = {r[0] for r in existing.where(F.startswith(run, F.lit(base))).select(run).distinct().collect()}  # versions of one run
    return base if base not in taken else next(f"{base}({n})" for n in range(1, len(taken) + 2) if f"{base}({n})" not in taken)
