"""From a folder of captured pages to image texts and product records, as whole jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import adapters, ship
from pagemill.config import DEFAULT, NO_CONTENT, Settings
from pagemill.guard import Guarded
from pagemill.operators import assets, boxes, records
from pagemill.operators.images import prepare_images
from pagemill.sources import captures, sinks
from pagemill.storage import fresh_path, materialise, spread

#: Images for one task, and strips that leave Python at once.
IMAGES_OF_TASK, STRIPS_AT_ONCE = 2000, 200
RAW_WORDS = "polygons array<array<array<double>>>, texts array<string>, scores array<double>"


def png_size(content: Column) -> Column:
    """(width, height) of a PNG file, from its header; null for anything else."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))


def read_words(images: DataFrame, make_reader: Callable[[], adapters.WordReader], settings: Settings = DEFAULT) -> DataFrame:
    """``path``, ``words`` (boxes of the whole image) and ``error`` of images (path, content).

    Each image travels once, with the list of its overlapping strips, which are read one by one and moved back to their place.
    A reader is made once for each task, in a process of its own; an image has settings.read_seconds. An image whose
    header or reading fails, or takes longer, has an error and null words, and holds up no other.
    """
    ship(images.sparkSession)
    strips = boxes.tiles(png_size(F.col("content"))["height"], settings)
    sized = images.select("path", "content", F.transform(strips, lambda s: F.struct(s["y0"].alias("y0"), s["y1"].alias("y1"))).alias("strips"))
    schema = T.StructType.fromDDL(f"path string, y0 int, {RAW_WORDS}, error string")

    def make_strip_reader() -> Callable:
        reader = make_reader()
        return lambda content, strips: [reader(content, *s) for s in strips]

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        with Guarded(make_strip_reader, settings.read_seconds) as reader:
            for batch in batches:
                rows = []
                for k in range(batch.num_rows):
                    path, content, strips = (batch.column(c)[k].as_py() for c in range(3))
                    strips = [(s["y0"], s["y1"]) for s in strips or ()]
                    found, error = reader(content, strips) if strips else (None, "ValueError: not a PNG file, or one without height")
                    if error:
                        rows.append({"path": path, "error": error})
                    else:
                        rows += [{"path": path, "y0": y0, "polygons": f[0], "texts": f[1], "scores": f[2]} for (y0, _), f in zip(strips, found)]
                    if len(rows) >= STRIPS_AT_ONCE:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    raw = sized.mapInArrow(read, schema)
    words = boxes.words_of_result(F.col("polygons"), F.col("texts"), F.col("scores"), F.col("y0"), settings)
    found = raw.select("path", "y0", "error", F.when(F.col("error").isNull(), words).alias("words"))
    in_order = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("y0", "words"))), lambda s: s["words"]))
    whole = found.groupBy("path").agg(in_order.alias("words"), F.min("error").alias("error"))
    return whole.select("path", F.when(F.col("error").isNull(), F.col("words")).alias("words"), "error")


def image_texts(images: DataFrame, make_reader: Callable[[], adapters.WordReader], texts: DataFrame | None = None, make_spacer: Callable[[], adapters.Spacer] | None = None, settings: Settings = DEFAULT, prepare: bool = False) -> DataFrame:
    """``path``, ``text``, ``error`` of the images (path, mtime, content) that have no fresh text (path, mtime) yet.

    prepare: enlarge and sharpen them before (images.prepare_images); one that cannot be prepared is read as it is.
    """
    pending = images if texts is None else assets.pending_images(images, texts)
    pictures = prepare_images(pending.select("path", "content"), settings) if prepare else pending
    read = read_words(pictures.select("path", "content"), make_reader, settings)
    found = read.select("path", boxes.recognised_text(F.col("words"), settings=settings).alias("text"), "error")
    return adapters.correct_spacing(found, "text", make_spacer) if make_spacer else found


def texts_by_product(texts: DataFrame) -> DataFrame:
    """``product``, ``text`` (all texts) and ``section`` (numbered, for the merged document) of texts (path, text), assets before product pictures."""
    known = texts.withColumns(assets.image_columns(F.col("path")))
    order = F.struct("is_product", "path")
    return known.groupBy("product").agg(assets.joined_texts(F.col("text"), order).alias("text"), assets.image_sections(F.col("text"), order).alias("section"))


def read_in_rounds(
    images: DataFrame, content: DataFrame, run: str, texts_path: str, make_reader: Callable[[], adapters.WordReader], make_spacer: Callable[[], adapters.Spacer] | None = None, settings: Settings = DEFAULT, use_cache: bool = True
) -> None:
    """Read the images (path, mtime; content: path, content) that have no fresh text, and add their texts to texts_path.

    An image that failed has no text but a row in the table of failures beside the texts (texts_path with ``_errors``: run,
    path, mtime, attempt, error). It is read again in the next round, with what else is left, and given up after
    settings.attempts of them; an image that has changed since begins anew.
    """
    spark = images.sparkSession
    for number in range(settings.attempts):
        known = captures.read_image_texts(spark, texts_path, run)
        todo = assets.pending_images(images, known, use_cache or number > 0)
        failures = captures.read_failures(spark, texts_path, run).groupBy("path", "mtime").agg(F.max("attempt").alias("tried"))
        todo = todo.join(failures, ["path", "mtime"], "left").where(F.coalesce("tried", F.lit(0)) < settings.attempts)
        left = todo.count()
        if not left:
            break
        pictures = spread(todo.select("path", "mtime").join(content, "path"), left, IMAGES_OF_TASK)
        done = materialise(image_texts(pictures, make_reader, None, make_spacer, settings), "image-texts")
        good = done.where(F.col("error").isNull())
        sinks.write_image_texts(good.select(F.lit(run).alias("run"), "path", "text", F.current_timestamp().alias("mtime")), texts_path)
        failed = done.where(F.col("error").isNotNull()).join(todo, "path").select(F.lit(run).alias("run"), "path", "mtime", (F.coalesce("tried", F.lit(0)) + 1).alias("attempt"), "error")
        sinks.write_failures(failed, texts_path)


def read_capture_images(
    spark: SparkSession, run: str, texts_path: str, make_reader: Callable[[], adapters.WordReader], make_spacer: Callable[[], adapters.Spacer] | None = None, settings: Settings = DEFAULT, use_cache: bool = True
) -> DataFrame:
    """read_in_rounds() of the images of a run, and texts_by_product() of all its texts. No image is an empty result."""
    name = run.rstrip("/").rsplit("/", 1)[-1]
    images = captures.read_images(spark, run)
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][nN][gG]").load(run).select("path", "content")
    read_in_rounds(images, content, name, texts_path, make_reader, make_spacer, settings, use_cache)
    newest = captures.read_image_texts(spark, texts_path, name).groupBy("path").agg(F.max_by("text", "mtime").alias("text"))
    return texts_by_product(newest.join(images.select("path"), "path"))


def capture_pages(spark: SparkSession, run: str, products: DataFrame | None = None) -> DataFrame:
    """The pages of a run as product_records() takes them, from their metadata and documents.

    products: texts_by_product() of the run's images; a section replaces nothing but is added to the page's document. Older runs
    with a merged document, or with separate texts in place of a document, are read as well.
    """
    old = {k: captures.read_documents(spark, run, f"{n}.txt") for k, n in (("product_dom", "product_dom"), ("tables", "tables"), ("dom", "dom"))}
    pages = captures.with_context(captures.read_metadata(spark, run), captures.read_documents(spark, run, "context.md"), captures.read_documents(spark, run, "product.md"), old)
    section = F.lit("")
    if products is not None:
        pages = pages.join(products.select(F.substring_index("product", "/", -1).alias("folder"), "section"), "folder", "left")
        section = F.coalesce("section", F.lit(""))
    pages = pages.withColumn("context", records.merged_document(F.col("context"), section))
    parts = records.context_sections(F.col("context"))
    return pages.withColumn("parts", parts).select("folder", "url", "status", "title", "context", "parts.*", F.col("elapsed_seconds").alias("elapsed"))


def build_records(
    spark: SparkSession, run: str, out: str | None = None, products: DataFrame | None = None, make_client: Callable[[], adapters.ModelClient] | None = None, mode: str = "full", settings: Settings = DEFAULT, answers: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Records of all pages of a run and their report by host; the records are written by host to out if it is given.

    With a client (and settings.engine ``model``) a model is asked first, for captured pages only, and the rules take what it leaves. Each
    distinct request is asked once, and its answer written to answers (a path, by default one in the shared folder) before
    it is used; the records returned are read from a table, so looking at them asks nobody.
    """
    pages = capture_pages(spark, run, products)
    if make_client and settings.engine == "model":
        captured = F.col("status") == "captured"
        messages = adapters.prompt(F.col("url"), F.col("title"), F.col("context"), F.lit(NO_CONTENT), settings=settings)
        asked = adapters.ask_once(pages.where(captured).withColumn("messages", messages), make_client, answers or fresh_path(spark, "answers"), settings).drop("messages", "request", "answer", "error")
        rest = pages.where(~captured | F.col("status").isNull())
        pages = asked.unionByName(rest.withColumn("model_record", F.lit(None).cast(asked.schema["model_record"].dataType)))
    found = materialise(records.product_records(pages, mode), "records")
    if out is not None:
        sinks.write_records(found, out)
    return found, records.host_report(found)
