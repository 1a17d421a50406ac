"""Image assets of pages: deduplication, numbering, grouping, pending work, combined texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill import config
from pagemill.config import DEFAULT, Settings
from pagemill.functions.text import strip
from pagemill.functions.urls import canonical


def is_worth_reading(media: Column, settings: Settings = DEFAULT) -> Column:
    """Whether a media element is visible and large enough."""
    return media["visible"] & (media["width"] >= settings.asset_width) & (media["height"] >= settings.asset_height)


def media_rows(pages: DataFrame, page: list[str], settings: Settings = DEFAULT) -> DataFrame:
    """The media of parsed pages (html.join_frames) that are worth reading, a row for each, as asset_manifest() takes them."""
    each = pages.select(*page, F.explode("media").alias("m"))
    return each.where(is_worth_reading(F.col("m"), settings)).select(*page, "m.frame_index", "m.index", "m.tag", "m.src", "m.alt", "m.width", "m.height")


def asset_key(src: Column, frame: Column, index: Column, width: Column, height: Column) -> Column:
    """What makes two media elements the same: the source without query and fragment; a canvas is known by its place and size."""
    canvas = F.concat(F.lit("canvas:"), frame.cast("string"), F.lit(":"), index.cast("string"), F.lit(":"), width.cast("string"), F.lit("x"), height.cast("string"))
    return F.when(F.coalesce(src, F.lit("")) != "", canonical(src)).otherwise(canvas)


def asset_manifest(media: DataFrame, page: str, settings: Settings = DEFAULT, captured: Column | None = None) -> DataFrame:
    """The assets of each page, with ``asset_no`` and ``file``: the first element of each key, the limit's first ones.

    media: page, frame_index, index, tag, src, alt, width, height. captured: whether an element could be captured;
    a key counts as seen even if its first element could not. Window limits keep a page of many elements cheap.
    """
    order = ["frame_index", "index"]
    key = asset_key(F.col("src"), F.col("frame_index"), F.col("index"), F.col("width"), F.col("height"))
    first = F.row_number().over(Window.partitionBy(page, "key_").orderBy(*order))
    kept = media.withColumn("key_", key).withColumn("nth_", first).where("nth_ = 1")
    if captured is not None:
        kept = kept.where(captured)
    numbered = kept.withColumn("asset_no", F.row_number().over(Window.partitionBy(page).orderBy(*order))).where(F.col("asset_no") <= settings.most_assets)
    name = F.concat(F.lit("asset_"), F.lpad(F.col("asset_no").cast("string"), 3, "0"), F.lit("_"), F.col("tag"), F.lit(".png"))
    return numbered.withColumn("file", name).drop("key_", "nth_")


def image_columns(path: Column) -> dict[str, Column]:
    """Of an image's path below a run: its product folder, its text file, and whether it is the product picture."""
    product = F.regexp_extract(path, r"^(.*?)/(?:assets/[^/]*|product\.png)$", 1)
    return {"product": product, "text_path": F.regexp_replace(path, r"\.[^./]*$", ".txt"), "is_product": path.endswith("product.png")}


def images_by_product(images: DataFrame) -> DataFrame:
    """``product``, ``images`` (assets by path, then the product picture) of images given by ``path``."""
    known = images.withColumns(image_columns(F.col("path")))
    ordered = F.sort_array(F.collect_list(F.struct("is_product", "path")))
    return known.groupBy("product").agg(F.transform(ordered, lambda s: s["path"]).alias("images"))


def pending_images(images: DataFrame, texts: DataFrame, use_cache: bool = True) -> DataFrame:
    """Images (path, mtime) without a text (path, mtime) that is as new as they are."""
    if not use_cache:
        return images
    fresh = texts.select(F.col("path").alias("path_"), F.col("mtime").alias("mtime_"))
    return images.join(fresh, (F.col("path") == F.col("path_")) & (F.col("mtime_") >= F.col("mtime")), "left_anti")


def joined_texts(text: Column, order: Column) -> Column:
    """Aggregate: the texts in order, stripped, without empty ones, with an empty line between them."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), strip(text).alias("t")))), lambda s: s["t"])
    return F.array_join(F.filter(parts, lambda t: t.isNotNull() & (t != "")), "\n\n")


def image_sections(text: Column, order: Column) -> Column:
    """Aggregate: the same, each under a heading with its number among the images that have a text."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), strip(text).alias("t")))), lambda s: s["t"])
    filled = F.filter(parts, lambda t: t.isNotNull() & (t != ""))
    return F.array_join(F.transform(filled, lambda t, i: F.concat(F.lit(config.IMAGE_HEADING), (i + 1).cast("string"), F.lit("\n\n"), t)), "\n\n")


def upscaled(width: Column, height: Column, settings: Settings = DEFAULT) -> Column:
    """The size (width, height) to which a narrow image is enlarged before recognition."""
    scale = F.least(settings.upscale_width / width, F.lit(settings.upscale_most))
    narrow = (width > 0) & (width < settings.upscale_width)
    grown = lambda x: F.when(narrow, F.bround(x * scale).cast("int")).otherwise(x.cast("int"))
    return F.struct(grown(width).alias("width"), grown(height).alias("height"))
