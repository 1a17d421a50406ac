"""Word boxes of recognised images: tiles, filtering, overlap, rows and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.config import DEFAULT, Settings
from pagemill.functions.text import bound, strip

WORD = "struct<text:string,conf:double,x1:double,x2:double,y1:double,y2:double,xc:double,yc:double,h:double,w:double>"
WORDS = f"array<{WORD}>"


def tiles(height: Column, settings: Settings = DEFAULT) -> Column:
    """Strips (y0, y1) that cover an image of this height and overlap; none for height 0."""
    step = settings.tile_height - settings.tile_overlap
    count = F.greatest(F.ceil((height - settings.tile_height) / step), F.lit(0)).cast("int")
    strip_ = lambda i: F.struct((i * step).alias("y0"), F.least(i * step + settings.tile_height, height.cast("int")).alias("y1"))
    return F.when(height > 0, F.transform(F.sequence(F.lit(0), count), strip_)).otherwise(F.array().cast("array<struct<y0:int,y1:int>>"))


def box(text: Column, conf: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A word box with its centre and size."""
    return F.struct(
        text.alias("text"), conf.cast("double").alias("conf"), x1.cast("double").alias("x1"), x2.cast("double").alias("x2"),
        y1.cast("double").alias("y1"), y2.cast("double").alias("y2"), ((x1 + x2) / 2).cast("double").alias("xc"), ((y1 + y2) / 2).cast("double").alias("yc"),
        (y2 - y1).cast("double").alias("h"), (x2 - x1).cast("double").alias("w"),
    )


def words_of_result(polygons: Column, texts: Column, scores: Column, y_offset: Column, settings: Settings = DEFAULT) -> Column:
    """Word boxes of one tile: polygons, texts and scores side by side (the shortest counts), moved down by y_offset.

    Blank texts and scores below the limit are left out.
    """
    n = F.least(F.size(polygons), F.size(texts), F.size(scores))
    zipped = F.slice(F.arrays_zip(polygons.alias("p"), texts.alias("t"), scores.alias("s")), 1, F.greatest(n, F.lit(0)))
    good = F.filter(zipped, lambda z: (strip(z["t"]) != "") & (z["s"] >= settings.least_confidence))

    def made(z: Column) -> Column:
        x, y = F.transform(z["p"], lambda q: F.get(q, F.lit(0))), F.transform(z["p"], lambda q: F.get(q, F.lit(1)))
        return box(z["t"], z["s"], F.array_min(x), F.array_min(y) + y_offset, F.array_max(x), F.array_max(y) + y_offset)

    return F.transform(good, made)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0 without an intersection."""
    across = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    down = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    inter = F.greatest(across, F.lit(0.0)) * F.greatest(down, F.lit(0.0))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return F.when(inter > 0, inter / (area(a) + area(b) - inter)).otherwise(F.lit(0.0))


def by_order(words: Column, *keys) -> Column:
    """words sorted by the keys, stable."""
    ranked = F.transform(words, lambda w, i: F.struct(*[k(w).alias(f"k{n}") for n, k in enumerate(keys)], i.alias("i"), w.alias("word")))
    return F.transform(F.array_sort(ranked), lambda r: r["word"])


def suppress_overlaps(words: Column, settings: Settings = DEFAULT) -> Column:
    """From the surest word on, words that overlap no word kept before by more than the limit; in that order."""

    def step(kept: Column, w: Column) -> Column:
        return F.when(F.exists(kept, lambda k: iou(k, w) > settings.overlap_limit), kept).otherwise(F.concat(kept, F.array(w)))

    return F.aggregate(by_order(words, lambda w: -w["conf"]), F.array().cast(WORDS), step)


def group_rows(words: Column, settings: Settings = DEFAULT) -> Column:
    """Rows of words from top to bottom, each from left to right.

    A word joins the row under way if its centre is no further from the mean centre of the row than the tolerance,
    a share of the mean word height, 4 at least.
    """
    return bound(words, lambda w: bound(_tolerance(w, settings), lambda t: _rows(w, t)))


def _tolerance(words: Column, settings: Settings) -> Column:
    mean_height = F.aggregate(words, F.lit(0.0), lambda a, w: a + w["h"]) / F.greatest(F.size(words), F.lit(1))
    return F.greatest(mean_height * settings.row_tolerance, F.lit(4.0))


def _rows(words: Column, tolerance: Column) -> Column:
    start = F.struct(F.array().cast(f"array<{WORDS}>").alias("rows"), F.array().cast(WORDS).alias("row"), F.lit(0.0).alias("sum"))

    def step(s: Column, w: Column) -> Column:
        fits = (F.size(s["row"]) == 0) | (F.abs(w["yc"] - s["sum"] / F.greatest(F.size(s["row"]), F.lit(1))) <= tolerance)
        return F.when(fits, F.struct(s["rows"].alias("rows"), F.concat(s["row"], F.array(w)).alias("row"), (s["sum"] + w["yc"]).alias("sum"))).otherwise(
            F.struct(F.concat(s["rows"], F.array(s["row"])).alias("rows"), F.array(w).alias("row"), w["yc"].alias("sum"))
        )

    folded = F.aggregate(by_order(words, lambda w: w["yc"]), start, step, lambda s: F.when(F.size(s["row"]) > 0, F.concat(s["rows"], F.array(s["row"]))).otherwise(s["rows"]))
    return F.when(F.size(words) > 0, F.transform(folded, lambda r: by_order(r, lambda w: w["xc"]))).otherwise(F.array().cast(f"array<{WORDS}>"))


def row_line(row: Column, settings: Settings = DEFAULT) -> Column:
    """The words of a row as one line: a tab where the gap is wide for the letters before it, else a space."""

    def joined(w: Column, i: Column) -> Column:
        before = F.get(row, i - 1)
        letter = before["w"] / F.greatest(F.length(before["text"]), F.lit(1))
        gap = F.when(w["x1"] - before["x2"] > letter * settings.column_gap, F.lit("\t")).otherwise(F.lit(" "))
        return F.when(i == 0, w["text"]).otherwise(F.concat(gap, w["text"]))

    return F.array_join(F.transform(row, joined), "")


def recognised_text(words: Column, spacing=None, settings: Settings = DEFAULT) -> Column:
    """The text of an image from its word boxes: overlaps removed, rows formed, columns kept apart by tabs.

    spacing: a function of a line's column that corrects its spacing; none by default.
    """
    rows = group_rows(suppress_overlaps(words, settings), settings)
    return F.array_join(F.transform(rows, lambda r: (spacing or (lambda x: x))(row_line(r, settings))), "\n")


def overlapping_pairs(words: DataFrame, image: list[str], order: str, settings: Settings = DEFAULT) -> DataFrame:
    """Pairs of boxes of one image that overlap by more than the limit: the image columns, ``a``, ``b`` (order values), ``iou``.

    Boxes are dealt to the cells of a coarse grid that they touch, so only boxes that share a cell meet; a pair is
    reported in the first cell that both touch. An image with very many boxes is thus spread over its cells.
    """
    cell = 256
    touched = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    dealt = words.withColumn("cx_", F.explode(touched("x1", "x2"))).withColumn("cy_", F.explode(touched("y1", "y2")))
    kept = ["x1", "x2", "y1", "y2"]
    left = dealt.select(*image, "cx_", "cy_", F.struct(order, *kept).alias("l"))
    right = dealt.select(*image, "cx_", "cy_", F.struct(order, *kept).alias("r"))
    met = left.join(right, [*image, "cx_", "cy_"]).where(F.col(f"l.{order}") < F.col(f"r.{order}"))
    first = lambda c, lo: F.col(c) == F.floor(F.greatest(F.col(f"l.{lo}"), F.col(f"r.{lo}")) / cell)
    met = met.where(first("cx_", "x1") & first("cy_", "y1")).withColumn("iou", iou(F.col("l"), F.col("r")))
    return met.where(F.col("iou") > settings.overlap_limit).select(*image, F.col(f"l.{order}").alias("a"), F.col(f"r.{order}").alias("b"), "iou")


def lines_of_rows(words: DataFrame, image: list[str], row: str, settings: Settings = DEFAULT) -> DataFrame:
    """One line for each row of words given as records (image columns, row, text, x1, x2, xc, ord): ``line``."""
    window = Window.partitionBy(*image, row).orderBy("xc", "ord")
    before, letters = F.lag("x2").over(window), F.lag((F.col("x2") - F.col("x1")) / F.greatest(F.length("text"), F.lit(1))).over(window)
    gap = F.when(before.isNull(), F.lit("")).when(F.col("x1") - before > letters * settings.column_gap, F.lit("\t")).otherwise(F.lit(" "))
    # words of one place keep the order in which their gaps were found
    marked = words.withColumns({"at_": F.row_number().over(window), "part_": F.concat(gap, F.col("text"))})
    parts = F.sort_array(F.collect_list(F.struct("at_", "part_")))
    return marked.groupBy(*image, row).agg(F.array_join(F.transform(parts, lambda p: p["part_"]), "").alias("line"))
