"""Reading raw HTML: text, tables, media, regions, Markdown, derived in Spark from the nodes of pages (dom.py).

What depends on a rendered page is approximated: scripts, styles, templates and comments have no text, block elements
begin a line, cells are kept apart by tabs, sizes come from attributes, and what lies in a hidden element is hidden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.config import DEFAULT, REGION_SELECTORS, Settings
from pagemill.operators.dom import page_nodes, page_parts
from pagemill.operators.tables import merge_split_tables

ADDED = ["title", "text", "tables", "media", "selector", "region_md"]


def region_selectors(pages: DataFrame, host: Column, selectors: dict[str, list[str]] | None = None) -> DataFrame:
    """pages with ``selectors_``: those of their host, from a small table of the settings; ``main`` elsewhere."""
    known = REGION_SELECTORS if selectors is None else selectors
    table = pages.sparkSession.createDataFrame(list(known.items()), "host_ string, selectors_ array<string>")
    looked_up = pages.withColumn("host_", host.cast("string")).join(F.broadcast(table), "host_", "left")
    return looked_up.withColumn("selectors_", F.coalesce("selectors_", F.array(F.lit("main")))).drop("host_")


def parse_pages(pages: DataFrame, html: str = "html", host: str | None = "host", settings: Settings = DEFAULT, selectors: dict[str, list[str]] | None = None) -> DataFrame:
    """pages without the column html, with title, text, tables, media, selector, region_md; same-named columns are replaced.

    host: the column by which the selectors are looked up (in selectors, or the settings' own); ``main`` elsewhere. A selector
    has one or more steps, such as ``#content > .detail table``. Null html reads as empty.
    """
    known = REGION_SELECTORS if selectors is None else selectors
    kept = [c for c in pages.columns if c != html and c.lower() not in ADDED]
    with_selectors = region_selectors(pages, F.col(host) if host else F.lit(""), known)
    nodes = page_nodes(with_selectors, html, [*kept, "selectors_"], settings)
    parts = page_parts(nodes, [*dict.fromkeys(s for found in known.values() for s in found), "main"], settings)
    return parts.select(*[F.col(f"row_.`{c}`").alias(c) for c in kept], *ADDED)


def read_page(html: str | None, selectors: list[str], settings: Settings = DEFAULT) -> dict:
    """parse_pages() of one page, to look at: title, text, tables, media, selector and region_md."""
    page = SparkSession.builder.getOrCreate().createDataFrame([(html, "")], "html string, host string")
    return parse_pages(page, settings=settings, selectors={"": selectors}).drop("host").first().asDict(True)


def join_frames(frames: DataFrame, page: list[str]) -> DataFrame:
    """Pages from their parsed frames (page columns, frame_index and what parse_pages adds); frame 0 is the main frame.

    Texts are joined in the order of frames, each under its label, with an empty line between; tables and media get
    their frame's index, tables are merged where split and numbered over all frames. title, selector and region
    are the main frame's. A frame that could not be read has no row; a page of few frames is one group.
    """
    one = F.struct("frame_index", with_frame_labels(F.col("text"), F.col("frame_index")).alias("text"), "tables", "media", "title", "selector", "region_md")
    grouped = frames.groupBy(*page).agg(F.sort_array(F.collect_list(one)).alias("f_"))
    main = F.get(F.filter("f_", lambda f: f["frame_index"] == 0), F.lit(0))
    own = lambda f: F.transform(f["tables"], lambda t: t.withField("frame_index", f["frame_index"]))
    media = lambda f: F.transform(f["media"], lambda m: m.withField("frame_index", f["frame_index"]))
    return grouped.select(
        *page,
        main["title"].alias("title"),
        F.array_join(F.transform("f_", lambda f: f["text"]), "\n\n").alias("text"),
        merge_split_tables(F.flatten(F.transform("f_", own))).alias("tables"),
        F.flatten(F.transform("f_", media)).alias("media"),
        main["selector"].alias("selector"),
        F.coalesce(main["region_md"], F.lit("")).alias("region_md"),
    )


def with_frame_labels(text, frame_index):
    """Text of a frame under its label; null for an empty one. Frame 0 is the main frame."""
    label = F.when(frame_index == 0, F.lit("[MAIN]")).otherwise(F.concat(F.lit("[IFRAME "), frame_index.cast("string"), F.lit("]")))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) != "", F.concat(label, F.lit("\n"), text))
