"""Pages as a table of nodes, numbered so that what lies in an element is an interval.

Python only reads tags: it closes what HTML closes by itself, and numbers nodes in the order in which they begin (``at``) and
end (``last``). A node lies in an element if its number lies between the element's two. Everything else is derived in Spark:
text, tables with their rows and cells, media, the region that selectors point at, and its Markdown.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import ship
from pagemill.config import DEFAULT, Settings
from pagemill.functions.text import SPACE, bound, collapse, strip
from pagemill.operators.tables import TABLES

#: Pages that Python reads at once; Spark bounds the bytes of a batch.
PAGES_AT_ONCE = 200
#: Bytes of HTML, and of a page besides, that one task reads, and whose nodes one task sorts.
TASK_BYTES, PAGE_BYTES = 4 << 20, 256
PAGE = "#page"
SILENT = ["script", "style", "noscript", "template", "head", "title"]
BLOCKS = (
    "address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody tfoot thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta source track wbr".split())
MEDIA = "array<struct<index:int,tag:string,src:string,alt:string,width:int,height:int,visible:boolean>>"
#: Stands for the indent of preformatted lines until the rest is tidy: a character for private use.
INDENT = "\ue000" * 4
NODE = "at int, last int, parent int, tag string, attributes map<string,string>, text string"


class _Nodes(HTMLParser):
    """The nodes of one page as [at, last, parent, tag, attributes, text]; the first stands for the page itself."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.open: list[list] = []
        self.number = 0
        self._begin(PAGE, None)

    def _begin(self, tag: str | None, attributes: list | None, text: str | None = None) -> list:
        node = [self.number, self.number, self.open[-1][0] if self.open else min(self.number, 1) - 1, tag, attributes, text]
        self.number += 1
        self.nodes.append(node)
        return node

    def _end(self) -> str:
        node = self.open.pop()
        node[1] = self.number
        self.number += 1
        return node[3]

    def _end_open(self, tags: tuple[str, ...], around: tuple[str, ...]) -> None:
        """End the innermost open element of one of tags with all in it, but nothing beyond an element of around."""
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][3] in around:
                return
            if self.open[depth][3] in tags:
                while len(self.open) > depth:
                    self._end()
                return

    def handle_starttag(self, tag, attrs):
        if tag == "li":
            self._end_open(("li",), ("ul", "ol"))
        elif tag == "tr":
            self._end_open(("tr",), ("table",))
        elif tag in ("td", "th"):
            self._end_open(("td", "th"), ("table", "tr"))
            if next((n[3] for n in reversed(self.open) if n[3] in ("tr", "table")), None) == "table":
                self.open.append(self._begin("tr", None))  # a cell right in a table has a row of its own
        node = self._begin(tag, [(k, v or "") for k, v in dict(attrs).items()] or None)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        if tag not in VOID and any(n[3] == tag for n in self.open):
            while self._end() != tag:
                pass

    def handle_data(self, data):
        self._begin(None, None, data)

    def finish(self) -> list[list]:
        self.close()
        while self.open:
            self._end()
        self.nodes[0][1] = self.number
        return self.nodes


def nodes_of(html: str | None, open_references: bool = True) -> list[list]:
    """The nodes of a page. open_references: read ``&amp`` without its semicolon as browsers do; else it stays as it is."""
    page, html = _Nodes(), html or ""
    if open_references or not (opened := _open_references(html)):
        page.feed(html)
        return page.finish()
    mark = next(c for c in map(chr, range(0xF0000, 0xFFFFE)) if c not in html)  # stands for their ampersands while tags are read
    page.feed("".join(mark if k in opened else c for k, c in enumerate(html)))
    plain = lambda x: x and x.replace(mark, "&")
    return [[*n[:3], plain(n[3]), n[4] and [(plain(k), plain(v)) for k, v in n[4]], plain(n[5])] for n in page.finish()]


def _open_references(html: str) -> set[int]:
    """Where ampersands stand that begin no reference with a semicolon at its end."""
    found = re.finditer(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?", html)
    return {m.start() for m in found if not m[1] or m[1][0] != "#" and m[1] not in html5}


def page_nodes(pages: DataFrame, html: str = "html", others: list[str] | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """A row for each node of each page: ``page_`` (a number for the row of pages), the columns of NODE, and ``row_``, the other
    columns of pages (or those in others), in the first row of a page and null in its rest.

    tag is null for text. attributes is null for none, a value that is missing is empty. Null html is an empty page, of its
    first row alone. Pages, and then their nodes, are dealt to as many tasks as their bytes ask for, which are counted first.
    """
    ship(pages.sparkSession)
    others = [c for c in pages.columns if c != html] if others is None else others
    row = F.struct(*([F.col(f"`{c}`") for c in others] or [F.lit(0).alias("none_")]))
    tasks = _tasks_for(pages, html)
    slim = pages.repartition(tasks).select(F.monotonically_increasing_id().alias("page_"), row.alias("row_"), F.col(f"`{html}`").alias("html_"))
    added = T.StructType.fromDDL(NODE)
    open_references = settings.open_references
    schema = T.StructType([slim.schema["page_"], *added, T.StructField("row_", slim.schema["row_"].dataType)])

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = [f.type for f in to_arrow_schema(added)]
        for batch in batches:
            for begin in range(0, batch.num_rows, PAGES_AT_ONCE):
                b = batch.slice(begin, PAGES_AT_ONCE)
                found = [nodes_of(h, open_references) for h in b.column(2).to_pylist()]
                page = pa.array([k for k, nodes in enumerate(found) for _ in nodes], pa.int32())
                first = pa.array([k if n[0] == 0 else None for k, nodes in enumerate(found) for n in nodes], pa.int32())
                columns = [pa.array(c, kind) for c, kind in zip(zip(*(n for nodes in found for n in nodes)), kinds)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(page), *columns, b.column(1).take(first)], schema.fieldNames())

    # a number of its own, for by their written bytes Spark would put many nodes into one task
    return slim.mapInArrow(read, schema).repartition(tasks, "page_")


def _tasks_for(pages: DataFrame, html: str) -> int:
    load = pages.agg(F.sum(F.coalesce(F.octet_length(F.col(f"`{html}`")), F.lit(0)) + PAGE_BYTES)).first()[0]
    return max(math.ceil((load or 0) / TASK_BYTES), 1)


# What nodes mean


def attribute(name: str) -> Column:
    return F.col("attributes")[name]


def number(value: Column, default: int) -> Column:
    """The digits that a value begins with; default for none."""
    return F.coalesce(F.nullif(F.regexp_extract(value, r"^\s*([0-9]{1,9})", 1), F.lit("")).cast("int"), F.lit(default))


def style() -> Column:
    return F.lower(F.regexp_replace(F.coalesce(attribute("style"), F.lit("")), r"\s", ""))


def is_hidden() -> Column:
    """Whether an element says itself that it is not shown."""
    return attribute("hidden").isNotNull() | F.rlike(style(), F.lit(r"display:none|visibility:hidden|opacity:0(?:\.0*)?(?:;|$)"))


def is_large(width: int, height: int) -> Column:
    """Whether an element is at least so wide and high, by its style or attributes; an unknown size counts as large."""

    def fits(name: str, least: int) -> Column:
        styled = F.nullif(F.regexp_extract(style(), rf"(?:^|;){name}:([0-9]{{1,9}})(?:\.[0-9]+)?px", 1), F.lit("")).cast("int")
        return F.coalesce(styled, number(attribute(name), least)) >= least

    return fits("width", width) & fits("height", height)


def selector_steps(selector: str) -> list[tuple[str, str]]:
    """The steps of a selector with what stands before each: ``' '`` for anywhere in, ``'>'`` for right in."""
    parts, steps, before = re.findall(r"\[[^\]]*\]|>|\s+|[^\s>\[]+", selector.strip()), [], " "
    for part in parts:
        if part == ">":
            before = ">"
        elif part.isspace():
            before = before if before == ">" else " "
            steps.append(("", ""))  # a compound ends here
        elif steps and steps[-1] != ("", "") and before == " ":
            steps[-1] = (steps[-1][0], steps[-1][1] + part)
        else:
            steps.append((before, part))
            before = " "
    return [s for s in steps if s[1]]


def compound_matches(compound: str) -> Column:
    """Whether a node is one that a compound of tag, ``#id``, ``.class`` and ``[name='value']`` names."""
    found = F.lit(True)
    for part in re.findall(r"\[[^\]]*\]|[#.]?[^#.\[]+", compound):
        if part[0] == "#":
            one = attribute("id") == part[1:]
        elif part[0] == ".":
            one = F.array_contains(F.split(attribute("class"), r"\s+"), part[1:])
        elif part[0] == "[":
            name, _, value = part[1:-1].partition("=")
            one = attribute(name) == value.strip("'\"") if value else attribute(name).isNotNull()
        else:
            one = F.lit(True) if part == "*" else F.col("tag") == part.lower()
        found &= F.coalesce(one, F.lit(False))
    return found


def first_match(candidates: Column, steps: list[tuple[str, int]]) -> Column:
    """The first of the candidates (sorted by ``at``, with the numbers of the compounds they match) at the end of the steps."""

    def narrowed(outer: Column, k: int) -> Column:
        if k == len(steps):
            return F.get(outer, F.lit(0))
        before, compound = steps[k]
        lies = (lambda a, c: a["at"] == c["parent"]) if before == ">" else (lambda a, c: (a["at"] < c["at"]) & (c["at"] < a["last"]))
        inner = F.filter(candidates, lambda c: F.array_contains(c["compounds"], compound) & F.exists(outer, lambda a: lies(a, c)))
        return bound(inner, lambda x: narrowed(x, k + 1))

    return bound(F.filter(candidates, lambda c: F.array_contains(c["compounds"], steps[0][1])), lambda x: narrowed(x, 1))


def _is_tag(tags: list[str]) -> Column:
    return F.expr("tag IN ('" + "', '".join(tags) + "')")


def _within(condition: Column, running) -> Column:
    """Whether an event lies in an element of the condition (that element's own events too): one that began and hasn't ended."""
    return F.coalesce(F.max(F.when(condition & ~F.col("ends"), F.col("last"))).over(running) >= F.col("at"), F.lit(False))


def page_parts(nodes: DataFrame, selectors: list[str], settings: Settings = DEFAULT) -> DataFrame:
    """From page_nodes: for each page row_, title, text, tables, media, selector and region_md.

    selectors: all that occur in the pages' own lists, ``row_.selectors_``, of which the first counts whose first element is
    shown and large enough. Nodes are dealt out by page and sorted once; what lies in an element are the nodes counted between its
    start and its end, so tables, rows and cells are slices of the page's rows, cells and texts.
    A page is one group; nothing else is gathered.
    """
    compounds = sorted({c for s in selectors for _, c in selector_steps(s)})
    steps = {s: [(before, compounds.index(c)) for before, c in selector_steps(s)] for s in dict.fromkeys(selectors)}
    tag = F.col("tag")
    has_end = _is_tag([*(b for b in BLOCKS if b not in VOID), "td", "th", "b", "strong", "i", "em", "code"])
    both = F.when(has_end, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    events = nodes.select("*", F.explode(both).alias("ends")).withColumn("begins", F.col("at")).withColumn("at", F.when(F.col("ends"), F.col("last")).otherwise(F.col("at")))

    by_page = Window.partitionBy("page_").orderBy("at")
    running = by_page.rowsBetween(Window.unboundedPreceding, 0)
    starts, lists = ~F.col("ends"), tag.isin("ul", "ol")
    events = events.withColumns({
        "silent": _within(_is_tag(SILENT), running),
        "titled": _within(tag == "title", running),
        "shown": ~_within(F.col("attributes").isNotNull() & is_hidden(), running),
        "preformatted": _within(tag == "pre", running),
        "level": F.sum(F.when(lists, F.when(starts, 1).otherwise(-1)).otherwise(0)).over(running),
        "quotes": F.sum(F.when(tag == "blockquote", F.when(starts, 1).otherwise(-1)).otherwise(0)).over(running),
    })
    # a list is the last one that began at its level; its items are counted from there
    at_level = Window.partitionBy("page_", "level").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("items", F.count(F.when((tag == "li") & starts, 1)).over(at_level))
    events = events.withColumns({
        "before": F.coalesce(F.last(F.when(lists & starts, F.col("items")), True).over(at_level), F.lit(0)),
        "list": F.last(F.when(lists & starts, tag), True).over(at_level),
    })
    heard = ~F.col("silent")
    is_text, is_cell, is_row = F.col("text").isNotNull(), tag.isin("td", "th"), tag == "tr"
    counted = lambda c: F.count(F.when(heard & c & starts, 1)).over(running)
    events = events.withColumns({"texts": counted(is_text), "cells": counted(is_cell), "rows": counted(is_row)})

    flat = F.when(F.col("preformatted"), F.col("text")).otherwise(F.regexp_replace("text", f"{SPACE}+", " "))
    block = _is_tag(BLOCKS)
    text = F.when(is_text, flat).when(block | ((tag == "br") & starts), "\n").when(is_cell & starts, "\t")
    line = F.when(block | (tag == "br"), F.when(tag.isin("br", "tr") | (tag == "li") & F.col("ends"), "\n").otherwise("\n\n"))
    item = F.concat(F.repeat(F.lit("  "), F.greatest(F.col("level"), F.lit(1)).cast("int")), F.when(F.col("list") == "ol", F.concat((F.col("items") - F.col("before")).cast("string"), F.lit(". "))).otherwise("* "))
    mark = (
        F.when(tag.isin("b", "strong"), "**").when(tag.isin("i", "em"), "_").when((tag == "code") & ~F.col("preformatted"), "`").when(tag == "hr", "* * *\n\n")
        .when(starts & is_row, "|").when(starts & (tag == "li"), item).when(starts & F.rlike(tag, F.lit("^h[1-6]$")), F.concat(F.repeat(F.lit("#"), F.substring(tag, 2, 1).try_cast("int")), F.lit(" ")))
        .when(F.col("ends") & is_cell, " |").when(starts & (tag == "pre"), INDENT)
    )
    empty = F.lit("")
    own = F.when(F.col("preformatted"), F.replace("text", F.lit("\n"), F.lit("\n" + INDENT))).otherwise(flat)
    markdown = F.when(is_text, own).when(starts, F.concat(F.coalesce(line, empty), F.coalesce(mark, empty))).otherwise(F.concat(F.coalesce(mark, empty), F.coalesce(line, empty)))
    markdown = F.when(F.col("quotes") > 0, F.regexp_replace(markdown, F.lit("\n"), F.concat(F.lit("\n"), F.repeat(F.lit("> "), F.col("quotes").cast("int"))))).otherwise(markdown)
    found = F.filter(F.array(*[F.when(compound_matches(c), F.lit(k)) for k, c in enumerate(compounds)]), lambda k: k.isNotNull()) if compounds else F.array().cast("array<int>")
    candidate = F.struct("at", "last", "parent", found.alias("compounds"), (F.col("shown") & is_large(settings.region_width, settings.region_height)).alias("fits"))
    medium = F.struct(
        "at", "tag", F.when(tag == "img", F.coalesce(attribute("src"), empty)).otherwise(empty).alias("src"), F.coalesce(attribute("alt"), empty).alias("alt"),
        number(attribute("width"), 0).alias("width"), number(attribute("height"), 0).alias("height"), F.col("shown").alias("visible"),
    )

    def gathered(condition: Column, value: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(condition, value)))

    pair = lambda n: F.struct("begins", F.col(n).alias("n"))
    cell = F.struct("begins", F.col("texts").alias("n"), number(attribute("rowspan"), 1).alias("rowspan"), number(attribute("colspan"), 1).alias("colspan"))
    ends, is_table = F.col("ends"), tag == "table"
    pages = events.groupBy("page_").agg(
        F.first("row_", True).alias("row_"),
        gathered(is_text & F.col("titled"), F.struct("at", collapse(F.col("text")).alias("text"))).alias("titles"),
        gathered(heard & (text.isNotNull() | (markdown != "")), F.struct("at", F.coalesce(text, empty).alias("text"), markdown.alias("markdown"), is_text.alias("is_text"))).alias("pieces"),
        gathered(heard & is_cell & starts, cell).alias("cell_starts"), gathered(heard & is_cell & ends, pair("texts")).alias("cell_ends"),
        gathered(heard & is_row & starts, pair("cells")).alias("row_starts"), gathered(heard & is_row & ends, pair("cells")).alias("row_ends"),
        gathered(heard & is_table & starts, pair("rows")).alias("table_starts"), gathered(heard & is_table & ends, pair("rows")).alias("table_ends"),
        gathered(heard & tag.isin("img", "canvas"), medium).alias("media"),
        gathered(heard & starts & tag.isNotNull() & ~_is_tag(sorted(VOID)) & (F.size(found) > 0), candidate).alias("candidates"),
    )

    part = lambda of, a, b: F.slice(of, a["n"].cast("int") + 1, (b["n"] - a["n"]).cast("int"))  # noqa: E731  what lies between a start and its end
    texts = F.transform(F.filter("pieces", lambda p: p["is_text"]), lambda p: p["text"])
    cells = bound(texts, lambda t: F.transform("cell_starts", lambda c, i: F.struct(collapse(F.array_join(part(t, c, F.get("cell_ends", i)), "")).alias("text"), c["rowspan"].alias("rowspan"), c["colspan"].alias("colspan"))))
    rows = bound(cells, lambda x: F.transform("row_starts", lambda r, i: part(x, r, F.get("row_ends", i))))
    tables = bound(rows, lambda x: F.transform("table_starts", lambda t, i: F.filter(part(x, t, F.get("table_ends", i)), lambda r: F.size(r) > 0)))
    tables = F.transform(F.filter(tables, lambda rows: F.size(rows) > 0), lambda rows, i: F.struct((i + 1).alias("table_index"), F.lit(0).alias("frame_index"), rows.alias("rows")))

    options = F.array(*[F.struct(F.lit(s).alias("selector"), first_match(F.col("candidates"), steps[s]).alias("node")) for s in steps])
    wanted = lambda o: F.filter(F.transform("row_.selectors_", lambda s: F.get(F.filter(o, lambda x: x["selector"] == s), F.lit(0))), lambda x: x["node"]["fits"])
    pages = pages.withColumn("region", bound(options, lambda o: F.get(wanted(o), F.lit(0))) if steps else F.lit(None))
    region = F.col("region")["node"]
    inside = F.filter("pieces", lambda p: (p["at"] >= region["at"]) & (p["at"] <= region["last"]))
    joined = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    return pages.select(
        "row_",
        F.coalesce(F.get(F.filter(F.transform("titles", lambda t: t["text"]), lambda t: t != ""), F.lit(0)), empty).alias("title"),
        strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(joined, r" *\t *", "\t"), r"[ \t]*\n[ \t\n]*", "\n"), " {2,}", " ")).alias("text"),
        tables.cast(TABLES).alias("tables"),
        F.transform("media", lambda m, i: F.struct(i.alias("index"), *[m[c].alias(c) for c in ("tag", "src", "alt", "width", "height", "visible")])).cast(MEDIA).alias("media"),
        F.col("region")["selector"].alias("selector"),
        F.when(region.isNotNull(), tidy(F.array_join(F.transform(inside, lambda p: p["markdown"]), ""))).otherwise("").alias("region_md"),
    )


def tidy(markdown: Column) -> Column:
    """Without indents before running text, spaces at the ends of lines, and more than one empty line, in quotes too."""
    plain = F.regexp_replace(markdown, r"(?<=\n)[ ]+(?=[^ *\d])", "")
    lines = F.regexp_replace(F.regexp_replace(plain, rf"{INDENT[0]}+(?=\n|$)", ""), r" *\n *(?=\n|$)", "\n")
    quoted = F.regexp_replace(lines, r"(?<=\n|^)(?:> ?)+(?=\n|$)", ">")
    for pattern, to in ((r"\n{3,}", "\n\n"), (r"(?:(?<=\n\n)|^)(?:>\n)+", ""), (r"(?:\n>){2,}(?=\n)", "\n>"), (r"(?:\n>)+(?=\n\n|\n?$)", "")):
        quoted = F.regexp_replace(quoted, pattern, to)
    return F.replace(strip(quoted), F.lit(INDENT[0]), F.lit(" "))
