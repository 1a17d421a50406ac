"""The library from SQL: its expressions as functions, and the nodes and tables of pages as table functions.

    from pagemill import sql
    sql.register(spark)
    spark.sql("SELECT url_host(url), t.* FROM pages, LATERAL parse_tables(html) t WHERE NOT is_excluded_url(url)")
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pagemill import ship
from pagemill.functions import labels, responses, text, urls
from pagemill.operators.dom import NODE, SILENT, nodes_of

CELLS = "table_index int, row_number int, cell_number int, text string, rowspan int, colspan int"

#: name: parameters, type of the value, expression of the parameters
FUNCTIONS: dict[str, tuple[str, str, object]] = {
    "url_host": ("url STRING", "STRING", urls.host),
    "url_slug": ("url STRING", "STRING", urls.host_slug),
    "canonical_url": ("url STRING", "STRING", urls.canonical),
    "model_in_url": ("url STRING", "STRING", urls.model_in_url),
    "is_excluded_url": ("url STRING", "BOOLEAN", urls.is_excluded),
    "is_blocked_request": ("url STRING, resource STRING", "BOOLEAN", urls.is_blocked_request),
    "collapse_spaces": ("text STRING", "STRING", text.collapse),
    "strip_spaces": ("text STRING", "STRING", text.strip),
    "text_lines": ("text STRING", "ARRAY<STRING>", text.lines),
    "first_line": ("text STRING", "STRING", text.first_line),
    "page_snippet": ("text STRING", "STRING", text.snippet),
    "truncated_source": ("text STRING", "STRING", text.truncated),
    "is_blocked_page": ("title STRING, body STRING", "BOOLEAN", text.is_blocked),
    "unfolds_more": ("label STRING", "BOOLEAN", text.unfolds_more),
    "normal_label": ("label STRING", "STRING", text.normal_label),
    "label_category": ("label STRING", "STRING", labels.classify_label),
    "clean_title": ("title STRING, host STRING", "STRING", labels.clean_title),
    "label_values": ("text STRING", "ARRAY<STRUCT<label: STRING, value: STRING>>", labels.label_values),
    "model_answer": ("answer STRING", "STRUCT<product_name: STRING, variants: ARRAY<STRUCT<model: STRING, specs: ARRAY<STRING>>>>", responses.normal_response),
}


def expression_sql(column: Column) -> str:
    """The SQL text of an expression of unbound columns. Operators stand in it as functions, whose names need quotes."""
    parts = re.split(r"('(?:[^'\\]|\\.)*')", column._jc.node().sql())
    return "".join(p if k % 2 else re.sub(r"(?<![\w`])(<=>|==|<=|>=|!=|[=<>!+\-*/%&|^~])\(", r"`\1`(", p) for k, p in enumerate(parts))


class PageNodes:
    """Table function: the nodes of a page, numbered in the order in which they begin and end."""

    def eval(self, html: str | None) -> Iterator[tuple]:
        for at, last, parent, tag, attributes, own in nodes_of(html):
            yield at, last, parent, tag, None if attributes is None else dict(attributes), own


class ParseTables:
    """Table function: the cells of a page's tables, those of nested tables with the tables, rows and cells around them too."""

    def eval(self, html: str | None) -> Iterator[tuple]:
        yield from cells_of(html)


def cells_of(html: str | None) -> Iterator[tuple]:
    """(table, row, cell, text, rowspan, colspan), numbered from 1; rows without cells and tables without rows are left out."""
    nodes, until, heard = nodes_of(html), -1, []
    for n in nodes:
        if n[3] in SILENT:
            until = max(until, n[1])
        if n[0] > until:
            heard.append(n)
    named = {kind: [n for n in heard if n[3] in tags] for kind, tags in (("table", ("table",)), ("tr", ("tr",)), ("cell", ("td", "th")))}
    texts = [n for n in heard if n[5] is not None]
    starts = {kind: [n[0] for n in found] for kind, found in (*named.items(), ("text", texts))}

    def inside(node: list, kind: str, found: list) -> list:
        return found[bisect_left(starts[kind], node[0]) : bisect_left(starts[kind], node[1])]

    number = 0
    for table in named["table"]:
        rows = [cells for r in inside(table, "tr", named["tr"]) if (cells := inside(r, "cell", named["cell"]))]
        number += bool(rows)
        for r, cells in enumerate(rows, 1):
            for c, cell in enumerate(cells, 1):
                spans = dict(cell[4] or ())
                span = [int(m[1]) if (m := re.match(r"\s*([0-9]{1,9})", spans.get(k, ""))) else 1 for k in ("rowspan", "colspan")]
                yield number, r, c, " ".join("".join(t[5] for t in inside(cell, "text", texts)).split()), *span


def register(spark: SparkSession) -> list[str]:
    """Make FUNCTIONS, ``page_nodes(html)`` and ``parse_tables(html)`` known to a session; their names."""
    ship(spark)
    for name, (parameters, kind, made) in FUNCTIONS.items():
        arguments = [F.col(p.split()[0]) for p in parameters.split(", ")]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {expression_sql(made(*arguments))}")
    # plain rows, as an Arrow batch for each page costs more than its few rows; functions of whole batches (arrow_udtf) cannot stand behind LATERAL
    spark.udtf.register("page_nodes", F.udtf(PageNodes, returnType=NODE, useArrow=False))
    spark.udtf.register("parse_tables", F.udtf(ParseTables, returnType=CELLS, useArrow=False))
    return [*FUNCTIONS, "page_nodes", "parse_tables"]
