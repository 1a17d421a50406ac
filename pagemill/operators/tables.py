"""Tables of a page: Markdown, label-value pairs, and tables that were split into header and body.

A page's tables are one array of structs (table_index, frame_index, rows), rows being arrays of cells (text,
rowspan, colspan). Everything is a fold or a map over that array, so pages stay whole and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import config
from pagemill.functions.text import bound, strip, table_cell

CELL = "struct<text:string,rowspan:int,colspan:int>"
TABLE = f"struct<table_index:int,frame_index:int,rows:array<array<{CELL}>>>"
TABLES = f"array<{TABLE}>"


def _row_line(row: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(row, lambda c: table_cell(c["text"])), " | "), F.lit(" |"))


def table_markdown(table: Column) -> Column:
    """One table: heading, header row, a rule as wide as the header, the other rows as they are."""
    header = F.get(table["rows"], F.lit(0))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(header, lambda c: F.lit("---")), " | "), F.lit(" |"))
    heading = F.concat(F.lit("\n" + config.TABLE_HEADING), table["table_index"].cast("string"))
    body = F.transform(F.slice(table["rows"], 2, F.greatest(F.size(table["rows"]) - 1, F.lit(0))), _row_line)
    return F.array_join(F.concat(F.array(heading, _row_line(header), rule), body), "\n")


def tables_markdown(tables: Column) -> Column:
    """All tables that have rows; empty for none."""
    filled = F.filter(F.coalesce(tables, F.array().cast(TABLES)), lambda t: F.size(t["rows"]) > 0)
    return F.array_join(F.transform(filled, table_markdown), "\n")


def table_pairs(rows: Column) -> Column:
    """(label, value) pairs of a table, given its rows as arrays of texts.

    If all rows have two cells, each is a pair. Else, if the second row is as wide as the first, the first row
    has the labels and a label's value is what stands below it: distinct values in order, joined by `` / ``. Empty
    labels and values give no pair.
    """
    data = lambda r: F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0)))
    return bound(rows, lambda r: bound(data(r), lambda d: _pairs(r, d)))


def _pairs(rows: Column, data: Column) -> Column:
    pair = lambda label, value: F.struct(label.alias("label"), value.alias("value"))
    tall = F.transform(rows, lambda r: pair(strip(F.get(r, F.lit(0))), strip(F.get(r, F.lit(1)))))
    header = F.get(rows, F.lit(0))

    def below(label: Column, i: Column) -> Column:
        values = F.filter(F.transform(data, lambda r: strip(F.get(r, i))), lambda v: v.isNotNull() & (v != ""))
        return pair(strip(label), F.array_join(F.array_distinct(values), " / "))

    wide = F.transform(header, below)
    none = F.array().cast("array<struct<label:string,value:string>>")
    pairs = (
        F.when(F.size(rows) == 0, none)
        .when(F.forall(rows, lambda r: F.size(r) == 2), tall)
        .when((F.size(data) > 0) & (F.size(F.get(data, F.lit(0))) == F.size(header)), wide)
        .otherwise(none)
    )
    return F.filter(pairs, lambda p: (p["label"] != "") & (p["value"] != ""))


def merge_split_tables(tables: Column) -> Column:
    """Tables with those put together that a page shows as a header of one row beside a body of several.

    A one-row table followed, in its frame, by a table of several rows and the same width begins a merge. Further
    pairs of a one-row table and a table of as many rows as the first body, in the same frame, join it, whatever
    their width. Headers are strung together, bodies row by row. All tables are then numbered from 1.

    One fold over the positions: ``skip`` says how many tables the merge under way still covers, ``rows`` is how
    many rows its body has (0 outside a merge).
    """
    return bound(tables.cast(TABLES), _merged)


def _merged(tables: Column) -> Column:
    n = F.size(tables)
    empty = F.array().cast(TABLES)
    start = F.struct(empty.alias("out"), F.lit(0).alias("skip"), F.lit(0).alias("rows"))

    def step(s: Column, i: Column) -> Column:
        head, body = F.get(tables, i), F.get(tables, i + 1)
        last = F.get(s["out"], F.size(s["out"]) - 1)
        single = (i + 1 < n) & (F.size(head["rows"]) == 1) & (head["frame_index"] == body["frame_index"])
        begins = single & (F.size(body["rows"]) > 1) & (F.size(F.get(body["rows"], F.lit(0))) == F.size(F.get(head["rows"], F.lit(0))))
        joins = single & (s["rows"] > 0) & (head["frame_index"] == last["frame_index"]) & (F.size(body["rows"]) == s["rows"])
        pair = F.concat(head["rows"], body["rows"])
        longer = F.transform(last["rows"], lambda r, k: F.concat(r, F.get(pair, k)))
        table = lambda rows: F.struct(F.lit(0).alias("table_index"), head["frame_index"].alias("frame_index"), rows.alias("rows")).cast(TABLE)
        before = F.slice(s["out"], 1, F.greatest(F.size(s["out"]) - 1, F.lit(0)))
        state = lambda out, skip, rows: F.struct(out.alias("out"), skip.alias("skip"), rows.alias("rows"))
        return (
            F.when(s["skip"] > 0, state(s["out"], s["skip"] - 1, s["rows"]))
            .when(joins, state(F.concat(before, F.array(table(longer))), F.lit(1), s["rows"]))
            .when(begins, state(F.concat(s["out"], F.array(table(pair))), F.lit(1), F.size(body["rows"])))
            .otherwise(state(F.concat(s["out"], F.array(table(head["rows"]))), F.lit(0), F.lit(0)))
        )

    positions = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    merged = F.aggregate(positions, start, step, lambda s: s["out"])
    return F.transform(merged, lambda t, k: F.struct((k + 1).alias("table_index"), t["frame_index"].alias("frame_index"), t["rows"].alias("rows")).cast(TABLE))


def with_merged_tables(pages: DataFrame, tables: str = "tables") -> DataFrame:
    """pages with the column of tables merged; null stays null."""
    return pages.withColumn(tables, F.when(F.col(tables).isNotNull(), merge_split_tables(F.col(tables).cast(TABLES))))
