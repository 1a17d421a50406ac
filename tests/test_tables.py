import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import tables

TABLE = f"id long, tables {tables.TABLES}"


def made(frame, *rows):
    return {"table_index": 9, "frame_index": frame, "rows": [[{"text": c, "rowspan": 1, "colspan": 1} for c in r] for r in rows]}


def grid(prefix, height, width):
    return [[f"{prefix}{y}{x}" for x in range(width)] for y in range(height)]


def merged_plainly(given):
    out, i = [], 0
    while i < len(given):
        head, body = given[i], given[i + 1] if i + 1 < len(given) else None
        if body and len(head["rows"]) == 1 and head["frame_index"] == body["frame_index"] and len(body["rows"]) > 1 and len(body["rows"][0]) == len(head["rows"][0]):
            rows = head["rows"] + body["rows"]
            i += 2
            while i + 1 < len(given) and len(given[i]["rows"]) == 1 and given[i]["frame_index"] == given[i + 1]["frame_index"] == head["frame_index"] and len(given[i + 1]["rows"]) == len(body["rows"]):
                rows = [a + b for a, b in zip(rows, given[i]["rows"] + given[i + 1]["rows"], strict=True)]
                i += 2
            out.append((head["frame_index"], rows))
        else:
            out.append((head["frame_index"], head["rows"]))
            i += 1
    return [(k + 1, f, [[c["text"] for c in r] for r in rows]) for k, (f, rows) in enumerate(out)]


def merge(spark, cases):
    frame = tables.with_merged_tables(spark.createDataFrame(list(enumerate(cases)), TABLE)).orderBy("id")
    return [[(t["table_index"], t["frame_index"], [[c["text"] for c in r] for r in t["rows"]]) for t in row["tables"]] for row in frame.collect()]


def test_merge_cases(spark):
    whole = [made(0, *grid("h", 1, 2)), made(0, *grid("b", 3, 2)), made(0, *grid("i", 1, 1)), made(0, *grid("c", 3, 1))]
    other_width = [made(0, *grid("h", 1, 2)), made(0, *grid("b", 3, 3))]
    other_frame = [made(0, *grid("h", 1, 2)), made(1, *grid("b", 3, 2))]
    got = merge(spark, [whole, other_width, other_frame, []])
    assert len(got[0]) == 1 and len(got[0][0][2]) == 4 and all(len(r) == 3 for r in got[0][0][2])
    assert [len(g) for g in got[1:]] == [2, 2, 0]
    assert got == [merged_plainly(c) for c in (whole, other_width, other_frame, [])]


def test_merge_like_a_loop(spark):
    draw = random.Random(4)
    cases = [[made(draw.choice([0, 0, 0, 1]), *grid(f"t{k}", draw.choice([1, 1, 2, 3]), draw.choice([1, 2]))) for k in range(draw.randrange(9))] for _ in range(150)]
    assert merge(spark, cases) == [merged_plainly(c) for c in cases]


@pytest.mark.parametrize(
    "rows, pairs",
    [
        ([["a", "1"], ["b", "2"]], [("a", "1"), ("b", "2")]),
        ([["m", "s", "t"], ["1", "x", ""], ["2", "x", ""]], [("m", "1 / 2"), ("s", "x")]),
        ([["m", "s", "t"], ["1"]], []),
        ([["m", "s", "t"], ["1", "2", "3"], ["4"]], [("m", "1 / 4"), ("s", "2"), ("t", "3")]),
        ([[" a ", ""]], []),
        ([["x"]], []),
        ([], []),
    ],
)
def test_pairs(one, rows, pairs):
    column = F.array(*[F.array(*map(F.lit, r)) for r in rows]).cast("array<array<string>>")
    assert [tuple(p) for p in one(tables.table_pairs(column))] == pairs


def test_markdown(spark):
    frame = spark.createDataFrame([(1, [made(0, ["a|b", "c\nd"], ["x"]), made(0)]), (2, None)], TABLE)
    got = {r["id"]: r["m"] for r in frame.select("id", tables.tables_markdown(F.col("tables")).alias("m")).collect()}
    assert got == {1: "\n### 표 9\n| a\\|b | c d |\n| --- | --- |\n| x |", 2: ""}
