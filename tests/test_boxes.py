import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import boxes

SCHEMA = "id long, words array<struct<text:string,conf:double,x1:double,y1:double,x2:double,y2:double>>"
EXAMPLE = [("a", 0.90, 0, 0, 10, 10), ("b", 0.80, 1, 0, 10, 10), ("c", 0.70, 40, 0, 50, 10), ("d", 0.95, 0, 30, 10, 40), ("e", 0.90, 2, 6, 12, 16)]


def frame(spark, cases):
    raw = spark.createDataFrame([(i, [(t, *map(float, r)) for t, *r in words]) for i, words in enumerate(cases)], SCHEMA)
    return raw.select("id", F.transform("words", lambda w: boxes.box(w["text"], w["conf"], w["x1"], w["y1"], w["x2"], w["y2"])).alias("words")).orderBy("id")


def plain_iou(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    inter = max(w, 0) * max(h, 0)
    return inter / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - inter) if inter > 0 else 0.0


def plain_text(words):
    kept = []
    for w in sorted(words, key=lambda w: -w[1]):
        if not any(plain_iou(k, w) > 0.5 for k in kept):
            kept.append(w)
    if not kept:
        return ""
    tolerance = max(sum(w[5] - w[3] for w in kept) / len(kept) * 0.6, 4.0)
    rows = []
    centre = lambda w: (w[3] + w[5]) / 2
    for w in sorted(kept, key=centre):
        if rows and abs(centre(w) - sum(map(centre, rows[-1])) / len(rows[-1])) <= tolerance:
            rows[-1].append(w)
        else:
            rows.append([w])
    lines = []
    for row in rows:
        row.sort(key=lambda w: (w[2] + w[4]) / 2)
        line = row[0][0]
        for before, w in zip(row, row[1:]):
            line += ("\t" if w[2] - before[4] > (before[4] - before[2]) / max(len(before[0]), 1) * 2.5 else " ") + w[0]
        lines.append(line)
    return "\n".join(lines)


def test_example(spark):
    row = frame(spark, [EXAMPLE]).select(F.transform(boxes.suppress_overlaps(F.col("words")), lambda w: w["text"]).alias("kept"), boxes.recognised_text(F.col("words")).alias("t")).first()
    assert row["kept"] == ["d", "a", "e", "c"] and row["t"] == "a e\tc\nd"


def test_like_a_loop(spark):
    draw = random.Random(5)
    cases = []
    for _ in range(120):
        words = []
        for k in range(draw.randrange(12)):
            x, y = draw.randrange(80), draw.randrange(40)
            words.append(("w" * draw.randrange(1, 4) + str(k), draw.randrange(1, 10) / 10, x, y, x + draw.randrange(1, 30), y + draw.randrange(1, 20)))
        cases.append(words)
    got = [r["t"] for r in frame(spark, cases).select("id", boxes.recognised_text(F.col("words")).alias("t")).collect()]
    assert got == [plain_text(c) for c in cases]


@pytest.mark.parametrize("height, strips", [(0, []), (1200, [(0, 1200)]), (1201, [(0, 1200), (1100, 1201)]), (2300, [(0, 1200), (1100, 2300)]), (2301, [(0, 1200), (1100, 2300), (2200, 2301)])])
def test_tiles(one, height, strips):
    assert [tuple(t) for t in one(boxes.tiles(F.lit(height)))] == strips


def test_words_of_result(spark):
    raw = spark.createDataFrame(
        [([[[0.0, 0.0], [4.0, 1.0], [4.0, 3.0], [0.0, 2.0]], [[0.0, 0.0]], [[1.0, 1.0]]], ["ok", " "], [0.3, 0.9, 0.9])], "p array<array<array<double>>>, t array<string>, s array<double>"
    )
    got = raw.select(boxes.words_of_result(F.col("p"), F.col("t"), F.col("s"), F.lit(1100)).alias("w")).first()["w"]
    assert [(w["text"], w["x1"], w["y1"], w["x2"], w["y2"], w["yc"]) for w in got] == [("ok", 0.0, 1100.0, 4.0, 1103.0, 1101.5)]


def test_overlapping_pairs_across_cells(spark):
    draw = random.Random(6)
    words = [(1, k, float(x), float(x + 90), float(y), float(y + 40)) for k, (x, y) in enumerate((draw.randrange(700), draw.randrange(700)) for _ in range(150))]
    got = boxes.overlapping_pairs(spark.createDataFrame(words, "img long, k long, x1 double, x2 double, y1 double, y2 double"), ["img"], "k").collect()
    box = lambda w: (None, None, w[2], w[4], w[3], w[5])
    want = {(a[1], b[1]) for i, a in enumerate(words) for b in words[i + 1 :] if plain_iou(box(a), box(b)) > 0.5}
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want and want


def test_equal_words_of_a_row(spark):
    """Words equal in all that orders them stand one after the other, the first without a gap."""
    word = ("i", 0, 7, "w1", 10.0, 30.0, 20.0)
    words = spark.createDataFrame([word, word, ("i", 0, 9, "w2", 90.0, 99.0, 94.5)], "image string, row int, ord long, text string, x1 double, x2 double, xc double")
    assert [r["line"] for r in boxes.lines_of_rows(words, ["image"], "row").collect()] == ["w1 w1\tw2"]
