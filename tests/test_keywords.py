import random

import pytest
from pyspark.sql import functions as F

from pagemill import config
from pagemill.functions import labels, text
from pagemill.operators import keywords
from pagemill.sources import captures

DICTIONARY = [("b", 2, "ab"), ("a", 1, "bc"), ("c", 3, "c"), ("z", 0, "ab"), ("z", 5, "하나"), ("q", 9, None), (None, 1, "bcd"), ("e", 4, "aa")]
TEXTS = [None, "", "x", "xxabxx", "bcd", "c", "aaaa", "하나 둘", "ab" * 2000 + "bc", "BC"]


def table(spark, rows):
    return spark.createDataFrame(rows, "category string, position long, keyword string")


def plain(text, rows):
    best = {}
    for c, p, k in rows:
        if k is not None:
            best[k] = min(best.get(k, (p, c or "", c)), (p, c or "", c))
    found = sorted((p, key, c, k) for k, (p, key, c) in best.items() if text is not None and k in text)
    found = sorted(((p, key, k.encode(), c, k) for p, key, c, k in found))
    return (found[0][3], found[0][4]) if found else (None, None)


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_first_category(spark, most):
    docs = spark.createDataFrame([(k, t, "mine") for k, t in enumerate(TEXTS)], "k int, text string, `a.b` string").withColumn("Category", F.lit(1))
    got = keywords.first_category(docs, table(spark, DICTIONARY), most=most)
    assert got.columns == ["k", "text", "a.b", "category", "keyword"]
    for r in got.collect():
        assert (r["category"], r["keyword"]) == plain(TEXTS[r["k"]], DICTIONARY) and r["text"] == TEXTS[r["k"]] and r["a.b"] == "mine"
    assert keywords.first_category(docs, table(spark, [])).where("keyword IS NOT NULL").count() == 0
    everywhere = keywords.first_category(docs, table(spark, [("all", 7, ""), ("a", 8, "x")]), most=most).collect()
    assert [r["category"] for r in everywhere] == [None if t is None else "all" for t in TEXTS]
    assert keywords.first_category(docs.limit(0), table(spark, DICTIONARY)).count() == 0


@pytest.mark.parametrize("most", [1 << 20, 30])
def test_counts_against_plain_search(spark, most):
    draw = random.Random(2)
    words = list({"".join(draw.choice("abc") for _ in range(draw.randint(1, 4))) for _ in range(30)})
    texts = ["".join(draw.choice("abcd") for _ in range(draw.randint(0, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    for r in keywords.keyword_counts(docs, table(spark, [("x", 1, w) for w in words]), most=most).collect():
        expected = sorted((w, sum(texts[r["k"]].startswith(w, i) for i in range(len(texts[r["k"]])))) for w in words if w in texts[r["k"]])
        assert [tuple(x) for x in r["keywords"]] == expected


def test_labels_by_table_and_by_pattern(spark):
    given = ["모델명", "Model  No", "치 수", "Product Type", "colour", "", None, "P/N", "p.n", "SIZE (mm)", "specmodel", "Note"]
    frame = spark.createDataFrame([(x,) for x in given], "label string")
    frame = frame.withColumn("normal", text.normal_label(F.col("label"))).withColumn("by_pattern", labels.classify_label(F.col("label")))
    got = keywords.first_category(frame, keywords.label_keywords(spark), "normal").collect()
    assert [r["category"] for r in got] == [r["by_pattern"] for r in got] == ["model", "model", "규격", "model", None, None, None, "model", None, "규격", "model", None]


def test_domains_in_a_table(spark):
    urls = spark.createDataFrame([(k, u) for k, u in enumerate(["https://shop.Naver.com/a", "https://ok.com", None, "no url", "http://x.coupang.com:80/"])], "pos int, url string")
    domains = keywords.excluded_domains(spark)
    by_table, by_list = captures.capture_plan(urls, domains=domains), captures.capture_plan(urls, domains=config.EXCLUDED_DOMAINS)
    assert sorted(map(str, by_table.collect())) == sorted(map(str, by_list.collect())) and by_table.count() == 3
