import random

import pytest
from pyspark.sql import functions as F

from pagemill.llm import url_filter


def judged(host, path, rules):
    fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, "allow")


def test_parts(spark):
    urls = ["http://A.Example.COM/en/x?y#z", "x://h", "no scheme", None, "", "a://b://c/d", "https://ÄB.com?q/x", "s://h/p\nq#f", "://"]
    frame = spark.createDataFrame([(u,) for u in urls], "url string").select(*url_filter.url_parts(F.col("url")))
    assert [tuple(r) for r in frame.collect()] == [("a.example.com", "/en/x"), ("h", ""), ("", ""), ("", ""), ("", ""), ("b:", "//c/d"), ("Äb.com", ""), ("h", "/p\nq"), ("", "")]


@pytest.mark.parametrize("bound", [url_filter.BROADCAST_RULES, 0])
def test_like_a_loop(spark, monkeypatch, bound):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", bound)
    draw = random.Random(8)
    rules = list(dict.fromkeys((".".join(draw.choices("abc", k=draw.randrange(1, 4))), draw.choice(["", "/", "/x/", "/x/y", "/xy", "/x/y/"])) for _ in range(25)))
    rules = [(h, p, draw.choice(["allow", "block"])) for h, p in rules]
    rows = [(k, ".".join(draw.choices("abc", k=draw.randrange(6))), draw.choice(["", "/", "/x", "/x/", "/xyz", "/x/y", "/x/yz/", "/x/y/z"])) for k in range(600)]
    rows += [(None, "a.b", "/x/"), (7, None, None), rows[0], rows[0], (8, "." * 300, "/" * 300)]
    rows += [(1000 + k, "a.b.c", "/x/y/z") for k in range(500)]  # one URL fills half of the table
    frame = spark.createDataFrame(rows, "page_id long, host string, path string").withColumn("rule_host", F.lit("clash")).withColumns({c: F.lit("mine") for c in ("row_", "url_", "copies_", "digest_", "short")})
    table = spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, action string")
    got = url_filter.judge_urls(frame, table).collect()
    want = sorted((str(i), h or "", p or "", *map(str, judged(h or "", p or "", rules))) for i, h, p in rows)
    assert sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in got) == want
    assert {r["digest_"] for r in got} == {r["url_"] for r in got} == {"mine"}
    assert url_filter.judge_urls(frame.limit(0), table).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(frame, table.limit(0), "block").collect()} == {"block"}
