import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pagemill.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def plain(text, items):
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        b = words(t)
        for k in range(max(1, len(b) - 12)) if b else ():
            x = b[k : k + 13]
            for p in range(len(w) - len(x) + 1):
                if w[p : p + len(x)] == x:
                    hit.update(range(p, p + len(x)))
                    ids |= {i} - {None}
    listed = ",".join(sorted(map(str, ids)))
    return len(w), len(hit), len(ids), hashlib.sha256(listed.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.fixture
def bench():
    draw = random.Random(12)
    items = [(k, " ".join(f"{draw.choice(['the', 'of', 'Rare', 'É'])}{draw.randrange(6)}" for _ in range(draw.choice([3, 13, 20, 40])))) for k in range(12)]
    return [*items, (20, None), (21, ""), (22, "..."), (2, items[2][1]), (None, items[4][1]), (10, "solo"), (9, "Ünï, çödé!")]


def test_like_a_search(spark, documents, odd, bench, monkeypatch):
    draw = random.Random(13)
    texts = list(odd)
    for _ in range(60):
        filler = lambda: " ".join(f"{draw.choice(['the', 'of', 'x'])}{draw.randrange(6)}" for _ in range(draw.randrange(60)))
        quote = (draw.choice(bench)[1] or "").split()
        a = draw.randrange(len(quote) + 1)
        texts.append(filler() + " " + draw.choice([", ", "; "]).join(quote[a : a + draw.randrange(30)]).upper() + " " + filler())
    texts += ["solo", "SOLO-solo", bench[0][1], bench[3][1] + " " + bench[3][1]]
    docs = documents(*texts).withColumns({"n_hit": F.lit("clash"), "window": F.lit(1)})
    items = spark.createDataFrame(bench, "item_id long, text string")
    want = {k: plain(t, bench) for k, t in enumerate(texts)}
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in dc.contamination(docs, items).collect()}
    assert got == want
    for bound in ("MOST_TERMS", "BROADCAST_ROWS", "BROADCAST_BYTES"):  # everything indexed, nothing broadcast
        monkeypatch.setattr(dc, bound, 2)
    assert {r["doc_id"]: tuple(r[c] for c in columns) for r in dc.contamination(docs, items).collect()} == want


def test_odd_rows(spark, documents):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = documents((None, "Alpha beta GAMMA"), (1, "alpha beta gamma"), (1, "other"), (1, "other"), (2, None))
    got = sorted((str(r["doc_id"]), r["n_hit"], r["contaminated"]) for r in dc.contamination(docs, items).collect())
    assert got == [("1", 0, False), ("1", 0, False), ("1", 3, True), ("2", 0, False), ("None", 3, True)]
    assert dc.contamination(docs.limit(0), items).count() == 0
    assert not any(r["contaminated"] for r in dc.contamination(docs, items.limit(0)).collect())


def near(w, x, slop):
    """Whether a start exists at which every word of x stands in w within slop of its place."""
    return any(all(v in w[max(s + i - slop, 0) : max(s + i + slop + 1, 0)] for i, v in enumerate(x)) for s in range(-slop, len(w) + slop))


def test_proximity(spark, documents):
    draw = random.Random(14)
    items = [(k, " ".join(draw.choice("abcdefghij") + draw.choice("xy") for _ in range(draw.choice([2, 3, 5])))) for k in range(8)]
    texts = ["red green blue", "red x green blue", "red x x x x green", "blue", "green red blue", "red x green", None, ""]
    for _ in range(60):
        quote = draw.choice(items)[1].split()
        for _ in range(draw.randrange(4)):
            quote.insert(draw.randrange(len(quote) + 1), draw.choice("abcdefghij") + "x")
        if draw.random() < 0.3:
            quote.pop(draw.randrange(len(quote)))
        texts.append(" ".join([draw.choice("abc") + "y"] * draw.randrange(3) + quote))
    items.append((9, "red green blue"))
    docs, bench = documents(*texts), spark.createDataFrame(items, "item_id long, text string")
    for slop in (0, 1, 2):
        want = {(k, t) for k, d in enumerate(texts) for _, t in items if near(words(d), t.split(), slop)}
        got = dc.proximity_matches(docs, bench, slop).collect()
        assert {(r["doc_id"], r["window"]) for r in got} == want
        for r in got:  # the start itself is right
            assert dc.near_start([w.encode() for w in words(texts[r["doc_id"]])], [w.encode() for w in r["window"].split()], r["start"], 0 if slop == 0 else slop) is not None
    assert (5, "red green blue") not in {(r["doc_id"], r["window"]) for r in dc.proximity_matches(docs, bench, 2).collect()}  # one word is missing


def test_clashing_columns_and_shared_windows(spark, documents):
    many = [(k, "alpha beta gamma") for k in range(300)] + [(400, "delta epsilon")]
    items = spark.createDataFrame(many, "item_id long, text string")
    clash = ("key_", "tie_", "found_", "rkey_", "rtie_", "row_", "w_", "h_", "n_hit", "wids", "set")
    docs = documents("x alpha beta gamma y alpha beta gamma", "delta epsilon", "none").withColumns({c: F.lit(f"mine {c}") for c in clash})
    got = {r["doc_id"]: r for r in dc.contamination(docs, items).collect()}
    ids = sorted(map(str, range(300)))
    assert (got[0]["n_hit"], got[0]["n_items"]) == (6, 300) and got[0]["items_sha256"] == hashlib.sha256(",".join(ids).encode()).hexdigest()
    assert (got[1]["n_hit"], got[1]["n_items"], got[2]["n_items"]) == (2, 1, 0)
    assert all(got[k][c] == f"mine {c}" for k in got for c in clash if c != "n_hit")


def test_repeated_rows(spark, documents):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = documents(*[(i, "Alpha beta GAMMA") for i in (None, None, None, 1, 1)], (2, "alpha beta"), (2, "alpha beta"))
    got = sorted((str(r["doc_id"]), r["n_hit"], r["n_items"], r["contaminated"]) for r in dc.contamination(docs, items).collect())
    assert got == [("1", 3, 1, True)] * 2 + [("2", 0, 0, False)] * 2 + [("None", 3, 1, True)] * 3
