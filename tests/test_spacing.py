import math
import os
import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import spacing

SF = "/root/testdata/sf0.01"


def cheapest(spacer, text):
    """The cost of the best of all cuts."""
    best = math.inf
    for cuts in range(1 << max(len(text) - 1, 0)):
        words, start = [], 0
        for i in range(1, len(text) + 1):
            if i == len(text) or cuts >> (i - 1) & 1:
                words.append(text[start:i])
                start = i
        best = min(best, sum(map(spacer.word_cost, words)))
    return best


def test_against_all_cuts():
    draw = random.Random(3)
    spacer = spacing.UnigramSpacer({"a": 5, "ab": 9, "bc": 4, "abc": 2, "c": 1, "cab": 7, "하나": 3})
    for _ in range(200):
        text = "".join(draw.choice("abc하나x") for _ in range(draw.randint(0, 10)))
        words = spacer.words(text)
        assert "".join(words) == text and all(words)
        assert math.isclose(sum(map(spacer.word_cost, words)), cheapest(spacer, text), abs_tol=1e-9) if text else words == []


def test_lines_and_columns(spark):
    corpus = spark.createDataFrame([("the red bolt and the old ring",), (None,), ("",)], "text string")
    make = spacing.train_spacer(corpus)
    texts = spark.createDataFrame([(1, "theredbolt\tandthe\noldring the"), (2, None), (3, ""), (4, "thezzzred")], "k int, t string")
    assert {r["k"]: r["t"] for r in spacing.spaced(texts, "t", make).collect()} == {1: "the red bolt\tand the\nold ring the", 2: None, 3: "", 4: "the zzz red"}
    assert len(spacing.train_spacer(corpus, most=2)().cost) == 2
    assert spacing.train_spacer(corpus.limit(0))()("abc") == "abc"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_documents(spark):
    """Boundaries that come back in documents the model has not seen. Their prose is invented of syllables that are words too,
    and a quarter of its words occurs once, so this is far from what a language gives; known words come back nearly all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL").select("doc_id", F.substring("text", 1, 600).alias("text"))
    held = [" ".join(r["text"].split()[:60]) for r in docs.where("doc_id % 25 = 0").collect()]
    all_ = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 25 <> 0")

    def share(spacer, texts):
        def ends(words):
            at, out = 0, set()
            for w in words[:-1]:
                at += len(w)
                out.add(at)
            return out

        pairs = [(ends(t.split()), ends(spacer.words("".join(t.split())))) for t in texts]
        return sum(len(a & b) for a, b in pairs) / max(sum(len(a) for a, _ in pairs), 1)

    assert share(spacing.train_spacer(all_)(), held) > 0.7
    known = {r["word"] for r in spacing.word_counts(all_).where("n >= 20").collect() if len(r["word"]) > 3}
    frequent = [" ".join(w for w in t.split() if w in known) for t in held]
    assert share(spacing.UnigramSpacer({w: 1 for w in known}), frequent) > 0.95
