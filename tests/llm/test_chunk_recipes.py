import re
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from pagemill.llm import chunk_recipes


def plain(rows):
    """(id, keep_id, group_size, kept, sha) by comparing whole texts."""
    by = defaultdict(list)
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    for at, (i, t) in enumerate(rows):
        by[norm(t)].append((i is None, i or 0, at))
    out = []
    for at, (i, t) in enumerate(rows):
        none, keep, first = min(by[norm(t)])
        out.append((i, None if none else keep, len(by[norm(t)]), at == first, sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def many(odd):
    words = [f"word{k % 17}d ap{k % 29}g" for k in range(400)]
    long_text = " ".join(words)
    edits = [" ".join(words[:k] + ["new"] + words[k:]) for k in range(0, 400, 40)]
    return [*enumerate([*odd, long_text, long_text.replace(" ", "\t\n "), " " + long_text, long_text + "\n", *edits, *edits, "あ、い。" * 3000, "a  b", "a b"]), (None, "a b"), (None, "nobody"), (None, "nobody"), (3, "\t"), (2, " ")]


def test_chunks_are_the_text(spark, odd):
    texts = spark.createDataFrame([(t,) for _, t in many(odd) if t is not None], "text string").withColumn("text", chunk_recipes.normalised(F.col("text")))
    got = texts.select("text", chunk_recipes.chunks(F.col("text")).alias("c")).collect()
    assert all("".join(r["c"]) == r["text"] for r in got)
    assert all(256 <= len(c) <= 4096 for r in got for c in r["c"][:-1])
    assert max(len(r["c"]) for r in got) > 10


def test_an_edit_changes_few_chunks(spark):
    words = [f"{'abcdlmnop'[k * k % 9]}{k}{'dglvxyz'[k % 7]}" for k in range(4000)]
    texts = [(" ".join(words),), (" ".join([*words[:2000], "inserted", *words[2000:]]),)]
    a, b = (r["c"] for r in spark.createDataFrame(texts, "text string").select(chunk_recipes.chunks(F.col("text")).alias("c")).collect())
    assert len(set(a) - set(b)) <= 5 < len(a) / 4


@pytest.mark.parametrize("bits", [64, 3])
def test_groups(spark, odd, bits):
    """With 3 bits nearly all hashes of chunks and recipes are shared; identifiers still tell all texts apart."""
    rows = many(odd)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((tuple(r) for r in chunk_recipes.duplicate_groups(docs, bits=bits).collect()), key=str)
    assert got == plain(rows)


def test_other_salts(spark, monkeypatch):
    texts = [(k, f"text {k % 50}") for k in range(100)]
    plain_hash, asked = chunk_recipes.chunk_hash, []
    monkeypatch.setattr(chunk_recipes, "MOST_SHARED", 0)
    monkeypatch.setattr(chunk_recipes, "chunk_hash", lambda c, salt, bits=64: asked.append(salt) or (F.lit(7).cast("long") if salt < 2 else plain_hash(c, salt)))
    got = chunk_recipes.duplicate_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert max(asked) == 2 and sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == [(k, k % 50, 2) for k in range(100)]


def test_whole_rows(spark, documents, odd):
    docs = documents(*many(odd)).withColumnsRenamed({"n_chars": "a.b", "source": "Row_"}).selectExpr("*", "'mine' AS kept", "'mine' AS same_", "'mine' AS hash_", "'mine' AS key_")
    got = chunk_recipes.drop_copies(docs)
    assert got.columns == docs.columns
    expected = sorted((str(i), t) for i, t in {(i, k) for i, keep, _, kept, k in plain(many(odd)) if kept})
    rows = got.collect()
    assert sorted((str(r["doc_id"]), sha256(re.sub("[\x20\x09-\x0d]+", " ", r["text"] or "").encode()).hexdigest()) for r in rows) == expected
    assert {r["kept"] + r["same_"] + r["hash_"] + r["key_"] for r in rows} == {"mine" * 4}
    assert chunk_recipes.drop_copies(docs.limit(0)).count() == 0


def test_hot_group(spark):
    """Half of all rows are one text, and its rows are not shuffled to one task."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("the same  text")).otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    got = chunk_recipes.duplicate_groups(docs)
    assert got.where("kept").count() == 2001 and got.where("group_size = 2000 and keep_id = 0").count() == 2000
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()
    assert not any(x in got._jdf.queryExecution().toString() for x in ("ArrowEvalPython", "MapInArrow", "MapInPandas", "BatchEvalPython"))
