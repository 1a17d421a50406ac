import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import mixing


def target_sizes(sizes):
    """Targets by weights 5, 2, 1, repeating; what comes above twice its size is shared again."""
    weights = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    left, open_, targets = Fraction(3, 2) * sum(sizes), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_:
        weight = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / weight > 2 * sizes[i]]
        if not above:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in above:
            targets[i] = Fraction(2 * sizes[i])
        left -= sum(targets[i] for i in above)
        open_ -= set(above)
    return targets


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 30, 5], [0, 7], [], [0], [3, 50, 700, 9, 20, 4000, 1, 1, 90]])
def test_targets(spark, sizes):
    names = sorted(f"{k}\U0001f600\uffff" for k in range(len(sizes)))
    rows = [(n if k + 1 < len(sizes) else None, s - s // 3) for k, (n, s) in enumerate(zip(names, sizes))]
    rows += [(n, s // 3) for (n, _), s in zip(rows, sizes)]
    got = mixing.source_table(spark.createDataFrame(rows, "source_ string, size_ long"), 4).orderBy("number").collect()
    assert [r["number"] for r in got] == list(range(len(sizes))) and [r["source_size_"] for r in got] == sizes
    assert [r["target_"] for r in got] == pytest.approx(list(map(float, target_sizes(sizes))))
    assert all(abs(r["quota_"] * 4 - r["target_"]) <= 8 and r["quota_"] <= 2 * r["blocks_"] for r in got)


def test_many_sources(spark, tmp_path, monkeypatch):
    """Groups of few sources: the same contract where sources are many and not broadcast."""
    monkeypatch.setattr(mixing, "GROUP_SOURCES", 7)
    monkeypatch.setattr(mixing, "MOST_TASKS", 3)
    draw = random.Random(10)
    rows = [(k, "w " * draw.randrange(300), "en", f"s{draw.randrange(60) if k % 3 else 0}", 0) for k in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    sizes, taken = Counter(), Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(t.split())
    names = sorted(sizes)
    targets = dict(zip(names, target_sizes([sizes[s] for s in names])))
    for r in mixing.op7_mixing(spark, str(tmp_path)).collect():
        s = rows[r["doc_id"]][3]
        assert r["target"] == pytest.approx(float(targets[s])) and r["source_size"] == sizes[s] and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 2 * mixing.BLOCK_WORDS for s in names)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(size):
    for seed in (1, 2):
        assert sorted(mixing.permuted(np.arange(size), size, seed).tolist()) == list(range(size))
    if size > 60:
        assert (mixing.permuted(np.arange(size), size, 1) != mixing.permuted(np.arange(size), size, 2)).mean() > 0.9


def test_draws_come_out():
    draws = mixing.shard_draws([1000, 10, 0, 333], 7, [1])
    assert [sum(d[k] for d in draws) for k in range(4)] == [1000, 10, 0, 333]
    assert max(map(sum, draws)) - min(map(sum, draws)) <= 7 and draws == mixing.shard_draws([1000, 10, 0, 333], 7, [1])
    assert len({d[0] for d in draws}) > 1
    parts = mixing.shard_draws([50, 80, 3], 7, [1, 2], [19, 20, 19, 18, 20, 18, 19])
    assert list(map(sum, parts)) == [19, 20, 19, 18, 20, 18, 19] and [sum(d[k] for d in parts) for k in range(3)] == [50, 80, 3]


def corpus(spark):
    draw = random.Random(9)
    rows = []
    for k in range(400):
        source = draw.choice(["a"] * 6 + ["b", "c", "Z", "é", None])
        rows.append((k, " ".join(f"w{draw.randrange(100)}" for _ in range(draw.randrange(1, 120))), "en", source, 0))
    rows += [(900, None, "en", "b", 0), (901, "", "en", "only empty", 0), (3, rows[3][1], "en", rows[3][3], 0), (None, "null id here", None, "b", 0), (902, "long " * 20000, "en", "c", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), rows


def test_query(spark, tmp_path):
    docs, rows = corpus(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op7_mixing(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for i, t, _, s, _ in rows:
        sizes[s] += len((t or "").encode().split())
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    targets = dict(zip(names, target_sizes([sizes[s] for s in names])))
    source = {i: s for i, _, _, s, _ in rows}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(float(targets[s])) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 2 * mixing.BLOCK_WORDS for s in names)
    assert sorted(map(str, got)) == sorted(map(str, mixing.op7_mixing(spark, str(tmp_path)).collect()))


def test_mixed_documents(spark, tmp_path):
    docs, rows = corpus(spark)
    got = mixing.mixed_documents(docs.withColumn("size_", F.lit("clash"))).collect()
    whole = {i: t for i, t, *_ in rows}
    words = Counter()
    for r in got:
        assert r["size_"] == "clash" and r["n_chars"] == len(r["text"]) and r["text"]
        words[r["doc_id"]] += len(r["text"].split())
        inside, at = whole[r["doc_id"]].split(), 0
        for w in r["text"].split():  # a part in order
            at = inside.index(w, at) + 1
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    taken = Counter()
    for r in mixing.op7_mixing(spark, str(tmp_path)).collect():
        taken[r["doc_id"]] += r["taken"]
    assert words == +taken
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs.where("doc_id = 900")).count() == 0
