import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pagemill.llm import chosen_path
from pagemill.llm.common import HEAVY_PARTS, join_by_key, rows_of_repeated_keys
from pagemill.llm.components import connected_components


def plain_classes(rows):
    """class and links by comparing all pairs."""
    sets = {}
    for k, (i, t) in enumerate(rows):
        w = (t or "").encode().split()
        sets[k] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = top(a), top(b)
                if rows[x][0] > rows[y][0]:
                    x, y = y, x
                root[y] = x
    return {rows[k][0]: (rows[top(k)][0], links[k]) for k in sets}


def variants(draw, n, size):
    base = [f"w{draw.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(draw.randrange(4)):
            words[draw.randrange(size)] = f"v{draw.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def classes(docs):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosen_path.similarity_classes(docs).collect()}


def test_like_all_pairs(documents, odd):
    draw = random.Random(1)
    texts = odd + [t for n, size in ((6, 60), (5, 200), (9, 30), (4, 5)) for t in variants(draw, n, size)]
    texts += [" ".join(f"u{draw.randrange(10**6)}" for _ in range(draw.randrange(1, 80))) for _ in range(30)]
    passage = " ".join(f"p{k}" for k in range(20))
    texts += [passage + " " + " ".join(f"q{draw.randrange(10**6)}" for _ in range(30)) for _ in range(20)]
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    assert classes(documents(*rows)) == plain_classes(rows)


def test_large_groups_and_buckets(documents, monkeypatch):
    monkeypatch.setattr(chosen_path, "BUCKET", 5)
    monkeypatch.setattr(chosen_path, "BLOCK", 8)
    draw = random.Random(2)
    texts = variants(draw, 45, 70) + variants(draw, 20, 40) + ["copy of one text that many have"] * 30
    rows = list(enumerate(texts))
    assert classes(documents(*rows)) == plain_classes(rows)


def test_odd_rows(spark, documents):
    docs = documents((None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f"), (6, None)).withColumn("node", F.lit("clash"))
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in chosen_path.similarity_classes(docs).collect())
    assert got == {(None, 4, 3): 1, (4, 4, 3): 2, (9, 4, 3): 1, (6, 6, 0): 1}
    kept = [r["doc_id"] for r in chosen_path.first_of_each_class(docs).collect()]
    assert Counter(kept) == {4: 1, 6: 1}
    nulls = documents((None, "a b c d e f"), (None, "a b c d e f"), (None, None), (None, None))
    assert [tuple(r) for r in chosen_path.similarity_classes(nulls).collect() if r["n_links"]] == [(None, None, 1)] * 2
    assert Counter(r["text"] for r in chosen_path.first_of_each_class(nulls).collect()) == {"a b c d e f": 1, None: 2}
    assert chosen_path.similarity_classes(docs.limit(0)).count() == 0
    assert chosen_path.first_of_each_class(docs.limit(0)).columns == docs.columns


def test_one_id_with_several_texts(documents):
    draw = random.Random(7)
    a, b, c = (" ".join(f"w{draw.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    rows = [(1, a), (1, b), (2, a), (3, b), (4, b + " x"), (5, c), (5, c + " y"), (5, c), (None, a + " z"), (1, c)]
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in chosen_path.similarity_classes(documents(*rows)).collect())
    want = plain_classes([(k, t) for k, (_, t) in enumerate(rows)])
    smallest = {top: min(rows[k][0] for k in want if want[k][0] == top and rows[k][0] is not None) for top in {w[0] for w in want.values()}}
    assert got == Counter((rows[k][0], smallest[top], links) for k, (top, links) in want.items())
    clash = {c: F.lit(f"mine {c}") for c in ("key_", "tie_", "row_", "rkey_", "node", "is_first")}
    kept = chosen_path.first_of_each_class(documents(*rows).withColumns(clash)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == {(1, a): 1, (1, b): 1, (1, c): 1}
    assert all(r[c] == f"mine {c}" for r in kept for c in clash)


def test_repeated_rows_that_differ_elsewhere(documents):
    docs = documents((3, "a b c d e f g"), (3, "a b c d e f g"), (8, "a b c d e f g"), source="s1").withColumn("extra", F.expr("uuid()")).cache()
    kept = chosen_path.first_of_each_class(docs).collect()
    assert [r["doc_id"] for r in kept] == [3] and kept == chosen_path.first_of_each_class(docs).collect()


def test_recall_of_runs():
    assert chosen_path.needed_runs(0.8, 4, 0.9999) == 3 and chosen_path.needed_runs(0.8, 4, 0.9) == 1


def test_threshold_is_exact():
    def group(*texts):
        return [{"id": i, "text": t.encode(), "copies": 1, "root": 0, "block": 0, "i": 0, "j": 0} for i, t in enumerate(texts)]

    word = " ".join(f"w{k}" for k in range(13))  # 9 shingles
    for text, linked in ((word + " x", 1), (word + " x y", 1), (word + " x y z", 0)):  # 9/10, 9/11, 9/12
        assert [f[1] for f in chosen_path.verified_in(group(word, text))] == [linked] * 2


@pytest.mark.parametrize("pairs", [[], [(1, 2)], [(k, k + 1) for k in range(60)], [(7, k) for k in range(40)], [(3, 3)]])
def test_components(spark, pairs):
    draw = random.Random(3)
    pairs = pairs + [(draw.randrange(100, 200), draw.randrange(100, 200)) for _ in range(60)]
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for a in sorted(near):
        todo = [a]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = a
                todo += near[x]
    got = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(got) == len(want) and {r["id"]: r["label"] for r in got} == want


def test_joins_with_heavy_keys(spark):
    rows = [(k % 7 if k % 2 else 1000, k) for k in range(400)] + [(5000 + k, k) for k in range(10)] + [(None, 1), (None, 2)]
    frame = spark.createDataFrame(rows, "key long, v long")
    counts = Counter(k for k, _ in rows if k is not None)
    got = rows_of_repeated_keys(frame, "key").collect()
    assert sorted((r["key"], r["v"], r["n_key"]) for r in got) == sorted((k, v, counts[k]) for k, v in rows if counts[k] > 1)
    table = spark.createDataFrame([(k, n) for k, n in counts.items()], "key long, n long")
    assert join_by_key(frame, table, "key", "n", HEAVY_PARTS * 20).count() == sum(counts.values())


def test_sketches_keep_contained_texts():
    """A text and its beginning, at similarities 0.80 to 0.82."""
    draw = random.Random(4)
    for k in range(3000):
        words = [f"w{draw.randrange(10**6)}" for _ in range(404)]
        texts = [" ".join(words), " ".join(words[: 324 + k % 3 * 4])]
        bucket = [(i, chosen_path.shingles(t.encode())[: chosen_path.SKETCH].astype("int32").tolist()) for i, t in enumerate(texts)]
        assert chosen_path.proposed_in(bucket) == [(0, 1)]


def test_recall_of_recursion():
    runs = chosen_path.runs_of_recursion(0.8)
    assert chosen_path.missed(0.8, runs) <= 1 - chosen_path.RECALL < chosen_path.missed(0.8, runs - 1)
    with pytest.raises(ValueError):
        chosen_path.runs_of_recursion(0.8, 0.9999999)


def test_pairs_that_meet_in_large_buckets_only(spark):
    draw, size = random.Random(5), chosen_path.SKETCH
    nodes = []
    for k in range(0, 3000, 2):
        tokens = [draw.randrange(-(2**31), 2**31) for _ in range(size + size // 5)]
        nodes += [(k, tokens[:size]), (k + 1, tokens[-size:])]
    frame = spark.createDataFrame(nodes, "id long, sketch array<int>").withColumns({"size": F.size("sketch"), "paths": F.expr("sequence(1L, 10L)")})
    found = {tuple(sorted((r["a"], r["b"]))) for r in chosen_path.propose(frame).collect()}
    assert {(k, k + 1) for k in range(0, 3000, 2)} <= found


def test_chains_from_settled_sets(spark, monkeypatch):
    """Growing texts: the second is settled with the first, and the third is similar to the second only."""
    monkeypatch.setattr(chosen_path, "BUCKET", 2)
    draw, nodes = random.Random(6), []
    for k in range(0, 900, 3):
        tokens = [draw.randrange(-(2**31), 2**31) for _ in range(500)]
        nodes += [(k + i, sorted(tokens[:n])[: chosen_path.SKETCH], [k * 10 + p for p in range(12)]) for i, n in enumerate((340, 400, 500))]
    frame = spark.createDataFrame(nodes, "id long, sketch array<int>, paths array<long>").withColumn("size", F.size("sketch"))
    groups = {r["id"]: r["label"] for r in connected_components(chosen_path.propose(frame)).collect()}
    assert groups == {k: k // 3 * 3 for k in range(900)}


def test_proposed_between():
    inside = [(k, [1, 2, 3, 4, k + 10]) for k in range(5)]
    assert chosen_path.proposed_between([(90, [1, 2, 3, 4, 99]), (91, [5, 6, 7])], inside) == [(90, 0)]
    assert chosen_path.proposed_between([], inside) == []


@pytest.mark.parametrize("bucket, chunk", [(4, 3), (30, 7)])
def test_groups_and_the_few_beside_them(documents, monkeypatch, bucket, chunk):
    """Chains of edited texts that share tokens with others; the few outside a bucket's main group are searched, not drawn."""
    monkeypatch.setattr(chosen_path, "BUCKET", bucket)
    monkeypatch.setattr(chosen_path, "CHUNK", chunk)
    draw = random.Random(9)
    passage = [f"p{k}" for k in range(30)]
    texts = []
    for _ in range(3):
        now = passage + [f"w{draw.randrange(10**6)}" for _ in range(90)]
        for _ in range(25):
            now = list(now)
            for _ in range(2):
                now[draw.randrange(30, len(now))] = f"v{draw.randrange(10**6)}"
            texts.append(" ".join(now))
    texts += [" ".join(passage + [f"u{draw.randrange(10**6)}" for _ in range(40)]) for _ in range(25)]
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    assert classes(documents(*rows)) == plain_classes(rows)
