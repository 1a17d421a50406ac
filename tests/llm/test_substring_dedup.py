import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import substring_dedup as sd
from pagemill.llm.common import rolling


def plain(texts, width):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def make_texts(draw, n=60):
    passages = [" ".join(f"p{draw.randrange(9)}" for _ in range(draw.randrange(20, 90))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(draw.randrange(4)):
            parts.append(draw.choice(passages) if draw.random() < 0.5 else " ".join(f"w{draw.randrange(50)}" for _ in range(draw.randrange(60))))
        texts.append(" ".join(parts))
    return texts


@pytest.mark.parametrize("frequent, shard_words, bits", [(1000, 300_000, 64), (3, 300_000, 64), (1000, 200, 64), (1, 300, 64), (1, 300_000, 9)])
def test_like_counting(documents, odd, monkeypatch, frequent, shard_words, bits):
    """Also with hashes that many stretches share, and with hashes that different windows share."""
    monkeypatch.setattr(sd, "FREQUENT", frequent)
    monkeypatch.setattr(sd, "ROUTE_BITS", bits)
    monkeypatch.setattr(sd, "SHARD_WORDS", shard_words)
    draw = random.Random(7)
    texts = make_texts(draw) + odd + ["z " * 34, "z " * 35, "y " * 36, "ab " * 500, "k l m " * 30]
    texts += texts[:5]
    rows = sd.remove_repeats(documents(*texts).withColumn("spans", F.lit("clash"))).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], bytes(r["kept"])) for r in rows}
    assert got == dict(enumerate(plain(texts, sd.WIDTH)))


def test_passage_of_most_documents(documents, monkeypatch):
    """A passage in every second document, between words that differ, far beyond what one index may hold."""
    monkeypatch.setattr(sd, "FREQUENT", 20)
    draw = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(50))
    filler = lambda: " ".join(f"w{draw.randrange(10**6)}" for _ in range(draw.randrange(60)))
    texts = [f"{filler()} {passage if k % 2 else passage[: draw.randrange(len(passage))]} {filler()}" for k in range(300)] + [passage] * 30
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], bytes(r["kept"])) for r in sd.remove_repeats(documents(*texts)).collect()}
    assert got == dict(enumerate(plain(texts, sd.WIDTH)))


def test_odd_rows(spark, documents, tmp_path):
    long = " ".join(map(str, range(50)))
    docs = documents((None, long), (1, long), (1, long), (2, "short"), (3, None))
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in sd.remove_repeats(docs).collect())
    assert got == {(None, 50, 50): 1, (1, 50, 50): 2, (2, 1, 0): 1, (3, 0, 0): 1}
    assert sd.remove_repeats(docs.limit(0)).count() == 0
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = sd.op3_substring_dedup(spark, str(tmp_path)).collect()
    assert {r["kept_sha256"] for r in rows if r["doc_id"] == 2} == {hashlib.sha256(b"short").hexdigest()}


def test_wavelet_matrix_counts():
    draw = np.random.default_rng(1)
    sequence = draw.integers(0, 37, 500)
    matrix = sd.WaveletMatrix(sequence, 37)
    symbol, at = draw.integers(0, 37, 800), draw.integers(0, 501, 800)
    assert matrix.rank(symbol, at).tolist() == [int((sequence[:a] == s).sum()) for s, a in zip(symbol, at)]


@pytest.mark.parametrize("width", [5, 12, 35])
def test_index_finds_all_windows(width):
    draw = np.random.default_rng(width)
    for letters in (2, 4, 30):
        pieces = [np.append(draw.integers(1, letters + 1, draw.integers(1, 3 * width)), 0) for _ in range(12)]
        pieces.append(pieces[0])
        text = np.concatenate(pieces)
        sizes = np.array(list(map(len, pieces)))
        begin = np.cumsum(sizes) - sizes
        windows = [(int(b) + k, tuple(p[k : k + width])) for b, p in zip(begin, pieces) for k in range(len(p) - width)]
        seen = Counter(w for _, w in windows)
        got = np.sort(sd.FMIndex(text, width).repeated(begin, begin + sizes - 1)).tolist()
        assert got == [k for k, w in windows if seen[w] > 1]


def test_stretches_cover_each_window_once():
    draw = np.random.default_rng(2)
    for n in (10, 35, 36, 400):
        hashes = draw.integers(0, 6 if n == 400 else 1 << 60, n).astype(np.uint64)
        route, first, last, own = sd.stretches(hashes)
        starts = [s for a, z in zip(first, last) for s in range(a, z + 1)]
        assert starts == list(range(max(n - sd.WIDTH + 1, 0)))
        grams = rolling(hashes, sd.GRAM)
        for r, a, z, o in zip(route, first, last, own):
            assert all(grams[s : s + sd.WIDTH - sd.GRAM + 1].min() == r for s in range(a, z + 1))
            assert o == ((grams[a : z + sd.WIDTH - sd.GRAM + 1] == r).sum() > 1)
