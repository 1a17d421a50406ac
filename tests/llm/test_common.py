import random

import numpy as np
import pytest

from pagemill.llm import common


def by_word(texts):
    seen = {}
    for t in texts:
        hashes = common.word_hashes(t.encode()).tolist()
        words = common.words_of(t)
        assert len(hashes) == len(words)
        for w, h in zip(words, hashes):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    return seen


@pytest.mark.parametrize("size", [common.HASHED_BYTES, 7, 1])
def test_word_hashes(monkeypatch, size):
    monkeypatch.setattr(common, "HASHED_BYTES", size)
    draw = random.Random(1)
    alphabet = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", "é", "日", "a", "b", "ab", "\x00", "  ", "word"]
    texts = ["".join(draw.choices(alphabet, k=draw.randrange(40))) for _ in range(1500)] + ["", " ", "x" * 3000, " x " * 50]
    by_word(texts)
    assert len(common.word_hashes(None)) == 0


def test_rolling_tells_runs_apart():
    draw = np.random.default_rng(1)
    words = draw.integers(0, 3, 400).astype(np.uint64)
    for width in (1, 2, 5, 8, 35):
        runs = common.rolling(words, width).tolist()
        plain = [tuple(words[k : k + width]) for k in range(len(words) - width + 1)]
        assert len(set(zip(plain, runs))) == len(set(plain)) == len(set(runs))
    assert len(common.rolling(words[:3], 4)) == 0
