import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagemill.llm import token_counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))


def test_like_the_library(library):
    counter = token_counts.TokenCounter.of(public_tokenizers.path(token_counts.TOKENIZER))
    draw = random.Random(3)
    alphabet = ["a", "th", "ing", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "é", "ß", "²", "½", "日本", "😀", "1", "23", "'s", "'re", "'S", "#", "...", "<|endoftext|>", "<|end", "\x00"]
    texts = ["".join(draw.choices(alphabet, k=draw.randrange(25))) for _ in range(3000)] + ["ab" * 20000, "!" * 3000]
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_all_code_points(library):
    """Strings over all of Unicode: classes are those of the library's tables, not of another Unicode version."""
    counter = token_counts.TokenCounter.of(public_tokenizers.path(token_counts.TOKENIZER))
    draw = random.Random(4)
    places = [*range(0xD800), *range(0xE000, 0x110000)]
    new = [0x558, 0x88F, 0xC5C, 0x208F, 0x11DE0, 0x11DE5, 0x323B0, 0x33479]  # assigned lately, or not yet
    texts = ["".join(chr(draw.choice(places if draw.random() < 0.7 else new)) + draw.choice(["", " ", "a", "1"]) for _ in range(draw.randrange(12))) for _ in range(20_000)]
    texts += ["".join(chr(p) + " " for p in places[a : a + 5000]) for a in range(0, len(places), 5000)]
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_added_tokens():
    import regex

    of = lambda **flags: regex.compile(token_counts.special_pattern({"content": "<x>", **flags})).findall
    assert of()("a <x> b") == ["<x>"] and of(lstrip=True)("a <x> b") == [" <x>"] and of(rstrip=True)("a <x> b") == ["<x> "]
    assert of(single_word=True)("a<x>") == [] and of(single_word=True)("a <x>.") == ["<x>"]


def test_rank_order():
    ranks = {("b", "c"): 0, ("a", "b"): 1, ("a", "bc"): 2}
    assert token_counts.merged_count(list("abc"), ranks) == 1
    assert token_counts.merged_count(list("abab"), ranks) == 2
    assert token_counts.merged_count(list("aaa"), {("a", "a"): 0}) == 2
    assert token_counts.merged_count([], ranks) == 0


def test_table(documents, odd, library):
    docs = documents(*odd).unionByName(documents((None, "null id"))).withColumn("n_tokens", F.lit("clash"))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs).collect())
    want = [(False, i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(odd)]
    assert got == [*want, (True, 0, 7, len(library.encode("null id").ids))]
    assert token_counts.count_tokens(docs.limit(0)).count() == 0
