import random
from hashlib import sha256
from zlib import crc32

import pytest

from pagemill.llm import periodic_runs
from pagemill.llm.common import word_hashes


def plain_runs(s, least, power):
    """Every period, every maximal stretch."""
    out, n = {}, len(s)
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, power * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((i, length, q) for (i, length), q in out.items())


def test_overlap():
    assert periodic_runs.overlap(6, 4) == 5
    assert all(periodic_runs.overlap(least, power) == min(max(least, power * q) - q for q in range(1, 200)) for least in range(2, 20) for power in range(2, 6))


@pytest.mark.parametrize("least, power", [(6, 4), (4, 2), (6, 3)])
def test_search_against_every_period(least, power):
    draw = random.Random(power)
    for _ in range(1500):
        letters, s = draw.choice([1, 2, 3, 5]), []
        for _ in range(draw.randint(0, 12)):
            s += [b"w%d" % draw.randrange(letters) for _ in range(draw.randint(1, 9))] * draw.choice([1, 1, 2, 4, 5, 9])
        expected = plain_runs(s, least, power)
        assert periodic_runs.main_lorentz(s, least, power) == expected
        assert periodic_runs.runs_of(s, word_hashes(b" ".join(s)), least, power) == expected


def test_masked_words_are_not_searched():
    words = [b"a%d" % i for i in range(50)] + [b"x", b"y"] * 6 + [b"b%d" % i for i in range(50)]
    assert periodic_runs.segments(word_hashes(b" ".join(words)), 5) == [(50, 62)]
    assert periodic_runs.segments(word_hashes(b" ".join(words[:50])), 5) == []


def test_table(spark, documents, odd):
    long_text = " ".join(f"w{i}" for i in range(3000)) + " la li lu" * 4000
    docs = documents(*odd, long_text, (None, "z " * 7)).withColumnsRenamed({"n_chars": "a.b", "source": "Row_"}).selectExpr("*", "'mine' AS runs", "'mine' AS text_")
    got = periodic_runs.collapse_runs(docs)
    assert got.columns == ["doc_id", "text", "lang", "Row_", "a.b", "text_", "runs"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == len(odd) + 2 and {r["text_"] for r in rows.values()} == {"mine"}
    assert [list(r) for r in rows[9]["runs"]] == [[0, 8000, 2]] and rows[9]["text"] == "x y"
    assert [list(r) for r in rows[len(odd)]["runs"]] == [[3000, 12000, 3]] and rows[len(odd)]["text"].endswith("w2999 la li lu")
    assert rows[None]["text"] == "z" and rows[0]["text"] == "" and rows[0]["runs"] == [] and rows[10]["text"] == "\x00\x1c\x85 b"
    assert periodic_runs.collapse_runs(docs.limit(0)).count() == 0
    assert periodic_runs.collapse_runs(docs.select("text")).columns == ["text", "runs"]


def plain_row(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h, n = (crc32(str(doc_id).encode()) if doc_id is not None else 1), len(words)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, 6, 4)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return (
        doc_id,
        len(runs),
        *(best or (None, None, None)),
        best and 1000 * best[1] // best[2],
        sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
        sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def test_query_against_plain_version(spark, documents, odd, tmp_path):
    draw = random.Random(5)
    texts = [" ".join(draw.choice("ab cde f") for _ in range(draw.randint(0, 300))) for _ in range(150)]
    chosen = [k for k in range(2000) if crc32(str(k).encode()) % 10 == 0][:40]
    rows = [*odd, *[(1000 + k, t) for k, t in enumerate(texts)], *[(10_000 + k, " ".join(f"u{i}" for i in range(k))) for k in range(60)], *[(k, " ".join(f"v{i}" for i in range(n))) for n, k in enumerate(chosen) if k > 20], (None, "p q " * 9), (None, None)]
    docs = documents(*rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted((tuple(r) for r in periodic_runs.op11_periodic_runs(spark, str(tmp_path)).collect()), key=key)
    assert got == sorted((plain_row(r["doc_id"], r["text"]) for r in docs.collect()), key=key)
    assert sum(r[1] > 0 for r in got) > 30
