import itertools
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from pagemill.llm import line_crf

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    again = {p for k in range(len(w) - 7) if runs[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)


def field(seed):
    draw = random.Random(seed)
    number = lambda: draw.uniform(-2, 2)
    return line_crf.LineField([[number() for _ in line_crf.FEATURES] for _ in (0, 1)], [[number(), number()], [number(), number()]], [number(), number()])


def test_measures(documents, odd):
    draw = random.Random(2)
    texts = odd + ["\n".join(" ".join(draw.choices(["a", "b#", "é", "|", "c\td"], k=draw.randrange(12))) for _ in range(draw.randrange(12))) for _ in range(80)]
    docs = documents(*texts, (None, None)).withColumn("kept", F.lit("clash"))
    got = line_crf.quality_rules(docs, field(1)).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got) == Counter(
        (i, *plain(t)) for i, t in [*enumerate(texts), (None, None)]
    )
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert line_crf.quality_rules(docs.limit(0), field(1)).count() == 0


def test_viterbi_is_the_best_path():
    draw = random.Random(4)
    for seed in range(30):
        f = field(seed)
        lines = [draw.randrange(1 << len(line_crf.FEATURES)) for _ in range(draw.randrange(7))]

        def score(marks):
            s = f.start[marks[0]] if marks else 0
            s += sum(f.transition[a][b] for a, b in zip(marks, marks[1:]))
            return s + sum(f.emission[m][k] for m, bits in zip(marks, lines) for k in range(len(line_crf.FEATURES)) if bits >> k & 1)

        best = max(itertools.product((0, 1), repeat=len(lines)), key=score)
        assert abs(score(f.viterbi(lines)) - score(best)) < 1e-9


def test_training_separates(spark, documents):
    draw = random.Random(5)
    prose = lambda: "\n".join(" ".join(f"w{draw.randrange(999)}" for _ in range(12)) + "." for _ in range(5))
    junk = lambda: "\n".join(" | ".join(f"W{draw.randrange(99)}" for _ in range(8)) for _ in range(5))
    rows = [(k, junk() if k % 4 == 0 else prose()) for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(200)] + [(None, 1), (1, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in line_crf.quality_rules(documents(*rows), line_crf.train_on_labels(documents(*rows), labels)).collect()}
    assert all(got[k] == (k % 4 != 0) for k in range(200, 300))
    nothing = line_crf.train_on_labels(documents(*rows), labels.limit(0))
    assert nothing.viterbi([1, 3]) == [0, 0]


def test_expected_counts_by_enumeration():
    """Forward and backward sums against all mark sequences."""
    import numpy as np

    draw = random.Random(6)
    docs = [([draw.randrange(1 << len(line_crf.FEATURES)) for _ in range(n)], [draw.randrange(1, 9) for _ in range(n)], n % 2) for n in (1, 4, 2, 5, 0, 3, 4)]
    lattice, f = line_crf.Lattice(docs), field(3)
    w, tr, st = np.array(f.emission), np.array(f.transition), np.array(f.start)
    tilt = np.array([draw.uniform(-1, 1) for _ in range(lattice.n)])
    p, pairs, first = lattice.expected(w, tr, st, tilt)
    want_p, want_pairs, want_first = np.zeros(len(p)), np.zeros((2, 2)), np.zeros(2)
    for d in range(lattice.n):
        at = np.flatnonzero(lattice.doc == d)
        score = (lattice.x @ w.T)[lattice.kind][at]
        score[:, 1] += tilt[d] * lattice.pull[at]
        weight = {m: np.exp(st[m[0]] + sum(score[i, k] for i, k in enumerate(m)) + sum(tr[a, b] for a, b in zip(m, m[1:]))) for m in itertools.product((0, 1), repeat=len(at))}
        for m, x in weight.items():
            x /= sum(weight.values())
            want_p[at] += x * np.array(m)
            want_first[m[0]] += x
            for a, b in zip(m, m[1:]):
                want_pairs[a, b] += x
    assert np.allclose(p, want_p) and np.allclose(pairs, want_pairs) and np.allclose(first, want_first)
    held = lattice.agreeing(w, tr, st)[0]
    shares = np.bincount(lattice.doc, held * lattice.share, lattice.n)
    assert all(shares[d] > line_crf.BAD_LEAST - 0.01 if lattice.bad[d] else shares[d] < line_crf.GOOD_MOST + 0.01 for d in range(lattice.n))


def test_lines_of_mixed_documents(spark, documents):
    """Only documents have labels; lines of both kinds in one document are told apart."""
    draw = random.Random(7)
    prose = lambda: " ".join(f"w{draw.randrange(999)}" for _ in range(12)) + "."
    junk = lambda: draw.choice([" | ".join(f"W{draw.randrange(99)}" for _ in range(8)), "BUY NOW!! " * 3, " ".join(f"t{draw.randrange(9)}##" for _ in range(9))])

    def made(bad):
        marks = [int(draw.random() < (0.85 if bad else 0.15)) for _ in range(draw.randrange(4, 12))]
        return "\n".join(junk() if m else prose() for m in marks), marks

    rows = [made(k % 3 == 0) for k in range(400)]
    labels = spark.createDataFrame([(str(k), int(k % 3 != 0)) for k in range(300)], "doc_id string, quality long")
    docs = documents(*[t for t, _ in rows]).withColumn("doc_id", F.col("doc_id").cast("string"))  # ids of another type
    trained = line_crf.train_on_labels(docs, labels)
    right = total = mixed = 0
    for text, marks in rows[300:]:
        got = trained.viterbi(line_crf.described(text.encode())[0])
        right, total, mixed = right + sum(a == b for a, b in zip(got, marks)), total + len(marks), mixed + (0 < sum(got) < len(got))
    assert right >= 0.97 * total and mixed > 50


def test_whole_documents_train(spark, documents):
    """Lines beyond any prefix count, and documents are drawn whole until the bound of lines."""
    prose, junk = " ".join(f"w{k}" for k in range(12)) + ".", "A | B | C | D"
    rows = [(k, "\n".join([prose] * 200 + [junk] * 400) if k % 2 else "\n".join([prose] * 300)) for k in range(40)]
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(40)], "doc_id long, quality int")
    trained = line_crf.train_on_labels(documents(*rows), labels)
    bits = line_crf.described(f"{junk}\n{prose}".encode())[0]
    assert trained.viterbi(bits) == [1, 0]
    assert line_crf.train_on_labels(documents(*rows), labels, most_lines=100).emission == [[0.0] * len(line_crf.FEATURES)] * 2  # none fits


def test_columns_of_any_name(spark, documents):
    docs = documents("some text", None, "").withColumnsRenamed({"n_chars": "a.b", "source": "Kept"})
    field = line_crf.train_on_labels(docs, spark.createDataFrame([], "doc_id long, quality int"))
    got = line_crf.quality_rules(docs, field)
    assert "Kept" not in got.columns and sorted(r["a.b"] or 0 for r in got.where("base_failed").collect()) == [0, 0, 9]
