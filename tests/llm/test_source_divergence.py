import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pagemill.llm import source_divergence as sd


def plain(rows, least, top):
    """(lang, source, part, item, value, rank) over (text, lang, source), by dictionaries."""
    docs, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        n[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, d in docs[lang].items() if d >= least)

        def share(count, total):
            return 1 + 1_000_000_000 * (count + 5) // (total + 5 * len(kept))

        p = {s: {t: share(n[lang, s][t], sum(n[lang, s][t] for t in kept)) for t in kept} for s in sources}
        whole = {t: sum(n[lang, s][t] for s in sources) for t in kept}
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def rows(n=400, seed=3):
    draw = random.Random(seed)
    words = [f"{a}{b}" for a in ("The", "été", "x", "日本", "ZZ", "q") for b in ("a", "b", "C", "ß", "ÄÖ", "d")]
    made = [(" ".join(draw.choice(words[: 6 + 3 * (k % 9)]) + draw.choice(["", ",", "1", "_", "\x00"]) for _ in range(draw.randint(0, 40))), ["en", "de", None, ""][k % 4 if k % 3 else 0], [None, "s1", "s2", "š", "Z", "a"][draw.randint(0, 5)]) for k in range(n)]
    return [*made, (None, "en", "silent"), ("", "only", "one"), (None, "none", "b"), ("", "none", "a"), ("word " * 3000, "en", "long"), ("Une", "en", "rare")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


@pytest.mark.parametrize("least, top, entries, shard_rows", [(30, 50, 200_000, 50_000), (5, 3, 7, 4), (1, 50, 1, 10), (10**6, 5, 100, 4)])
def test_against_plain_version(spark, monkeypatch, least, top, entries, shard_rows):
    """Also with tasks that hand on their counts all the time and with many shards for each language."""
    monkeypatch.setattr(sd, "TASK_ENTRIES", entries)
    monkeypatch.setattr(sd, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(sd, "SHARD_BYTES", 40 * shard_rows)
    docs = frame(spark, rows()).withColumns({c: F.lit("mine") for c in ("term", "n", "part", "rank", "a.b", "shard")})
    got = sd.source_divergence(docs, least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows(), least, top)


def test_terms():
    assert sd.terms_of("A-b9Çd\x7fÉ [x]　y".encode()) == [t.encode() for t in ("a", "b", "Çd", "É", "x", "　y")]


def test_empty_table(spark):
    assert sd.source_divergence(frame(spark, [])).count() == 0


def test_hot_source_moves_as_counts(spark):
    """Two thirds of all rows are of one source: what tasks hand on grows with terms, not with rows."""
    docs = frame(spark, [("same words all over again", "en", "hot")] * 3000 + [(f"same words {k % 7}", "en", f"s{k % 5}") for k in range(1500)])
    counted = sd.term_counts(docs.repartition(3))
    assert counted.count() <= 3 * 6 * 6
    found = {(r["term"], r["source"]): r["n"] for r in sd.kept_counts(counted, 100_000).collect() if r["term"]}
    assert found["same", "hot"] == 3000 and found["words", "s1"] == 300


def test_large_counts_stay_exact(spark):
    """Counts whose product with the scale is beyond 64 bits."""
    n = 7_000_000_000_000
    kept = spark.createDataFrame([("en", "a", "x", n, 1), ("en", "b", "x", 3, 0), ("en", "b", "y", n + 1, 1), ("en", "a", "", 0, 0), ("en", "b", "", 0, 0)], "lang string, source string, term string, n long, lead long")
    share = lambda c, total: 1 + 1_000_000_000 * (c + 5) // (total + 10)
    value = abs(share(n, n) - share(3, n + 4)) + abs(share(0, n) - share(n + 1, n + 4))
    got = [(r["source"], r["item"], r["value"]) for r in sd.shard_shares(kept).where("part = 'pair'").groupBy("source", "item").agg(F.sum("value").alias("value")).collect()]
    assert got == [("a", "b", value)]
