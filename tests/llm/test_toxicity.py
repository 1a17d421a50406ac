import random

from pyspark.sql import functions as F

from pagemill.llm import toxicity


def corpus(n, seed):
    draw = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = [f"{draw.choice('abcdefgh')}word{chr(97 + draw.randrange(26))}" for _ in range(draw.randrange(5, 120))]
        toxic = k % 5 == 0
        for _ in range(draw.randrange(1, 4) if toxic else 0):
            words.insert(draw.randrange(len(words)), draw.choice(["Villain", "rotten", "nastyish" + chr(97 + draw.randrange(26))]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 10 != 0), int(toxic)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark, documents):
    rows, labels = corpus(900, 1)
    train = spark.createDataFrame([*labels[:600], (None, 1, 1), (5, None, None), (3, 1, 0)], LABELS)
    chain = toxicity.train_chain(documents(*rows), train, toxicity.label_categories())
    assert chain.categories == ["toxic_prose", "toxic_junk", "toxic"] and 0 < chain.threshold < 1
    assert [len(w) - len(chain.weights[0]) for w in chain.weights] == [0, 1, 2]  # each sees the categories before it
    got = {r["doc_id"]: r["rejected"] for r in toxicity.score_toxicity(documents(*rows), chain).collect()}
    held_out = [(got[k], bool(t)) for k, _, t in labels[600:]]
    caught = sum(g and t for g, t in held_out)
    assert caught >= 0.95 * sum(t for _, t in held_out) and sum(g and not t for g, t in held_out) <= 3
    again = toxicity.train_chain(documents(*rows), train, toxicity.label_categories())
    assert again.features == chain.features and again.threshold == chain.threshold


def test_odd_rows(spark, documents, odd):
    docs = documents(*odd, (None, "x")).withColumn("rejected", F.lit("clash"))
    nothing = toxicity.train_chain(docs, spark.createDataFrame([], LABELS), toxicity.label_categories())
    scored = toxicity.score_toxicity(docs, nothing).collect()
    assert len(scored) == len(odd) + 1 and not any(r["rejected"] for r in scored)
    clean = toxicity.train_chain(docs, spark.createDataFrame([(4, 1, 0), (5, 1, 0)], LABELS), toxicity.label_categories())
    assert not any(r["rejected"] for r in toxicity.score_toxicity(docs, clean).collect())
    assert toxicity.score_toxicity(docs.limit(0), clean).count() == 0


def test_known_features_agree():
    text = "Alphabet alphabets ALPHA beta betamax betamaxes é"
    found, size = toxicity.features_of(text)
    chain = toxicity.ToxicityChain(["toxic"], sorted(found))
    known, again = toxicity.known_features_of(text, chain.places, chain.starts)
    assert size == again and {chain.features[i]: n for i, n in known.items()} == dict(found)


def test_chain_against_plain_training(spark, documents):
    """The chain trained step by step here: each model on the features and the out-of-fold probabilities before it."""
    import numpy as np

    rows, labels = corpus(120, 2)
    docs, table = documents(*rows), spark.createDataFrame(labels, LABELS)
    categories = toxicity.label_categories()
    chain = toxicity.train_chain(docs, table, categories)
    flags = {k: ((t == 1) & (q == 1), (t == 1) & (q != 1), t == 1) for k, q, t in labels}
    fold = {r["text"]: r["fold"] for r in toxicity.training_rows(docs, table, categories).collect()}
    x = np.array([plain_features(t, chain.features) for _, t in rows], np.float32)
    y, folds = np.array([flags[k] for k, _ in rows], np.float32), np.array([fold[t] for _, t in rows])
    before = np.zeros((len(rows), 0), np.float32)
    for k, weights in enumerate(chain.weights):
        seen = np.hstack([x, before])
        assert np.allclose(weights, toxicity.logistic(seen, y[:, k]), atol=0.02)
        held = np.zeros(len(rows), np.float32)
        for f in set(folds.tolist()):
            held[folds == f] = 1 / (1 + np.exp(-(seen[folds == f] @ toxicity.logistic(seen[folds != f], y[folds != f, k]))))
        before = np.hstack([before, held[:, None]])
    assert abs(chain.threshold - toxicity.best_threshold(before[:, -1], y[:, -1])) < 0.06


def plain_features(text, features):
    """Counts of the features in the distinct words, the same against their number, a constant, the number of words."""
    words = {w.lower() for w in text.split()}
    n = [sum(len(w) >= least and w.startswith(f[:-1]) for w in words for length, least in toxicity.BEGINNINGS if length == len(f) - 1) if f[-1] == "*" else int(f in words) for f in features]
    import math

    return [*map(math.log1p, n), *(k / math.sqrt(len(words)) for k in n), 1.0, math.log1p(len(words)) / 5]


def test_logistic_is_stationary():
    """With enough steps the slope of the penalised likelihood vanishes."""
    import numpy as np

    draw = np.random.default_rng(3)
    x = np.hstack([draw.normal(size=(200, 4)), np.ones((200, 1))]).astype(np.float32)
    y = (x[:, 0] - 0.5 * x[:, 1] + draw.normal(size=200) > 0).astype(np.float32)
    w = toxicity.logistic(x, y, steps=3000, rate=0.02)
    slope = x.T @ (toxicity.sigmoid(x @ w) - y) + w
    assert np.abs(slope).max() < 0.1


def test_columns_of_any_name(spark, documents):
    docs = documents("some text", None, "", "x " * 3000).withColumnsRenamed({"n_chars": "a.b", "source": "Rejected"})
    chain = toxicity.train_chain(docs.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, quality int, toxic int"), toxicity.label_categories())
    got = toxicity.score_toxicity(docs, chain)
    assert got.columns == ["doc_id", "text", "lang", "a.b", "p_toxic_prose", "p_toxic_junk", "p_toxic", "rejected"]
    assert sorted(r["a.b"] or 0 for r in got.where("not rejected").collect()) == [0, 0, 9, 6000]
