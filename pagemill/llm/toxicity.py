"""Toxicity by classifier chains: categories are predicted one after another, each by a linear model that also
sees the probabilities of the categories before it. The later models are trained on out-of-fold probabilities."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import ship
from pagemill.llm.common import materialise, read_table, slices

#: Labelled documents that the models are trained on at most, those with the smallest hashes of their ids.
MOST_TRAINING_ROWS = 8000
FEATURES = 512
FOLDS = 3
STEPS = 150
#: Word beginnings that are features besides whole words: (length, shortest word that counts).
BEGINNINGS = ((4, 6), (5, 7), (7, 9))
_words = re.compile(r"[^\W\d_]+").findall


def features_of(text: str | None) -> tuple[Counter, int]:
    """Distinct words of a text, the number of distinct words with each beginning, and the number of distinct words."""
    distinct = set(_words((text or "").lower()))
    found = Counter(distinct)
    for length, least in BEGINNINGS:
        found.update(f"{w[:length]}*" for w in distinct if len(w) >= least)
    return found, len(distinct)


def known_features_of(text: str | None, places: dict[str, int], starts: list[tuple[int, int, frozenset]]) -> tuple[dict[int, int], int]:
    """As features_of, but only the features in places, by their number."""
    distinct = set(_words((text or "").lower()))
    found: dict[int, int] = {places[w]: 1 for w in distinct & places.keys()}
    for length, least, known in starts:
        for w in distinct:
            if len(w) >= least and w[:length] in known:
                i = places[f"{w[:length]}*"]
                found[i] = found.get(i, 0) + 1
    return found, len(distinct)


@dataclass
class ToxicityChain:
    """Trained weights: one row for each category, over the features, then the earlier categories' probabilities."""

    categories: list[str]
    features: list[str]
    weights: list = field(default_factory=list)
    threshold: float = 0.5

    def __post_init__(self):
        self.places = {f: i for i, f in enumerate(self.features)}
        self.starts = [
            (length, least, frozenset(f[:-1] for f in self.features if f[-1] == "*" and len(f) == length + 1)) for length, least in BEGINNINGS
        ]

    def matrix(self, texts: list[str | None]):
        import numpy as np

        n = len(self.features)
        x = np.zeros((len(texts), 2 * n + 2), np.float32)
        for row, text in enumerate(texts):
            found, size = known_features_of(text, self.places, self.starts)
            fill(x[row], found, size, n)
        return x

    def probabilities(self, x):
        """One column for each category, in chain order."""
        import numpy as np

        p = np.zeros((len(x), 0), np.float32)
        for w in self.weights:
            p = np.hstack([p, sigmoid(np.hstack([x, p]) @ w)[:, None]])
        return p


def fill(row, found: dict[int, int], size: int, n: int) -> None:
    """One row of the matrix: counts, counts against the length, a constant and the length."""
    for i, count in found.items():
        row[i] = math.log1p(count)
        row[n + i] = count / math.sqrt(max(size, 1))
    row[2 * n], row[2 * n + 1] = 1.0, math.log1p(size) / 5


def sigmoid(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x, y, penalty: float = 1.0, steps: int = STEPS, rate: float = 0.1, rows=None):
    """Weights of a logistic regression with a ridge penalty, by gradient descent with moment estimates.

    rows: which rows count (a mask), so that a fold is left out without a copy; all by default.
    """
    import numpy as np

    n = len(y) if rows is None else int(rows.sum())
    w = np.zeros(x.shape[1], np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        error = sigmoid(x @ w) - y
        slope = (x.T @ (error if rows is None else error * rows) + penalty * w) / max(n, 1)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
        w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w.astype(np.float32)


def training_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], most: int = MOST_TRAINING_ROWS) -> DataFrame:
    """``text``, the categories as 0 or 1, and ``fold``: at most most labelled documents, the same at every run.

    Repeated labels of a document count as the larger value; null ids and null labels are left out. Equal texts
    share a fold.
    """
    flags = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(c.cast("int")).alias(k) for k, c in categories.items()])
    chosen = flags.na.drop().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most most rows
    return rows.orderBy(F.xxhash64("doc_id", "text")).limit(most).select("text", *categories, F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))


def select_features(rows: DataFrame, categories: list[str], most: int = FEATURES) -> list[str]:
    """The features most associated with any category (by the chi-square of presence), in a fixed order."""

    def listed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches):
            found = [list(features_of(t)[0]) for t in b.column(0).to_pylist()]
            at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([w for f in found for w in f], pa.string()), *(b.column(k + 1).take(at) for k in range(len(categories)))], ["feature", *categories])

    present = rows.select("text", *categories).mapInArrow(listed, f"feature string, {', '.join(f'{c} int' for c in categories)}")
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    n = sums["n"]
    if not n:
        return []
    counts = present.groupBy("feature").agg(F.count(F.lit(1)).alias("f"), *[F.sum(c).alias(c) for c in categories]).where("f >= 3")

    def chi(c: str) -> Column:
        total = float(sums[c] or 0)
        gap = F.col(c) * n - F.col("f") * total
        return gap * gap / F.greatest(F.col("f") * (n - F.col("f")) * total * (n - total), F.lit(1.0))

    best = counts.select("feature", F.greatest(*[chi(c) for c in categories], F.lit(0.0)).alias("chi"))
    return sorted(r["feature"] for r in best.orderBy(F.desc("chi"), "feature").limit(most).collect())


def train_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], most: int = MOST_TRAINING_ROWS) -> ToxicityChain:
    """Train the chain on a bounded sample; the last category decides, by the threshold of the best out-of-fold F1.

    Without labelled rows the chain rejects nothing.
    """
    import numpy as np

    ship(docs.sparkSession)
    rows = materialise(training_rows(docs, labels, categories, most), "toxicity-rows")
    names = list(categories)
    chain = ToxicityChain(names, select_features(rows, names))
    flags = f"fold int, {', '.join(f'{c} int' for c in names)}"
    places, starts, n = chain.places, chain.starts, len(chain.features)

    def sparse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches):
            got = [known_features_of(t, places, starts) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(f) for f, _ in got], pa.list_(pa.int32())), pa.array([list(f.values()) for f, _ in got], pa.list_(pa.int32())), pa.array([s for _, s in got], pa.int32()), *(b.column(k) for k in range(1, len(names) + 2))],
                ["at", "count", "size", "fold", *names],
            )

    sample = rows.select("text", "fold", *names).mapInArrow(sparse, f"at array<int>, count array<int>, size int, {flags}").toArrow()  # at most most rows
    of = lambda c: sample[c].combine_chunks().to_numpy(zero_copy_only=False)
    x = np.zeros((sample.num_rows, 2 * n + 2 + len(names)), np.float32)  # the last columns are for the earlier categories
    lists = [sample[c].combine_chunks() for c in ("at", "count")]
    owner = np.repeat(np.arange(sample.num_rows), np.diff(lists[0].offsets.to_numpy()))
    at, count = (column.flatten().to_numpy() for column in lists)
    size = np.maximum(of("size"), 0)
    x[owner, at] = np.log1p(count)
    x[owner, n + at] = count / np.sqrt(np.maximum(size, 1))[owner]
    x[:, 2 * n], x[:, 2 * n + 1] = 1.0, np.log1p(size) / 5
    y = np.stack([of(c) for c in names], 1).astype(np.float32)
    fold = of("fold")
    if not sample.num_rows:
        chain.weights = [np.zeros(2 + k, np.float32) for k in range(len(names))]
        chain.threshold = 1.0
        return chain
    del sample, lists, owner, at, count
    for k in range(len(names)):
        seen = x[:, : 2 * n + 2 + k]
        chain.weights.append(logistic(seen, y[:, k]))
        held_out = np.zeros(len(x), np.float32)
        for f in range(FOLDS):
            out = fold == f
            if out.any():
                held_out[out] = sigmoid(seen[out] @ logistic(seen, y[:, k], rows=~out))
        x[:, 2 * n + 2 + k] = held_out
    chain.threshold = best_threshold(x[:, -1], y[:, -1])
    return chain


def best_threshold(p, y) -> float:
    """The threshold with the greatest F1 (the middle one of equally good ones); 1.0 if nothing is positive."""
    if not y.sum():
        return 1.0
    tried = [t / 100 for t in range(5, 96)]
    scores = [2 * ((p >= t) & (y == 1)).sum() / max((p >= t).sum() + y.sum(), 1) for t in tried]
    best = [t for t, s in zip(tried, scores, strict=True) if s == max(scores)]
    return best[len(best) // 2]


def score_toxicity(docs: DataFrame, chain: ToxicityChain, keep: list[str] | None = None) -> DataFrame:
    """docs (or their columns in keep) with ``p_<category>`` for each category and ``rejected``.

    Columns of these names, in any case, are replaced; all others stay, whatever their names. A null text counts as empty,
    repeated rows are scored alike, an empty table gives an empty result. One pass, no shuffle.
    """
    ship(docs.sparkSession)
    added = [f"p_{c}" for c in chain.categories]
    replaced = {c.lower() for c in (*added, "rejected")}
    kept = [c for c in keep or docs.columns if c.lower() not in replaced]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, T.DoubleType()) for c in added] + [T.StructField("rejected", T.BooleanType())])

    at = kept.index("text") if "text" in kept else len(kept)  # the text travels once

    def scored(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches):
            p = chain.probabilities(chain.matrix(b.column(at).to_pylist()))
            made = [pa.array(p[:, k].astype("float64")) for k in range(len(added))] + [pa.array(p[:, -1] >= chain.threshold)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(kept))), *made], schema.fieldNames())

    places = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)]  # Spark passes no dotted names to Python
    return docs.select(*places, *([] if "text" in kept else ["text"])).mapInArrow(scored, schema)


def label_categories() -> dict[str, Column]:
    """Categories from the labels: toxic running text, toxic junk, and toxic at all, which decides."""
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    return {"toxic_prose": toxic & good, "toxic_junk": toxic & ~good, "toxic": toxic}


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a chain that is trained on the labelled ones."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    chain = train_chain(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), label_categories())
    return score_toxicity(docs, chain, keep=["doc_id"])
