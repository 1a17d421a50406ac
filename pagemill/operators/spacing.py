"""Spaces put back into texts: a model of words counted over a corpus, and the likeliest way to cut a line into words.

Words are counted by Spark over all texts; the model holds the most frequent ones, a bounded number. Each line is cut by dynamic
programming over its characters, inside the tasks that hold the texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.adapters import correct_spacing
from pagemill.functions.text import SPACE

#: Words of the model, and characters of its longest word.
MOST_WORDS, LONGEST = 200_000, 32


def word_counts(texts: DataFrame, text: str = "text", longest: int = LONGEST) -> DataFrame:
    """``word`` and ``n``: the words of all texts, between white space, of at most longest characters. Null has none."""
    words = texts.select(F.explode(F.split(F.col(f"`{text}`"), f"{SPACE}+")).alias("word"))
    return words.where((F.col("word") != "") & (F.length("word") <= longest)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


class UnigramSpacer:
    """Cuts lines into words (a Spacer). A word costs the logarithm of its share of all words; a word that the model lacks
    costs as much as one seen half a time, and a fixed sum for each of its characters, so it is no longer than it must be.

    Spaces that a line has stay; only what stands between them is cut. Of equally likely cuts the one with the longer last
    word counts.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None, longest: int = LONGEST, letter: float = 3.0):
        self.total = max(total or sum(counts.values()), 1)
        self.cost = {w: math.log(self.total / n) for w, n in counts.items()}
        self.longest, self.letter = longest, letter

    def word_cost(self, word: str) -> float:
        known = self.cost.get(word)
        return math.log(2 * self.total) + self.letter * len(word) if known is None else known

    def words(self, text: str) -> list[str]:
        best, cut = [0.0], [0]
        for end in range(1, len(text) + 1):
            costs = [(best[start] + self.word_cost(text[start:end]), start) for start in range(max(0, end - self.longest), end)]
            cost, start = min(costs)
            best.append(cost)
            cut.append(start)
        found, end = [], len(text)
        while end:
            found.append(text[cut[end] : end])
            end = cut[end]
        return found[::-1]

    def __call__(self, line: str) -> str:
        return " ".join(" ".join(self.words(part)) for part in line.split())


def train_spacer(texts: DataFrame, text: str = "text", most: int = MOST_WORDS, longest: int = LONGEST) -> Callable[[], UnigramSpacer]:
    """What makes a spacer of the most frequent most words of texts (ties by the word), for adapters.correct_spacing().

    Shares are those of all words. The words are broadcast: at most ``most`` of at most longest characters.
    """
    counts = word_counts(texts, text, longest)
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.orderBy(F.desc("n"), "word").limit(most).collect()
    shared = texts.sparkSession.sparkContext.broadcast({r["word"]: r["n"] for r in rows})
    return lambda: UnigramSpacer(shared.value, total, longest)


def spaced(texts: DataFrame, column: str, make_spacer: Callable[[], UnigramSpacer]) -> DataFrame:
    """texts with the lines of a column cut into words; tabs between columns of a line stay. Null stays null."""
    return correct_spacing(texts, column, lambda: _by_columns(make_spacer()))


def _by_columns(spacer: UnigramSpacer) -> Callable[[str], str]:
    return lambda line: "\t".join(spacer(part) for part in line.split("\t"))
