"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import join_by_key, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``id`` and ``label`` (the smallest id of its component) for every id in edges (a, b, both long).

    Each round hangs the larger neighbours of every vertex, then its smaller ones, below their minimum, until
    nothing changes, which takes a number of rounds that grows with the logarithm of the longest path. Rounds are written to the
    shared folder. A vertex with very many neighbours does not fill a task: minima are pre-aggregated, and
    join_by_key brings them back.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialise(now, "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hung = _with_minimum(both, 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        hung = materialise(hung, "large-star")
        lower = _with_minimum(hung, 2 * state[0])
        lower = lower.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v")))
        now = materialise(lower.where("u <> v").distinct(), "small-star")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())


def _with_minimum(pairs: DataFrame, total: int) -> DataFrame:
    minima = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return join_by_key(pairs, minima, "u", "n", total).drop("n")


def _state(pairs: DataFrame) -> tuple:
    """Number and checksum of the pairs; equal for equal sets of pairs."""
    r = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]
