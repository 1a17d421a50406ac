"""Periodic runs of words: stretches that repeat a block of words again and again, found whole and collapsed.

Two words of a run that are a period apart are equal, so the run overlaps itself, and every word of it lies in a
k-gram that occurs again in the text, where k is the shortest such overlap. Words outside repeated k-grams are masked:
no run holds one. What survives is cut into segments, and only these go through the search of Main and Lorentz, which
finds the runs that cross the middle of a block from common prefixes and suffixes and then searches both halves.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagemill import ship
from pagemill.llm.common import read_table, rolling, slices, word_hashes, words_of

#: A run has at least LEAST words and comes at least POWER times.
LEAST, POWER = 6, 4

Run = tuple[int, int, int]  # start, length, period, in words


def overlap(least: int = LEAST, power: int = POWER) -> int:
    """The fewest words that a run shares with itself moved by its period: the k of the masking k-grams."""
    return min(max(least, power * q) - q for q in range(1, least + 1))


def segments(hashes, k: int) -> list[tuple[int, int]]:
    """Stretches [start, end) of words that lie in k-grams found twice or more, from the hashes of the words.

    Equal k-grams have equal hashes, so a collision can only let more words survive, never hide a run.
    """
    import numpy as np

    grams = rolling(hashes, k)
    if len(grams) < 2:
        return []
    _, which, n = np.unique(grams, return_inverse=True, return_counts=True)
    again = np.flatnonzero(n[which] > 1)
    if not len(again):
        return []
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + k, -1)
    inside = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(turns[::2].tolist(), turns[1::2].tolist()))


def prefixes(s: list, upto: int) -> list[int]:
    """For each of the first upto places, how many elements from there on equal those from the beginning (Z values)."""
    n, left, right = len(s), 0, 0
    z = [n] + [0] * (upto - 1)
    for i in range(1, upto):
        k = z[i - left] if i < right else 0
        if i + k >= right:
            k = max(right - i, 0)
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def crossing(u: list, v: list, most: int) -> Iterator[tuple[int, int, int]]:
    """For each period up to most: (words before the middle, words after it, period) of the stretch of uv that has this
    period, crosses the middle and has a whole period behind it."""
    ahead = prefixes(v, min(most + 1, len(v)))
    gap = len(u) + 1
    back = prefixes([*reversed(u), None, *reversed(v[:most]), *reversed(u)], gap + most)
    for q in range(1, min(most, len(v)) + 1):
        yield back[gap + min(most, len(v)) - q], q + (ahead[q] if q < len(ahead) else 0), q


def main_lorentz(s: list, least: int = LEAST, power: int = POWER) -> list[Run]:
    """All runs of s, by start and period: no neighbour extends them, and each has its smallest period.

    A block answers for the runs that lie in it and cross its middle; a stretch that goes on outside the block is left to
    a larger one. Blocks with nearly no repeated element cannot hold a run and are left out with all in them. Time is
    n log n, memory is linear.
    """
    found: dict[tuple[int, int], int] = {}
    blocks, n, shared = [(0, len(s))], len(s), overlap(least, power)
    while blocks:
        low, high = blocks.pop()
        size = high - low
        if size < least or len(set(s[low:high])) > size - shared:
            continue
        middle, most = low + size // 2, size // power
        u, v = s[low:middle], s[middle:high]
        both = [(middle - a, middle + b, q) for a, b, q in crossing(u, v, most)]
        both += [(middle - b, middle + a, q) for a, b, q in crossing(v[::-1], u[::-1], most)]
        for start, end, q in both:
            whole = (start == 0 or s[start - 1] != s[start - 1 + q]) and (end == n or s[end] != s[end - q])
            if end - start >= max(least, power * q) and whole and q < found.get((start, end), n):
                found[start, end] = q
        blocks += [(low, middle), (middle, high)]
    return sorted((start, end - start, q) for (start, end), q in found.items())


def runs_of(words: list[bytes], hashes, least: int = LEAST, power: int = POWER) -> list[Run]:
    """All runs of a text given by its words and their hashes; only surviving segments are searched."""
    found = []
    for start, end in segments(hashes, overlap(least, power)):
        if end - start >= least:
            found += [(start + at, length, q) for at, length, q in main_lorentz(words[start:end], least, power)]
    return found


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if runs:
        dropped = bytearray(len(words))
        for start, length, q in runs:
            dropped[start + q : start + length] = b"\1" * (length - q)
        words = [w for w, gone in zip(words, dropped) if not gone]
    return b" ".join(words)


def collapse_runs(df: DataFrame, text: str = "text", least: int = LEAST, power: int = POWER) -> DataFrame:
    """df with its runs collapsed: text is replaced by its words joined by one space, without repetitions of a run's period;
    ``runs`` lists (start, length, period) by start and period, in words numbered from 0.

    One pass without a shuffle; whole texts, of any length, in memory that is linear in one text. A null text counts
    as empty: no runs, an empty text. Repeated rows are judged like any others, all other columns keep their
    values whatever their names, a column named runs is replaced, and an empty table gives an empty result.
    """
    ship(df.sparkSession)
    rest = [c for c in df.columns if c != text]
    row = F.struct(*([F.col(f"`{c}`") for c in rest] or [F.lit(0).alias("none_")]))
    slim = df.select(row.alias("row_"), F.col(f"`{text}`").cast("binary").alias("text_"))

    def searched(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in slices(batches):
            texts, found = [], []
            for value in b.column(1):
                raw = value.as_py()
                words = words_of(raw)
                runs = runs_of(words, word_hashes(raw), least, power) if len(words) >= least else []
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                texts.append(collapsed(words, runs))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary()), pa.array(found, kind)], ["row_", "text_", "runs_"])

    schema = StructType(slim.schema.fields + StructType.fromDDL("runs_ array<struct<start:bigint,length:bigint,period:bigint>>").fields)
    done = slim.mapInArrow(searched, schema)
    kept = [F.col("text_").cast("string").alias(c) if c == text else F.col(f"row_.`{c}`").alias(c) for c in df.columns if c.lower() != "runs"]
    return done.select(*kept, F.col("runs_").alias("runs"))


def strongest(runs: Column) -> Column:
    """Of an array of runs, the one with the greatest length by period, exactly; then smallest start, then period."""
    return F.reduce(
        runs,
        F.get(runs, F.lit(0)),
        lambda best, r: F.when(
            (r["length"] * best["period"] > best["length"] * r["period"])
            | ((r["length"] * best["period"] == best["length"] * r["period"]) & (F.struct(r["start"], r["period"]) < F.struct(best["start"], best["period"]))),
            r,
        ).otherwise(best),
    )


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where of one document in ten, chosen by the checksum of its id, the words from some place on
    repeat a block. A null id chooses none."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", hashed.alias("h"), F.when(hashed % 10 == 0, words).alias("w"))
    at = chosen.withColumn("g", F.expr("h div 10")).withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    block = at.withColumn("p", 1 + F.expr("(n - a) div (3 + g % 8)"))
    kept = F.slice("w", F.lit(1), F.col("a").cast("int"))
    again = F.transform(F.sequence(F.lit(0), (F.col("n") - F.col("a") - 1).cast("int")), lambda i: F.get("w", (F.col("a") + i % F.col("p")).cast("int")))
    return block.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(kept, again), " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with planted repetitions: the number of runs, the strongest one, digests of all runs and of the text left."""
    found = collapse_runs(planted(read_table(spark, sf_dir, "documents", "doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: A run of period q shows as a stretch of places whose 5-gram stands q words further on again.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
h AS (
  SELECT r, doc_id, w, len(w)::BIGINT AS n,
         xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i, 1))::BIGINT),
           lambda c, x: list_reduce([xor(c, x)] || range(8), lambda v, i: xor(v >> 1, 3988292384::BIGINT * (v & 1))))) AS h
  FROM d WHERE doc_id IS NOT NULL
  UNION ALL SELECT r, doc_id, w, len(w), 1 FROM d WHERE doc_id IS NULL),
a AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h),
p AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w
         ELSE w[1:a] || list_transform(range(n - a), lambda i: w[1 + a + i % (1 + (n - a) // (3 + g % 8))]) END AS w
  FROM a),
grams AS (SELECT r, i, array_to_string(w[i + 1:i + 5], ' ') AS x, n FROM (SELECT r, w, n, unnest(range(n - 4)) AS i FROM p WHERE n >= 6)),
pairs AS (
  SELECT a.r, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.r = b.r AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
islands AS (
  SELECT r, q, min(i) AS start, count(*) + q + 4 AS length
  FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs) GROUP BY r, q, island),
runs AS (SELECT r, start, length, min(q) AS period FROM islands WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
dropped AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS text
  FROM (SELECT r, unnest(w) AS word, unnest(range(n)) AS i FROM p WHERE r IN (SELECT r FROM runs)) ANTI JOIN dropped USING (r, i) GROUP BY r),
told AS (
  SELECT r, count(*) AS n_runs, arg_min({'s': start, 'l': length, 'p': period}, (-(length::HUGEINT * 1000000000000 // period), start, period)) AS b,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
  FROM runs GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.p::BIGINT AS period, (1000 * b.l // b.p)::BIGINT AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, array_to_string(w, ' '))) AS collapsed_sha256
FROM p LEFT JOIN told ON told.r = p.r LEFT JOIN kept ON kept.r = p.r
"""
