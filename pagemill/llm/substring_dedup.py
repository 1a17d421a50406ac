"""Exact substring deduplication: FM-indexes per shard, backward search over wavelet matrices, matching statistics.

A window of ``width`` words that starts in two places has the same smallest gram hash in both, so stretches of
windows are routed to shards by that hash and every shard can be searched alone. Stretches whose hash is found
once only are never shipped. In a shard an FM-index of all its stretches is built and the stretches are streamed
against it backwards; stretches of windows with two occurrences or more are the intervals reported.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import ship
from pagemill.llm.common import join_by_key, materialise, read_table, rolling, rows_of_repeated_keys, slices, word_hashes, words_of

WIDTH = 35
#: Words of the grams whose smallest hash routes a window.
GRAM = 8
#: Windows of a stretch at most; longer runs of one hash are cut into several stretches.
STRETCH = 64
#: Words that one index should hold.
SHARD_WORDS = 1_000_000
#: Stretches of one hash that a task can hold, with the index of them all if no two are equal (3 million words or so).
#: Stretches of more frequent hashes are routed again, window by window (see frequent_windows); the results are the same.
FREQUENT = 50_000
#: Bits of the hash that routes such a window.
ROUTE_BITS = 64
_KEYS = ["k1", "k2"]


def stretches(hashes, width: int = WIDTH, gram: int = GRAM):
    """Runs of consecutive windows with one smallest gram hash: that hash, first and last window start, and whether
    the gram stands in the run more than once (then windows of the run may equal each other)."""
    import numpy as np

    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    grams = rolling(hashes, gram)
    low, span, left = grams, 1, width - gram + 1
    while span * 2 <= left:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[left - span : left - span + n])
    first = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [n - 1]])
    parts = (last - first) // STRETCH + 1
    if parts.max() > 1:
        again = np.repeat(np.arange(len(first)), parts)
        step = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
        first = first[again] + step * STRETCH
        last = np.minimum(first + STRETCH - 1, last[again])
    route = low[first]
    ordered = np.sort(grams)
    if not (ordered[1:] == ordered[:-1]).any():
        return route, first, last, np.zeros(len(first), bool)
    values, number = np.unique(grams, return_inverse=True)
    places = np.sort(number * len(grams) + np.arange(len(grams)))
    own = np.searchsorted(values, route) * len(grams)
    inside = np.searchsorted(places, own + last + left) - np.searchsorted(places, own + first)
    return route, first, last, inside > 1


class WaveletMatrix:
    """Rank queries on a sequence of symbols: one packed bit vector for each bit of the symbols, counts by 64 bits."""

    def __init__(self, sequence, symbols: int):
        import numpy as np

        self.levels = []
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bits = (sequence >> bit) & 1
            packed = np.packbits(bits.astype(np.uint8), bitorder="little")
            words = np.zeros(len(bits) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            zeros = int(len(bits) - bits.sum())
            self.levels.append((bit, words, before, zeros))
            sequence = np.concatenate([sequence[bits == 0], sequence[bits == 1]])
        self.first = self._walk(np.arange(symbols), np.zeros(symbols, np.int64))

    def _walk(self, symbol, at):
        import numpy as np

        one = np.uint64(1)
        for bit, words, before, zeros in self.levels:
            word = at >> 6
            ones = before[word] + np.bitwise_count(words[word] & ((one << (at & 63).astype(np.uint64)) - one))
            at = np.where((symbol >> bit) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol, at):
        """How often each symbol occurs before the place at, for arrays of both."""
        return self._walk(symbol, at) - self.first[symbol]


class FMIndex:
    """An FM-index of a text of numbers (0 separates pieces), and its suffixes grouped by their first width-1 symbols.

    Suffixes are sorted by prefix doubling as far as patterns of width symbols need.
    """

    def __init__(self, text, width: int = WIDTH):
        import numpy as np

        n = len(text)
        self.size, self.text, self.width = n, text, width
        ranks, depth = {1: text.astype(np.int64)}, 1
        rank = ranks[1]
        while True:
            later = np.zeros(n, np.int64)
            later[: max(n - depth, 0)] = rank[depth:] + 1
            key = rank * (int(later.max()) + 1) + later
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            depth *= 2
            rank = ranks[depth] = new
            if depth > width:
                break
        suffixes = order
        # two suffixes agree in width-1 symbols if they agree in the parts of that length, by powers of two
        same, at, left = np.ones(n - 1, bool), 0, width - 1
        for part in sorted(ranks, reverse=True):
            if part <= left:
                known = np.concatenate([ranks[part], np.full(width, -1, np.int64)])
                value = known[suffixes + at]
                same &= value[1:] == value[:-1]
                at, left = at + part, left - part
        heads = np.flatnonzero(np.concatenate([[True], ~same]))
        group = np.cumsum(np.concatenate([[True], ~same])) - 1
        self.group_start, self.group_end = heads[group], np.concatenate([heads[1:], [n]])[group]
        symbols = int(text.max()) + 1
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])[:-1]
        self.wavelet = WaveletMatrix(text[suffixes - 1], symbols)

    def repeated(self, begin, end):
        """Starts of the windows inside the pieces [begin, end) of the text that occur twice or more in it.

        Each piece is searched backwards. A state is the interval of suffixes that begin with the d symbols read
        last, d < width. A symbol that leaves two suffixes or more extends it; at width symbols the window is
        reported and the state falls back to its first width-1 symbols. If one suffix is left, no window across
        the d+1 symbols repeats, and the search starts again before the last of them.
        """
        import numpy as np

        found, width = [], self.width
        lanes = np.flatnonzero(end - begin >= width)
        begin, i = begin[lanes], end[lanes] - 1
        low, high, d = np.zeros(len(i), np.int64), np.full(len(i), self.size, np.int64), np.zeros(len(i), np.int64)
        while len(i):
            c = self.text[i]
            base = self.below[c]
            both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([low, high]))
            low2, high2 = base + both[: len(i)], base + both[len(i) :]
            more = high2 - low2 >= 2
            whole = more & (d == width - 1)
            found.append(i[whole])
            low, high = np.where(more, low2, 0), np.where(more, high2, self.size)
            if whole.any():
                at = low[whole]
                low[whole], high[whole] = self.group_start[at], self.group_end[at]
            stop = i + d
            i = np.where(more, i - 1, stop - 1)
            d = np.where(more, np.where(whole, d, d + 1), 0)
            stay = (i >= begin) & np.where(more, True, stop - begin >= width)
            if not stay.all():
                begin, i, low, high, d = begin[stay], i[stay], low[stay], high[stay], d[stay]
        return np.concatenate(found) if found else np.empty(0, np.int64)


def runs_of(starts, width: int) -> list[tuple[int, int]]:
    """Intervals of words that windows at these ascending starts cover."""
    out: list[list[int]] = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1][1] = s + width
        else:
            out.append([s, s + width])
    return [(a, z) for a, z in out]


def search_shard(rows: list[dict], width: int = WIDTH) -> list[tuple]:
    """For the stretches of a shard (k1, k2, first, words, and copies if not 1): the intervals of each that repeat in the shard.

    Equal stretches are indexed once. They repeat as a whole, so only stretches that came once are streamed.
    """
    import numpy as np

    distinct: dict[bytes, int] = {}
    of = [distinct.setdefault(r["words"], len(distinct)) for r in rows]
    number: dict[bytes, int] = {}
    pieces = [np.array([number.setdefault(w, len(number) + 1) for w in words.split(b" ")] + [0], np.int64) for words in distinct]
    sizes = np.array([len(p) for p in pieces])
    begin = np.cumsum(sizes) - sizes
    single = np.bincount(of, [r.get("copies", 1) for r in rows]) == 1
    spans: list[list[tuple[int, int]]] = [[] if once else [(0, int(n) - 1)] for once, n in zip(single, sizes, strict=True)]
    if single.any():
        starts = np.sort(FMIndex(np.concatenate(pieces), width).repeated(begin[single], (begin + sizes - 1)[single]))
        owner = np.searchsorted(begin, starts, side="right") - 1
        cuts = np.flatnonzero(np.diff(owner)) + 1
        for group, part in zip(np.split(owner, cuts), np.split(starts, cuts), strict=True):
            if len(group):
                spans[group[0]] = runs_of((part - begin[group[0]]).tolist(), width)
    return [(r["k1"], r["k2"], r["first"] + a, r["first"] + z) for r, k in zip(rows, of, strict=True) for a, z in spans[k]]


def grouped_rows(batches: Iterator, key: str) -> Iterator[list[dict]]:
    """The rows of sorted batches, one list for each value of the key."""
    value, waiting = None, []
    for b in slices(batches):
        for r in b.to_pylist():
            if r[key] != value:
                if waiting:
                    yield waiting
                value, waiting = r[key], []
            waiting.append(r)
    if waiting:
        yield waiting


def keyed_documents(docs: DataFrame) -> DataFrame:
    """doc_id and text with a key of 96 bits that is never null: rows of one key are equal in both."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2"))


def find_stretches(keyed: DataFrame, width: int) -> DataFrame:
    """k1, k2, ``route`` (hash), ``first`` and ``last`` (window starts) and ``own`` (see stretches) of all stretches."""

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in slices(batches):
            found = [stretches(word_hashes(t), width) for t in b.column(2).to_pylist()]
            if not found:
                continue
            at = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            route, first, last, own = (np.concatenate([f[k] for f in found]) for k in range(4))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(route.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(own)],
                ["k1", "k2", "route", "first", "last", "own"],
            )

    return keyed.select(*_KEYS, "text").mapInArrow(cut, "k1 long, k2 int, route long, first int, last int, own boolean")


def repeated_intervals(keyed: DataFrame, dealt: DataFrame, width: int = WIDTH) -> DataFrame:
    """``k1``, ``k2`` and ``spans`` (start and end of words) for documents with windows that start twice or more.

    keyed: keyed_documents(); dealt: the same, dealt by the keys. Stretches of hashes that more than FREQUENT of them share
    (a passage in very many documents) are routed by the words of their windows instead.
    """
    spark = keyed.sparkSession
    ship(spark)
    all_ = materialise(find_stretches(keyed, width), "stretches")
    shared = rows_of_repeated_keys(all_, "route", "n", "routes")
    shared = shared.unionByName(all_.where("own").withColumn("n", F.lit(1).cast("long")))
    wanted = materialise(shared.groupBy(*_KEYS).agg(F.collect_set(F.struct("first", "last", "route", (F.col("n") > FREQUENT).alias("frequent"))).alias("cuts")), "cuts")
    often = F.filter("cuts", lambda c: c["frequent"])
    rare = F.filter("cuts", lambda c: ~c["frequent"] & ~F.exists(often, lambda o: o["first"] == c["first"]))
    n_words = F.aggregate(rare, F.lit(0).cast("long"), lambda n, c: n + c["last"] - c["first"] + width)
    sums = wanted.agg(F.sum(n_words), F.max(F.size(often))).first()
    shards = max(1, -(-(sums[0] or 0) // SHARD_WORDS))

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches):
            rows = []
            for k1, k2, text, cuts in zip(*(b.column(k).to_pylist() for k in range(4))):
                words = words_of(text)
                rows += [(k1, k2, c["route"], c["first"], b" ".join(words[c["first"] : c["last"] + width])) for c in cuts]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["k1", "k2", "route", "first", "words"])

    def searched(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        for rows in grouped_rows(batches, "shard"):
            found = search_shard(rows, width)
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], ["k1", "k2", "start", "end"])

    # doc_id is kept so that this reads the very exchange that remove_repeats reads: documents move once
    chosen = dealt.join(wanted.select(*_KEYS, rare.alias("cuts")).where(F.size("cuts") > 0), _KEYS).select(*_KEYS, "text", "cuts", "doc_id")
    routed = chosen.mapInArrow(pieces, "k1 long, k2 int, route long, first int, words binary")
    routed = routed.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)).cast("int")).drop("route").repartition("shard").sortWithinPartitions("shard")
    spans = routed.mapInArrow(searched, "k1 long, k2 int, start int, end int")
    if (sums[1] or 0) > 0:
        spans = spans.unionByName(frequent_windows(keyed, wanted.select(*_KEYS, often.alias("cuts")).where(F.size("cuts") > 0), width))
    return spans.groupBy(*_KEYS).agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def frequent_windows(keyed: DataFrame, cuts: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """``k1``, ``k2``, ``start``, ``end`` of the windows in cuts (first and last starts, by document) that start twice or more.

    Each window is routed by a hash of all its words. Only windows whose hash is found twice bring their words, and equal
    ones are put together before they move, with their number, so a passage of very many documents is one piece. An
    FM-index of the distinct pieces of a shard decides which repeat. Where all pieces of a hash agree,
    which they do unless different windows share it, its windows are known by the hash; else those are routed again
    with another seed. So nothing depends on a hash being free of collisions.
    """
    mask = (1 << ROUTE_BITS) - 1
    slim = materialise(keyed.join(cuts, _KEYS).select(*_KEYS, "text", "cuts"), "frequent-texts")

    def hashed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for b in slices(batches):
            at, starts, routes = [], [], []
            for k, (text, found) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                words = words_of(text)
                own = [s for c in found for s in range(c["first"], c["last"] + 1)]
                at += [k] * len(own)
                starts += own
                routes += [xxhash.xxh3_64_intdigest(b" ".join(words[s : s + width]), seed) & mask for s in own]
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(rows), b.column(1).take(rows), pa.array(starts, pa.int32()), pa.array(np.array(routes, np.uint64).view(np.int64))], ["k1", "k2", "start", "route"]
            )

    windows = materialise(slim.mapInArrow(hashed, "k1 long, k2 int, start int, route long"), "frequent-windows")
    windows = materialise(rows_of_repeated_keys(windows, "route", "n", "frequent"), "frequent-repeated")
    wanted = windows.groupBy(*_KEYS).agg(F.collect_set(F.struct("start", "route")).alias("own"))

    def brought(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches, 50):
            routes, pieces = [], []
            for text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(text)
                routes += [w["route"] for w in own]
                pieces += [b" ".join(words[w["start"] : w["start"] + width]) for w in own]
            yield pa.RecordBatch.from_arrays([pa.array(routes, pa.int64()), pa.array(pieces, pa.binary())], ["route", "words"])

    pieces = slim.join(wanted, _KEYS).select("text", "own").mapInArrow(brought, "route long, words binary").groupBy("route", "words").agg(F.count(F.lit(1)).alias("copies"))
    pieces = materialise(pieces, "frequent-pieces")
    shards = max(1, -(-pieces.count() * width // SHARD_WORDS))

    def searched(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for rows in grouped_rows(batches, "shard"):
            found = {f[0] for f in search_shard([r | {"k1": k, "k2": 0, "first": 0} for k, r in enumerate(rows)], width)}
            yield pa.RecordBatch.from_arrays([pa.array([r["route"] for r in rows], pa.int64()), pa.array([k in found for k in range(len(rows))])], ["route", "again"])

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)).cast("int")).repartition("shard").sortWithinPartitions("shard")
    judged = dealt.mapInArrow(searched, "route long, again boolean").groupBy("route").agg(F.bool_and("again").alias("all"), F.bool_or("again").alias("any"))
    judged = materialise(judged.where("any"), "frequent-judged")
    counts = windows.groupBy("route").agg(F.count(F.lit(1)).alias("n_route"))
    met = join_by_key(windows.drop("n"), judged.join(counts, "route"), "route", "n_route", windows.count())
    out = met.where("all").select(*_KEYS, "start", (F.col("start") + width).alias("end"))
    mixed_up = judged.where("not all")
    if mixed_up.isEmpty():
        return out
    again = met.where("not all").groupBy(*_KEYS).agg(F.collect_set(F.struct(F.col("start").alias("first"), F.col("start").alias("last"))).alias("cuts"))
    return out.unionByName(frequent_windows(keyed, materialise(again, "frequent-cuts"), width, seed + 1))


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """For every row of docs (doc_id, text): ``n_words``, ``n_removed`` and ``kept`` (the words kept, joined by one space).

    Removed is each word covered by a window of width words whose words also start anywhere else, the same text
    included; windows are judged on the input. A null or empty text has no words; texts of fewer than width words
    stay as they are; repeated rows count as separate texts.
    """
    keyed = keyed_documents(docs)
    dealt = keyed.repartition(*_KEYS)
    spans = repeated_intervals(keyed, dealt, width)
    joined = dealt.join(spans, _KEYS, "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind)]).add("n_words", "long").add("n_removed", "long").add("kept", "binary")

    def kept(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches):
            rows = []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = words_of(text)
                n, at, parts = len(words), 0, []
                for a, z in sorted((s["start"], s["end"]) for s in found or ()):
                    parts += words[at:a]
                    at = max(at, z)
                parts += words[at:]
                rows.append((n, n - len(parts), b" ".join(parts)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return joined.mapInArrow(kept, schema)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated stretches, as digests of what is kept."""
    out = remove_repeats(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS (SELECT r, unnest(range(1, len(w) - 33)) AS k, w FROM d),
named AS (SELECT r, k, array_to_string(w[k:k + 34], ' ') AS x FROM windows),
repeated AS (SELECT r, k FROM named QUALIFY count(*) OVER (PARTITION BY x) > 1),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
last AS (SELECT words.r, p, word, max(repeated.k) OVER (PARTITION BY words.r ORDER BY p) AS k FROM words LEFT JOIN repeated ON repeated.r = words.r AND repeated.k = p),
kept AS (SELECT r, count(*) FILTER (WHERE k >= p - 34) AS removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE k IS NULL OR k < p - 34) AS text FROM last GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.r = d.r
"""
