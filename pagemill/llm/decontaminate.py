"""Benchmark decontamination with a distributed positional inverted index.

Training postings are stored for the terms that the test items need, the offset-adjusted lists of each test
window's rarest terms are intersected, and what is left is confirmed word by word in the documents.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import ship
from pagemill.llm.common import KEYS, join_texts, materialise, read_table, slices, unnested
from pagemill.llm.url_filter import ascii_lower

WINDOW = 13
#: Rarest terms of a window whose postings are intersected.
ANCHORS = 2
#: Term sets up to this size travel to the workers; beyond it all terms are indexed and joins shuffle.
MOST_TERMS = 500_000
#: Candidates in bytes, and texts with hits in rows of some 120 bytes, that are broadcast at most; beyond, the joins shuffle.
BROADCAST_BYTES, BROADCAST_ROWS = 32 << 20, 200_000
#: Characters that separate words once A-Z are lower-case (fixed by the definition of a word).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def index_words(text: str | bytes | None) -> list[bytes]:
    """Words of a text: runs of ASCII letters (lower-cased), digits and all non-ASCII characters; none for null."""
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(_TABLE).split()


def test_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The distinct windows of the items: ``window`` (its words joined by one space), ``words``, ``items``.

    A window is size consecutive words; an item of fewer words, but not none, is one window. Items with a null
    text give none; a null item_id is not listed in items. items is sorted and made of strings.
    """
    words = F.filter(F.split(ascii_lower(F.coalesce("text", F.lit(""))), SEPARATORS), lambda w: w != "")
    split = items.select(F.col("item_id").cast("string").alias("item_id"), words.alias("all")).where(F.size("all") > 0)
    each = split.select(
        "item_id",
        F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("all") - size + 1, F.lit(1))), lambda i: F.slice("all", i, size))).alias("words"),
    )
    return each.groupBy(F.array_join("words", " ").alias("window")).agg(F.first("words").alias("words"), F.sort_array(F.collect_set("item_id")).alias("items"))


def _terms_within_bound(terms: DataFrame) -> frozenset[bytes] | None:
    """The terms, if there are few enough to send to every worker; else None."""
    found = terms.distinct().limit(MOST_TERMS + 1).collect()
    return frozenset(r[0].encode() for r in found) if len(found) <= MOST_TERMS else None


def term_counts(docs: DataFrame, terms: frozenset[bytes] | None) -> DataFrame:
    """How often each of the terms (all if None) occurs in docs.text: ``term``, ``n``."""

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n: Counter = Counter()
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                words = index_words(text)
                n.update(words if terms is None else filter(terms.__contains__, words))
            if len(n) > 200_000:
                yield pa.RecordBatch.from_pydict({"term": [w.decode() for w in n], "n": list(n.values())}, schema=schema)
                n.clear()
        yield pa.RecordBatch.from_pydict({"term": [w.decode() for w in n], "n": list(n.values())}, schema=schema)

    import pyarrow as pa

    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])
    return docs.select(F.col("text").cast("binary")).mapInArrow(counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def rarest_terms(windows: DataFrame, counts: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """For each window (its number wid) its rarest terms by counts: ``wid``, ``anchor`` (from 0), ``term``, ``offset``, ``anchors``.

    A term that does not occur counts 0: then the window cannot occur, and it is left out.
    """
    placed = windows.select("wid", F.posexplode("words").alias("offset", "term")).groupBy("wid", "term").agg(F.min("offset").alias("offset"))
    known = placed.join(counts, "term", "left").groupBy("wid").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))).alias("ranked")
    )
    best = known.where(F.get("ranked", F.lit(0))["n"] > 0).select("wid", F.slice("ranked", 1, anchors).alias("best"))
    return best.select("wid", F.size("best").alias("anchors"), F.posexplode("best").alias("anchor", "b")).select(
        "wid", "anchor", "b.term", "b.offset", "anchors"
    )


def positional_index(docs: DataFrame, terms: frozenset[bytes] | None, keys: list[str]) -> DataFrame:
    """Postings of docs: the key columns, ``term`` and ``positions`` (ascending, from 0), for terms (all if None)."""
    key_schema = docs.select(*keys).schema
    schema = T.StructType([*key_schema.fields, T.StructField("term", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])

    def indexed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches):
            rows, found, places = [], [], []
            for i, text in enumerate(b.column(len(keys)).to_pylist()):
                words = index_words(text)
                lists: dict[bytes, list[int]] = {}
                for p, w in enumerate(words) if terms is None else [(p, w) for p, w in enumerate(words) if w in terms]:
                    lists.setdefault(w, []).append(p)
                rows += [i] * len(lists)
                found += [w.decode() for w in lists]
                places += lists.values()
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k).take(at) for k in range(len(keys))), pa.array(found, pa.string()), pa.array(places, pa.list_(pa.int32()))],
                schema.fieldNames(),
            )

    return docs.select(*keys, F.col("text").cast("binary").alias("text")).mapInArrow(indexed, schema)


def intersect(index: DataFrame, anchors: DataFrame, keys: list[str], slop: int = 0) -> DataFrame:
    """Where the rarest terms of a window stand as in the window: the keys, ``wid``, ``start``.

    Positions are adjusted by the term's offset, so that an exact phrase has equal starts for all its terms. With a
    slop, each term may stand slop words off its place, so starts may differ from that of the rarest term (which is
    given) by twice as many. Anchors are counted once, however many rows of docs have the same keys.
    """
    starts = index.join(anchors, "term").select(*keys, "wid", "anchor", "anchors", F.explode("positions").alias("p"), "offset")
    starts = starts.select(*keys, "wid", "anchor", "anchors", (F.col("p") - F.col("offset")).alias("start"))
    if not slop:
        grouped = starts.where("start >= 0").groupBy(*keys, "wid", "start")
        seen = F.expr("bit_count(bit_or(shiftleft(1L, anchor)))").alias("n")
        return grouped.agg(seen, F.first("anchors").alias("anchors")).where("n = anchors").drop("n", "anchors")
    reach = 2 * slop
    cell = F.floor(F.col("start") / (reach + 1))
    base = starts.where("anchor = 0").withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    rest = starts.select(*keys, "wid", F.col("anchor").alias("other"), F.col("start").alias("at"), cell.alias("cell"))
    rest = rest.withColumnsRenamed({k: f"r{k}" for k in (*keys, "wid", "cell")})
    on = [*[F.col(k).eqNullSafe(F.col(f"r{k}")) for k in keys], F.col("wid") == F.col("rwid"), F.col("cell") == F.col("rcell")]
    near = base.join(rest, on).where(F.abs(F.col("start") - F.col("at")) <= reach)
    return near.groupBy(*keys, "wid", "start").agg(F.countDistinct("other").alias("n"), F.first("anchors").alias("anchors")).where("n = anchors").drop("n", "anchors")


def find_windows(docs: DataFrame, windows: DataFrame, keys: list[str], slop: int = 0) -> DataFrame:
    """Places in docs (key columns and text) where windows (wid, words, a materialised table) may occur: the keys, ``wid``, ``start``.

    Nothing that occurs is missed; all words but the rarest are still to be confirmed. The index of the rarest
    terms is written to the shared folder and read from there.
    """
    ship(docs.sparkSession)
    counts = materialise(term_counts(docs, _terms_within_bound(windows.select(F.explode("words")))), "terms")
    anchors = materialise(rarest_terms(windows, counts), "anchors")
    terms = _terms_within_bound(anchors.select("term"))
    index = materialise(positional_index(docs, terms, keys), "postings")
    if terms is not None and anchors.count() <= MOST_TERMS:
        anchors = F.broadcast(anchors)
    return intersect(index, anchors, keys, slop)


def _with_candidates(keyed: DataFrame, windows: DataFrame, slop: int = 0) -> DataFrame:
    """KEYS, ``text`` and ``found_`` (wid, window, starts) of the texts in which windows may occur, each text once.

    A text's list has each candidate window's words once, and 4 bytes for each place, so it is bounded by the text's
    length and by how many windows share two rarest terms at one distance; items are not in it. Only texts with candidates
    move, or none if these are few enough to be broadcast.
    """
    found = find_windows(keyed, windows, KEYS, slop)
    grouped = found.groupBy(*KEYS, "wid").agg(F.collect_list("start").alias("starts")).join(windows.select("wid", "window"), "wid")
    per_text = materialise(grouped.groupBy(*KEYS).agg(F.collect_list(F.struct("wid", "window", "starts")).alias("found_")), "candidates")
    texts = keyed.select(*KEYS, F.col("text").cast("binary").alias("text"))
    ids = per_text.select(*[F.col(k).alias(f"r{k}") for k in KEYS], "found_")
    n_bytes = F.expr("aggregate(found_, 40L, (n, f) -> n + 24 + octet_length(f.window) + 4 * size(f.starts))")
    if (per_text.agg(F.sum(n_bytes)).first()[0] or 0) <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    met = texts.join(ids, F.col("key_").eqNullSafe(F.col("rkey_")) & (F.col("tie_") == F.col("rtie_")))
    return met.select(*KEYS, "text", "found_")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, share: int = 20, keep: list[str] | None = None) -> DataFrame:
    """docs (or their columns in keep) with n_words, n_hit, n_items, items_sha256 and contaminated.

    A word is hit if it lies in any occurrence of a window of items. A document is contaminated if a word is hit
    and share * n_hit >= n_words. items_sha256 digests the sorted distinct ids of items with occurring windows.
    A null or empty text has no words and is clean; rows with equal ids are judged by their own texts, repeated rows
    alike; an empty table of items leaves all clean. Columns of these names are replaced; all other columns stay,
    whatever their names.
    """
    ship(docs.sparkSession)
    columns = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    kept = docs.select(*[F.col(f"`{c}`") for c in keep or docs.columns if c.lower() not in columns])
    row = F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row_")
    keyed = docs.select(row, F.col("doc_id").alias("key_"), F.xxhash64("text").alias("tie_"), "text")
    # windows of one set of items share its number; writing the table fixes the numbers
    windows = test_windows(items, size)
    sets = materialise(windows.groupBy("items").agg(F.count(F.lit(1)).alias("n")).select("items", F.monotonically_increasing_id().alias("set")), "item-sets")
    windows = materialise(windows.join(sets, "items").select("window", "words", "set", F.monotonically_increasing_id().alias("wid")), "windows")

    def checked(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches):
            got = [confirmed(text, found) for text, found in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            made = [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], [*KEYS, "n_hit", "wids"])

    kind = keyed.schema["key_"].dataType.simpleString()
    hits = _with_candidates(keyed, windows).mapInArrow(checked, f"key_ {kind}, tie_ long, n_hit long, wids array<long>").where("n_hit > 0")
    # equal rows have equal hits; one of them is enough
    hits = materialise(hits.groupBy(*KEYS).agg(F.max("n_hit").alias("n_hit"), F.first("wids").alias("wids")), "hits")
    met = hits.select(*KEYS, F.explode("wids").alias("wid")).join(windows.select("wid", "set"), "wid").select(*KEYS, "set").distinct()
    listed = met.join(sets.select("set", F.explode("items").alias("item")), "set").groupBy(*KEYS).agg(F.sort_array(F.collect_set("item")).alias("ids"))
    listed = listed.select(F.col("key_").alias("lkey_"), F.col("tie_").alias("ltie_"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    full = hits.select(F.col("key_").alias("rkey_"), F.col("tie_").alias("rtie_"), "n_hit")
    full = full.join(listed, F.col("rkey_").eqNullSafe(F.col("lkey_")) & (F.col("rtie_") == F.col("ltie_")), "left").drop("lkey_", "ltie_")
    judged = join_texts(keyed, materialise(full, "hit-texts"), "left", BROADCAST_ROWS)
    schema = T.StructType([judged.schema["row_"]]).add("w_", "long").add("h_", "long").add("i_", "long").add("s_", "string")

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches):
            n_words = pa.array([len(index_words(t)) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n_words, *(b.column(k) for k in (2, 3, 4))], schema.fieldNames())

    known = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_hit", "n_items")]
    judged = judged.select("row_", F.col("text").cast("binary"), *known, "items_sha256").mapInArrow(counted, schema)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return unnested(judged, kept, {
        "n_words": F.col("w_"), "n_hit": F.col("h_"), "n_items": F.col("i_"), "items_sha256": F.coalesce("s_", none),
        "contaminated": (F.col("h_") > 0) & (share * F.col("h_") >= F.col("w_")),
    })


def confirmed(text: bytes | None, found: list[dict]) -> tuple[int, list[int]]:
    """Number of words hit in a text, and the windows (wid) that stand in it word by word."""
    words, wids = index_words(text), []
    hit = bytearray(len(words))
    for f in found:
        window = f["window"].encode().split(b" ")
        n = len(window)
        there = [s for s in f["starts"] if words[s : s + n] == window]
        for s in there:
            hit[s : s + n] = b"\x01" * n
        if there:
            wids.append(f["wid"])
    return sum(hit), wids


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int, size: int = WINDOW) -> DataFrame:
    """Where windows of items stand in docs with every word within slop words of its place: ``doc_id``, ``window``, ``start``.

    All words are confirmed. A window's word i must stand at start + i, give or take slop; slop 0 is the phrase. For
    each occurrence of a window's rarest term the start with the least total displacement (then the smallest) is
    returned, once. Texts as in contamination(); rows equal in doc_id and text are reported once.
    """
    ship(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").alias("key_"), F.xxhash64("text").alias("tie_"), "text")
    windows = materialise(test_windows(items, size).withColumn("wid", F.monotonically_increasing_id()), "windows")

    def checked(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches):
            at, texts, starts = [], [], []
            for i, (text, found) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                words = index_words(text)
                for f in found:
                    best = {near_start(words, f["window"].encode().split(b" "), s, slop) for s in f["starts"]} - {None}
                    at += [i] * len(best)
                    texts += [f["window"]] * len(best)
                    starts += sorted(best)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(texts, pa.string()), pa.array(starts, pa.int32())], ["doc_id", "window", "start"])

    kind = keyed.schema["key_"].dataType.simpleString()
    return _with_candidates(keyed, windows, slop).mapInArrow(checked, f"doc_id {kind}, window string, start int").distinct()


def near_start(words: list[bytes], window: list[bytes], around: int, slop: int) -> int | None:
    """The start within slop of around at which all words of the window stand within slop of their places, or None."""
    best = None
    for start in range(around - slop, around + slop + 1):
        total = 0
        for i, w in enumerate(window):
            off = [abs(p - start - i) for p in range(max(start + i - slop, 0), min(start + i + slop + 1, len(words))) if words[p] == w]
            if not off:
                break
            total += min(off)
        else:
            if best is None or total < best[0]:
                best = (total, start)
    return best and best[1]


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    docs, items = read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "item_id", "text")
    return contamination(docs, items, keep=["doc_id"])


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
b AS (
  SELECT item_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k:k + 12], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
places AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS k, w FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
hits AS (SELECT r, k, places.n, item_id FROM (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS x FROM places) places JOIN windows USING (n, x)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS listed FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words ON words.r = d.r LEFT JOIN items ON items.r = d.r
"""
