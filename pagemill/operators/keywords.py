"""Keywords from a dictionary table, found in texts by an Aho-Corasick automaton: one pass over a text for all keywords.

The dictionary (category, position, keyword) is broadcast once its bytes have been looked at. A larger one is dealt into parts
of that size, and texts are passed over once for each part; what parts find is put together within the pass of a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill import ship
from pagemill.config import EXCLUDED_DOMAINS, LABEL_KEYWORDS

#: Bytes of keywords that are broadcast at once; an automaton takes some fifty times of these in each Python worker.
PART_BYTES = 1 << 20
ROWS_AT_ONCE = 500


def label_keywords(spark: SparkSession) -> DataFrame:
    """The dictionary of labels of the settings, as labels are compared: without white space, in lower case."""
    rows = [(category, k, "".join(w.split()).lower()) for k, (category, words) in enumerate(LABEL_KEYWORDS.items()) for w in words]
    return spark.createDataFrame(rows, "category string, position long, keyword string")


def excluded_domains(spark: SparkSession) -> DataFrame:
    """The domains of the settings that are not captured."""
    return spark.createDataFrame([("excluded", k, d) for k, d in enumerate(EXCLUDED_DOMAINS)], "category string, position long, keyword string")


def ranked(dictionary: DataFrame) -> DataFrame:
    """The distinct keywords, each with its smallest position and, of equal ones, category. Null keywords are left out."""
    first = F.min(F.struct("position", "category"))
    return dictionary.where("keyword IS NOT NULL").groupBy("keyword").agg(first.alias("f")).select("keyword", "f.position", "f.category")


def dictionary_parts(dictionary: DataFrame, most: int = PART_BYTES) -> Iterator[list[tuple[int, str, str]]]:
    """The keywords as (position, category, keyword), in parts of at most most bytes (and one keyword at least)."""
    known = ranked(dictionary)
    size = known.agg(F.sum(F.octet_length("keyword") + F.octet_length(F.coalesce("category", F.lit(""))) + 16)).first()[0] or 0
    parts = max(1, -(-int(size) * 5 // (4 * most)))
    if parts == 1:
        yield [tuple(r) for r in known.select("position", "category", "keyword").collect()]
        return
    dealt = known.withColumn("part", F.pmod(F.xxhash64("keyword"), F.lit(parts)))
    for k in range(parts):
        yield [tuple(r) for r in dealt.where(F.col("part") == k).select("position", "category", "keyword").collect()]


class Matcher:
    """The automaton of a part of a dictionary; the values of keywords are their ranks in the part."""

    _made: dict[str, Matcher] = {}

    def __init__(self, rows: list[tuple[int, str, str]]):
        import ahocorasick

        self.rows = sorted(rows, key=lambda r: (r[0], r[1] or "", r[2].encode()))
        self.automaton, self.everywhere = ahocorasick.Automaton(ahocorasick.STORE_INTS), []
        for rank, (_, _, keyword) in enumerate(self.rows):
            if keyword:
                self.automaton.add_word(keyword, rank)
            else:
                self.everywhere.append(rank)
        self.automaton.make_automaton()

    @classmethod
    def of(cls, name: str, part: Broadcast) -> Matcher:
        """One for each Python worker and part; that of another part goes."""
        if name not in cls._made:
            cls._made.clear()
            cls._made[name] = cls(part.value)
        return cls._made[name]

    def ranks(self, text: str) -> Iterator[int]:
        """The rank of each keyword, as often as it stands in the text."""
        yield from self.everywhere
        if len(self.automaton):
            yield from (rank for _, rank in self.automaton.iter(text))


def _pass(rows: DataFrame, part: list[tuple[int, str, str]], told) -> DataFrame:
    """rows (row_, text_, found_) with what one part finds added to found_, by told(matcher, text, found)."""
    name, shared = uuid.uuid4().hex, rows.sparkSession.sparkContext.broadcast(part)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        matcher = Matcher.of(name, shared)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                b = batch.slice(at, ROWS_AT_ONCE)
                found = [f if t is None else told(matcher, t, f) for t, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, b.column(2).type)], ["row_", "text_", "found_"])

    return rows.mapInArrow(read, rows.schema)


def _rows(df: DataFrame, text: str, found: str) -> DataFrame:
    ship(df.sparkSession)
    rest = [F.col(f"`{c}`") for c in df.columns if c != text]
    return df.select(F.struct(*(rest or [F.lit(0).alias("none_")])).alias("row_"), F.col(f"`{text}`").alias("text_"), F.lit(None).cast(found).alias("found_"))


def _unpacked(rows: DataFrame, like: DataFrame, text: str, extra: dict) -> DataFrame:
    taken = {k.lower() for k in extra}
    kept = [F.col("text_").alias(c) if c == text else F.col(f"row_.`{c}`").alias(c) for c in like.columns if c.lower() not in taken]
    return rows.select(*kept, *[c.alias(k) for k, c in extra.items()])


def first_category(df: DataFrame, dictionary: DataFrame, text: str = "text", most: int = PART_BYTES) -> DataFrame:
    """df with ``category`` and ``keyword``: of all keywords in the text the first by position, then category, then the keyword.

    An empty keyword is in every text. Both are null where no keyword is in the text, or the text is null. Keywords are compared as they are: fold both
    sides before, if case or white space should not count. Columns of these names are replaced, all others stay. An empty dictionary
    finds nothing, repeated rows are judged alike. Texts are read whole, once for each part of the dictionary; no shuffle.
    """
    best = "struct<position:bigint,category:string,keyword:string>"

    def told(matcher: Matcher, text: str, found: dict | None) -> dict | None:
        rank = min(matcher.ranks(text), default=None)
        if rank is None:
            return found
        own = dict(zip(("position", "category", "keyword"), matcher.rows[rank]))
        key = lambda f: (f["position"], f["category"] or "", f["keyword"].encode())
        return own if found is None else min(found, own, key=key)

    rows = _rows(df, text, best)
    for part in dictionary_parts(dictionary, most):
        rows = _pass(rows, part, told)
    return _unpacked(rows, df, text, {"category": F.col("found_.category"), "keyword": F.col("found_.keyword")})


def keyword_counts(df: DataFrame, dictionary: DataFrame, text: str = "text", most: int = PART_BYTES) -> DataFrame:
    """df with ``keywords``: an array of (keyword, n), how often each keyword stands in the text, overlaps counted, by keyword.

    A keyword that is empty counts once. Otherwise as first_category().
    """

    def told(matcher: Matcher, text: str, found: list | None) -> list:
        counts: dict[int, int] = {}
        for rank in matcher.ranks(text):
            counts[rank] = counts.get(rank, 0) + 1
        return (found or []) + [{"keyword": matcher.rows[rank][2], "n": n} for rank, n in counts.items()]

    rows = _rows(df, text, "array<struct<keyword:string,n:bigint>>")
    for part in dictionary_parts(dictionary, most):
        rows = _pass(rows, part, told)
    return _unpacked(rows, df, text, {"keywords": F.sort_array(F.coalesce("found_", F.array().cast("array<struct<keyword:string,n:bigint>>")))})
