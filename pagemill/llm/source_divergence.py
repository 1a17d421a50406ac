"""How far the sources of a language differ in their words: pairwise distances, and each source's most overused terms.

Documents are counted where they are; counts go to shards by the hash of language and term, so a shard has all counts of
its terms. Each shard runs vectorised SQL in an embedded DuckDB: first the counts of the terms that stay, then, once Spark has
added up the totals, its share of all distances and its best terms. Spark adds the shares and ranks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill import ship
from pagemill.llm.common import join_by_key, materialise, read_table, slices

#: A term stays in its language if at least so many of its documents have it; the ranks of terms that are listed.
LEAST_DOCUMENTS, TOP = 30, 50
#: Counts are added to each kept term before shares are taken, and shares are in units of one part in SCALE.
ADDED, SCALE = 5, 1_000_000_000
#: Entries that a task counts before it hands them on; bytes of text whose counts one shard should get; rows of kept counts of one shard.
TASK_ENTRIES, SHARD_BYTES, SHARD_ROWS = 400_000, 4 << 20, 50_000

#: Bytes that part terms become spaces, capitals A to Z become small; bytes beyond ASCII stay.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of a text in UTF-8, A to Z in small letters."""
    return text.translate(_FOLDED).split()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed up within each task as far as TASK_ENTRIES allows.

    Each (lang, source) that occurs also has rows with an empty term and no counts, so groups without terms are
    known. Null is an empty string throughout. No shuffle; memory is bounded by TASK_ENTRIES and one text.
    """
    ship(docs.sparkSession)

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def told() -> Iterator:
            for (lang_, source_), (n, docs_) in found.items():
                terms = [b"", *n]
                columns = [pa.array([lang_]).take(zeros := pa.array([0] * len(terms), pa.int32())), pa.array([source_]).take(zeros), pa.array(terms, pa.binary()).cast(pa.string())]
                counts = [pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs_.__getitem__, n)], pa.int64())]
                yield from slices([pa.RecordBatch.from_arrays(columns + counts, ["lang", "source", "term", "n", "docs"])], 50_000)
            found.clear()

        for b in slices(batches):
            for lang_, source_, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                n, docs_ = found.setdefault((lang_, source_), (Counter(), Counter()))
                terms = terms_of(value.as_py())
                n.update(terms)
                docs_.update(set(terms))
            if sum(len(n) + 1 for n, _ in found.values()) > TASK_ENTRIES:
                yield from told()
        yield from told()

    empty = F.lit("")
    slim = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), empty).alias(k) for k, c in (("lang", lang), ("source", source))], F.coalesce(F.col(f"`{text}`"), empty).cast("binary").alias("text"))
    return slim.mapInArrow(counted, "lang string, source string, term string, n long, docs long")


def _engine():
    """An embedded DuckDB for one shard: one thread, in memory."""
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1})


#: The counts of the terms that stay, one row of each term marked, and one row without a term for each group of the shard.
KEPT_SQL = """
SELECT lang, source, term, sum(n)::BIGINT AS n, (term <> '' AND row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1)::BIGINT AS lead
FROM counted GROUP BY lang, source, term
QUALIFY term = '' OR sum(sum(docs)) OVER (PARTITION BY lang, term) >= {least}
"""


def kept_counts(counted: DataFrame, n_bytes: int, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, lead) of the terms in at least least documents of their language.

    counted: rows of term_counts over texts of n_bytes. The number of shards follows from the bytes, of which a count needs two at
    least, so a shard is bounded; each term is in one shard, where all sums are exact. lead is 1 in one row of each (lang,
    term), 0 in the others.
    """
    ship(spark := counted.sparkSession)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // SHARD_BYTES))

    def shard(batches: Iterator) -> Iterator:
        import pyarrow as pa

        with _engine() as db:
            db.execute("CREATE TABLE counted (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
            for b in batches:
                db.register("part", pa.Table.from_batches([b]))
                db.execute("INSERT INTO counted SELECT * FROM part")
                db.unregister("part")
            yield from db.execute(KEPT_SQL.format(least=least)).to_arrow_table().to_batches(50_000)

    return counted.repartition(shards, "lang", "term").mapInArrow(shard, "lang string, source string, term string, n long, lead long")


#: With z the share of a term that a source lacks: |p - q| summed over all terms of the shard is |z - z'| for each term, plus what
#: the terms of one source change against the z of the other, plus what terms of both change beside that.
SHARES_SQL = """
WITH z AS (SELECT source, total, coalesce(1 + ({added} * {scale}::HUGEINT) // nullif(total + {added} * kept, 0), 0) AS z FROM groups),
p AS (
  SELECT term, source, z, 1 + (n + {added})::HUGEINT * {scale} // (total + {added} * (SELECT any_value(kept) FROM groups)) AS p
  FROM counts JOIN z USING (source) WHERE term <> ''),
base AS (
  SELECT a.source AS source, b.source AS item, abs(a.z - b.z) * (SELECT coalesce(sum(lead), 0) FROM counts) AS value
  FROM z a JOIN z b ON a.source < b.source),
of_one AS (
  SELECT least(a.source, b.source) AS source, greatest(a.source, b.source) AS item, a.n * (abs(a.p - b.z) - abs(a.z - b.z)) AS value
  FROM (SELECT source, z, p, count(*) AS n FROM p GROUP BY source, z, p) a JOIN z b ON a.source <> b.source),
of_both AS (
  SELECT a.source AS source, b.source AS item, abs(a.p - b.p) - abs(a.p - b.z) - abs(a.z - b.p) + abs(a.z - b.z) AS value
  FROM p a JOIN p b ON a.term = b.term AND a.source < b.source),
pairs AS (
  SELECT source, item, sum(value) AS value
  FROM (SELECT source, item, sum(value) AS value FROM base GROUP BY source, item
        UNION ALL SELECT source, item, sum(value) FROM of_one GROUP BY source, item
        UNION ALL SELECT source, item, sum(value) FROM of_both GROUP BY source, item)
  GROUP BY source, item),
whole AS (
  SELECT term, 1 + (sum(n) + {added})::HUGEINT * {scale} // (SELECT any_value(lang_total) + {added} * any_value(kept) FROM groups) AS q
  FROM counts WHERE term <> '' GROUP BY term),
terms AS (
  SELECT source, term AS item, p - q AS value FROM p JOIN whole USING (term) WHERE p > q
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY value DESC, item) <= {top})
SELECT 'pair' AS part, source, item, value::BIGINT AS value FROM pairs
UNION ALL SELECT 'term', source, item, value::BIGINT FROM terms
"""


def shard_shares(kept: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value) of each shard: its share of the distance of each pair of sources (source < item), and
    the terms that can be among the top of a source. kept: rows of kept_counts, as a table.

    A language has as many shards as its rows ask for, but none with fewer rows than it has pairs of sources, so shares
    don't outgrow counts. Totals go to the shards of their language along with the counts, nothing is broadcast to all.
    """
    ship(kept.sparkSession)
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("lead").alias("lead"), F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("lang")
    groups = materialise(totals.select("lang", "source", "total", *[F.sum(c).over(whole).alias(k) for c, k in (("lead", "kept"), ("total", "lang_total"), ("rows", "lang_rows"))], "rows", F.count(F.lit(1)).over(whole).alias("sources")), "totals")
    shards = F.ceil(F.col("lang_rows") / F.greatest(F.lit(SHARD_ROWS), F.col("sources") * F.col("sources"))).cast("int")
    langs = groups.select("lang", "lang_rows", shards.alias("shards")).distinct()
    total = groups.agg(F.sum("rows")).first()[0] or 0
    dealt = join_by_key(kept, langs, "lang", "lang_rows", total).withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int"))
    left = dealt.select("lang", "shard", "source", "term", "n", "lead").groupBy("lang", "shard")
    right = groups.select("lang", F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"), "source", "total", "kept", "lang_total").groupBy("lang", "shard")

    def shares(counts, totals):
        import pyarrow as pa

        lang = totals.column("lang")[0]
        with _engine() as db:
            db.register("counts", counts)
            db.register("groups", totals)
            found = db.execute(SHARES_SQL.format(added=ADDED, scale=SCALE, top=top)).to_arrow_table()
        return found.add_column(0, "lang", pa.array([lang.as_py()], pa.string()).take(pa.array([0] * found.num_rows, pa.int32())))

    return left.cogroup(right).applyInArrow(shares, "lang string, part string, source string, item string, value long")


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) for each source of each language; other columns of docs are ignored.

    part ``pair``: each other source of the language, by the sum of the differences of their shares over all kept terms. part
    ``term``: up to top terms by what their share exceeds the language's. Ties go to the smaller item in UTF-8. Null is an
    empty string, repeated rows count as documents of their own, a group without terms has zero counts, texts
    are read whole, and an empty table gives an empty result. All arithmetic is exact.
    """
    n_bytes = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    kept = materialise(kept_counts(term_counts(docs, text, lang, source), n_bytes, least), "kept-terms")
    found = materialise(shard_shares(kept, top), "shares")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("e"), "value")
    pairs = both.select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value").withColumn("rank", F.row_number().over(by_value))
    terms = found.where("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of all languages of documents."""
    return source_divergence(read_table(spark, sf_dir, "documents", "text", "lang", "source"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
occurs AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM occurs GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM occurs SEMI JOIN kept USING (lang, term) GROUP BY ALL),
counts AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (n + 5)::HUGEINT * 1000000000 // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM counts JOIN v USING (lang)),
whole AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL),
q AS (SELECT lang, term, 1 + (n + 5)::HUGEINT * 1000000000 // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM whole JOIN v USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 50
"""
