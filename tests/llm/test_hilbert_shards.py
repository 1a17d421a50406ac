from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from pagemill.llm import hilbert_shards


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (1, 4), (4, 1)])
def test_curve_visits_neighbours(spark, dims, bits):
    cells = spark.range(1 << dims * bits).select(*[(F.shiftright("id", bits * d).bitwiseAND((1 << bits) - 1)).cast("int").alias(f"x{d}") for d in range(dims)])
    got = cells.select("*", hilbert_shards.hilbert_index([F.col(f"x{d}") for d in range(dims)], bits).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in got] == list(range(1 << dims * bits))
    assert all(sum(abs(a[d] - b[d]) for d in range(dims)) == 1 for a, b in zip(got, got[1:]))


def test_table(spark, documents, odd):
    docs = documents(*odd, *[f"text {k % 40} " * (k % 9) for k in range(300)]).unionByName(documents((None, None), (3, "same"), (3, "same"), source=None, lang=None))
    clash = ("level_0_", "order_0_", "cell_", "bin_", "row_", "spread_", "rank_", "at_", "n_")
    docs = docs.withColumns({"shard": F.lit("clash"), **{c: F.lit(f"mine {c}") for c in clash}})
    got = hilbert_shards.shard_documents(docs, 7, 4).collect()
    total = docs.count()
    by = Counter(r["shard"] for r in got)
    assert all(r[c] == f"mine {c}" for r in got for c in clash)
    assert len(got) == total and set(by) == set(range(7)) and max(by.values()) - min(by.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in by.items())
    assert Counter(r["text"] for r in got) == Counter(r["text"] for r in docs.collect())
    again = {(r["doc_id"], r["text"], r["shard"]) for r in hilbert_shards.shard_documents(docs, 7, 4).collect()}
    assert again == {(r["doc_id"], r["text"], r["shard"]) for r in got}
    assert hilbert_shards.shard_documents(docs.limit(0), 7).count() == 0
    assert {r["shard"] for r in hilbert_shards.shard_documents(docs.limit(3), 7).collect()} <= set(range(7))


def test_shards_are_compact(documents):
    docs = documents(*["w " * (1 << k % 8) for k in range(640)])
    got = hilbert_shards.shard_documents(docs, 16).collect()
    sizes = [{r["n_chars"] for r in got if r["shard"] == s} for s in range(16)]
    assert sum(map(len, sizes)) <= 16 * 4  # eight lengths; each shard has few of them


def test_query(spark, documents, tmp_path):
    documents("", None, "é").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in hilbert_shards.op6_hilbert_shards(spark, str(tmp_path)).collect())
    assert got == [(0, 8, 0, "rows", None), (1, 8, 0, "rows", None), (2, 10, crc32("é".encode()), "rows", None)]


@pytest.mark.parametrize("shards, n", [(7, 1000), (24, 500), (3, 2), (1, 50)])
def test_cut_against_the_whole_order(spark, shards, n):
    """Sorted as a whole by the curve, the rows come in the order of shard and slot, cut where equal counts ask for."""
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 90).alias("text"), F.concat(F.lit("l"), F.col("id") % 3).alias("lang"), F.concat(F.lit("s"), F.col("id") * 7 % 11).alias("source"))
    docs = docs.withColumn("text", F.repeat("text", (1 + F.col("doc_id") % 13 * 9).cast("int")))
    placed = hilbert_shards.shard_documents(docs, shards).withColumn("h", hilbert_shards.hilbert_index(hilbert_shards.document_levels(6), 6))
    rows = sorted(placed.collect(), key=lambda r: (r["shard"], r["slot"]))
    assert [r["h"] for r in rows] == sorted(r["h"] for r in rows)
    starts = [-(-s * n // shards) for s in range(shards + 1)]
    assert [(r["shard"], r["slot"]) for r in rows] == [(s, k - starts[s]) for s in range(shards) for k in range(starts[s], starts[s + 1])]


def test_files_prune(spark, tmp_path):
    """Minima and maxima of the files' row groups leave out most of them, in every dimension; files of another order leave out none."""
    import pyarrow.parquet as pq

    words = F.repeat(F.lit("word "), F.expr("cast(pow(2, id * 31 % 11) as int)"))
    docs = spark.range(4800).select(F.col("id").alias("doc_id"), words.alias("text"), F.concat(F.lit("l"), F.col("id") * 17 % 4).alias("lang"), F.concat(F.lit("s"), F.col("id") * 13 % 16).alias("source"))
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    hilbert_shards.write_shards(hilbert_shards.shard_documents(docs, 6), str(tmp_path / "curve"), 48)
    docs.repartition(48).write.parquet(str(tmp_path / "any"))
    assert spark.read.parquet(str(tmp_path / "curve")).drop("shard", "slot").exceptAll(docs).count() == 0 == docs.exceptAll(spark.read.parquet(str(tmp_path / "curve")).drop("shard", "slot")).count()

    def skipped(folder, column, value):
        groups = [g.column(c).statistics for f in (tmp_path / folder).rglob("*.parquet") for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups)) for c in range(m.num_columns) if g.column(c).path_in_schema == column]
        return sum(not x.min <= value <= x.max for x in groups) / len(groups)

    # levels of categories are hashes, so of four languages a file with two can still hold the third between its minimum and maximum
    for column, value, least in (("lang", "l2", 0.2), ("source", "s5", 0.4), ("n_chars", 5 * 2**7, 0.4)):
        assert skipped("curve", column, value) > least and skipped("any", column, value) == 0, column
    one = sorted(p.name for p in (tmp_path / "curve").iterdir() if p.name.startswith("shard="))
    assert one == [f"shard={s}" for s in range(6)]
    hilbert_shards.write_shards(hilbert_shards.shard_documents(docs.limit(0), 6), str(tmp_path / "none"), 4)
