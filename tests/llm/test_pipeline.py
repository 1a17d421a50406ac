import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), "test-stage")
        counts.append(docs.count())
        if name != "sharding":
            assert docs.columns == columns
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[4] == counts[5]
    assert docs.columns == [*columns, "shard", "slot"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, SF).toArrow(), con.execute(queries.ORACLE_SQL[name]).to_arrow_table()
    columns = ", ".join(sorted(ours.column_names))
    for a, b in ((ours, theirs), (theirs, ours)):
        assert con.execute(f"select count(*) from (select {columns} from a except all select {columns} from b)").fetchall() == [(0,)]


def test_empty_pipeline(spark, tmp_path):
    schemas = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_and_odd_rows(spark, documents, odd, tmp_path):
    """Null ids, repeated rows, odd texts, and columns named like those that stages work with: all values come through."""
    clean = [f"{k} quite different words {' '.join(f'x{k * 31 + j}' for j in range(40))}" for k in range(12)]
    mine = {c: f"mine {c}" for c in ("n_words", "contaminated", "Rejected", "p_toxic", "a.b", "N_hit", "row_", "items_sha256", "key_", "shard_")}
    docs = documents(*odd, *[(100 + k, t) for k, t in enumerate(clean)], (None, clean[0] + " none"), (None, clean[0] + " none"), (100, clean[0]), (7, None))
    docs = docs.withColumns({c: F.lit(v) for c, v in mine.items()})
    spark.createDataFrame([(100 + k, k % 2, 0) for k in range(10)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(f"x{j}" for j in range(5)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), "test-stage")
        rows = docs.collect()
        assert rows and all(r[c] == v for r in rows for c, v in mine.items()), name
        if name == "toxicity":
            assert len(rows) == len(odd) + 16
        elif name == "n-gram Jaccard join":
            assert sum(r["text"] == clean[0] for r in rows) == 1 and sum(r["text"] is None for r in rows) == 2
    empty = docs.drop("shard", "slot").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
