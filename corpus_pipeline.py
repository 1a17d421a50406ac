"""From documents to a sharded training mix: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.chosen_path import first_of_each_class
from pagemill.llm.common import apart, materialise, read_table, together
from pagemill.llm.decontaminate import contamination
from pagemill.llm.hilbert_shards import shard_documents
from pagemill.llm.mixing import mixed_documents
from pagemill.llm.toxicity import label_categories, score_toxicity, train_chain


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier chain rejects; it is trained on those of docs that have labels.

    A null or empty text is scored as an empty one, whole texts of any length are scored, rows with a null id have no label, and
    repeated rows meet one verdict. All columns keep their values, whatever their names. An empty table stays empty.
    """
    chain = train_chain(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), label_categories())
    scored = score_toxicity(apart(docs, "text"), chain, keep=["row_", "text"])
    return together(scored.where(~F.col("rejected")), docs, "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest doc_id, a null id last.

    Rows whose text is null or has no words all stay; of repeated rows one stays; rows that share an id are told apart by their
    texts. All columns keep their values, whatever their names. An empty table stays empty.
    """
    return first_of_each_class(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the rule of contamination meets.

    A null or empty text is clean, an empty benchmark leaves all clean, repeated rows and rows that share an id are
    judged by their own texts. All columns keep their values, whatever their names. An empty table stays empty.
    """
    items = read_table(spark, sf_dir, "benchmark", "item_id", "text")
    judged = contamination(apart(docs, "doc_id", "text"), items)
    return together(judged.where(~F.col("contaminated")), docs, "doc_id", "text")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by target weights: documents as often, and with the words, that the mix takes.

    A null or empty text has no words to take and is not in the mix; a null source is a source of its own; repeated rows are
    documents of their own. All columns but text and n_chars keep their values. An empty table stays empty.
    """
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with shard and slot along the Hilbert curve; columns of these two names are replaced, all others stay.

    Nulls in any column are ordinary values, equal rows are interchangeable, and an empty table stays empty.
    """
    return shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

#: SQL cannot express the classifier, the join's classes and the draws.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read back."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
