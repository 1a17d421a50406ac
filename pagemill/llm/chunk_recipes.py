"""Exact duplicates by content-defined chunk recipes: a text is the ordered list of the identifiers of its chunks.

Built from DataFrame functions only. A normalised text is cut where its own letters say so, so equal passages give
equal chunks wherever they stand. Distinct chunks move once, to be given identifiers that are verified: a chunk's hash
is its identifier where no other chunk has that hash; where two share it, the hash with the chunk itself is.
From then on only recipes move, a few hundredths of the texts, and equal recipes are equal texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import join_by_key, join_texts, materialise, nested, read_table, unnested

#: Characters of a chunk, at least (but for the last of a text) and at most.
SHORTEST, LONGEST = 256, 4096
#: Where a chunk may end: after a space between a word that ends with one of the first letters and one that begins with
#: one of the second, or after a full stop or comma of scripts that set no spaces.
CUT = "(?:(?<=[dglv0-4à-éа-д] )(?=[abcp0-4À-Éа-д])|(?<=[。、，！？]))"
#: Shared hashes that the plan carries; a salt with more is given up for the next.
MOST_SHARED = 10_000


def normalised(text: Column) -> Column:
    """The text with each stretch of ASCII white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def chunks(text: Column) -> Column:
    """The chunks of a text, which joined are the text; at most LONGEST characters each, in time linear in the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{SHORTEST},{LONGEST}}}?{CUT}|.{{1,{LONGEST}}}"), F.lit(0))


def chunk_hash(chunk: Column, salt: int, bits: int = 64) -> Column:
    """A hash of that many bits (fewer than 64 in tests only); another salt gives unrelated hashes."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), chunk), 64 - bits)


def shared_hashes(texts: DataFrame, salt: int, bits: int = 64) -> DataFrame:
    """The hashes that two or more different chunks of texts (a column ``text``) have: none, but by accident.

    A task hands on each chunk once, however many copies it holds, and a hash gathers its different chunks only.
    """
    each = texts.select(F.explode(chunks(F.col("text"))).alias("chunk")).select(chunk_hash(F.col("chunk"), salt, bits).alias("hash"), "chunk")
    return each.groupBy("hash", "chunk").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.sum("one").alias("n")).where("n > 1").select("hash")


def verified_recipe(texts: DataFrame, bits: int = 64) -> Column:
    """The recipe of the column ``text`` as an expression: the identifiers of its chunks in order.

    Of all rows of texts, those with equal recipes have equal texts. For other texts nothing is verified.
    """
    for salt in range(1000):
        shared = [r["hash"] for r in shared_hashes(texts, salt, bits).limit(MOST_SHARED + 1).collect()]
        if not shared:
            return F.transform(chunks(F.col("text")), lambda c: chunk_hash(c, salt, bits))
        if len(shared) <= MOST_SHARED:
            return F.transform(
                chunks(F.col("text")),
                lambda c: F.struct(chunk_hash(c, salt, bits).alias("hash"), F.when(chunk_hash(c, salt, bits).isin(shared), c).alias("chunk")),
            )
    raise ValueError("no salt tells the chunks apart")


def duplicate_groups(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: int = 64) -> DataFrame:
    """For each row of df: its id, ``keep_id`` (the id of the row that stays), ``group_size`` (rows with an equal normalised
    text, itself included), ``kept`` and ``text_sha256`` (of the normalised text).

    The row with the smallest id stays. Of rows that repeat that id with an equal text one stays, and a null id comes after all
    others. A null text is an empty one, a text of any length is judged whole, and an empty table gives an empty result.

    Recipes are compared within their hash, after both were counted together, so a group of a third of all rows is summed
    up by each task before it moves and comes back to its rows by broadcast (common.join_by_key).
    """
    slim = df.select(F.col(f"`{id_column}`").alias("key_"), normalised(F.col(f"`{text_column}`")).alias("text"))
    rows = slim.select("key_", F.monotonically_increasing_id().alias("at_"), F.sha2(F.col("text").cast("binary"), 256).alias("sha_"), verified_recipe(slim, bits).alias("recipe_"))
    rows = materialise(rows.withColumn("hash_", chunk_hash(F.col("recipe_"), 0, bits)), "recipes")
    first = F.min(F.struct(F.col("key_").isNull().alias("none"), "key_", "at_"))
    groups = rows.groupBy("hash_", "recipe_").agg(first.alias("first_"), F.count(F.lit(1)).alias("group_size"))
    groups = materialise(groups.withColumn("alone_", F.count(F.lit(1)).over(Window.partitionBy("hash_")) == 1).select("hash_", "recipe_", "alone_", "group_size", F.col("first_.key_").alias("keep_id"), F.col("first_.at_").alias("keep_at_")), "groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    of_hash = join_by_key(rows.drop("recipe_"), groups.where("alone_").drop("alone_", "recipe_"), "hash_", "group_size", total)
    of_recipe = rows.join(groups.where("not alone_").drop("alone_"), ["hash_", "recipe_"]).drop("recipe_")
    return of_hash.unionByName(of_recipe).select(
        F.col("key_").alias(id_column), "keep_id", "group_size", (F.col("at_") == F.col("keep_at_")).alias("kept"), F.col("sha_").alias("text_sha256")
    )


def drop_copies(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of df that stay, whole: of equal texts the row with the smallest id, all its columns with their values.

    Of rows that repeat this id with an equal text any one stays. Whole rows move once at most, to meet their verdicts.
    """
    found = duplicate_groups(df.select(F.col(f"`{id_column}`").alias("id_"), F.col(f"`{text_column}`").alias("text_")), "id_", "text_")
    ids = materialise(
        found.where(F.col("id_").eqNullSafe(F.col("keep_id"))).groupBy(F.col("id_").alias("rkey_"), F.col("text_sha256").alias("rtie_")).agg(F.count(F.lit(1)).alias("same_")), "kept"
    )
    rows = nested(df).withColumns({"key_": F.col(f"row_.`{id_column}`"), "tie_": F.sha2(normalised(F.col(f"row_.`{text_column}`")).cast("binary"), 256)})
    whole = join_texts(rows, ids)
    once = whole.where("same_ = 1").select("row_")
    again = whole.where("same_ > 1").groupBy("key_", "tie_").agg(F.first("row_").alias("row_")).select("row_")
    return unnested(once.unionByName(again), df, {})


def op13_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the document that stays of their equals."""
    return duplicate_groups(read_table(spark, sf_dir, "documents", "doc_id", "text"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
