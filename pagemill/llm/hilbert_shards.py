"""Sharding along a Hilbert curve: rows near each other in several metadata dimensions share shards.

Built from DataFrame functions only. Each dimension is quantised to a few bits, the Hilbert index of the cell
orders the rows, and the order is cut into runs of equal length, so that each shard (and each file written from
it) covers a small box of the metadata space and minimum/maximum statistics prune well in every dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import materialise, read_table, unnested

#: Rows that one bin of a cell should hold; a cell has as many bins as this asks for if it held all rows.
BIN_ROWS = 20_000
MAX_BINS = 4096


def category_level(column: Column, bits: int) -> Column:
    """A level in [0, 2^bits) for a categorical value; null is a value of its own."""
    return F.pmod(F.xxhash64(F.coalesce(column.cast("string"), F.lit("\u0000null"))), F.lit(1 << bits)).cast("int")


def magnitude_level(column: Column, bits: int) -> Column:
    """A level in [0, 2^bits) that grows with the logarithm of a count; null counts as 0."""
    steps = F.floor(2 * F.log2(F.greatest(F.coalesce(column, F.lit(0)), F.lit(1)).cast("double")))
    return F.least(steps, F.lit((1 << bits) - 1)).cast("int")


def hilbert_index(levels: list[Column], bits: int) -> Column:
    """The index along the Hilbert curve of a cell given by one level in [0, 2^bits) for each dimension.

    The axes are transformed bit by bit from the highest (Skilling's in-place method), then their bits interleave.
    """
    dims = len(levels)
    if dims * bits > 62:
        raise ValueError("dimensions times bits must not exceed 62")
    undo = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(dims)])

    def exchange(axes: Column, step: Column) -> Column:
        q, i, first = step["q"], step["i"], F.get(axes, F.lit(0))
        own = F.get(axes, i)
        inverted = own.bitwiseAND(q) != 0
        swapped = first.bitwiseXOR(own).bitwiseAND(q - 1)
        flip = F.when(inverted, q - 1).otherwise(swapped)
        # inverted: only the first axis changes; else the first and the i-th exchange their low bits
        return F.transform(axes, lambda v, j: F.when((j == 0) | (~inverted & (j == i)), v.bitwiseXOR(flip)).otherwise(v))

    axes = F.aggregate(undo, F.array(*[x.cast("int") for x in levels]), exchange) if bits > 1 else F.array(*[x.cast("int") for x in levels])
    gray = F.aggregate(
        axes,
        F.array().cast("array<int>"),
        lambda done, v: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)).bitwiseXOR(v))),
    )

    def indexed(x: Column) -> Column:
        last = F.element_at(x, -1)
        turn = F.aggregate(
            F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]).cast("array<int>"),
            F.lit(0),
            lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t),
        )
        turned = F.transform(x, lambda v: v.bitwiseXOR(turn))
        places = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(dims)])
        return F.aggregate(
            places,
            F.lit(0).cast("long"),
            lambda h, s: h * 2 + F.when(F.get(turned, s["i"]).bitwiseAND(s["q"]) != 0, F.lit(1)).otherwise(F.lit(0)),
        )

    # A one-element array lets the lambda name the axes, so that they are worked out once.
    return F.get(F.transform(F.array(gray), indexed), F.lit(0))


def hilbert_shards(df: DataFrame, levels: list[Column], order: list[Column], shards: int, bits: int = 6, short: bool = False) -> DataFrame:
    """df with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 within a shard), cut from the Hilbert order.

    levels: for each dimension a level in [0, 2^bits), of df's columns. order: what orders rows within a cell;
    rows equal in all of it are interchangeable. The law is ``rows``: shards differ by one row at most. short: rows are
    few bytes, so they are written once with their cells, instead of working these out again for each pass.

    A cell that holds a third of all rows is dealt over many bins by the hash of the first order column(s), so no
    task gets a cell: ranks are offsets of cells, plus offsets of bins in their cell, plus the rank in the bin. The
    only unpartitioned window runs over one row for each occupied cell (2^(bits*dimensions) at most).
    Nulls are ordinary values. An empty df gives an empty result. Columns named shard or slot are replaced;
    all others stay, whatever their names.
    """
    total = df.count()
    bins = min(MAX_BINS, max(1, -(-total // BIN_ROWS)))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row_")
    packed = df.select(row, *[c.alias(f"level_{i}_") for i, c in enumerate(levels)], *[c.alias(f"order_{i}_") for i, c in enumerate(order)])
    keys = [F.col(f"order_{i}_") for i in range(len(order))]
    placed = packed.select(
        "row_",
        *keys,
        hilbert_index([F.col(f"level_{i}_") for i in range(len(levels))], bits).alias("cell_"),
        F.pmod(F.xxhash64(*keys), F.lit(1 << 40)).alias("spread_"),
    ).withColumn("bin_", F.floor(F.col("spread_") * bins / (1 << 40)).cast("int"))
    if short:
        placed = materialise(placed, "placed")
    placed = placed.repartition("cell_", "bin_") if total else placed

    sizes = placed.groupBy("cell_", "bin_").agg(F.count(F.lit(1)).alias("n_"))
    cells = sizes.groupBy("cell_").agg(F.sum("n_").alias("n_")).select(
        "cell_", (F.sum("n_").over(Window.orderBy("cell_").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_")).alias("cell_at_")
    )
    in_cell = Window.partitionBy("cell_").orderBy("bin_").rowsBetween(Window.unboundedPreceding, 0)
    starts = sizes.select("cell_", "bin_", (F.sum("n_").over(in_cell) - F.col("n_")).alias("bin_at_")).join(cells, "cell_").select(
        "cell_", "bin_", (F.col("cell_at_") + F.col("bin_at_")).alias("at_")
    )
    in_bin = Window.partitionBy("cell_", "bin_").orderBy("spread_", *keys)
    ranked = placed.withColumn("rank_", F.row_number().over(in_bin)).join(starts, ["cell_", "bin_"]).withColumn("rank_", F.col("at_") + F.col("rank_") - 1)
    cut = ranked.withColumn("shard_", F.expr(f"(rank_ * {shards}) div {max(total, 1)}")).withColumn(
        "slot_", F.col("rank_") - F.expr(f"(shard_ * {max(total, 1)} + {shards - 1}) div {shards}")
    )
    return unnested(cut, df, {"shard": F.col("shard_").cast("int"), "slot": F.col("slot_").cast("long")})


def document_levels(bits: int) -> list[Column]:
    """The metadata dimensions of documents: language, source, length."""
    return [category_level(F.col("lang"), bits), category_level(F.col("source"), bits), magnitude_level(F.octet_length(F.coalesce(F.col("text"), F.lit(""))), bits)]


def shard_documents(docs: DataFrame, shards: int = 24, bits: int = 6) -> DataFrame:
    """Documents with their shard and slot, whole rows kept. Ties between equal doc_ids are broken by the text."""
    return hilbert_shards(docs, document_levels(bits), [F.col("doc_id"), F.xxhash64("text")], shards, bits)


def write_shards(placed: DataFrame, path: str, files: int, row_group_bytes: int = 128 << 20) -> None:
    """Write rows with shard and slot (shard_documents) as Parquet, a folder ``shard=…`` for each shard, in about files files.

    Rows are dealt out by ranges of (shard, slot) and sorted by them, so each file, and each row group in it, holds a run of the
    Hilbert order: its minima and maxima are narrow in every dimension, and readers that filter by one skip most of them. No task
    needs a whole shard. An empty table writes no file.
    """
    ordered = placed.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.option("parquet.block.size", row_group_bytes).partitionBy("shard").parquet(path)


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by the law ``rows``; a null text has size 8 and the checksum of no bytes."""
    bits = 6
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("tie"),
        *[c.alias(f"l{i}") for i, c in enumerate(document_levels(bits))],
    )
    placed = hilbert_shards(slim, [F.col("l0"), F.col("l1"), F.col("l2")], [F.col("doc_id"), F.col("tie")], 24, bits, short=True)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
