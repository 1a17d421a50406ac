"""Mixing sources to target weights: fixed-length blocks, multinomial draws for each shard, index permutations."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import ship
from pagemill.llm.common import join_by_key, materialise, mixed, read_table, slices

#: Words of a block.
BLOCK_WORDS = 128
SHARDS = 24
WEIGHTS = (5, 2, 1)
SHARE, MOST_TIMES = Fraction(3, 2), 2
#: Sources whose draws are made together; a shard's slots are drawn for such groups first, then inside each of them.
GROUP_SOURCES = 10_000
#: Slots of a task that deals blocks to them, and tasks at most (then each has more).
TASK_SLOTS, MOST_TASKS, RUN_SLOTS = 50_000, 20_000, 65_536
CHUNK_ROWS, MOST_CHUNKS = 20_000, 65_536


def shard_draws(quotas: list[int], shards: int, seed: list[int], slots: list[int] | None = None) -> list[list[int]]:
    """For each shard the number of slots of each quota: multinomial in what is left, so that the quotas come out.

    slots: how many each shard has; as equal as can be by default.
    """
    import numpy as np

    left, draws = np.array(quotas, np.int64), []
    for k in range(shards):
        wanted = int(left.sum()) // (shards - k) if slots is None else slots[k]
        counts = np.zeros_like(left)
        draw = np.random.default_rng([*seed, k])
        while (missing := wanted - int(counts.sum())) > 0:
            free = left - counts
            counts = np.minimum(counts + draw.multinomial(missing, free / free.sum()), left)
        draws.append(counts.tolist())
        left -= counts
    return draws


def permuted(index, size: int, seed: int):
    """Where index (numbers below size) go under a pseudorandom permutation of 0 to size-1.

    A Feistel network permutes the next even power of two; what falls outside walks on until it is inside.
    """
    import numpy as np

    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        for turn in range(4):
            high, low = v >> shift, v & mask
            with np.errstate(over="ignore"):
                key = np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
                v = (low << shift) | (high ^ (mixed(low + key) & mask))
        out[todo] = v
        todo = todo[v >= size]
    return out.astype(np.int64)


def source_table(packed: DataFrame, block_words: int) -> DataFrame:
    """For each source: ``source_``, ``number`` (by code point, null last), ``docs_``, ``source_size_``, ``target_``, ``blocks_``, ``quota_``.

    packed: source_, size_. However many sources there are, none of their rows goes through the driver: they are sorted by range and
    numbered by partition, and the driver learns sums only.
    """
    order = F.col("source_").asc_nulls_last()
    found = packed.groupBy("source_").agg(F.sum("size_").alias("source_size_"), F.count(F.lit(1)).alias("docs_"))
    # ids grow with the partition and count up inside it; writing the table fixes them
    ranked = materialise(found.repartitionByRange(order).sortWithinPartitions(order).withColumn("at_", F.monotonically_increasing_id()), "ranked-sources")
    part, inside = F.shiftright("at_", 33), F.col("at_").bitwiseAND((1 << 33) - 1)
    sizes = ranked.groupBy(part.alias("part_")).agg(F.count(F.lit(1)).alias("n_"))  # one row for each partition
    starts = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("start_"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("number") % len(WEIGHTS)).cast("int") + 1)
    numbered = ranked.withColumn("part_", part).join(F.broadcast(starts), "part_").withColumn("number", F.col("start_") + inside)
    weighed = numbered.select("source_", "number", "docs_", "source_size_", weight.alias("weight_"))

    level = F.col("weight_") * F.lit(target_level(weighed))
    target = F.least(level, MOST_TIMES * F.col("source_size_").cast("double"))
    blocks = F.ceil(F.col("source_size_") / block_words).cast("long")
    quota = F.when(F.col("source_size_") > 0, F.round(F.col("target_") * F.col("blocks_") / F.col("source_size_")).cast("long")).otherwise(F.lit(0).cast("long"))
    planned = weighed.withColumns({"target_": target, "blocks_": blocks}).withColumn("quota_", F.least(quota, MOST_TIMES * F.col("blocks_")))
    return materialise(planned.drop("weight_"), "sources")


def target_level(weighed: DataFrame, share: Fraction = SHARE, most: int = MOST_TIMES) -> float:
    """What a weight of 1 gets, so that the targets sum to share of all sizes, none above most times its size.

    What the sources above theirs leave over is shared again by the weights of the others, until no more come above.
    """
    size, weight = most * F.col("source_size_"), F.col("weight_")
    total, open_ = weighed.agg(F.sum("source_size_"), F.sum("weight_")).first()
    left, level, before = share * (total or 0), Fraction(0), 0
    if open_:
        level = left / open_
    while open_:
        above = weight * F.lit(float(level)) > size
        n, full, open_ = weighed.agg(F.count_if(above), F.sum(F.when(above, size).otherwise(0)), F.sum(F.when(above, 0).otherwise(weight))).first()
        if n <= before or not open_:
            break
        level, before = (left - full) / open_, n
    return float(level)


def mix_slots(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """Every slot of the mix: ``shard``, ``number`` (of the source), ``slot``, ``block``.

    A shard's slots are drawn among groups of GROUP_SOURCES sources, then, by a task for each group, among its sources.
    Slot q of a source takes the block to which its permutation sends q modulo its blocks, so every block is taken
    equally often, but for one time.
    """
    ship(sources.sparkSession)
    grouped = sources.where("quota_ > 0").select(F.floor(F.col("number") / GROUP_SOURCES).cast("long").alias("group_"), "number", "blocks_", "quota_")
    quotas = sorted(grouped.groupBy("group_").agg(F.sum("quota_")).collect())  # one row for each GROUP_SOURCES sources
    by_shard = shard_draws([q for _, q in quotas], shards, [seed])
    slots = {g: [d[k] for d in by_shard] for k, (g, _) in enumerate(quotas)}

    def drawn(key, table):
        import pyarrow as pa

        group = key[0].as_py()
        rows, out = sorted(table.select(["number", "blocks_", "quota_"]).to_pylist(), key=lambda r: r["number"]), []
        draws = shard_draws([r["quota_"] for r in rows], shards, [seed, group], slots[group])
        for k, r in enumerate(rows):
            first = 0
            for shard, d in enumerate(draws):
                out.append((shard, r["number"], r["blocks_"], first, first + d[k]))
                first += d[k]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["shard", "number", "blocks", "begin", "end"])

    def dealt(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in slices(batches):
            for r in b.to_pylist():
                slot = np.arange(r["first"], r["last"])
                block = permuted(slot % r["blocks"], r["blocks"], seed * 1_000_003 + r["number"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(slot), r["shard"], np.int32)), pa.array(np.full(len(slot), r["number"], np.int64)), pa.array(slot), pa.array(block)],
                    ["shard", "number", "slot", "block"],
                )

    runs = grouped.groupBy("group_").applyInArrow(drawn, "shard int, number long, blocks long, begin long, end long").where("end > begin")
    runs = runs.select("shard", "number", "blocks", "end", F.explode(F.sequence("begin", F.col("end") - 1, F.lit(RUN_SLOTS).cast("long"))).alias("first"))
    runs = runs.select("shard", "number", "blocks", "first", F.least("end", F.col("first") + RUN_SLOTS).alias("last"))
    tasks = min(MOST_TASKS, sum(q for _, q in quotas) // TASK_SLOTS + 1)
    return runs.repartition(tasks, "shard", "number", "first").mapInArrow(dealt, "shard int, number long, slot long, block long")


def word_count(text: Column) -> Column:
    """The number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, size: Column, tie: Column, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """docs as ``row_`` with size_, source_size_, target_, begin_ (in its source's stream of words) and ``uses_``.

    uses_ lists the blocks that a document lies in and how often the mix takes each. The documents of a source
    are strung together in the order of a hash of doc_id and tie, packed into blocks, and the blocks joined to
    slots by index. The large source is dealt over chunks of that order; offsets of chunks and of documents in
    their chunk add up, so no task sees a whole source. Null text: no words; null source: a source of its own;
    repeated rows are documents of their own. An empty table gives an empty mix.
    """
    total = docs.count()
    chunks = min(MOST_CHUNKS, max(1, -(-total // CHUNK_ROWS)))
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"),
        F.col("source").alias("source_"), size.alias("size_"), F.col("doc_id").alias("id_"), tie.alias("tie_"),
    )
    sources = source_table(packed, block_words)
    spread = packed.withColumn("spread_", F.pmod(F.xxhash64("id_", "tie_"), F.lit(1 << 40)))
    spread = spread.withColumn("chunk_", F.floor(F.col("spread_") * chunks / (1 << 40)).cast("int"))
    named = F.coalesce(F.concat(F.lit("="), "source_"), F.lit(""))  # null has a name of its own
    spread, by_name = spread.withColumn("name_", named).drop("source_"), sources.withColumn("name_", named).select("name_", "number", "docs_", "source_size_", "target_")
    if sources.count() <= GROUP_SOURCES:
        known = spread.join(F.broadcast(by_name), "name_")
    else:
        known = join_by_key(spread, by_name, "name_", "docs_", total)

    sums = known.groupBy("number", "chunk_").agg(F.sum("size_").alias("n_"))
    before = Window.partitionBy("number").orderBy("chunk_").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("number", "chunk_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("at_"))
    in_chunk = Window.partitionBy("number", "chunk_").orderBy("spread_", "id_", "tie_").rowsBetween(Window.unboundedPreceding, -1)
    placed = known.withColumn("in_chunk_", F.coalesce(F.sum("size_").over(in_chunk), F.lit(0))).join(starts, ["number", "chunk_"])
    placed = placed.select("row_", "number", "size_", "source_size_", "target_", (F.col("at_") + F.col("in_chunk_")).alias("begin_"))
    placed = materialise(placed, "placed")

    uses = mix_slots(sources, shards, seed).groupBy("number", "block").agg(F.count(F.lit(1)).alias("uses"))
    first, last = F.expr(f"begin_ div {block_words}"), F.expr(f"(begin_ + size_ - 1) div {block_words}")
    lies = placed.where("size_ > 0").select("number", "begin_", F.explode(F.sequence(first, last)).alias("block"))
    # Spark takes the slots for few, as they are made of a short table; without the hint it would broadcast them
    taken = lies.join(uses.hint("merge"), ["number", "block"]).groupBy("number", "begin_").agg(F.sort_array(F.collect_list(F.struct("block", "uses"))).alias("uses_"))
    # begin_ is unique among documents with words
    with_words = placed.where("size_ > 0").join(taken, ["number", "begin_"], "left")
    return with_words.unionByName(placed.where("size_ = 0").withColumn("uses_", F.lit(None).cast(with_words.schema["uses_"].dataType)))


def taken_words(block_words: int = BLOCK_WORDS):
    """How many words of a document the mix takes: the overlap with each block times the uses of the block."""

    def overlap(u):
        start, end = u["block"] * block_words, (u["block"] + 1) * block_words
        return (F.least(end, F.col("begin_") + F.col("size_")) - F.greatest(start, F.col("begin_"))) * u["uses"]

    return F.coalesce(F.aggregate("uses_", F.lit(0).cast("long"), lambda n, u: n + overlap(u)), F.lit(0)).cast("long")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """The mix as documents with the columns of docs.

    A document comes once for each pass over it, with the words that lie in the blocks of that pass: the whole
    text as it was, or the taken words joined by one space. n_chars, if it is a column, follows the text.
    """
    schema = docs.schema
    names = docs.columns
    mix = mix_sources(docs, word_count(F.col("text")), F.xxhash64("text"), block_words, shards, seed).where("uses_ is not null")
    ship(docs.sparkSession)

    def emitted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches):
            at, texts = [], []
            columns = {c: b.column(i) for i, c in enumerate(names)}
            placed = [columns["text"], *(b.column(len(names) + k) for k in range(3))]
            for i, (text, begin, size, uses) in enumerate(zip(*(c.to_pylist() for c in placed), strict=True)):
                words = None
                for turn in range(1, max(u["uses"] for u in uses) + 1):
                    spans = [(max(u["block"] * block_words - begin, 0), min((u["block"] + 1) * block_words - begin, size)) for u in uses if u["uses"] >= turn]
                    at.append(i)
                    if sum(e - s for s, e in spans) == size:
                        texts.append(text)
                        continue
                    words = words or text.encode().split()
                    texts.append(b" ".join(w for s, e in spans for w in words[s:e]).decode())
            made = {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                made["n_chars"] = pa.array([len(t) for t in texts], pa.int64()).cast(columns["n_chars"].type)
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([made[c] if c in made else columns[c].take(index) for c in names], names)

    # columns go by their places here, so that no name of docs can clash
    flat = mix.select(*[F.col(f"row_.`{c}`").alias(f"c{i}") for i, c in enumerate(names)], "begin_", "size_", "uses_")
    return flat.mapInArrow(emitted, T.StructType([T.StructField(f.name, f.dataType) for f in schema]))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "source", "text")
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")), "sizes")
    mix = mix_sources(sized, F.col("size"), F.col("tie"))
    return mix.select("row_.doc_id", F.col("size_").alias("size"), F.col("source_size_").alias("source_size"), F.col("target_").alias("target"), taken_words().alias("taken"))
