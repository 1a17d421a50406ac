"""Helpers shared by the corpus operators: reading tables, shared storage, skew-safe key joins, word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that hold more than 1/HEAVY_PARTS of all rows are heavy; there can be fewer than HEAVY_PARTS of them.
HEAVY_PARTS = 1000
#: Rows of an Arrow batch that Python works on at once. Spark bounds the bytes of a batch, this bounds the objects made of it.
BATCH_ROWS = 500


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A test table by name, with the given columns only (all if none are given)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def slices(batches: Iterable, rows: int = BATCH_ROWS) -> Iterator:
    """Arrow batches cut into pieces of at most rows rows."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master without that setting gets a temporary folder; a cluster without it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-pagemill-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to a table of its own in the shared folder and read it back.

    This cuts the lineage: later stages survive the loss of executors without recomputing df.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_by_key(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with table, which has one row for each key and, in count, how many of the rows have that key.

    Keys with more than a thousandth of all total rows are fewer than a thousand: they are broadcast, and their
    rows stay where they are. The rest is joined by key, and no key of the rest can fill a partition. how: inner, or
    left to keep rows whose key is not in the table (such a key must be rare, null included).
    """
    limit = max(2, total // HEAVY_PARTS)
    heavy = F.broadcast(table.where(F.col(count) > limit))
    return rows.join(heavy, key).unionByName(rows.join(heavy, key, "left_anti").join(table.where(F.col(count) <= limit), key, how))


def rows_of_repeated_keys(rows: DataFrame, key: str, count_as: str = "n_key", tag: str = "key") -> DataFrame:
    """The rows whose key occurs in two rows or more, with the number of rows of the key; null keys are dropped.

    rows should be a materialised table, as it is read more than once. No key fills a partition (join_by_key).
    """
    counts = materialise(
        rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(count_as)).where(F.col(count_as) > 1),
        f"{tag}-counts",
    )
    return join_by_key(rows, counts, key, count_as, counts.agg(F.sum(count_as)).first()[0] or 0)


#: Of a row, what finds it again in another table: its id, which may be null or stand in several rows, and a hash of its text.
KEYS = ["key_", "tie_"]


def join_texts(rows: DataFrame, ids: DataFrame, how: str = "inner", most: int = 200_000) -> DataFrame:
    """rows (with KEYS) joined with ids (rkey_, rtie_ and short columns; a materialised table); a null id finds its own.

    ids is broadcast if it has at most most rows, else both are shuffled.
    """
    on = F.col("key_").eqNullSafe(F.col("rkey_")) & (F.col("tie_") == F.col("rtie_"))
    return rows.join(F.broadcast(ids) if ids.count() <= most else ids, on, how)


def nested(df: DataFrame, name: str = "row_") -> DataFrame:
    """All columns of df as one struct, so that working columns cannot clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def unnested(df: DataFrame, like: DataFrame, extra: dict[str, Column], name: str = "row_") -> DataFrame:
    """Undo nested(); extra columns replace columns of the same name, which Spark compares without regard to case."""
    replaced = {k.lower() for k in extra}
    kept = [F.col(f"{name}.`{c}`").alias(c) for c in like.columns if c.lower() not in replaced]
    return df.select(*kept, *[c.alias(k) for k, c in extra.items()])


def apart(df: DataFrame, *names: str) -> DataFrame:
    """The columns names as they are, all others as one struct ``row_``: what is added beside them cannot clash with these."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return df.select(F.struct(*(rest or [F.lit(0).alias("none_")])).alias("row_"), *names)


def together(df: DataFrame, like: DataFrame, *names: str) -> DataFrame:
    """Undo apart(): the columns of like, in their order and with their values."""
    return df.select(*[F.col(c) if c in names else F.col(f"row_.`{c}`").alias(c) for c in like.columns])


def words_of(text: str | bytes | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in UTF-8; none for null.

    bytes.split() separates at exactly these six ASCII characters.
    """
    if text is None:
        return []
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).split()


def mixed(values):
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    import numpy as np

    with np.errstate(over="ignore"):
        v = values.astype(np.uint64, copy=True)
        v ^= v >> np.uint64(30)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        v ^= v >> np.uint64(27)
        v *= np.uint64(0x94D049BB133111EB)
        v ^= v >> np.uint64(31)
    return v


#: Bytes hashed at once; a longer text is cut between words.
HASHED_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_powers: dict = {}


def _hash_tables(n: int):
    """Values of bytes, which bytes are spaces, powers of the base and of its inverse, for texts of up to n bytes."""
    import numpy as np

    if _powers.get("n", 0) < n:
        size = max(n, HASHED_BYTES) + 1
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        spaces = np.zeros(256, bool)
        spaces[[9, 10, 11, 12, 13, 32]] = True
        _powers.update(n=size - 1, values=mixed(np.arange(1, 257)), spaces=spaces, up=np.cumprod(up), down=np.cumprod(down))
    return _powers


def word_hashes(text: bytes | None):
    """64-bit hashes of the words of a text in UTF-8 (see words_of), in order.

    A polynomial over the word's bytes, taken from the running sum over the whole text, so that no word is looked
    at alone.
    """
    import numpy as np

    if not text:
        return np.empty(0, np.uint64)
    parts, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > HASHED_BYTES:
            # up to the last space within reach, or, in a longer word, the next one
            inside = max(text.rfind(s, at, at + HASHED_BYTES) for s in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
            after = [p for s in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c") if (p := text.find(s, at + HASHED_BYTES)) >= 0]
            end = inside + 1 if inside >= at else min(after, default=len(text) - 1) + 1
        parts.append(_part_hashes(np.frombuffer(text, np.uint8, end - at, at)))
        at = end
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _part_hashes(codes):
    import numpy as np

    tables = _hash_tables(len(codes))
    solid = np.zeros(len(codes) + 2, np.int8)
    solid[1:-1] = ~tables["spaces"][codes]
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edges[::2], edges[1::2]
    sums = np.zeros(len(codes) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(tables["values"][codes] * tables["up"][: len(codes)], out=sums[1:])
        return mixed((sums[end] - sums[start]) * tables["down"][start] + (end - start).astype(np.uint64))


def rolling(hashes, width: int):
    """Scrambled 64-bit hashes of all runs of width consecutive elements (empty if there are fewer)."""
    import numpy as np

    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # Blocks double: h(2k) = h(k) * M^k + h(k) shifted by k, so that a width costs log2(width) passes.
    base, out, done = _BASE, None, 0
    block, size, bit = hashes, 1, width
    with np.errstate(over="ignore"):
        while bit:
            if bit & 1:
                part = block[done : done + n]
                out = part.copy() if out is None else out * np.uint64(pow(base, size, 1 << 64)) + part
                done += size
            bit >>= 1
            if bit:
                block = block[:-size] * np.uint64(pow(base, size, 1 << 64)) + block[size:]
                size *= 2
    return mixed(out)
