"""Set similarity join by chosen paths: documents whose word shingles have a Jaccard similarity of a threshold or more.

Sets are split into buckets by tokens that they sample in the same way, large buckets are split again by further
tokens, small ones are searched by brute force, and runs with fresh hash functions are repeated until the target
recall. What the buckets propose is put together in groups, and the groups are verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill import ship
from pagemill.llm.common import KEYS, join_by_key, join_texts, materialise, mixed, nested, read_table, rolling, rows_of_repeated_keys, slices, unnested, word_hashes
from pagemill.llm.components import connected_components

WIDTH, THRESHOLD = 5, (4, 5)  # similarity as a fraction
#: Tokens that a set chooses at a level, as an expectation.
CHOSEN = 4
#: The same inside each large bucket, where sets draw again from their sketches.
CHOSEN_AGAIN = 2.5
RECALL = 0.9999
#: Buckets of more sets are split again, so often at most; what is still large then is proposed as one group.
BUCKET, DEPTH = 100, 3
#: Sets of a large bucket's main group that the few others are compared with at once.
CHUNK = 1000
#: Smallest token hashes kept as a sketch of a set, and the sketch similarity from which a pair is proposed: a pair at
#: the threshold has fewer than the 37 common tokens that this takes with probability 0.000014 at most.
SKETCH, SKETCH_LEAST = 64, 0.4
#: Sketch similarity to a large bucket's first set from which a set is settled there, and from which sets are proposed
#: with the first. Sketches are sets with a Jaccard distance of their own, so the triangle inequality holds for them
#: exactly: a set whose sketch is SKETCH_LEAST similar to that of a settled one is proposed with the same first set.
SETTLED = 0.85
FIRST_LEAST = SETTLED + SKETCH_LEAST - 1 - 1e-9
#: Sets of a verified block; larger groups are verified in pairs of blocks.
BLOCK = 512


def needed_runs(threshold: float, chosen: int = CHOSEN, recall: float = RECALL) -> int:
    """Runs until a pair at the threshold meets with probability recall.

    Two sets share at least threshold of the larger one's tokens; a shared token is chosen by both with
    probability chosen / size of the larger, so a run misses the pair with exp(-chosen * threshold) at most.
    """
    return max(1, math.ceil(math.log(1 - recall) / (-chosen * threshold)))


def missed(threshold: float, runs: int) -> float:
    """Bound of the probability that propose() misses a pair at the threshold, over all levels and the sketches.

    The worst case is a text that contains the other, with all its buckets large: m of its SKETCH tokens are common,
    binomially; too few fail the sketch test. Each large bucket that the pair shares keeps it with the probability
    that a common token is chosen again and the bucket of that token keeps it in turn; the last level keeps all.
    """
    lost = 0.0
    for m in range(SKETCH + 1):
        share = math.comb(SKETCH, m) * threshold**m * (1 - threshold) ** (SKETCH - m)
        kept = 1.0
        for _ in range(DEPTH - 1):
            kept = 1 - (1 - min(1.0, CHOSEN_AGAIN / SKETCH) * kept) ** m
        lost += share * (1.0 if m < SKETCH_LEAST * (2 * SKETCH - m) else math.exp(-runs * CHOSEN * threshold * kept))
    return lost


def runs_of_recursion(threshold: float, recall: float = RECALL) -> int:
    """Runs until a pair at the threshold is proposed with probability recall, whatever the size of its buckets."""
    runs = needed_runs(threshold, recall=recall)
    if missed(threshold, 1000) > 1 - recall:
        raise ValueError(f"sketches of {SKETCH} tokens don't reach recall {recall}")
    while missed(threshold, runs) > 1 - recall:
        runs += 1
    return runs


def shingles(text: bytes | None, width: int = WIDTH):
    """Sorted distinct hashes of the runs of width words; of all words if there are fewer; none for no words."""
    import numpy as np

    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    size = min(width, len(hashes))
    return np.unique(rolling(hashes, size) ^ np.uint64(size))


def set_name(tokens) -> bytes:
    """128 bits that name a set of tokens."""
    import xxhash

    return xxhash.xxh3_128_digest(tokens.tobytes())


def sketched(docs: DataFrame, runs: int, width: int = WIDTH) -> DataFrame:
    """For each row (doc_id, text): KEYS, ``node`` (name of its set, null for none), ``size``, ``sketch``, ``paths``."""
    ship(docs.sparkSession)

    def made(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        seeds = mixed(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
        for b in slices(batches):
            rows = []
            for text in b.column(2).to_pylist():
                t = shingles(text, width)
                if not len(t):
                    rows.append((None, 0, [], []))
                    continue
                least = np.uint64(min(2**64 - 1, int(CHOSEN / len(t) * 2**64)))
                scores = [mixed(t ^ s) for s in seeds]
                paths = np.concatenate([s[s <= least] for s in scores]).view(np.int64)
                rows.append((set_name(t), len(t), (t[:SKETCH] >> np.uint64(32)).astype(np.uint32).view(np.int32), paths))
            kinds = [pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], [*KEYS, "node", "size", "sketch", "paths"])

    slim = docs.select(F.col("doc_id").alias("key_"), F.xxhash64("text").alias("tie_"), F.col("text").cast("binary").alias("text"))
    kind = slim.schema["key_"].dataType.simpleString()
    return slim.mapInArrow(made, f"key_ {kind}, tie_ long, node binary, size int, sketch array<int>, paths array<long>")


def proposed_in(bucket: list[tuple[int, list[int]]]) -> list[tuple[int, int]]:
    """Brute force in a bucket of (id, sketch): links of similar sketches, thinned to a forest of stars."""
    import numpy as np

    ids = [i for i, _ in bucket]
    if len(bucket) == 2:
        a, b = (set(s) for _, s in bucket)
        n = len(a & b)
        return [(ids[0], ids[1])] if n >= SKETCH_LEAST * (len(a) + len(b) - n) else []
    tokens, at = np.unique(np.concatenate([np.asarray(s, np.int32) for _, s in bucket]), return_inverse=True)
    x = np.zeros((len(bucket), len(tokens)), np.float32)
    x[np.repeat(np.arange(len(bucket)), [len(s) for _, s in bucket]), at] = 1
    return stars(ids, similar(x @ x.T, x.sum(1), x.sum(1), SKETCH_LEAST, 1))


def proposed_between(others: list[tuple[int, list[int]]], inside: list[tuple[int, list[int]]]) -> list[tuple[int, int]]:
    """Brute force between sets and those of one group, all (id, sketch): for each set a link with one that is similar."""
    import numpy as np

    if not others:
        return []

    def matrix(sets, tokens):
        flat = np.concatenate([np.asarray(t, np.int32) for _, t in sets])
        owner = np.repeat(np.arange(len(sets)), [len(t) for _, t in sets])
        at = np.minimum(np.searchsorted(tokens, flat), len(tokens) - 1)
        known = tokens[at] == flat
        x = np.zeros((len(sets), len(tokens)), np.float32)
        x[owner[known], at[known]] = 1
        return x, np.array([len(t) for _, t in sets], np.float32)

    tokens = np.unique(np.concatenate([np.asarray(t, np.int32) for _, t in others]))
    (x, size_x), (y, size_y) = matrix(others, tokens), matrix(inside, tokens)
    linked = similar(x @ y.T, size_x, size_y, SKETCH_LEAST, 1)
    return [(others[k][0], inside[int(linked[k].argmax())][0]) for k in np.flatnonzero(linked.any(1))]


def similar(common, sizes_a, sizes_b, num: float, den: float):
    """Where common / union >= num / den, for a matrix of common counts."""
    return den * common >= num * (sizes_a[:, None] + sizes_b[None, :] - common)


def stars(ids: list[int], linked) -> list[tuple[int, int]]:
    """(smallest id, id) for each connected group of the symmetric matrix linked."""
    import numpy as np

    found, todo = [], np.ones(len(ids), bool)
    for first in np.argsort(np.array(ids)):
        if not todo[first]:
            continue
        group = frontier = np.zeros(len(ids), bool)
        group = frontier = group.copy()
        frontier[first] = group[first] = True
        while frontier.any():
            reached = linked[frontier].any(0) & ~group
            group = group | reached
            frontier = reached
        todo &= ~group
        found += [(ids[first], ids[k]) for k in np.flatnonzero(group) if k != first]
    return found


def propose(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Links (a, b) between sets that may be similar, by the recursion over buckets.

    nodes: id, size, sketch, paths. Buckets of equal members are searched once. In a large bucket every set is first
    compared with the smallest one: similar ones are proposed with it, very similar ones are settled, and only the
    others are split, each bucket by itself. A bucket whose sets are all in one group by now is not split; if no more than BUCKET are
    not, these are compared with the whole bucket by brute force. So a large group of near copies does not multiply. A bucket
    that stays large through all levels is proposed as one star, so nothing in it is lost.
    """
    spark = nodes.sparkSession
    rows = nodes.select("id", F.explode("paths").alias("path"))
    small, links, mixed_buckets, sum_large = [], [], [], 0
    for level in range(depth):
        kept = materialise(rows_of_repeated_keys(materialise(rows, f"paths-{level}"), "path", "n", "paths"), f"buckets-{level}")
        small.append(kept.where(F.col("n") <= BUCKET).select("path", "id"))
        large = kept.where(F.col("n") > BUCKET).select("path", "id")
        n_large = large.count()
        if not n_large:
            break
        first = large.groupBy("path").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n_path"))
        if level + 1 == depth:
            links.append(join_by_key(large, first, "path", "n_path", n_large).select("a", F.col("id").alias("b")))
            break
        first = first.join(nodes.select(F.col("id").alias("a"), F.col("sketch").alias("first_sketch")), "a")
        compared = join_by_key(large, materialise(first, f"firsts-{level}"), "path", "n_path", n_large).join(nodes.select("id", "sketch"), "id")
        common = F.size(F.array_intersect("sketch", "first_sketch"))
        near = common / (F.size("sketch") + F.size("first_sketch") - common)
        compared = materialise(compared.select("path", "id", "a", near.alias("near")), f"compared-{level}")
        links.append(compared.where(F.col("near") >= FIRST_LEAST).select("a", F.col("id").alias("b")))

        # Sets of one group are verified with each other in any case, so a bucket of one group need not be split.
        labelled = nodes.join(group_labels(_united(links), sum_large := sum_large + n_large), "id", "left").select("id", "sketch", F.coalesce("label", "id").alias("group"))
        # the path is part of the key, so each bucket is split by draws of its own
        draw = f"filter(transform(sketch, t -> xxhash64(path, t, {level})), k -> pmod(k, 1073741824L) * size(sketch) < {CHOSEN_AGAIN} * 1073741824L)"
        grouped = compared.join(labelled, "id").select("path", "id", "group", F.when(F.col("near") < SETTLED, F.expr(draw)).alias("drawn"))
        grouped = materialise(grouped, f"grouped-{level}")
        sizes = grouped.groupBy("path", "group").agg(F.count(F.lit(1)).alias("n"))
        sizes = sizes.groupBy("path").agg(F.sum("n").alias("n_path"), F.max(F.struct("n", "group")).alias("main"))
        open_ = sizes.select("path", "n_path", F.col("main.group").alias("main"), (F.col("n_path") - F.col("main.n")).alias("others"))
        open_ = materialise(open_.where("others > 0"), f"open-{level}")
        # few sets outside its main group are compared with the whole bucket, in chunks; else its sets draw again
        met = join_by_key(grouped.select("path", "id", "group"), open_.where(F.col("others") <= BUCKET), "path", "n_path", n_large)
        chunks = F.ceil(F.col("n_path") / CHUNK).cast("int")
        inside = met.where("group = main").select("path", F.pmod(F.xxhash64("id"), chunks).cast("int").alias("chunk"), "id", F.lit(False).alias("other"))
        outside = met.where("group <> main").select("path", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), "id", F.lit(True).alias("other"))
        mixed_buckets.append(inside.unionByName(outside))
        again = join_by_key(grouped.where("drawn is not null").select("path", "id", "drawn"), open_.where(F.col("others") > BUCKET), "path", "n_path", n_large)
        rows = again.select("id", F.explode("drawn").alias("path"))

    # at most BUCKET members each
    members = _united(small).groupBy("path").agg(F.sort_array(F.collect_set("id")).alias("ids")).groupBy("ids").agg(F.min("path").alias("path"))
    each = members.select("path", F.explode("ids").alias("id")).join(nodes.select("id", "sketch"), "id")
    gathered = each.groupBy("path").agg(F.collect_list(F.struct("id", "sketch", F.lit(True).alias("other"))).alias("members"))
    if mixed_buckets:  # at most CHUNK members or so, and BUCKET others
        each = _united(mixed_buckets).join(nodes.select("id", "sketch"), "id")
        gathered = gathered.unionByName(each.groupBy("path", "chunk").agg(F.collect_list(F.struct("id", "sketch", "other")).alias("members")).select("path", "members"))

    def searched(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches):
            found = []
            for bucket in b.column(0).to_pylist():
                others, inside = ([(m["id"], m["sketch"]) for m in bucket if m["other"] == o] for o in (True, False))
                found += proposed_between(others, inside) if inside else []
                found += proposed_in(others) if len(others) > 1 else []
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

    ship(spark)
    links.append(gathered.select("members").mapInArrow(searched, "a long, b long"))
    return _united(links)


def group_labels(links: DataFrame, total: int) -> DataFrame:
    """``id`` and ``label`` for every id in links (first set a, id b; a is linked with itself): equal labels mean connected ids.

    total: how many links there are at most.

    A label is the smallest first set that is reached from an id over its first sets, their other ids and those' first
    sets. Ids that are connected by longer ways may have different labels.
    """
    own = links.groupBy("b").agg(F.min("a").alias("label"))
    by_first = links.join(own, "b").groupBy("a").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("n"))
    met = join_by_key(links, materialise(by_first, "labels"), "a", "n", total)
    return met.groupBy(F.col("b").alias("id")).agg(F.min("label").alias("label"))


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def verified_in(group: list[dict], width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> list[tuple[int, int, int]]:
    """Exact similarities in a block or between two blocks: for each id its links to the other texts, and its group."""
    import numpy as np

    i, j = group[0]["i"], group[0]["j"]
    sets = [shingles(r["text"], width) for r in group]
    ids, copies = [r["id"] for r in group], np.array([r["copies"] for r in group], np.int64)
    sizes = np.array([len(s) for s in sets], np.float64)
    tokens, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    shared = often[at] > 1
    at, owner = (np.cumsum(often > 1) - 1)[at[shared]], owner[shared]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    common = np.zeros((len(sets), len(sets)), np.float64)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        a, z = np.searchsorted(at, [low, low + 4096])
        x = np.zeros((len(sets), 4096), np.float32)
        x[owner[a:z], at[a:z] - low] = 1
        common += x @ x.T
    linked = similar(common, sizes, sizes, *threshold)
    np.fill_diagonal(linked, False)
    if i != j:  # links within the two blocks are counted elsewhere
        block = np.array([r["block"] for r in group])
        linked &= block[:, None] != block[None, :]
    links = linked @ copies
    roots = dict(zip(ids, ids, strict=True)) | {b: a for a, b in stars(ids, linked)}
    return [(x, int(n), roots[x]) for x, n in zip(ids, links, strict=True)]


def verify(texts: DataFrame) -> DataFrame:
    """``id``, ``links``, ``root`` for texts (id, text, copies, root, block, i, j): one row for each block pair of an id."""

    def checked(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(rows: list[dict]):
            found = verified_in(rows)
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], ["id", "links", "root"])

        key, waiting = None, []
        for b in slices(batches):
            for r in b.to_pylist():
                if (k := (r["root"], r["i"], r["j"])) != key:
                    if len(waiting) > 1:
                        yield out(waiting)
                    key, waiting = k, []
                waiting.append(r)
        if len(waiting) > 1:
            yield out(waiting)

    ship(texts.sparkSession)
    sorted_ = texts.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return sorted_.mapInArrow(checked, "id long, links long, root long")


def classified(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """For every row of docs (doc_id, text): KEYS, ``class_id``, ``n_links`` and ``is_first`` (null for a text without words).

    Sets are vertices with numbers of their own, so rows that share a doc_id are told apart by their texts. The
    first of a class is the row with the smallest doc_id (null is last), then the smallest hash of its text.
    """
    runs = runs_of_recursion(THRESHOLD[0] / THRESHOLD[1], recall)
    table = materialise(sketched(docs, runs), "sketches")
    alive = table.where(F.col("node").isNotNull())
    row = F.struct(F.col("key_").isNull().alias("last"), *KEYS)
    nodes = alive.groupBy("node").agg(
        F.min(row).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths")
    )
    nodes = materialise(nodes.withColumn("id", F.monotonically_increasing_id()), "sets")  # writing the table fixes the numbers
    groups = materialise(connected_components(propose(nodes)), "groups")
    large = groups.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    placed = join_by_key(groups, large, "label", "n", groups.count())
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = placed.select("id", F.col("label").alias("root"), blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    placed = placed.join(nodes.select("id", "copies", F.col("first.key_").alias("rkey_"), F.col("first.tie_").alias("rtie_")), "id")
    checked = materialise(verify(_once(docs, table, materialise(placed, "members"))), "verified")

    classes = connected_components(checked.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = checked.groupBy("id").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "id", "first", "copies").join(classes, "id", "left").join(links, "id", "left")
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    named = materialise(named.select("node", "first", "copies", F.coalesce("label", "id").alias("label"), n_links.alias("n_links")), "classes")
    firsts = named.groupBy("label").agg(F.min("first").alias("class_first"), F.count(F.lit(1)).alias("n_label"))
    named = materialise(join_by_key(named, firsts, "label", "n_label", named.count()).select("node", "copies", "class_first", "n_links"), "named")
    found = join_by_key(alive.select("node", *KEYS), named, "node", "copies", alive.count())
    found = found.select(*KEYS, F.col("class_first.key_").alias("class_id"), "n_links", (F.struct(*KEYS) == F.struct("class_first.key_", "class_first.tie_")).alias("is_first"))
    alone = table.where(F.col("node").isNull())
    return found.unionByName(alone.select(*KEYS, F.col("key_").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("boolean").alias("is_first")))


def _once(docs: DataFrame, table: DataFrame, placed: DataFrame) -> DataFrame:
    """The text of each set in placed (id, rkey_, rtie_, copies, root, block, blocks), for each pair of blocks that it is verified in.

    A row that was entered several times gives its text once.
    """
    texts = docs.select(F.col("doc_id").alias("key_"), F.xxhash64("text").alias("tie_"), F.col("text").cast("binary").alias("text"))
    met = join_texts(texts, placed).select("id", "text", "copies", "root", "block", "blocks")
    again = table.where(F.col("node").isNotNull()).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = join_texts(again, placed.select("id", "rkey_", "rtie_")).select("id")
    again = materialise(again, "repeated-rows")
    if not again.isEmpty():
        rest = ["copies", "root", "block", "blocks"]
        several = met.join(again, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"), *[F.first(c).alias(c) for c in rest])
        met = met.join(again, "id", "left_anti").unionByName(several.select(met.columns))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).cast("int").alias("i"), F.greatest("block", o).cast("int").alias("j"))
    )
    return met.select("*", F.explode(pairs).alias("p")).select("id", "text", "copies", "root", "block", "p.i", "p.j")


def similarity_classes(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """``doc_id``, ``class_id`` (smallest doc_id of the connected class), ``n_links`` for every row of docs (doc_id, text).

    A link joins two rows whose sets of WIDTH-word shingles have a Jaccard similarity of THRESHOLD or more; a
    text of fewer words is one shingle. n_links counts a row's links to other rows, copies included. Equal
    sets are one vertex, so copies never meet in pairs. A null or empty text has no links and is a class of its
    own. Rows that share a doc_id are judged by their own texts. A null doc_id is a row like any other, but names no
    class unless all rows of the class have none.
    """
    return classified(docs, recall).select(F.col("key_").alias("doc_id"), "class_id", "n_links")


def first_of_each_class(docs: DataFrame) -> DataFrame:
    """One row of each class of docs: that of the smallest doc_id (null is last), then of the smallest hash of the text.

    Of rows equal in doc_id and text one stays, by a hash of all columns. A text is never dropped but for a similar
    one that stays; rows without words all stay. All columns stay.
    """
    found = materialise(classified(docs.select("doc_id", "text")), "doc-classes")
    named = {"key_": "rkey_", "tie_": "rtie_"}
    dropped = materialise(found.where(~F.col("is_first")).select(*KEYS).distinct().withColumnsRenamed(named), "dropped")
    again = found.where("is_first").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEYS)
    again = materialise(again.withColumnsRenamed(named), "repeated")
    packed = nested(docs).select("row_", F.col("row_.doc_id").alias("key_"), F.xxhash64("row_.text").alias("tie_"))
    rest = join_texts(packed, dropped, "left_anti", 500_000)
    if not again.isEmpty():
        plain = [F.col(f"row_.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]  # maps have no hash
        once = join_texts(rest, again, "left_semi").groupBy(*KEYS).agg(F.min_by("row_", F.xxhash64(*plain)).alias("row_"))
        rest = join_texts(rest, again, "left_anti").unionByName(once.select(rest.columns))
    return unnested(rest, docs, {})


def op5_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and links of all documents."""
    return similarity_classes(read_table(spark, sf_dir, "documents", "doc_id", "text"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 5 * common.n >= 4 * (s.n + t.n - common.n)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT doc_id, min(other) AS class_id, (SELECT count(*) FROM links WHERE links.a = reach.doc_id) AS n_links FROM reach GROUP BY doc_id
"""
