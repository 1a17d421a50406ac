"""Quality rules with a linear-chain conditional random field that marks each line as content or boilerplate.

Only whole documents have labels. The marks of their lines are latent: the field is trained by expectation and
maximisation, where the expected marks must agree with the document's label (see train_field), so that a good line in a
bad document counts as content and the other way round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import ship
from pagemill.llm.common import read_table, rolling, slices, word_hashes

CONTENT, BOILERPLATE = 0, 1
#: Labelled documents, and lines of them all, that the field is trained on at most. Documents are taken whole; those
#: with more than a tenth of all lines are left out of the training.
MOST_TRAINING_ROWS, MOST_TRAINING_LINES = 3000, 200_000
#: Rounds of expectation and maximisation, and gradient steps of a maximisation.
ROUNDS, STEPS = 12, 10
#: What the label of a document says of the expected share of its words in boilerplate lines, and by how much scores are
#: sharpened before the marks are expected (otherwise the field fades from round to round).
BAD_LEAST, GOOD_MOST, SHARPNESS = 0.5, 0.5, 2.0
#: A document is kept if at least this share of its words stands in content lines.
CONTENT_SHARE = 0.5
REPEAT_WIDTH = 8
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\r\x0b\x0c"
_NOT_FIRST = bytes(range(0x80, 0xC0))  # continuation bytes of UTF-8
_CAPITALS, _DIGITS = bytes(range(0x41, 0x5B)), b"0123456789"
FEATURES = (
    "constant", "one word", "two to four words", "over forty words", "some symbols", "many symbols", "mostly capitals", "many digits",
    "ends a sentence", "exclamations", "equals an earlier line", "few distinct words", "hardly any distinct words", "address",
)


def line_features(line: bytes, words: list[bytes], again: bool) -> int:
    """The features of a line that has words, as bits in the order of FEATURES."""
    n, size = len(words), len(line)
    symbols = size - len(line.translate(None, _SYMBOLS))
    capitals, digits = size - len(line.translate(None, _CAPITALS)), size - len(line.translate(None, _DIGITS))
    distinct = len(set(words))
    return (
        1
        | (n == 1) << 1
        | (2 <= n <= 4) << 2
        | (n > 40) << 3
        | (0 < symbols * 5 < n) << 4
        | (symbols * 5 >= n) << 5
        | (2 * capitals > size) << 6
        | (5 * digits > size) << 7
        | (line.rstrip()[-1:] in (b".", b"!", b"?")) << 8
        | (line.count(b"!") * 5 > n) << 9
        | again << 10
        | (n > 4 and 2 * distinct < n) << 11
        | (n > 4 and 5 * distinct < n) << 12
        | (b"://" in line or b"@" in line) << 13
    )


def described(text: bytes | None) -> tuple[list[int], list[int], int]:
    """For the lines with words: features and number of words; and how many of them equal an earlier line."""
    bits, sizes, seen, repeated = [], [], set(), 0
    for line in (text or b"").split(b"\n"):
        words = line.split()
        if words:
            again = line in seen
            repeated += again
            seen.add(line)
            bits.append(line_features(line, words, again))
            sizes.append(len(words))
    return bits, sizes, repeated


@dataclass
class LineField:
    """A linear-chain conditional random field over the two marks; scores are logarithms."""

    emission: list[list[float]]  # by mark, then feature
    transition: list[list[float]]  # by mark before, then mark
    start: list[float]

    def __post_init__(self):
        self._gain: dict[int, float] = {}

    def gain(self, bits: int) -> float:
        """By how much a line's features speak for boilerplate against content."""
        g = self._gain.get(bits)
        if g is None:
            on = [k for k in range(len(FEATURES)) if bits >> k & 1]
            g = self._gain[bits] = sum(self.emission[BOILERPLATE][k] - self.emission[CONTENT][k] for k in on)
        return g

    def viterbi(self, lines: list[int]) -> list[int]:
        """The most likely marks of a document's lines; content wins ties."""
        if not lines:
            return []
        (cc, cb), (bc, bb) = self.transition
        content, boiler = self.start[CONTENT], self.start[BOILERPLATE] + self.gain(lines[0])
        to_content, to_boiler = [], []
        for bits in lines[1:]:
            from_b, from_c = boiler + bc > content + cc, content + cb < boiler + bb
            to_content.append(from_b)
            to_boiler.append(from_c)
            content, boiler = (boiler + bc if from_b else content + cc), (boiler + bb if from_c else content + cb) + self.gain(bits)
        mark = int(boiler > content)
        marks = [mark]
        for k in range(len(lines) - 2, -1, -1):
            mark = int((to_boiler if mark else to_content)[k])
            marks.append(mark)
        return marks[::-1]


class Lattice:
    """Documents laid out by line number, so that forward and backward sums run over all documents at once.

    The longest documents come first: line t of all documents that have one stands in one block of the flat arrays.
    """

    def __init__(self, documents: list[tuple[list[int], list[int], int]]):
        import numpy as np

        documents = sorted((d for d in documents if d[0]), key=lambda d: -len(d[0]))
        self.n = len(documents)
        lengths = np.array([len(d[0]) for d in documents], np.int64)
        sizes = [int((lengths > t).sum()) for t in range(int(lengths[0]) if self.n else 0)]
        self.blocks = [(int(z) - m, int(z)) for z, m in zip(np.cumsum(sizes), sizes, strict=True)]
        self.doc = np.concatenate([np.arange(m) for m in sizes]) if sizes else np.empty(0, np.int64)
        bits = np.array([documents[d][0][t] for t, m in enumerate(sizes) for d in range(m)], np.int64)
        words = np.array([documents[d][1][t] for t, m in enumerate(sizes) for d in range(m)], float)
        self.kinds, self.kind = np.unique(bits, return_inverse=True)  # lines of the same features score alike
        self.x = ((self.kinds[:, None] >> np.arange(len(FEATURES))) & 1).astype(float)
        self.share = words / np.maximum(np.bincount(self.doc, words, self.n), 1)[self.doc]
        self.pull = self.share * lengths[self.doc]  # 1 for a line of average size
        self.bad = np.array([d[2] == BOILERPLATE for d in documents], bool)
        self.ends = np.zeros(len(bits), bool)
        for d, n in enumerate(lengths):
            self.ends[self.blocks[n - 1][0] + d] = True

    def expected(self, w, tr, st, tilt=None):
        """Probability of boilerplate for each line, expected transitions, expected first marks; tilt is added to boilerplate."""
        import numpy as np

        score = (self.x @ w.T)[self.kind]
        if tilt is not None:
            score[:, 1] += tilt[self.doc] * self.pull
        forward, backward = np.empty_like(score), np.zeros_like(score)
        forward[: self.n] = st + score[: self.n]
        for (a, _), (c, z) in zip(self.blocks, self.blocks[1:]):
            f = forward[a : a + z - c]
            forward[c:z] = np.logaddexp(f[:, :1] + tr[0], f[:, 1:] + tr[1]) + score[c:z]
        for (a, _), (c, z) in zip(self.blocks[-2::-1], self.blocks[:0:-1]):
            later = score[c:z] + backward[c:z]
            backward[a : a + z - c] = np.logaddexp(later[:, :1] + tr[:, 0], later[:, 1:] + tr[:, 1])
        norm = np.empty(self.n)
        norm[self.doc[self.ends]] = np.logaddexp(forward[self.ends, 0], forward[self.ends, 1])
        p = np.exp(forward[:, 1] + backward[:, 1] - norm[self.doc])
        pairs = np.zeros((2, 2))
        for (a, _), (c, z) in zip(self.blocks, self.blocks[1:]):
            later, f = score[c:z] + backward[c:z] - norm[: z - c, None], forward[a : a + z - c]
            pairs += np.exp(f[:, :, None] + tr + later[:, None, :]).sum(0)
        return p, pairs, np.array([(1 - p[: self.n]).sum(), p[: self.n].sum()])

    def counts(self, p):
        """Expected features by mark."""
        import numpy as np

        by_kind = [np.bincount(self.kind, q, len(self.kinds)) for q in (1 - p, p)]
        return np.stack([k @ self.x for k in by_kind])

    def agreeing(self, w, tr, st):
        """expected() under the labels: the closest distribution in which every document's expected share of words in
        boilerplate is BAD_LEAST or more, or GOOD_MOST or less. One multiplier for each document, by bisection."""
        import numpy as np

        def share(tilt):
            return np.bincount(self.doc, self.expected(w, tr, st, tilt)[0] * self.share, self.n)

        sign = np.where(self.bad, 1.0, -1.0)
        wrong = lambda s: np.where(self.bad, s < BAD_LEAST, s > GOOD_MOST)
        low, high = np.zeros(self.n), np.where(wrong(share(np.zeros(self.n))), 40.0, 0.0)
        for _ in range(8):
            middle = (low + high) / 2
            more = wrong(share(sign * middle))
            low, high = np.where(more, middle, low), np.where(more, high, middle)
        return self.expected(w, tr, st, sign * high)


def train_field(documents: list[tuple[list[int], list[int], int]], rounds: int = ROUNDS, steps: int = STEPS, penalty: float = 1.0) -> LineField:
    """Fit the field to documents: features of their lines, words of their lines, and BOILERPLATE or CONTENT for the whole.

    The marks of lines are not known. Round 0 takes every line for what its document is, and fits the features alone.
    Each further round takes the expected marks under the sharpened field, held to the labels (Lattice.agreeing), and moves the
    field towards them by the gradient of the likelihood (expected counts by forward and backward sums).
    """
    import numpy as np

    k = len(FEATURES)
    lattice = Lattice(documents)
    w, tr, st = np.zeros((2, k)), np.zeros((2, 2)), np.zeros(2)
    if not lattice.n:
        return LineField(w.tolist(), tr.tolist(), st.tolist())
    moments, step = [np.zeros(2 * k + 6), np.zeros(2 * k + 6)], 0
    for turn in range(rounds + 1):
        if turn:
            p, pairs, first = lattice.agreeing(SHARPNESS * w, SHARPNESS * tr, SHARPNESS * st)
        else:
            p = lattice.bad[lattice.doc].astype(float)
        seen = lattice.counts(p)
        for _ in range(steps if turn else 4 * steps):
            step += 1
            q, both, begun = lattice.expected(w, tr, st)
            slope = np.concatenate([
                (seen - lattice.counts(q) - penalty * w).ravel(),
                (pairs - both - penalty * tr).ravel() if turn else np.zeros(4),
                first - begun - penalty * st if turn else np.zeros(2),
            ]) / lattice.n
            moments[0] = 0.9 * moments[0] + 0.1 * slope
            moments[1] = 0.99 * moments[1] + 0.01 * slope * slope
            move = 0.1 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
            w, tr, st = w + move[: 2 * k].reshape(2, k), tr + move[2 * k : 2 * k + 4].reshape(2, 2), st + move[2 * k + 4 :]
    return LineField(w.tolist(), tr.tolist(), st.tolist())


def train_on_labels(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING_ROWS, most_lines: int = MOST_TRAINING_LINES) -> LineField:
    """A field trained on at most most labelled documents of most_lines lines together; quality 0 is bad, any other good.

    Ids may be of any type; null ids and labels are left out, repeated labels count as the smaller, and repeated ids
    bring all their texts. The sample is the same at every run, documents are whole. Without labels all lines are content.
    """
    ship(docs.sparkSession)
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    # low quality is rare, so half of the places are reserved for it
    halves = [chosen.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for c in (F.col("quality") == 0, F.col("quality") != 0)]
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(halves[0].union(halves[1])), "doc_id")  # at most most rows

    def listed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches):
            found = [described(t) for t in b.column(0).to_pylist()]
            made = [pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*made, b.column(1), b.column(2)], ["bits", "sizes", "quality", "hash"])

    sample = rows.select("text", "quality", F.xxhash64("doc_id", "text").alias("hash")).mapInArrow(listed, "bits array<int>, sizes array<int>, quality int, hash long")
    whole = sample.where((F.size("bits") > 0) & (F.size("bits") <= most_lines // 10)).orderBy("hash", "bits").limit(most)
    so_far = F.sum(F.size("bits")).over(Window.orderBy("hash", "bits").rowsBetween(Window.unboundedPreceding, 0))  # over most rows at most
    collected = whole.withColumn("lines", so_far).where(F.col("lines") <= most_lines).orderBy("hash", "bits").collect()
    return train_field([(list(r["bits"]), list(r["sizes"]), BOILERPLATE if r["quality"] == 0 else CONTENT) for r in collected])


def repeated_words(words, width: int = REPEAT_WIDTH) -> int:
    """How many words stand in runs of width words that are found twice or more, given the hashes of the words."""
    import numpy as np

    if len(words) <= width:
        return 0
    runs = rolling(words, width)
    order = np.argsort(runs, kind="stable")
    same = runs[order][1:] == runs[order][:-1]
    if not same.any():
        return 0
    starts = np.zeros(len(runs), bool)
    starts[order[1:][same]] = starts[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measured(text: bytes | None, field: LineField, share: float = CONTENT_SHARE) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content share."""
    text = text or b""
    words = word_hashes(text)
    n = len(words)
    chars = len(text.translate(None, _SPACES + _NOT_FIRST))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    repeats = repeated_words(words)
    bits, sizes, again = described(text)
    content = sum(s for s, m in zip(sizes, field.viterbi(bits), strict=True) if m == CONTENT)
    failed = n < 20 or 100 * repeats > 30 * n
    return n, chars, symbols, again, repeats, failed, not failed and content >= share * n, content / n if n else 0.0


def quality_rules(docs: DataFrame, field: LineField, keep: list[str] | None = None) -> DataFrame:
    """docs (or their columns in keep) with the measures of measured().

    Columns of these names, in any case, are replaced; all others stay, whatever their names. Repeated rows are judged alike, an
    empty table gives an empty result. A null or empty text has no words and fails. Lines without words are no part of the sequence. One pass over
    whole texts, no shuffle.
    """
    ship(docs.sparkSession)
    added = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "content_share": "double"}
    kept = [c for c in keep or docs.columns if c.lower() not in added]
    schema = T.StructType([docs.schema[c] for c in kept])
    for name, kind in added.items():
        schema = schema.add(name, kind)

    def judged(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
        for b in slices(batches):
            rows = [measured(t, field) for t in b.column(len(kept)).to_pylist()]
            made = [pa.array([r[k] for r in rows], kinds[kind]) for k, kind in enumerate(added.values())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(kept))), *made], schema.fieldNames())

    places = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)]  # Spark passes no dotted names to Python
    return docs.select(*places, F.col("text").cast("binary").alias("bytes_")).mapInArrow(judged, schema)


def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the base rules and the field trained on the labelled ones."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    field = train_on_labels(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality_rules(docs, field, keep=["doc_id"])
