"""Token counts by byte-pair merging with a heap over a linked list of symbols; no identifiers are made."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill import ship
from pagemill.llm.common import read_table, slices

#: How the byte-level pre-tokenizer cuts a text (fixed value of that tokenizer family), with its classes named.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[LETTER]+| ?[NUMBER]+| ?[^[SPACE][LETTER][NUMBER]]+|[SPACE]+(?![^[SPACE]])|[SPACE]+"""
CLASSES = {"LETTER": r"\p{L}", "NUMBER": r"\p{N}", "SPACE": r"\s"}
#: The same cut with the classes spelled out, for texts of the characters that NOT_PLAIN leaves: several times faster.
PLAIN_LETTERS, PLAIN_SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", " \\t-\\r\\x85\\xa0"
PLAIN_PIECES = rf"""'(?:[stmd]|re|ve|ll)| ?[{PLAIN_LETTERS}]+| ?[0-9]+| ?[^{PLAIN_SPACES}{PLAIN_LETTERS}0-9]+|[{PLAIN_SPACES}]+(?![^{PLAIN_SPACES}])|[{PLAIN_SPACES}]+"""
NOT_PLAIN = r"[^\x00-\xb1\xb4-\xb8\xba\xbb\xbf-\xff]"
TOKENIZER = "byte_bpe_50k.json"
MAX_TOKENS = 512


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file.

    Printable Latin-1 characters stand for themselves; the other bytes take the letters from U+0100 on, in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = {b: chr(b) for b in shown}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


@cache
def piece_pattern() -> str:
    """PIECES with the character classes of the tokenizer library's own splitter.

    Its Unicode tables may be of another version than those of the regex library: each class is that of regex, less
    and plus the code points on which the two differ.
    """
    import numpy as np
    import regex
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    pattern, places = PIECES, np.array([*range(0xD800), *range(0xE000, 0x110000)])
    every = "".join(map(chr, places))
    for name, known in CLASSES.items():
        theirs, ours = np.ones(len(every), bool), np.zeros(len(every), bool)
        for _, (a, z) in Split(Regex(f"{known}+"), "removed").pre_tokenize_str(every):
            theirs[a:z] = False
        for found in regex.finditer(f"{known}+", every):
            ours[found.start() : found.end()] = True
        pattern = pattern.replace(f"[{name}]", f"[[{known}{_ranges(places[theirs & ~ours])}]--[{_ranges(places[ours & ~theirs])}]]" if (theirs != ours).any() else f"[{known}]")
    return f"(?V1){pattern}"


def _ranges(places) -> str:
    """Code points as the inside of a character class; one that no text has if there are none."""
    import numpy as np

    parts = np.split(places, np.flatnonzero(np.diff(places) != 1) + 1)
    return "".join(f"\\U{p[0]:08x}-\\U{p[-1]:08x}" for p in parts if len(p)) or "\\ud800"


class PieceCounts(dict):
    """The number of tokens of a piece of text; short pieces seen before are kept, in two generations of bounded size."""

    LIMIT, LONGEST = 600_000, 64

    def __init__(self, ranks: dict[tuple[str, str], int]):
        super().__init__()
        self.ranks, self.letters, self.older = ranks, byte_letters(), {}

    def __missing__(self, piece: str) -> int:
        n = self.older.get(piece)
        if n is None:
            n = merged_count([self.letters[b] for b in piece.encode("utf-8", "surrogatepass")], self.ranks)
        if len(piece) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.older = dict(self)
                self.clear()
            self[piece] = n
        return n


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Initial symbols minus merges.

    A heap holds the mergeable adjacent pairs as (rank, place); the lowest rank, then the leftmost place, merges
    first. Symbols form a doubly linked list, so a merge costs O(log n) and a piece of any length O(n log n).
    """
    n = len(symbols)
    if n < 2:
        return n
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(rank, i) for i in range(n - 1) if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if j < 0 or symbols[i] is None or ranks.get((symbols[i], symbols[j])) != rank:
            continue  # one of the two has merged since
        symbols[i] += symbols[j]
        symbols[j] = None
        merges += 1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (rank := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (rank, i))
        if (h := before[i]) >= 0 and (rank := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (rank, h))
    return n - merges


def special_pattern(token: dict) -> str:
    """Where an added token stands: it may take the white space beside it, and may have to be a word of its own."""
    import regex

    content = regex.escape(token["content"])
    if token.get("single_word"):
        content = rf"(?<!\w){content}(?!\w)"
    return (r"\s*" if token.get("lstrip") else "") + content + (r"\s*" if token.get("rstrip") else "")


class TokenCounter:
    """Counts tokens as a byte-level BPE vocabulary file defines them; one for each Python worker and file."""

    _made: dict[str, TokenCounter] = {}

    def __init__(self, path: str, pattern: str | None = None):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.counts = PieceCounts({pair: rank for rank, pair in enumerate(merges)})
        self.any_pieces, self.plain_pieces = regex.compile(pattern or piece_pattern()).findall, re.compile(PLAIN_PIECES).findall
        self.not_plain = re.compile(NOT_PLAIN).search
        special = sorted(spec.get("added_tokens", []), key=lambda t: len(t["content"]), reverse=True)
        self.special = regex.compile("|".join(map(special_pattern, special))) if special else None

    @classmethod
    def of(cls, path: str, pattern: str | None = None) -> TokenCounter:
        if path not in cls._made:
            cls._made[path] = cls(path, pattern)
        return cls._made[path]

    def pieces(self, text: str) -> list[str]:
        return self.any_pieces(text) if self.not_plain(text) else self.plain_pieces(text)

    def count(self, text: str | None) -> int:
        """Tokens of a text; each special string in it is one token, and the text around it is cut there."""
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return sum(map(self.counts.__getitem__, self.pieces(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.counts.__getitem__, self.pieces(p))) for p in parts)


def count_tokens(docs: DataFrame, tokenizer: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row: its id, ``n_bytes`` (UTF-8) and ``n_tokens`` of the whole text.

    tokenizer: path of a byte-level BPE file, the same on all executors. One pass without a shuffle; a null or empty
    text has 0 bytes and 0 tokens, and rows with null or repeated ids are counted like any other.
    """
    ship(docs.sparkSession)
    pattern = piece_pattern()  # worked out once, by the driver

    def counted(batches: Iterator) -> Iterator:
        import public_tokenizers
        import pyarrow as pa
        import pyarrow.compute as pc

        counter = TokenCounter.of(tokenizer or public_tokenizers.path(TOKENIZER), pattern)
        for b in slices(batches):
            texts = b.column(1)
            n = [counter.count(t.as_py()) for t in texts]
            size = pc.fill_null(pc.binary_length(texts.cast(pa.large_binary())), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), size.cast(pa.int64()), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(counted, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_column)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, and whether they exceed MAX_TOKENS."""
    counted = count_tokens(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > MAX_TOKENS).alias("over_limit"))
