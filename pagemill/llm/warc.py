"""WARC archives in Zstandard: one frame for each record, a dictionary in the leading skippable frame, revisits."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill import ship
from pagemill.llm.common import join_by_key, materialise, read_table, slices

#: Magic number of the skippable frame that holds the dictionary, and of a Zstandard frame (fixed by the format).
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: Payload bytes after which an archive is closed; records are never cut, so a longer payload has one of its own.
ARCHIVE_BYTES = 4 << 20
#: Bytes of an archive that are handed to the decompressor first; the next piece of a longer frame is twice as long.
FIRST_PIECE = 4 << 10
#: The date of records whose capture time is not known; the format demands one.
NO_DATE = "1970-01-01T00:00:00Z"
DICTIONARY_BYTES, SAMPLE_BYTES = 16 << 10, 1 << 20
#: Repeated payloads up to this number are broadcast (digest and id, some 60 bytes each).
BROADCAST_FIRSTS = 300_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = re.compile(r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])T(?:[01]\d|2[0-3]):[0-5]\d:(?:[0-5]\d|60)(?:\.\d{1,9})?Z", re.ASCII).fullmatch
RECORD = "record_id string, target_uri string, date string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(row: dict) -> bytes:
    """One WARC record: version line, headers, empty line, block, two empty lines.

    A revisit has no block. Its headers carry the digest and the length of the payload that it stands for, and
    the record it refers to. Line ends in a URI are percent-encoded, so that they cannot start a header. A row
    without a date gets NO_DATE.
    """
    revisit = row["record_type"] == "revisit"
    block = b"" if revisit else row["payload"]
    headers = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<urn:page:{row['record_id']}>"), ("WARC-Date", row.get("date") or NO_DATE)]
    if row["target_uri"] is not None:
        headers.append(("WARC-Target-URI", row["target_uri"].replace("\r", "%0D").replace("\n", "%0A")))
    headers += [("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"), ("X-Payload-Length", str(row["payload_bytes"]))]
    if revisit:
        headers += [("WARC-Refers-To", f"<urn:page:{row['refers_to']}>"), ("WARC-Profile", REVISIT_PROFILE)]
    headers += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parsed_record(data: bytes) -> dict:
    """The record in one decoded frame; WarcError unless version, headers, date, lengths and digest are right."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    try:
        lines = head.decode("utf-8").split("\r\n")
    except UnicodeDecodeError as error:
        raise WarcError(f"headers that are not UTF-8: {error}") from error
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("no WARC version line or no end of headers")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"not a header: {line[:80]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"no {name}")
    if not _DATE(headers["warc-date"]):
        raise WarcError(f"not a date: {headers['warc-date'][:80]!r}")
    if len(rest) != _length(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("the block's length differs from Content-Length")
    block, digest = rest[:-4], headers.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit = headers["warc-type"] == "revisit"
    if revisit and (block or "warc-refers-to" not in headers):
        raise WarcError("a revisit has no block and refers to a record")
    if not revisit and digest and digest != payload_digest(block):
        raise WarcError("the payload differs from its digest")
    length = _length(headers["x-payload-length"]) if "x-payload-length" in headers else len(block)
    if not revisit and length != len(block):
        raise WarcError("the payload's length differs from its header")
    name = lambda v: v.removeprefix("<urn:page:").removesuffix(">") if v is not None else None
    return {
        "record_id": name(headers["warc-record-id"]), "target_uri": headers.get("warc-target-uri"), "date": headers["warc-date"], "record_type": headers["warc-type"],
        "payload_bytes": length, "payload_digest": digest or payload_digest(block), "refers_to": name(headers.get("warc-refers-to")), "payload": None if revisit else block,
    }


def _length(value: str) -> int:
    if not (value.isascii() and value.isdigit() and len(value) < 19):
        raise WarcError(f"not a length: {value[:80]!r}")
    return int(value)


def archive_bytes(records: list[bytes]) -> bytes:
    """An archive of whole records, with a dictionary trained on their beginnings if there is enough to train on."""
    import zstandard

    samples, left = [], SAMPLE_BYTES
    for r in records:
        samples.append(r[: min(len(r), 16 << 10)])
        left -= len(samples[-1])
        if left <= 0:
            break
    dictionary = None
    if len(samples) >= 16:
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples)
        except zstandard.ZstdError:
            dictionary = None
    packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=True)
    content = dictionary.as_bytes() if dictionary else b""
    return struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content + b"".join(map(packer.compress, records))


def archive_records(archive: bytes) -> Iterator[dict]:
    """The records of an archive, one for each frame, read with the dictionary of the leading skippable frame.

    The dictionary may itself be compressed. WarcError for anything cut off, left over, broken or out of place. A
    frame is handed over in pieces that double, so what is copied in vain is bounded by the frame, and the time
    grows with the archive.
    """
    import zstandard

    at, view, dictionary = 0, memoryview(archive), None
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", archive, 4)[0]
        at, content = 8 + size, archive[8 : 8 + size]
        if len(content) != size:
            raise WarcError("the dictionary is cut off")
        try:
            if size >= 4 and struct.unpack_from("<I", content)[0] == FRAME_MAGIC:
                content = zstandard.ZstdDecompressor().decompress(content)
            dictionary = zstandard.ZstdCompressionDict(content) if content else None
        except (zstandard.ZstdError, MemoryError) as error:
            raise WarcError(f"a broken dictionary: {error}") from error
    try:
        unpacker = zstandard.ZstdDecompressor(dict_data=dictionary)
    except zstandard.ZstdError as error:
        raise WarcError(f"a broken dictionary: {error}") from error
    while at < len(archive):
        if len(archive) - at < 4 or struct.unpack_from("<I", archive, at)[0] != FRAME_MAGIC:
            raise WarcError(f"no frame at byte {at}")
        try:
            one, parts, end, piece = unpacker.decompressobj(), [], at, FIRST_PIECE
            while not one.eof:
                if end == len(archive):
                    raise WarcError("the last frame is cut off")
                parts.append(one.decompress(view[end : end + piece]))
                end, piece = min(end + piece, len(archive)), piece * 2
        except zstandard.ZstdError as error:
            raise WarcError(f"a broken frame at byte {at}: {error}") from error
        at = end - len(one.unused_data)
        yield parsed_record(b"".join(parts))


def mark_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (record_id, target_uri, payload, and date if there is one) with digest, length, ``record_type`` and ``refers_to``.

    Of records with equal payloads of at least ``least`` bytes those with the smallest record_id are the response and the
    others revisit it; so rows that repeat that record_id with that payload are responses too. Firsts are found with
    partial aggregation over digests alone; only those of payloads that occur twice are brought back: broadcast if they
    are few, so that no payload moves, else by a join in which no payload's copies fill a task (join_by_key). Records
    with a null id are always responses.
    """
    ship(pages.sparkSession)

    def digested(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches):
            payloads = [p or b"" for p in b.column(3).to_pylist()]
            made = [pa.array(payloads, pa.binary()), pa.array(list(map(len, payloads)), pa.int64()), pa.array(list(map(payload_digest, payloads)), pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), *made], ["record_id", "target_uri", "date", "payload", "payload_bytes", "payload_digest"])

    kind = pages.schema["record_id"].dataType.simpleString()
    date = F.col("date").cast("string") if "date" in pages.columns else F.lit(None).cast("string").alias("date")
    plain = pages.select("record_id", F.col("target_uri").cast("string"), date, F.col("payload").cast("binary"))
    digests = plain.mapInArrow(digested, f"record_id {kind}, target_uri string, date string, payload binary, payload_bytes long, payload_digest string")
    firsts = materialise(
        digests.where((F.col("payload_bytes") >= least) & F.col("record_id").isNotNull())
        .groupBy("payload_digest")
        .agg(F.min("record_id").alias("first_"), F.count(F.lit(1)).alias("n_"))
        .where("n_ > 1"),
        "firsts",
    )
    found, total = firsts.agg(F.count(F.lit(1)), F.sum("n_")).first()
    if found <= BROADCAST_FIRSTS:
        joined = digests.join(F.broadcast(firsts), "payload_digest", "left")
    else:
        joined = join_by_key(digests, firsts, "payload_digest", "n_", total, "left")
    revisits = F.col("first_").isNotNull() & F.col("record_id").isNotNull() & (F.col("first_") != F.col("record_id")) & (F.col("payload_bytes") >= least)
    return joined.select(
        "record_id", "target_uri", "date", "payload", "payload_bytes", "payload_digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("first_")).alias("refers_to"),
    )


def write_archives(records: DataFrame, archive_size: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (``content``) of the records of mark_revisits(), each of bounded size; the order is that of the rows."""

    def packed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        waiting, size = [], 0
        for b in slices(batches):
            for row in b.to_pylist():
                if row["record_type"] == "revisit":
                    row["payload"] = None
                waiting.append(record_bytes(row))
                size += len(waiting[-1])
                if size >= archive_size:
                    yield pa.RecordBatch.from_pydict({"content": pa.array([archive_bytes(waiting)], pa.binary())})
                    waiting, size = [], 0
        if waiting:
            yield pa.RecordBatch.from_pydict({"content": pa.array([archive_bytes(waiting)], pa.binary())})

    ship(records.sparkSession)
    slim = records.withColumn("payload", F.when(F.col("record_type") != "revisit", F.col("payload")))
    return slim.mapInArrow(packed, "content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """All records of archives (``content``), such as ``spark.read.format("binaryFile").load("*.warc.zst")``.

    A broken archive fails the job with WarcError.
    """

    def unpacked(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])
        for b in slices(batches):
            for content in b.column(0):
                rows, size = [], 0
                for r in archive_records(content.as_py() or b""):
                    rows.append(r)
                    size += len(r["payload"] or b"")
                    if size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    ship(archives.sparkSession)
    return archives.select("content").mapInArrow(unpacked, RECORD)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives in the shared folder and read back from there. A null html is an empty payload.

    Rows that repeat the smallest page_id of a payload are responses like it; pages carry no date, so records have NO_DATE.
    """
    pages = read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    records = mark_revisits(pages.select(F.col("page_id").alias("record_id"), F.col("url").alias("target_uri"), F.coalesce("html", F.lit("")).alias("payload")))
    read = read_archives(materialise(write_archives(records), "archives"))
    number = lambda c: F.when(F.col(c) != "None", F.col(c).cast("long"))  # noqa: E731  a null id was written as None
    return read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
d AS (
  SELECT page_id, octet_length(b) AS payload_bytes, h,
         min(page_id) OVER (PARTITION BY h) AS first_id,
         list_aggregate(list_transform(range(8), lambda k: list_aggregate(list_transform(range(4), lambda j:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * k::INT, 5))::BIGINT >> (15 - 5 * j)::INT) & 31)::INT, 1)), 'string_agg', '')), 'string_agg', '') AS digest
  FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""
