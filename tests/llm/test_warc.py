import struct

import pytest
import zstandard

from pagemill.llm import warc


def row(k, payload, **over):
    return {"record_id": k, "target_uri": f"https://h/{k}", "record_type": "response", "payload": payload, "payload_bytes": len(payload), "payload_digest": warc.payload_digest(payload), "refers_to": None} | over


ROWS = [row(k, f"<p>page {k} of many</p>".encode() * 40) for k in range(40)] + [row(40, b"", record_type="revisit", payload_bytes=880, refers_to=3), row(41, b""), row(42, b"\r\n\r\nWARC/1.1\r\n")]


def test_round_trip():
    data = warc.archive_bytes([warc.record_bytes(r) for r in ROWS])
    assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY_MAGIC and struct.unpack_from("<I", data, 4)[0] > 0
    got = list(warc.archive_records(data))
    assert [(r["record_id"], r["payload_bytes"], r["record_type"]) for r in got] == [(str(r["record_id"]), r["payload_bytes"], r["record_type"]) for r in ROWS]
    assert [r["payload"] for r in got] == [None if r["record_type"] == "revisit" else r["payload"] for r in ROWS]


def test_compressed_dictionary_and_none():
    records = [warc.record_bytes(r) for r in ROWS]
    data = warc.archive_bytes(records)
    size = struct.unpack_from("<I", data, 4)[0]
    packed = zstandard.ZstdCompressor().compress(data[8 : 8 + size])
    again = struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + data[8 + size :]
    assert len(list(warc.archive_records(again))) == len(ROWS)
    assert len(list(warc.archive_records(b"".join(map(zstandard.ZstdCompressor().compress, records))))) == len(ROWS)
    assert list(warc.archive_records(b"")) == []


@pytest.mark.parametrize(
    "damage",
    [
        lambda d: d[:-3],
        lambda d: d + b"\x00\x01",
        lambda d: d[:6],
        lambda d: d[:-40] + b"\xff" * 8 + d[-32:],
        lambda d: struct.pack("<II", warc.DICTIONARY_MAGIC, 20) + struct.pack("<I", warc.FRAME_MAGIC) + b"\xff" * 16 + d,
        lambda d: struct.pack("<II", warc.DICTIONARY_MAGIC, 12) + struct.pack("<I", 0xEC30A437) + b"\xff" * 8 + d,
    ],
)
def test_broken_archives(damage):
    data = warc.archive_bytes([warc.record_bytes(r) for r in ROWS[:20]])
    with pytest.raises(warc.WarcError):
        list(warc.archive_records(damage(data)))


@pytest.mark.parametrize(
    "change",
    [
        (b"WARC/1.1", b"HTTP/1.1"),
        (b"Content-Length: ", b"Content-Length: 1"),
        (b"WARC-Type: ", b"WARC-Type "),
        (b"X-Payload-Length: ", b"X-Payload-Length: 1"),
        (b"page 1", b"page 2"),
        (b"WARC-Record-ID", b"WARC-Other"),
        (b"WARC-Date", b"WARC-Other"),
        (b"1970-01-01T", b"1970-13-01T"),
        (b"X-Payload-Length: ", b"X-Payload-Length: x"),
        (b"X-Payload-Length: ", b"X-Payload-Length: -"),
        (b"https://", b"\xff\xfe://"),
    ],
)
def test_broken_records(change):
    with pytest.raises(warc.WarcError):
        warc.parsed_record(warc.record_bytes(ROWS[1]).replace(*change, 1))


@pytest.mark.parametrize("most", [warc.BROADCAST_FIRSTS, 0])
def test_table(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_FIRSTS", most)
    pages = [(5, "u5", "same"), (3, "u3", "same"), (9, None, "same"), (1, "u\r\n1", ""), (2, "u2", ""), (7, "u7", "other ü"), (None, "n", "same")]
    frame = spark.createDataFrame(pages, "record_id long, target_uri string, payload string")
    archives = warc.write_archives(warc.mark_revisits(frame), archive_size=200)
    got = {r["record_id"]: r for r in warc.read_archives(archives).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {
        "5": ("revisit", "3"), "3": ("response", None), "9": ("revisit", "3"), "1": ("response", None), "2": ("revisit", "1"), "7": ("response", None), "None": ("response", None),
    }
    assert got["7"]["payload"] == "other ü".encode() and got["9"]["payload_bytes"] == 4 and got["9"]["target_uri"] is None
    least = {r["record_id"]: r["record_type"] for r in warc.mark_revisits(frame, least=1).collect()}
    assert least[2] == "response" and least[5] == "revisit"
    for k, r in enumerate(archives.collect()):
        (tmp_path / f"{k}.warc.zst").write_bytes(bytes(r["content"]))
    assert warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path))).count() == len(pages)
    assert warc.read_archives(warc.write_archives(warc.mark_revisits(frame.limit(0)))).count() == 0


def test_large_archive_in_linear_time():
    """80 MB in records of 20 kB; reading what is left again for each record would take minutes."""
    import os
    import time

    one = os.urandom(20_000)
    frames = [zstandard.ZstdCompressor().compress(warc.record_bytes(row(k, str(k).encode() + one))) for k in range(4000)]
    began = time.perf_counter()
    assert sum(r["payload_bytes"] > 20_000 for r in warc.archive_records(b"".join(frames))) == 4000
    assert time.perf_counter() - began < 30


def test_dates_and_repeated_rows(spark):
    pages = [(1, "u", "same", "2024-02-03T04:05:06Z"), (1, "v", "same", None), (2, "w", "same", "2024-02-03T04:05:06.5Z")]
    frame = spark.createDataFrame(pages, "record_id long, target_uri string, payload string, date string")
    got = sorted(tuple(r) for r in warc.read_archives(warc.write_archives(warc.mark_revisits(frame))).select("target_uri", "date", "record_type").collect())
    assert got == [("u", "2024-02-03T04:05:06Z", "response"), ("v", warc.NO_DATE, "response"), ("w", "2024-02-03T04:05:06.5Z", "revisit")]


def test_session_is_left_alone(spark):
    """Batches are bounded by bytes unless the session has a limit of its own; nothing else changes."""
    rows, limit = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(limit, "5000000")
    try:
        test_dates_and_repeated_rows(spark)
        assert spark.conf.get(limit) == "5000000" and spark.conf.get(rows) == before
    finally:
        spark.conf.unset(limit)
