import json
import os
import time

import pytest
from pyspark.sql import functions as F

from pagemill import adapters, config
from pagemill.guard import Guarded
from pagemill.plans import captures as plans
from pagemill.sources import captures
from tests.test_pages import Reader, png


class Odd:
    def __call__(self, what):
        if what == "hang":
            time.sleep(600)
        if what == "crash":
            os._exit(9)
        if what == "raise":
            raise ValueError("bad")
        return what.upper()


def test_calls():
    began = time.monotonic()
    with Guarded(Odd, 0.7) as call:
        got = [call(w) for w in ("a", "hang", "b", "crash", "c", "raise", "d")]
        process = call.process
    assert [v for v, _ in got] == ["A", None, "B", None, "C", None, "D"]
    assert [e and e.split(":")[0] for _, e in got] == [None, "TimeoutError", None, "ProcessLookupError", None, "ValueError", None]
    assert time.monotonic() - began < 10 and not process.is_alive()


def test_engine_that_cannot_be_made():
    with Guarded(lambda: 1 / 0, 5) as call:
        assert call("x") == (None, "ZeroDivisionError: division by zero")


class Counting:
    """A client that writes each call to a file."""

    def __init__(self, path):
        self.path = path

    def __call__(self, messages):
        with open(self.path, "a") as f:
            f.write(json.dumps(messages[-1]["content"][:40]) + "\n")
        what = messages[-1]["content"]
        if "fails" in what:
            raise ValueError("bad")
        return '{"product_name": "N", "variants": []}'


def asked(path):
    return len(open(path).read().split("\n")) - 1 if os.path.exists(path) else 0


def test_each_request_once(spark, tmp_path):
    log, store = str(tmp_path / "log"), str(tmp_path / "answers")
    urls = ["https://a/1"] * 40 + ["https://a/2"] * 3 + ["https://a/fails"] * 2
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k int, url string").repartition(4).withColumn("messages", adapters.prompt(F.col("url"), F.lit("t"), F.lit("c"), F.lit("")))
    settings, make = config.Settings(attempts=2, wait_seconds=0.0), lambda: Counting(log)
    found = adapters.ask_once(pages, make, store, settings)
    for _ in range(3):
        rows = found.collect()
    assert asked(log) == 3 and len(rows) == 45
    assert {r["url"]: (r["model_record"] is not None, r["error"]) for r in rows} == {"https://a/1": (True, None), "https://a/2": (True, None), "https://a/fails": (False, "ValueError: bad")}
    more = pages.unionByName(pages.limit(1).withColumns({"k": F.lit(99), "messages": adapters.prompt(F.lit("https://a/new"), F.lit("t"), F.lit("c"), F.lit(""))}))
    assert adapters.ask_once(more, make, store, settings).count() == 46
    assert asked(log) == 5  # the new one, and what failed, for the last time
    assert adapters.ask_once(more, make, store, settings).count() == 46 and asked(log) == 5
    assert adapters.ask_once(pages.limit(0), make, str(tmp_path / "none"), settings).count() == 0


def test_records_ask_once(spark, tmp_path):
    run, log, out = tmp_path / "capture_20260101_000000", str(tmp_path / "log"), str(tmp_path / "out")
    for k in range(5):
        (run / f"{k}_h").mkdir(parents=True)
        (run / f"{k}_h" / "metadata.json").write_text(json.dumps({"url": f"https://h/{k}", "status": "captured", "title": f"title {k}", "elapsed_seconds": 1.0}))
        (run / f"{k}_h" / "context.md").write_text(f"# title {k}\n- URL: u")
    found, report = plans.build_records(spark, str(run), out, None, lambda: Counting(log))
    assert asked(log) == 5
    assert {r["product_name"] for r in found.collect()} == {"N"} and report.first()["urls"] == 5 and spark.read.json(out).count() == 5
    assert asked(log) == 5
    plans.build_records(spark, str(run), None, None, lambda: Counting(log), settings=config.Settings(engine="rules"))
    assert asked(log) == 5


class HangingReader(Reader):
    def __call__(self, image, y0, y1):
        if image[24:] == b"hang":
            time.sleep(600)
        return super().__call__(image, y0, y1)


def test_failures_of_a_run(spark, tmp_path):
    """One hung image costs its own deadline in each round, is told in the table of failures, and is given up in the end."""
    run, texts = tmp_path / "capture_20260101_000000", str(tmp_path / "texts")
    (run / "1_h" / "assets").mkdir(parents=True)
    for k, text in enumerate(["one", "hang", "broken", "two", "three"]):
        (run / "1_h" / "assets" / f"asset_{k:03d}_img.png").write_bytes(png(10, 30, text))
    settings = config.Settings(attempts=2, read_seconds=2.0)
    began = time.monotonic()
    products = plans.read_capture_images(spark, str(run), texts, HangingReader, settings=settings)
    assert products.first()["text"] == "one\n\ntwo\n\nthree" and time.monotonic() - began < 120
    failures = sorted((r["path"].rsplit("/", 1)[1], r["attempt"], r["error"].split(":")[0]) for r in captures.read_failures(spark, texts, run.name).collect())
    assert failures == [(f"asset_{k:03d}_img.png", n, e) for k, e in ((1, "TimeoutError"), (2, "RuntimeError")) for n in (1, 2)]
    plans.read_capture_images(spark, str(run), texts, HangingReader, settings=settings)
    assert captures.read_failures(spark, texts, run.name).count() == 4
    os.utime(run / "1_h" / "assets" / "asset_001_img.png", (2_000_000_000, 2_000_000_000))  # a changed image begins anew
    plans.read_capture_images(spark, str(run), texts, HangingReader, settings=settings)
    assert captures.read_failures(spark, texts, run.name).count() == 6
    assert captures.read_image_texts(spark, texts, run.name).count() == 3


@pytest.mark.parametrize("heights", [30, 3500])
def test_an_image_travels_once(spark, heights):
    """Strips of an image are read from one row."""
    images = spark.createDataFrame([(f"p{k}", bytearray(png(10, heights, "a\nb\nc\nd"))) for k in range(3)], "path string, content binary")
    words = plans.read_words(images, Reader)
    assert "Generate explode" not in words._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(w["text"] for w in r["words"]) for r in words.collect()} == {("a",) if heights == 30 else ("a", "b", "c", "d")}


def test_images_are_dealt_out(spark, tmp_path, monkeypatch):
    """Images of one file are read by as many tasks as their number asks for; their texts leave Python together."""
    tasks, whole = [], plans.image_texts
    monkeypatch.setattr(plans, "image_texts", lambda images, *a, **k: tasks.append(images.rdd.getNumPartitions()) or whole(images, *a, **k))
    monkeypatch.setattr(plans, "IMAGES_OF_TASK", 5, raising=False)
    monkeypatch.setattr(plans, "STRIPS_AT_ONCE", 3, raising=False)
    rows = [(f"r/assets/{k}.png", "2026-01-01 00:00:00", bytearray(png(10, 30, f"w{k}"))) for k in range(40)]
    pictures = spark.createDataFrame(rows, "path string, at string, content binary").withColumn("mtime", F.col("at").cast("timestamp")).coalesce(1)
    texts = str(tmp_path / "texts")
    plans.read_in_rounds(pictures.select("path", "mtime"), pictures.select("path", "content"), "r", texts, Reader)
    assert tasks == [8]
    assert {r["path"]: r["text"] for r in captures.read_image_texts(spark, texts, "r").collect()} == {f"r/assets/{k}.png": f"w{k}" for k in range(40)}
