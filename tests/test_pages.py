import json
import time

import pytest
from pyspark.sql import functions as F

from pagemill import adapters, config
from pagemill.operators import assets, dom, html, records, tables
from pagemill.plans import captures as captures_plan
from pagemill.sources import captures, sinks
from pagemill.streaming import captures as streams

PAGE = """<html><head><title> A &amp; B | Shop </title><script>var t="</p>";</script></head><body><nav><ul><li>one<li>two</ul></nav>
<main><h1>Bolt</h1><p>Fine <b>steel</b>.<br>Second<p>Third</p><table><tr><th rowspan=2>Model<td>Size<tr><td>M-1<td>5 mm
<table><tr><td>inner</td></tr></table></td></tr></table><img src="a.png?x=1" width="300" height="100"><img src="b.png" style="display: none" width=300 height=100><canvas></canvas></main><!-- no --></body></html>"""


def test_read_page():
    page = html.read_page(PAGE, ["#none", "main"])
    assert page["title"] == "A & B | Shop" and page["selector"] == "main"
    assert [[[c["text"] for c in r] for r in t["rows"]] for t in page["tables"]][0][:2] == [["Model", "Size"], ["M-1", "5 mm inner", "inner"]]
    assert [t["table_index"] for t in page["tables"]] == [1, 2] and page["tables"][0]["rows"][0][0]["rowspan"] == 2
    assert [(m["tag"], m["src"], m["visible"]) for m in page["media"]] == [("img", "a.png?x=1", True), ("img", "b.png", False), ("canvas", "", True)]
    assert "var t" not in page["text"] and "no" not in page["text"].split() and page["text"].startswith("one\ntwo\nBolt\nFine steel.\nSecond\nThird")
    assert page["region_md"].startswith("# Bolt\n\nFine **steel**.\nSecond\n\nThird")


@pytest.mark.parametrize("body, markdown", [
    ("<p>a</p><blockquote><p>x</p><p>y <b>z</b></p></blockquote><p>b</p>", "a\n\n> x\n>\n> y **z**\n\nb"),
    ("<blockquote>one<blockquote>two</blockquote>three</blockquote>end", "> one\n>\n> > two\n>\n> three\n\nend"),
    ("text<pre>a  b\n  c\n</pre>after <code>x_y</code>", "text\n\n    a  b\n      c\n\nafter `x_y`"),
    ("up<hr>down", "up\n\n* * *\n\ndown"),
    ("<ol><li>x<li>y<ul><li>q</ul><li>z</ol><h2>t</h2>", "1. x\n\n  2. y\n\n    * q\n\n  3. z\n\n## t"),
    ("<pre><code>k = 1</code></pre>", "    k = 1"),
])
def test_markdown(body, markdown):
    assert html.read_page(f"<main>{body}</main>", ["main"])["region_md"] == markdown


@pytest.mark.parametrize("text", [None, "", "<", "<p", "</p></table>", "<table><td>x", "<ul>" * 3000 + "x"])
def test_read_odd_pages(text):
    assert html.read_page(text, ["main"])["selector"] is None


def test_references_without_semicolon():
    """Read as browsers do, or kept as text in titles, texts and values; scripts and other ampersands stay as they are."""
    page = '<title>a&amp;&lt&#65;</title><p id="x&copy1">&am b&amp</p>&notit;&&middot;<script>1 &amp 2</script>'
    texts = lambda **o: [n[5] for n in dom.nodes_of(page, **o) if n[5]]
    assert "".join(texts(open_references=False)) == "a&&ltA&am b&amp&notit;&\u00b71 &amp 2"
    assert "".join(texts()) == "a&<A&am b&\u00acit;&\u00b71 &amp 2"
    assert [n[4] for n in dom.nodes_of(page, False) if n[4]] == [[("id", "x&copy1")]]


def test_page_queries_keep_cut_references(spark, tmp_path):
    """page_texts and page_records give the rows of their SQL where a reference is cut before its semicolon."""
    import duckdb

    from pagemill.plans import catalogue

    body = "<html><head><title>x&amp;y &amp</title></head><body><main><h1>x&amp;y &amp</h1><p>z</p></main></body></html>"
    pages = spark.createDataFrame([(1, "https://h.example/p", body)], "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("page_texts", "page_records"):
        got = catalogue.QUERIES[name](spark, str(tmp_path))
        assert [tuple(r) for r in got.collect()] == con.execute(f"select {', '.join(got.columns)} from ({catalogue.SQL[name]})").fetchall()


def test_nodes_are_dealt_by_bytes(spark, monkeypatch):
    """As many tasks as the bytes of pages ask for, whatever files they came in; each page's nodes stay together."""
    pages = spark.createDataFrame([(k, f"<p>{k}</p>" + "x" * (k * 40)) for k in range(40)] + [(40, None)], "id int, html string").coalesce(1)
    monkeypatch.setattr(dom, "TASK_BYTES", 4096)
    nodes = dom.page_nodes(pages)
    assert nodes.rdd.getNumPartitions() == 11  # 41 pages of 256 bytes and their HTML
    in_tasks = nodes.withColumn("task", F.spark_partition_id()).groupBy("page_").agg(F.count_distinct("task").alias("tasks")).select("tasks").distinct().collect()
    assert [r[0] for r in in_tasks] == [1]
    got = {r["id"]: r["text"] for r in html.parse_pages(pages, host=None).collect()}
    assert got == {k: f"{k}\n" + "x" * (k * 40) if k else "0" for k in range(40)} | {40: ""}


def test_parse_pages_keeps_columns(spark):
    frame = spark.createDataFrame([(1, PAGE, "old", "h"), (2, None, None, None)], "page_id long, html string, text string, host string")
    got = {r["page_id"]: r for r in html.parse_pages(frame).collect()}
    assert got[1]["host"] == "h" and got[1]["selector"] == "main" and got[2]["tables"] == [] and got[2]["text"] == ""


def test_context_document(spark, one):
    t = F.array().cast(tables.TABLES)
    got = one(records.context_document(F.lit(""), F.lit("u"), F.lit(""), t, F.lit("x" * 3001)))
    assert got == f"# {config.NO_TITLE}\n- URL: u\n\n{config.TEXT_HEADING}\n\n" + "x" * 3000 + config.CUT
    assert one(records.context_document(F.lit("T"), F.lit("u"), F.lit(None).cast("string"), t, F.lit(""))) == "# T\n- URL: u"


def record_rows(spark, **over):
    row = dict(url="https://www.shop.com/p/AB-12", status="captured", title="x", context="ctx line", region_text="Name line\n모델명: X-1\nmodel: X-1\n규격: 5mm", tables=[], text="t", image_text="Size: 9", elapsed=1.5) | over
    schema = f"url string, status string, title string, context string, region_text string, tables {tables.TABLES}, text string, image_text string, elapsed double"
    return spark.createDataFrame([row], schema)


def test_records_by_rules(spark):
    full = records.product_records(record_rows(spark)).first()
    assert (full["product_name"], [(v["model"], v["specs"]) for v in full["variants"]]) == ("Name line", [("X-1", ["5mm", "9"])])
    strict = records.product_records(record_rows(spark), "as_called").first()
    assert (strict["product_name"], [(v["model"], v["specs"]) for v in strict["variants"]]) == ("ctx line", [("AB-12", [])])


def test_record_routing(spark):
    blocked = records.product_records(record_rows(spark, status="blocked")).first()
    assert (blocked["status"], blocked["product_name"], blocked["variants"]) == ("blocked", "", [])
    assert records.product_records(record_rows(spark, status=None)).first()["status"] == "unknown"
    assert records.product_records(record_rows(spark, status="error")).count() == 0
    assert records.product_records(record_rows(spark, status="error"), keep_errors=True).count() == 1


class Client:
    calls = 0

    def __call__(self, messages):
        Client.calls += 1
        what = messages[-1]["content"]
        if "url-down" in what:
            raise ConnectionError("down")
        if "url-bad" in what:
            raise ValueError("bad")
        return '{"product_name": "P", "variants": [{"model": "M", "규격": ["s"]}]}' if "url-ok" in what else " "


def test_model_before_rules(spark):
    pages = spark.createDataFrame([("url-ok",), ("url-down",), ("url-bad",), ("url-empty",)], "url string").withColumn("messages", adapters.prompt(F.col("url"), F.lit(""), F.lit("c"), F.lit("")))
    got = {r["url"]: r for r in adapters.ask_model(pages, Client, config.Settings(attempts=2, wait_seconds=0.0)).collect()}
    assert got["url-ok"]["model_record"]["variants"][0]["specs"] == ["s"]
    assert {u: (r["error"] or "")[:5] for u, r in got.items()} == {"url-ok": "", "url-down": "unrea", "url-bad": "Value", "url-empty": "empty"}
    rows = record_rows(spark).crossJoin(spark.createDataFrame([(("P", [("M", ["s"])]),)], "model_record struct<product_name string, variants array<struct<model string, specs array<string>>>>"))
    assert records.product_records(rows).first()["product_name"] == "P"


def test_v1_to_v2(spark):
    old = spark.createDataFrame([("u", "captured", "n", ["a", "b"], ["s"]), ("u", "captured", "n", [], ["s"])], "url string, status string, product_name string, models array<string>, specs array<string>")
    assert [[v["model"] for v in r["variants"]] for r in records.v1_to_v2(old).collect()] == [["a", "b"], [""]]


def test_asset_manifest(spark):
    media = spark.createDataFrame(
        [("p", 0, k, "img", f"https://h/{k % 3}.png?v={k}", "", 300, 100, k != 1) for k in range(6)] + [("p", 1, 0, "canvas", "", "", 300, 100, True)],
        "page string, frame_index int, index int, tag string, src string, alt string, width int, height int, ok boolean",
    )
    got = [(r["file"], r["index"], r["frame_index"]) for r in assets.asset_manifest(media, "page", captured=F.col("ok")).orderBy("asset_no").collect()]
    assert got == [("asset_001_img.png", 0, 0), ("asset_002_img.png", 2, 0), ("asset_003_canvas.png", 0, 1)]


def test_upscaled(one):
    assert tuple(one(assets.upscaled(F.lit(350), F.lit(101)))) == (700, 202)
    assert tuple(one(assets.upscaled(F.lit(100), F.lit(10)))) == (300, 30)
    assert tuple(one(assets.upscaled(F.lit(900), F.lit(10)))) == (900, 10)


def test_capture_folder(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# list\n\n https://a.com/x \nhttps://naver.com\nhttps://b.com\n", encoding="utf-8")
    urls = captures.read_target_urls(spark, str(tmp_path / "urls.txt"))
    plan = captures.capture_plan(urls)
    assert [(r["number"], r["folder"]) for r in plan.orderBy("number").collect()] == [(1, "1_a_com"), (2, "2_b_com")]
    run = tmp_path / "capture_20260101_000000"
    for k, (name, status) in enumerate((("1_a_com", "captured"), ("2_b_com", "blocked"))):
        (run / name / "assets").mkdir(parents=True)
        (run / name / "metadata.json").write_text(json.dumps({"url": f"https://{name}", "status": status, "title": "t"}, indent=2))
        (run / name / "assets" / "asset_001_img.png").write_bytes(b"x")
    (run / "1_a_com" / "context.md").write_text("context\nof a", encoding="utf-8")
    (run / "1_a_com" / "assets.json").write_text(json.dumps([{"file": "f", "tag": "img", "src": "s", "alt": "", "frame_index": 0, "width": 1, "height": 2}]))
    meta = captures.read_metadata(spark, str(run))
    assert {(r["folder"], r["status"], r["table_count"]) for r in meta.collect()} == {("1_a_com", "captured", None), ("2_b_com", "blocked", None)}
    context = captures.read_documents(spark, str(run), "context.md")
    old = {"dom": spark.createDataFrame([("2_b_com", "d" * 2001)], "folder string, text string")}
    got = {r["folder"]: r["context"] for r in captures.with_context(meta, context, captures.read_documents(spark, str(run), "product.md"), old).collect()}
    assert got == {"1_a_com": "context\nof a", "2_b_com": "d" * 2000}
    assert captures.read_assets(spark, str(run)).first()["folder"] == "1_a_com"
    assert captures.read_images(spark, str(run)).count() == 2
    runs = spark.createDataFrame([("capture_1",), ("capture_3",), ("other",), ("capture_3(1)",)], "run string")
    assert captures.latest_run(runs).first()["run"] == "capture_3(1)"
    assert captures.next_free_name(runs, "capture_3") == "capture_3(2)" and captures.next_free_name(runs, "capture_9") == "capture_9"
    with pytest.raises(FileNotFoundError):
        captures.latest_run(runs.where("run = 'other'"))


def test_numbered_like_a_window(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 100003).alias("k"))
    got = [r["number"] for r in captures.numbered(frame, "k", buckets=8).orderBy("k").collect()]
    assert got == list(range(1, 1001))
    assert captures.numbered(frame.where("k < 0"), "k").count() == 0


def test_written_records(spark, tmp_path):
    out = str(tmp_path / "records")
    sinks.write_records(records.product_records(record_rows(spark)), out)
    assert spark.read.json(out).select("URL", config.STATUS_KEY, config.NAME_KEY, "host").first()["host"] == "www.shop.com"
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_records(records.product_records(record_rows(spark)), out)


def test_streams(spark, tmp_path):
    source = tmp_path / "media"
    source.mkdir()
    rows = [{"page": "p", "src": f"https://h/a.png?v={k}", "tag": "img", "width": 1, "height": 1, "seen_at": "2026-01-01 00:00:00"} for k in range(3)]
    (source / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = streams.new_assets(spark.readStream.schema(streams.MEDIA_EVENTS).json(str(source)))
    running = streams.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    run = tmp_path / "run" / "1_h"
    run.mkdir(parents=True)
    (run / "metadata.json").write_text(json.dumps({"url": "https://H.com/x", "status": "captured", "elapsed_seconds": 2.0}))
    counts = streams.host_counts(streams.stream_metadata(spark, str(tmp_path / "run")))
    query = counts.writeStream.outputMode("update").format("memory").queryName(f"counts_{int(time.time())}").start()
    try:
        query.processAllAvailable()
        assert [(r["host"], r["pages"]) for r in spark.table(query.name).collect()] == [("h.com", 1)]
    finally:
        query.stop()


def test_region_size_and_visibility():
    """Too small or hidden regions are passed over; an unknown size counts as large; only the first element of a selector counts."""
    small = "<div id=a width=299 height=400>small</div><div id=b style='width: 300px; height: 149px'>low</div><div id=c hidden>gone</div><div id=d style='width:300px;height:150px'>fits</div>"
    for selectors, found in ((["#a", "#b", "#c", "#d"], "#d"), (["#b"], None), (["div", "#d"], "#d"), (["#e"], None)):
        assert html.read_page(small, selectors)["selector"] == found
    assert html.read_page("<main>any</main>", ["main"])["selector"] == "main"


def test_frames_of_a_page(spark):
    table = lambda t: f"<table><tr><td>{t}</td><td>x</td></tr><tr><td>{t}2</td></tr></table>"
    frames = [
        (1, 2, "h", "second<img src=b.png width=300 height=90>" + table("C")),
        (1, 0, "h", "<title>Top</title><main>main text</main>" + table("A")),
        (1, 1, "h", "  "),
        (2, 0, None, None),
    ]
    parsed = html.parse_pages(spark.createDataFrame(frames, "page_id long, frame_index int, host string, html string"))
    got = {r["page_id"]: r for r in html.join_frames(parsed, ["page_id"]).collect()}
    assert got[1]["text"] == "[MAIN]\nmain text\nA\tx\nA2\n\n[IFRAME 2]\nsecond\nC\tx\nC2" and got[1]["title"] == "Top" and got[1]["region_md"] == "main text"
    assert [(t["table_index"], t["frame_index"], t["rows"][0][0]["text"]) for t in got[1]["tables"]] == [(1, 0, "A"), (2, 2, "C")]
    assert [(m["frame_index"], m["src"]) for m in got[1]["media"]] == [(2, "b.png")]
    assert (got[2]["text"], got[2]["tables"], got[2]["region_md"]) == ("", [], "")
    found = assets.asset_manifest(assets.media_rows(html.join_frames(parsed, ["page_id"]), ["page_id"]), "page_id").collect()
    assert [(r["page_id"], r["frame_index"], r["file"]) for r in found] == [(1, 2, "asset_001_img.png")]


def test_sections_come_back(spark, one):
    cells = [[[("a|b", 1, 1), ("c", 1, 1)], [("1", 1, 1), ("2 ", 1, 1)]], [[("규격", 1, 1)], [("5mm", 1, 1)], [("6mm", 1, 1)]]]
    rows = spark.createDataFrame([([(k + 1, 0, r) for k, r in enumerate(cells)],)], f"tables {tables.TABLES}")
    context = records.context_document(F.lit("T"), F.lit("u"), F.lit("# Bolt\n\n모델명: X-1"), F.col("tables"), F.lit("[MAIN]\nall\ntext"))
    images = F.lit(f"{config.IMAGE_HEADING}1\n\nSize: 9\n\n{config.IMAGE_HEADING}2\n\nmore")
    got = rows.select(records.context_sections(records.merged_document(context, images)).alias("s")).first()["s"]
    assert got["region_text"] == "# Bolt\n\n모델명: X-1" and got["text"] == "all\ntext" and got["image_text"] == "Size: 9\n\nmore"
    assert [[[c["text"] for c in r] for r in t["rows"]] for t in got["tables"]] == [[["a|b", "c"], ["1", "2"]], [["규격"], ["5mm"], ["6mm"]]]
    bare = one(records.context_sections(F.lit("# T\n- URL: u")))
    assert (bare["region_text"], bare["tables"], bare["text"], bare["image_text"]) == ("", [], "", "")
    assert one(records.context_sections(F.lit(None).cast("string")))["tables"] == []


def test_values_with_source(one):
    candidates = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(v).alias("value"), F.lit(s).alias("source")) for c, v, s in (("model", " A ", "table#1"), ("model", "", "ocr"), ("x", "B", "ocr"), ("model", "A", "ocr"), ("model", "C", "product_dom"))])
    assert [tuple(v) for v in one(records.values_with_source(candidates, "model"))] == [("A", "table#1"), ("C", "product_dom")]


def test_run_times(spark):
    pages = spark.createDataFrame([("r", 1.5), ("r", None), ("s", 4.0)], "run string, elapsed double")
    assert {r["run"]: (r["urls"], r["seconds"], r["mean_seconds"]) for r in records.run_times(pages, "run").collect()} == {"r": (2, 1.5, 0.75), "s": (1, 4.0, 4.0)}


def test_written_manifests_and_metadata(spark, tmp_path):
    pages = spark.createDataFrame([("r", "1_a"), ("r", "2_b")], "run string, folder string")
    manifest = spark.createDataFrame([("r", "1_a", n, f"f{n}", "img", "s", "", 0, 300, 100) for n in (2, 1)], "run string, folder string, asset_no int, file string, tag string, src string, alt string, frame_index int, width int, height int")
    sinks.write_manifests(pages, manifest, str(tmp_path / "m"))
    got = {r["folder"]: r["assets"] for r in spark.read.json(str(tmp_path / "m")).collect()}
    assert [a["file"] for a in got["1_a"]] == ["f1", "f2"] and got["2_b"] == [] and "asset_no" not in got["1_a"][0]
    sinks.write_metadata(spark.createDataFrame([("r", "u", 1.24, None)], "run string, url string, elapsed_seconds double, title string"), str(tmp_path / "meta"))
    sinks.write_metadata(spark.createDataFrame([("r", "v", 2.0, "t")], "run string, url string, elapsed_seconds double, title string"), str(tmp_path / "meta"))
    assert {(r["url"], r["elapsed_seconds"], r["title"]) for r in spark.read.json(str(tmp_path / "meta")).collect()} == {("u", 1.2, None), ("v", 2.0, "t")}


def png(width, height, text):
    import struct

    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", width, height) + text.encode()


class Reader:
    """Stands in for a recognition engine: the words of an image are written after its header, in a line for each tile."""

    def __call__(self, image, y0, y1):
        line = image[24:].decode().split("\n")[y0 // 1100]
        if line == "broken":
            raise RuntimeError("no engine")
        words = line.split()
        box = lambda k: [[k * 50.0, 5.0], [k * 50.0 + 40, 5.0], [k * 50.0 + 40, 25.0], [k * 50.0, 25.0]]
        return [box(k) for k in range(len(words))], words, [0.9 if w != "faint" else 0.1 for w in words]


class Upper:
    def __call__(self, line):
        return line.upper()


def test_capture_folder_to_records(spark, tmp_path):
    """Metadata, documents and images of a run become texts, merged documents and records by host."""
    run, texts, out = tmp_path / "capture_20260101_000000", str(tmp_path / "texts"), str(tmp_path / "records")
    document = f"# Bolt M8 | Shop\n- URL: https://www.shop.com/p/1\n\n{config.REGION_HEADING}\n\n모델명: X-1\n\n{config.TABLES_HEADING}\n\n{config.TABLE_HEADING}1\n| Size | Note | More |\n| --- | --- | --- |\n| 5mm | n | m |\n| 6mm | n | m |"
    for folder, meta in (
        ("1_www_shop_com", {"url": "https://www.shop.com/p/1", "status": "captured", "title": "Bolt M8 | Shop", "elapsed_seconds": 2.0}),
        ("2_www_shop_com", {"url": "https://www.shop.com/p/2", "status": "blocked", "title": "t", "elapsed_seconds": 1.0}),
        ("3_b_com", {"url": "https://b.com/c/T-8M3-1", "status": "captured", "title": "A part of many", "elapsed_seconds": 4.0}),
    ):
        (run / folder / "assets").mkdir(parents=True)
        (run / folder / "metadata.json").write_text(json.dumps(meta), encoding="utf-8")
    (run / "1_www_shop_com" / "context.md").write_text(document, encoding="utf-8")
    (run / "3_b_com" / "dom.txt").write_text("nothing known", encoding="utf-8")
    (run / "1_www_shop_com" / "product.png").write_bytes(png(10, 30, "last faint"))
    (run / "1_www_shop_com" / "assets" / "asset_002_img.png").write_bytes(png(10, 1300, "사이즈: 9mm\nsecond tile"))
    (run / "1_www_shop_com" / "assets" / "asset_001_img.png").write_bytes(png(10, 30, "broken"))
    (run / "3_b_com" / "assets" / "x.PNG").write_bytes(b"no picture")

    products = captures_plan.read_capture_images(spark, str(run), texts, Reader, Upper)
    got = {r["product"].rsplit("/", 1)[-1]: r for r in products.collect()}
    assert set(got) == {"1_www_shop_com"} and got["1_www_shop_com"]["text"] == "사이즈: 9MM\nSECOND TILE\n\nLAST"
    kept = captures.read_image_texts(spark, texts, run.name)
    assert kept.count() == 2  # what failed is read again
    again = captures_plan.read_capture_images(spark, str(run), texts, Reader, Upper)
    assert captures.read_image_texts(spark, texts, run.name).count() == 2 and again.collect() == list(got.values())

    found, report = captures_plan.build_records(spark, str(run), out, products)
    rows = {r["url"]: r for r in found.collect()}
    first = rows["https://www.shop.com/p/1"]
    assert (first["product_name"], [(v["model"], v["specs"]) for v in first["variants"]]) == ("Bolt M8", [("X-1", ["5mm / 6mm", "9MM"])])
    assert rows["https://www.shop.com/p/2"]["variants"] == [] and [v["model"] for v in rows["https://b.com/c/T-8M3-1"]["variants"]] == ["T-8M3-1"]
    assert {r["host"]: (r["urls"], r["seconds"]) for r in report.collect()} == {"www.shop.com": (2, 3.0), "b.com": (1, 4.0)}
    assert spark.read.json(out).count() == 3
    asked, _ = captures_plan.build_records(spark, str(run), None, products, Client)
    assert {r["url"]: r["product_name"] for r in asked.collect()} == {r["url"]: r["product_name"] for r in rows.values()}  # the client does not know these pages


def test_examples_follow_the_prompt(one):
    got = one(adapters.prompt(F.lit("https://shop.example/p/77-1204"), F.lit("Relay base 77-1204"), F.lit(adapters.EXAMPLES[1][0].split("[context]\n")[1].split("\n\n[image")[0]), F.lit("")))
    assert [m["role"] for m in got] == ["system", "user", "assistant", "user", "assistant", "user"] and got[-1]["content"] == adapters.EXAMPLES[1][0]
    assert all(json.loads(answer)["variants"] for _, answer in adapters.EXAMPLES)
    assert len(one(adapters.prompt(F.lit("u"), F.lit("t"), F.lit("c"), F.lit(""), []))) == 2
