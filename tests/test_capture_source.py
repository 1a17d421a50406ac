import shutil

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagemill.sources import capture_source as cs

PAGES = [(k, f"https://{h}/p/{k}", f"<p>page {k}</p>", "captured", f"t{k}") for k, h in enumerate(["www.a.com", "shop.naver.com", "a_b.com", "x.org", "naver.com", "a-b.org", "m.naver.com:8080"])] + [(7, None, None, None, None)]


@pytest.fixture
def run(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "number long, url string, html string, status string, title string")
    path = str(tmp_path / "capture_20260101_000000")
    cs.write_capture_folders(pages, path)
    return path


def rows(run, columns, *filters):
    """Rows and names of opened files of a reader asked directly."""
    known, opened = StructType.fromDDL(cs.COLUMNS), []
    reader = cs.PushingReader(StructType([known[c] for c in columns]), {"path": run, "foldersPerPartition": "3"})
    left = list(reader.pushFilters(list(filters)))
    plain, cs.read_file = cs.read_file, lambda files, path: opened.append(path.rsplit("/", 1)[1]) or plain(files, path)
    try:
        parts = reader.partitions()
        found = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    finally:
        cs.read_file = plain
    return found, opened, left, parts


def test_opened_files(run):
    """An excluded domain costs the metadata of its pages, never their HTML; a filter on names opens nothing else at all."""
    naver = ds.Not(ds.StringContains(("host",), "naver.com"))
    found, opened, left, parts = rows(run, ["number", "host", "html"])
    assert len(found) == 8 and opened.count("page.html") == 8 == opened.count("metadata.json") and [len(p.names) for p in parts] == [3, 3, 2]
    found, opened, left, _ = rows(run, ["number", "host", "html"], naver)
    assert [r["number"] for r in found] == [0, 2, 3, 5] and opened.count("page.html") == 4 and opened.count("metadata.json") == 8 and left == []
    found, opened, _, _ = rows(run, ["number", "host", "html"], ds.EqualTo(("host",), "a.b.com"))
    assert found == [] and opened == ["metadata.json"]  # the folder of a_b.com has the same name
    found, opened, _, parts = rows(run, ["html"], ds.In(("host",), ("x.org", "www.a.com")), ds.GreaterThan(("number",), 0))
    assert [r["html"] for r in found] == ["<p>page 3</p>"] and opened == ["metadata.json", "page.html"] and [p.names for p in parts] == [["3_x_org"]]
    found, opened, _, _ = rows(run, ["folder", "number"])
    assert len(found) == 8 and opened == []
    found, opened, _, _ = rows(run, ["number", "title"], ds.Not(ds.StringContains(("host",), "a-b")))
    assert [r["number"] for r in found] == [0, 1, 2, 3, 4, 6] and len(opened) == 7  # a name without dots is certain


def test_filters_in_three_valued_logic(run):
    assert [r["number"] for r in rows(run, ["number"], ds.IsNull(("host",)))[0]] == [7]
    assert [r["number"] for r in rows(run, ["number"], ds.Not(ds.EqualTo(("host",), "x.org")))[0]] == [0, 1, 2, 4, 5, 6]
    assert [r["number"] for r in rows(run, ["number"], ds.EqualNullSafe(("title",), None))[0]] == [7]
    assert rows(run, ["number"], ds.StringContains(("html",), "page"))[2] != []  # Spark keeps what takes the HTML


def test_with_spark(spark, run):
    """HTML of excluded pages cannot be opened here, and nothing of it is."""
    for k, slug in ((1, "shop_naver_com"), (4, "naver_com"), (6, "m_naver_com")):
        page = f"{run}/{k}_{slug}/page.html"
        shutil.move(page, page + "_")
        shutil.copytree(run + "/0_www_a_com", page)
    (open(f"{run}/3_x_org/metadata.json", "w")).write("{broken")
    kept = cs.capture_folders(spark, run, "number", "host", "html", "error")
    plan = kept.where(~F.contains("host", F.lit("naver.com")))
    got = {r["number"]: r for r in plan.collect()}
    assert sorted(got) == [0, 2, 5] and got[2]["html"] == "<p>page 2</p>" and got[2]["host"] == "a_b.com"
    broken = kept.where("number = 3").first()
    assert broken["host"] is None and broken["html"] == "<p>page 3</p>" and broken["error"].startswith("JSONDecodeError")
    assert spark.conf.get(cs.PUSHDOWN, "false") == "false"
    with pytest.raises(Exception, match="page.html"):
        kept.where("number < 2").collect()


def test_empty_run(spark, tmp_path):
    (tmp_path / "run").mkdir()
    assert cs.capture_folders(spark, str(tmp_path / "run")).count() == 0
