import pytest
from pyspark.sql import functions as F

from pagemill import sql
from pagemill.operators import dom

HTML = "<title>T</title><table><td>a<td colspan=2>b <i>c</i><tr><td>x<table><tr><th rowspan=3>n</table>y<script>'<td>'</script></table><table></table><table><tr></tr><tr><td></table>"
VALUES = [None, "", "https://www.Naver.com:80/a/AB-12-X%2F?x=1#y", "Shop | Fine bolt - www", " Show  more ", "모델명: X-1\nSize\t5 mm\n\nmodel no: 7", '{"product_name": "P", "variants": [{"model": "M", "규격": ["5"]}]}', "Access denied by cloudflare", "it's a \\ quote　"]


def test_functions_equal_their_expressions(spark):
    sql.register(spark)
    frame = spark.createDataFrame([(a, b) for a in VALUES for b in (None, "www.bolt.com", "font")], "a string, b string")
    frame.createOrReplaceTempView("sql_values")
    for name, (parameters, _, made) in sql.FUNCTIONS.items():
        names = ["a", "b"][: parameters.count(",") + 1]
        both = spark.sql(f"SELECT a, b, {name}({', '.join(names)}) AS v FROM sql_values").withColumn("w", made(*map(F.col, names)))
        assert both.where("NOT v <=> w").count() == 0, name


def test_tables_in_sql(spark):
    spark.createDataFrame([(1, HTML), (2, None), (3, "<p>no table")], "id int, html string").createOrReplaceTempView("sql_pages")
    sql.register(spark)
    got = spark.sql("SELECT id, t.* FROM sql_pages, LATERAL parse_tables(html) t").collect()
    assert [tuple(r) for r in got] == [
        (1, 1, 1, 1, "a", 1, 1), (1, 1, 1, 2, "b c", 1, 2), (1, 1, 2, 1, "xny", 1, 1), (1, 1, 2, 2, "n", 3, 1), (1, 1, 3, 1, "n", 3, 1), (1, 2, 1, 1, "n", 3, 1), (1, 3, 1, 1, "", 1, 1),
    ]


def test_nodes_in_sql(spark):
    """The structural join by containment of intervals, in plain SQL."""
    spark.createDataFrame([(1, HTML), (2, None)], "id int, html string").createOrReplaceTempView("sql_pages")
    sql.register(spark)
    got = spark.sql("""
      WITH n AS (SELECT id, t.* FROM sql_pages, LATERAL page_nodes(html) t)
      SELECT n.id, c.at, string_agg(n.text, '') WITHIN GROUP (ORDER BY n.at) AS text FROM n JOIN n AS c ON c.id = n.id AND c.tag IN ('td', 'th') AND n.at > c.at AND n.at < c.last
      WHERE n.text IS NOT NULL GROUP BY ALL ORDER BY c.at""")
    assert [r["text"].split("'")[0] for r in got.collect()] == ["a", "b c", "xny", "n"]


@pytest.mark.parametrize("html", [None, "", HTML, "<ul><li>a<li>b</ul></p><br>x"])
def test_numbers_are_intervals(html):
    nodes = dom.nodes_of(html)
    assert [n[0] for n in nodes] == sorted({n[0] for n in nodes}) and nodes[0][3] == dom.PAGE
    for a in nodes:
        for b in nodes:
            assert not a[0] < b[0] < a[1] < b[1]  # no two overlap
    assert all(n[2] == max((a[0] for a in nodes if a[0] < n[0] and n[1] <= a[1] and a[3] is not None and a[1] > a[0]), default=-1) for n in nodes[1:])
