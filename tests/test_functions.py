import json

import pytest
from pyspark.sql import functions as F

from pagemill import config
from pagemill.functions import labels, responses, text, urls


@pytest.mark.parametrize("url, slug", [("https://U:p@WWW.a_b.com:84/x", "www_a_b_com"), ("not a url", "unknown"), (None, "unknown"), ("", "unknown")])
def test_host_slug(one, url, slug):
    assert one(urls.host_slug(F.lit(url).cast("string"))) == slug


def test_canonical(one):
    assert one(urls.canonical(F.lit("https://h/i.jpg?w=1#z"))) == one(urls.canonical(F.lit("https://h/i.jpg?w=2"))) == "https://h/i.jpg"


@pytest.mark.parametrize("url, out", [("https://mynaver.com/x", True), ("https://m.NAVER.com.evil.org", True), ("https://example.com/naver.com", False), ("nothing", False)])
def test_excluded(one, url, out):
    assert one(urls.is_excluded(F.lit(url))) is out


def test_blocked_requests(one):
    assert one(urls.is_blocked_request(F.lit("https://x.org/a"), F.lit("font")))
    assert one(urls.is_blocked_request(F.lit("https://www.Facebook.com/tr?id=1"), F.lit("image")))
    assert not one(urls.is_blocked_request(F.lit("https://x.org/a"), F.lit("image")))
    assert not one(urls.is_blocked_request(F.lit(None).cast("string"), F.lit(None).cast("string")))


@pytest.mark.parametrize(
    "url, model",
    [
        ("https://h/p/abc-12-345.html", "abc-12-345.html"),
        ("https://h/c/T-8M3-1/", "T-8M3-1"),
        ("https://h/view?x=T-8M3-1", None),
        ("https://h/500%2D033260", "500-033260"),
        ("https://h/a+b", None),
        ("https://h", None),
    ],
)
def test_model_in_url(one, url, model):
    assert one(urls.model_in_url(F.lit(url))) == model


def test_strip_and_collapse(one):
    assert one(text.strip(F.lit("　\x1c a b \x85"))) == "a b"
    assert one(text.collapse(F.lit(" a \n\t　b "))) == "a b"
    assert one(text.table_cell(F.lit(" a|b\nc "))) == "a\\|b c"


def test_lines_end_as_in_unicode(one):
    assert one(text.lines(F.lit("a\r\nb\x0bc\x0cd\x1ce\x85f g h\r\n\r\n i "))) == list("abcdefghi")
    assert one(text.lines(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize("offset, out", [(1490, True), (1491, False)])
def test_blocked_within_1500(one, offset, out):
    assert one(text.is_blocked(F.lit("t"), F.lit("x" * offset + "cloudflare"))) is out


def test_blocked_words(one):
    assert one(text.is_blocked(F.lit("Just A  Moment"), F.lit(None).cast("string")))
    assert one(text.is_blocked(F.lit(None).cast("string"), F.lit("비정상적인 접근")))
    assert not one(text.is_blocked(F.lit("ok"), F.lit("fine")))
    assert one(text.unfolds_more(F.lit("상세 정보 더보기"))) and one(text.unfolds_more(F.lit("Show More"))) and not one(text.unfolds_more(F.lit("buy")))


def test_truncated(one):
    assert one(text.truncated(F.lit("  "))) == config.NO_CONTENT
    assert one(text.truncated(F.lit("a" * 10001))) == "a" * 10000 + config.CUT
    assert one(text.truncated(F.lit(" " + "a" * 10000))) == "a" * 10000
    assert one(text.snippet(F.lit(" b"))) == " b"


def test_as_strings(one):
    values = F.array(*[F.lit(v).cast("string") for v in (" a ", "a", "", None, "x" * 151, "x" * 150 + "y")])
    assert one(text.as_strings(values)) == ["a", "x" * 150, "x" * 150]
    assert one(text.as_strings(F.lit(None).cast("array<string>"))) == []


def test_longest_takes_the_first(one):
    assert one(text.longest(F.array(F.lit("ab"), F.lit("cde"), F.lit("fgh")))) == "cde"


@pytest.mark.parametrize(
    "title, host, name",
    [
        ("Red Bolt M8 | Example Shop", "www.example.com", "Example Shop"),
        ("Red Bolt M8 | Example", "www.example.com", "Red Bolt M8"),
        ("Industry Mall - Big Motor", "mall.example.com", "Big Motor"),
        ("a | b", "", "a"),
        ("  ", "h", ""),
        ("||", "h", "||"),
        (None, "h", ""),
        ("MSFG-24/42-50/60-OD", "www.x.com", "MSFG-24/42-50/60-OD"),
    ],
)
def test_clean_title(one, title, host, name):
    assert one(labels.clean_title(F.lit(title).cast("string"), F.lit(host))) == name


@pytest.mark.parametrize("label, category", [("Inspection Date", config.SPEC), ("Model size", config.MODEL), ("색상", None), ("Part  No.", config.MODEL), ("", None)])
def test_classify_label(one, label, category):
    assert one(labels.classify_label(F.lit(label))) == category


@pytest.mark.parametrize(
    "line, pairs",
    [
        ("모델명: X-1", [("모델명", "X-1")]),
        ("규격\t5mm", [("규격", "5mm")]),
        ("A\tB: C", [("A", "B: C")]),
        ("l" * 20 + ": v", [("l" * 20, "v")]),
        ("l" * 21 + ": v", []),
        ("a: " + "v" * 121, [("a", "v" * 121)]),
        ("a: " + "v" * 122, []),
        ("a:", []),
        ("  a ： b \n\n c:d", [("a", "b"), ("c", "d")]),
    ],
)
def test_label_values(one, line, pairs):
    assert [tuple(p) for p in one(labels.label_values(F.lit(line)))] == pairs


def test_json_object(one):
    assert one(responses.json_object(F.lit('ok {"a":{"b":1}} end'))) == '{"a":{"b":1}}'
    assert one(responses.json_object(F.lit(' {"a": ["x"'))) == '{"a": ["x"'
    assert one(responses.json_object(F.lit("none"))) is None


@pytest.mark.parametrize(
    "cut, whole",
    [
        ('{"a": ["x"', {"a": ["x"]}),
        ('{"a": {"b": 1}', {"a": {"b": 1}}),  # a closing brace, but not the last one
        ('{"a": 1, "b": [2, ', {"a": 1, "b": [2]}),
        ('{"a":', {"a": None}),
        ('{"a": "x\\"{[y', {"a": 'x"{[y'}),
        ('{"a": "x\\', {"a": "x"}),
        ('{"a": "x\\\\', {"a": "x\\"}),
        ('{"a": "x\\u00', {"a": "x"}),
        ('{"a": "' + "y" * 50_000, {"a": "y" * 50_000}),
    ],
)
def test_closed(one, cut, whole):
    assert json.loads(one(responses.closed(F.lit(cut)))) == whole
    assert json.loads(one(F.to_json(responses.parsed_object(F.lit(cut))))) == whole


@pytest.mark.parametrize(
    "answer, name, variants",
    [
        ('{"variants":[1,{"model":"M","규격":"5mm"}]}', "", [("M", ["5mm"])]),
        ('{"model":["M1","M2"],"규격":["x"," x ",""]}', "", [("M1", ["x"]), ("M2", ["x"])]),
        ('{"product_name": " P ", "variants": []}', "P", [("", [])]),
        ('so: {"product_name": "P", "variants": [{"model": null, "규격": [1, "a"]}]} .', "P", [("", ["1", "a"])]),
        ('{"product_name": "P", "variants": [{"model": "M', "P", [("M", [])]),
        ('ok {"product_name": "P", "variants": [{"model": "M"}] and', "P", [("M", [])]),
        ("{}", "", [("", [])]),
    ],
)
def test_normal_response(one, answer, name, variants):
    got = one(responses.normal_response(F.lit(answer)))
    assert (got["product_name"], [(v["model"], v["specs"]) for v in got["variants"]]) == (name, variants)


@pytest.mark.parametrize("answer", ["[1]", "no", "", None])
def test_no_response(one, answer):
    assert one(responses.normal_response(F.lit(answer).cast("string"))) is None


REPAIRS = [
    ('{"k": 69 "t": "view"}', {"k": 69, "t": "view"}), ('{"k": 69,, "t": "view",}', {"k": 69, "t": "view"}), ("{'k': 69, 't': 'it\\'s view'}", {"k": 69, "t": "it's view"}),
    ("{k: 69, t: view}", {"k": 69, "t": "view"}), ('{"k": [69, 1}, "t": "view"]', {"k": [69, 1], "t": "view"}), ('{"k": [69, {"a": "vie', {"k": [69, {"a": "vie"}]}),
    ('{"k" "v", "t":, "u"}', {"k": "v", "t": None, "u": None}), ('{"t": "5" wide", "k": 69}', {"t": '5" wide', "k": 69}), ('{"k": None, "t": True, n: -1.5e2}', {"k": None, "t": True, "n": -150.0}),
    ('{"a":[1,2}', {"a": [1, 2]}), ('[{"a":[1,2}, {"b":2}]', [{"a": [1, 2]}, {"b": 2}]), ('{"a": "x\ny", "b": [one two, 2]}', {"a": "x\ny", "b": ["one two", 2]}),
    ('{"a": {"b": 1}, "c": 2}} tail {"d": 1}', {"a": {"b": 1}, "c": 2}), ('{"a": "q\\', {"a": "q"}), ('{ {"a":1} }', {"": {"a": 1}}), ('{"a"::1}', {"a": 1}), ('{"a": [1, 2, ], "b": {"c": 1,}}', {"a": [1, 2], "b": {"c": 1}}),
    ('{"a": "tab\there \\d \\u12"}', {"a": "tab\there d "}), ('{"a": \'say "hi"\'}', {"a": 'say "hi"'}), ("{C:\\path: x\\y}", {"C": "\\path"}), ("{", {}), ('{"a": [[1, 2}}', {"a": [[1, 2]]}), ('{"a" "b" "c" "d"}', {"a": "b", "c": "d"}),
]


def test_repaired(spark):
    """Whatever is broken, JSON comes out; these come out as they were meant."""
    import json

    from pagemill.functions import responses

    frame = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(REPAIRS)], "k int, t string").select("k", responses.repaired(F.col("t")).alias("r"))
    for r in frame.collect():
        if REPAIRS[r["k"]][0].startswith("{C:"):
            json.loads(r["r"])
        else:
            assert json.loads(r["r"]) == REPAIRS[r["k"]][1], REPAIRS[r["k"]][0]


def test_repair_of_anything_is_json_and_leaves_json_alone(spark):
    import json
    import random

    from pagemill.functions import responses

    draw = random.Random(4)
    marks = ['{', '}', '[', ']', ':', ',', '"a"', "'b'", "bare", "7", "true", " ", '"', "'", "\\", "\n"]
    broken = ["{" + "".join(draw.choice(marks) for _ in range(draw.randint(0, 14))) for _ in range(1500)]

    def value(depth):
        kind = draw.randint(0, 5 if depth else 3)
        return [draw.choice([None, True, False]), draw.randint(-99, 99), draw.choice(["", 'q"q', "a,b: c", "\\", "x\n\t", "é 하", "it's"]), 0.5][kind] if kind < 4 else [value(depth - 1) for _ in range(draw.randint(0, 3))] if kind == 4 else {draw.choice("abcd") + str(i): value(depth - 1) for i in range(draw.randint(0, 3))}

    good = [json.dumps({"v": value(3)}, ensure_ascii=False) for _ in range(400)]
    frame = spark.createDataFrame([(t,) for t in broken + good], "t string").select("t", responses.repaired(F.col("t")).alias("r"))
    for r in frame.collect():
        got = json.loads(r["r"], strict=True)
        assert isinstance(got, dict)
        if r["t"] in good:
            assert got == json.loads(r["t"])
