"""What a language model answers: finding the JSON object in it and bringing both known shapes to one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.config import SPECS_KEY
from pagemill.functions.text import as_strings, bound, strip

VARIANTS = "array<struct<model string, specs array<string>>>"


def json_object(answer: Column) -> Column:
    """The text from the first brace to the last; without a closing brace, the whole of an answer that begins with one.

    Null if there is neither. Whether it is JSON is not looked at; see parsed_object.
    """
    whole = F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit(""))
    return F.coalesce(whole, bound(strip(answer), lambda bare: F.when(F.startswith(bare, F.lit("{")), bare)))


def parsed_object(answer: Column) -> Column:
    """The JSON object in an answer as a variant: as it stands, else closed where it was cut off, else repaired; null if none is JSON."""
    return bound(json_object(answer), lambda found: F.coalesce(F.try_parse_json(found), F.try_parse_json(closed(found)), F.try_parse_json(repaired(found))))


def closed(text: Column) -> Column:
    """A cut-off JSON text with its open string and brackets closed, by a fold over its quotation marks and brackets.

    Before that a comma at the end is dropped, a colon at the end gets null, and half an escape in a string is dropped.
    """
    start = F.struct(F.lit(False).alias("quoted"), F.lit("").alias("open"))

    def step(s: Column, c: Column) -> Column:
        opener = F.when(c == "{", "}").when(c == "[", "]")
        inside = (
            F.when(s["quoted"], s["open"]).when(opener.isNotNull(), F.concat(opener, s["open"]))
            .when(c.isin("}", "]"), F.substring(s["open"], 2, 1 << 30)).otherwise(s["open"])
        )
        return F.struct(F.when(c == '"', ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), inside.alias("open"))

    def ended(end: Column) -> Column:
        bare = F.regexp_replace(text, r"[\s,]+$", "")
        whole = F.when(F.endswith(bare, F.lit(":")), F.concat(bare, F.lit("null"))).otherwise(bare)
        half = F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)\\(?:u[0-9A-Fa-f]{0,3})?$", "$1")
        return F.concat(F.when(end["quoted"], F.concat(half, F.lit('"'))).otherwise(whole), end["open"])

    # escapes are matched first, so an escaped quotation mark is none
    marks = F.regexp_extract_all(text, F.lit(r'(?s)\\.|["{}\[\]]'), F.lit(0))
    return bound(F.aggregate(marks, start, step), ended)


#: Tokens of broken JSON. A quotation mark ends a string where a mark, a bracket, another string, a line's end or nothing
#: follows, and stands for itself elsewhere; what is neither string nor mark is a bare word up to the next mark.
_AFTER = r"(?=\s*[,:}\]\"']|[ \t]*\n|\s*$)"
_TOKENS = "(?s)" + "|".join((
    rf'"(?:[^"\\]|\\.|"(?!\s*[,:}}\]\"]|[ \t]*\n|\s*$))*(?:"|\\?$)',
    rf"'(?:[^'\\]|\\.|'(?!\s*[,:}}\]']|[ \t]*\n|\s*$))*(?:'|\\?$)",
    r"[{}\[\]:,]", r"[^\s{}\[\]:,\"'](?:[^{}\[\]:,\"\n])*",
))
_NUMBER = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"
_WORDS = {"true": "true", "false": "false", "null": "null", "True": "true", "False": "false", "None": "null", "undefined": "null", "NaN": "null"}


def _quoted(body: Column) -> Column:
    """A JSON string of a body that may hold escapes, bare quotation marks and control characters."""
    whole = F.regexp_replace(body, r"(?<!\\)((?:\\\\)*)\\(?:u[0-9A-Fa-f]{0,3})?$", "$1")
    known = F.regexp_replace(whole, r'(\\["\\/bfnrt]|\\u[0-9A-Fa-f]{4})|\\', "$1")  # without escapes that JSON has not
    marked = F.regexp_replace(known, r'(?<!\\)((?:\\\\)*)"', r'$1\\"')
    for character, name in (("\n", "n"), ("\r", "r"), ("\t", "t")):
        marked = F.replace(marked, F.lit(character), F.lit("\\" + name))
    return F.concat(F.lit('"'), F.regexp_replace(marked, r"[\x00-\x1f]", " "), F.lit('"'))


def _scalar(token: Column, is_key: Column) -> Column:
    """A token that is no mark, as a key or a value."""
    mark = F.substring(token, 1, 1)
    ended = F.rlike(token, F.lit(r"(?s)^(.).*(?<!\\)(?:\\\\)*\1$")) & (F.length(token) > 1)
    body = F.substring(token, F.lit(2), F.length(token) - F.when(ended, 2).otherwise(1))
    bare = F.rtrim(F.regexp_replace(token, r"\s+$", ""))
    word = F.coalesce(*[F.when(bare == k, v) for k, v in _WORDS.items()], F.when(F.rlike(bare, F.lit(_NUMBER)), bare))
    return F.when(mark.isin('"', "'"), _quoted(body)).when(is_key | word.isNull(), _quoted(F.replace(bare, F.lit("\\"), F.lit("\\\\")))).otherwise(word)


def repaired(text: Column) -> Column:
    """JSON from a broken text, by a pushdown parser over its tokens that corrects as it goes.

    It knows the open brackets and what must come next: a key, a colon, a value, or the end of an item. What is missing (commas,
    colons, values as null, brackets, quotation marks) is put in, what is too much (commas, colons, brackets, all behind the first
    value) is left out, single quotes and bare words become strings. A bracket closed by the wrong one is closed; so is what
    lies between, if an outer bracket is the one meant, unless a key follows that must then be the middle one's.
    """
    tokens = F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0))
    start = F.struct(*[F.lit(v).alias(k) for k, v in (("out", ""), ("open", ""), ("need", "value"), ("comma", False))])

    def unfinished(s: Column) -> Column:
        """What an item that ends here still lacks."""
        top = F.substring(s["open"], 1, 1)
        return F.when(s["need"] == "colon", ":null").when((s["need"] == "value") & (top == "{"), "null").otherwise("")

    def step(s: Column, x: Column) -> Column:
        token, need, open_ = x["token"], s["need"], s["open"]
        mark = F.when(F.length(token) == 1, token).otherwise("")
        in_object = F.substring(open_, 1, 1) == "{"
        keyed = (need == "key") | ((need == "end") & in_object)
        before = F.when(need == "colon", ":").when((need == "end") | s["comma"], ",").otherwise("")

        def state(out: Column, brackets: Column, then: Column, comma: bool = False) -> Column:
            return F.struct(F.concat(s["out"], out).alias("out"), brackets.alias("open"), then.alias("need"), F.lit(comma).alias("comma"))

        opened = state(F.concat(before, F.when(keyed, '"":').otherwise(""), mark), F.concat(mark, open_), F.when(mark == "{", "key").otherwise("value"))
        place = F.instr(open_, F.when(mark == "}", "{").otherwise("["))
        outer = F.substring(open_, place + 1, F.lit(1))
        middle = (place > 1) & x["keyed"] & (outer != "{") & (F.substring(open_, 2, 1) == "{")
        n = F.when((place == 0) | middle, 1).otherwise(place)
        closes = state(F.concat(unfinished(s), F.translate(F.substring(open_, F.lit(1), n), "{[", "}]")), F.substring(open_, n + 1, F.lit(1 << 30)), F.lit("end"))
        parted = state(unfinished(s), open_, F.when(in_object, "key").otherwise("value"), True)
        item = state(F.concat(before, _scalar(token, keyed)), open_, F.when(keyed, "colon").otherwise("end"))
        fits = (need == "end") | (unfinished(s) != "")
        return (
            F.when((need == "end") & (open_ == ""), s)
            .when(mark.isin("{", "["), opened).when(mark.isin("}", "]"), F.when(open_ == "", s).otherwise(closes))
            .when(mark == ",", F.when(fits, parted).otherwise(s))
            .when(mark == ":", F.when(need == "colon", state(F.lit(":"), open_, F.lit("value"))).otherwise(s))
            .otherwise(item)
        )

    def folded(found: Column) -> Column:
        ahead = F.transform(found, lambda t, i: F.struct(t.alias("token"), F.coalesce((F.get(found, i + 1) == ",") & (F.get(found, i + 3) == ":"), F.lit(False)).alias("keyed")))
        return F.aggregate(ahead, start, step, lambda s: F.concat(s["out"], unfinished(s), F.translate(s["open"], "{[", "}]")))

    return bound(tokens, folded)


def _text(value: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(value, path, "string"), F.lit(""))


def _strings(value: Column, path: str) -> Column:
    """A string, or a list of anything, as an array of strings."""
    many = F.transform(F.try_variant_get(value, path, "array<variant>"), lambda v: F.try_variant_get(v, "$", "string"))
    one = F.try_variant_get(value, path, "string")
    return as_strings(F.coalesce(many, F.when(one.isNotNull(), F.array(one))))


def normal_response(answer: Column) -> Column:
    """(product_name, variants) of an answer, or null if it holds no JSON object.

    The newer shape has variants, whose entries that are no objects are left out; the older one lists models that
    share the specifications, and without a model has one empty one. JSON null counts as empty.
    """
    return bound(parsed_object(answer), _normal)


def _normal(value: Column) -> Column:
    def newer(entries: Column) -> Column:
        objects = F.filter(entries, lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT")))
        return F.transform(objects, lambda v: F.struct(F.substring(strip(_text(v, "$.model")), 1, 200).alias("model"), _strings(v, f"$.{SPECS_KEY}").alias("specs")))

    def older(found: Column) -> Column:
        models = F.when(F.size(found["models"]) > 0, found["models"]).otherwise(F.array(F.lit("")))
        return F.transform(models, lambda m: F.struct(m.alias("model"), found["specs"].alias("specs")))

    legacy = bound(F.struct(_strings(value, "$.model").alias("models"), _strings(value, f"$.{SPECS_KEY}").alias("specs")), older)
    variants = bound(F.try_variant_get(value, "$.variants", "array<variant>"), lambda entries: F.when(F.size(entries) > 0, newer(entries)).otherwise(legacy))
    name = F.substring(strip(_text(value, "$.product_name")), 1, 200)
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.struct(name.alias("product_name"), variants.alias("variants")))
