"""Titles, labels and label-value lines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill import config
from pagemill.functions.text import SPACE, bound, lines, longest, normal_label, strip

_SEPARATORS = config.TITLE_SEPARATORS.replace(r"\s", SPACE)
_NO_SPACE = r"[^\t-\r\x1c-\x20\x85\p{Z}]"
_IN_LINE = r"[^\n]"
#: Lines of a label and its value, by tab and by colon.
TAB_LINE = rf"^([^\t]{{1,20}})\t+({_NO_SPACE}{_IN_LINE}{{0,120}})$"
COLON_LINE = rf"^([^\t:：]{{1,20}}?){SPACE}*[:：]{SPACE}*({_NO_SPACE}{_IN_LINE}{{0,120}})$"


def clean_title(title: Column, host: Column) -> Column:
    """The product's name in a page title: the longest part that does not name the site.

    Parts are cut at separators. A part names the site if, in lower case and without spaces, it contains the
    host's first label; if all do (an empty host is in all), all are considered. A title of separators only is
    returned stripped; null becomes empty.
    """
    root = F.lower(F.substring_index(F.coalesce(host, F.lit("")), ".", 1))

    def named(raw: Column, parts: Column) -> Column:
        other = F.filter(parts, lambda p: ~F.contains(F.replace(F.lower(p), F.lit(" "), F.lit("")), root))
        return F.when(F.size(parts) == 0, strip(raw)).otherwise(bound(other, lambda o: longest(F.when(F.size(o) > 0, o).otherwise(parts))))

    split = lambda raw: F.filter(F.transform(F.split(raw, _SEPARATORS), strip), lambda p: p != "")
    return bound(F.coalesce(title, F.lit("")), lambda raw: bound(split(raw), lambda parts: named(raw, parts)))


def classify_label(label: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """The first category with a keyword in the label, both without white space and in lower case; else null.

    A category's keywords (the settings', or others) are one pattern. For a dictionary in a table see operators/keywords.py.
    """
    known = config.LABEL_KEYWORDS if keywords is None else keywords
    patterns = {name: "|".join(re.escape("".join(w.split()).lower()) for w in words) for name, words in known.items()}
    return bound(normal_label(label), lambda normal: F.coalesce(F.lit(None).cast("string"), *[F.when(F.rlike(normal, F.lit(p)), F.lit(name)) for name, p in patterns.items() if p]))


def label_value(line: Column) -> Column:
    """(label, value) of a stripped line, by tab before colon, or null. Labels have 1 to 20 characters, values 1 to 121."""

    def pair(pattern: str) -> Column:
        sides = F.struct(strip(F.regexp_extract(line, pattern, 1)).alias("label"), strip(F.regexp_extract(line, pattern, 2)).alias("value"))
        return bound(sides, lambda p: F.when((p["label"] != "") & (p["value"] != ""), p))

    # a line that matches by tab is not tried by colon, even if one side turns out blank
    by_colon = F.when(F.rlike(line, F.lit(COLON_LINE)), pair(COLON_LINE))
    return F.when(F.rlike(line, F.lit(TAB_LINE)), pair(TAB_LINE)).otherwise(by_colon)


def label_values(text: Column) -> Column:
    """All (label, value) pairs in the lines of a text."""
    return F.filter(F.transform(lines(text), label_value), lambda p: p.isNotNull())
