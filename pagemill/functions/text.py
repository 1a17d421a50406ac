"""Text expressions. All are Catalyst expressions; nulls stay null unless the function says otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill import config

#: White space in the sense of Unicode, with the separators U+001C to U+001F.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
#: What ends a line: also vertical tab, form feed, file separators, next line, line and paragraph separators.
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once: a lambda over a one-element array names it, so the plan holds it once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def without_spaces(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", "")


def normal_label(label: Column) -> Column:
    """A label without white space, in lower case."""
    return F.lower(without_spaces(label))


def lines(text: Column) -> Column:
    """Lines of a text (empty array for null), without those that are blank, stripped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END), strip), lambda x: x != "")


def table_cell(text: Column) -> Column:
    """A cell of a Markdown table: pipes escaped, line feeds as spaces, stripped."""
    return strip(F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def snippet(text: Column, limit: int = config.DEFAULT.snippet_chars) -> Column:
    """The beginning of a text, with a mark if it was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(config.CUT))).otherwise(text)


def truncated(text: Column, limit: int = config.DEFAULT.source_chars) -> Column:
    """snippet() of the stripped text; null or blank becomes a placeholder."""
    return bound(strip(F.coalesce(text, F.lit(""))), lambda bare: F.when(bare == "", F.lit(config.NO_CONTENT)).otherwise(snippet(bare, limit)))


def is_blocked(title: Column, body: Column, limit: int = config.DEFAULT.blocked_chars) -> Column:
    """Whether a page only keeps robots out; null title or body count as empty."""
    sample = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(F.coalesce(body, F.lit("")), 1, limit))
    return F.rlike(sample, F.lit("(?i)" + config.BLOCKED_PATTERN.replace(r"\s", SPACE)))


def unfolds_more(label: Column) -> Column:
    """Whether a button's text promises more of the page."""
    return F.coalesce(F.rlike(label, F.lit("(?i)" + config.MORE_PATTERN.replace(r"\s", SPACE))), F.lit(False))


def first_line(text: Column, least: int = 4) -> Column:
    """The first line of at least least characters, or null."""
    return F.get(F.filter(lines(text), lambda x: F.length(x) >= least), F.lit(0))


def longest(parts: Column) -> Column:
    """The longest string of an array, the first of equally long ones; null for none."""
    ranked = F.transform(parts, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x")))
    return F.array_max(ranked)["x"]


def distinct_stripped(values: Column) -> Column:
    """The values stripped, without empty ones, each where it comes first."""
    return F.array_distinct(F.filter(F.transform(values, strip), lambda x: x.isNotNull() & (x != "")))


def as_strings(values: Column, limit: int = 150) -> Column:
    """Distinct stripped values, then cut to limit characters (cut values may be equal); null gives an empty array."""
    return F.transform(distinct_stripped(F.coalesce(values, F.array().cast("array<string>"))), lambda x: F.substring(x, 1, limit))
