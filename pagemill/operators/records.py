"""Product records by rules, with a language model before them if one is given; routing, grouping, reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import config
from pagemill.functions.labels import classify_label, clean_title, label_values
from pagemill.functions.text import bound, first_line, snippet, strip
from pagemill.functions.urls import host as url_host
from pagemill.functions.urls import model_in_url
from pagemill.operators.tables import TABLES, table_pairs, tables_markdown

VARIANTS = "array<struct<model:string,specs:array<string>>>"
_CANDIDATES = "array<struct<category:string,value:string,source:string>>"


def context_document(title: Column, url: Column, region_md: Column, tables: Column, text: Column, settings=config.DEFAULT) -> Column:
    """The Markdown document of a page: heading, product region, tables, beginning of the text; empty parts are left out."""
    filled = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    head = F.concat(F.lit("# "), F.coalesce(filled(title), F.lit(config.NO_TITLE)), F.lit("\n- URL: "), F.coalesce(url, F.lit("")))
    return F.concat_ws(
        "\n\n",
        head,
        F.concat(F.lit(config.REGION_HEADING + "\n\n"), filled(region_md)),
        F.concat(F.lit(config.TABLES_HEADING + "\n"), filled(tables_markdown(tables))),
        F.concat(F.lit(config.TEXT_HEADING + "\n\n"), filled(snippet(text, settings.snippet_chars))),
    )


def merged_document(context: Column, image_text: Column) -> Column:
    """The context with the section of image texts, if there are any."""
    section = F.concat(F.lit("\n\n" + config.OCR_HEADING + "\n\n"), F.nullif(image_text, F.lit("")))
    return F.concat(context, F.coalesce(section, F.lit("")))


def legacy_context(context: Column, region_text: Column, tables_text: Column, text: Column, settings=config.DEFAULT) -> Column:
    """The context, or for older captures what they have instead."""
    filled = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    old = F.concat_ws("\n\n", filled(region_text), filled(tables_text), filled(F.substring(text, 1, settings.legacy_chars)))
    return F.coalesce(filled(context), old)


def context_sections(context: Column) -> Column:
    """(region_text, tables, text, image_text) of a document as context_document() and merged_document() write it.

    Tables come back as cells of texts, without spans; a missing section is empty. Headings count at the start of a
    line, the first of each kind, in their order.
    """
    headings = [config.REGION_HEADING, config.TABLES_HEADING, config.TEXT_HEADING, config.OCR_HEADING]

    def section(k: int) -> Column:
        later = "|".join(_quoted(h) for h in headings[k + 1 :])
        end = rf"(?=\n(?:{later})\n|\z)" if later else r"\z"
        return F.regexp_extract(F.coalesce(context, F.lit("")), rf"(?s)(?:^|\n){_quoted(headings[k])}\n+(.*?){end}", 1)

    found = F.struct(*[section(k).alias(n) for k, n in enumerate(("region", "tables", "text", "images"))])

    def parts(s: Column) -> Column:
        texts = F.regexp_replace(F.regexp_replace(s["text"], r"\s+\z", ""), r"(?m)^\[(?:MAIN|IFRAME \d+)\]\n", "")
        images = F.regexp_replace(s["images"], rf"(?m)^{_quoted(config.IMAGE_HEADING)}\d+\n+", "")
        return F.struct(strip(s["region"]).alias("region_text"), markdown_tables(s["tables"]).alias("tables"), texts.alias("text"), images.alias("image_text"))

    return bound(found, parts)


def _quoted(text: str) -> str:
    return re.sub(r"([()\[\].*+?^$|\\])", r"\\\1", text)


def markdown_tables(markdown: Column) -> Column:
    """The tables that tables_markdown() has written."""
    blocks = F.filter(F.split(F.concat(F.lit("\n"), markdown), rf"\n{_quoted(config.TABLE_HEADING)}"), lambda b: F.rlike(b, F.lit(r"^\d+\n")))
    cell = lambda c: F.struct(F.replace(strip(c), F.lit("\\|"), F.lit("|")).alias("text"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"))
    row = lambda r: F.transform(F.split(F.regexp_extract(r, r"^\| (.*) \|$", 1), r" (?<!\\)\| "), cell)
    lines = lambda b: F.filter(F.split(b, "\n"), lambda x: F.rlike(x, F.lit(r"^\| .*\|$")))
    rows = lambda b: F.transform(F.filter(lines(b), lambda x, i: i != 1), row)  # noqa: E731  the second line is the rule
    number = lambda b: F.regexp_extract(b, r"^(\d+)\n", 1).cast("int")
    return F.transform(blocks, lambda b: F.struct(number(b).alias("table_index"), F.lit(0).alias("frame_index"), rows(b).alias("rows"))).cast(TABLES)


def product_name(title: Column, host: Column, region_text: Column, text: Column) -> Column:
    """(name, source): the cleaned title if it has four characters, else the first such line of the region, then of the text."""
    found = lambda name, source: F.when(name.isNotNull(), F.struct(name.alias("name"), F.lit(source).alias("source")))
    by_title = bound(clean_title(title, host), lambda t: found(F.when(F.length(t) >= 4, t), "title"))
    by_line = lambda text, source: bound(first_line(text), lambda line: found(line, source))
    return F.coalesce(by_title, by_line(region_text, "product_dom"), by_line(text, "dom"), found(F.lit(""), "unknown"))


def spec_candidates(region_text: Column, tables: Column, image_text: Column) -> Column:
    """(category, value, source) from tables, then the region's text, then the images' text; other labels are left out."""

    def tagged(pairs: Column, source: Column) -> Column:
        return F.transform(pairs, lambda p: F.struct(classify_label(p["label"]).alias("category"), p["value"].alias("value"), source.alias("source")))

    texts = lambda t: F.transform(t["rows"], lambda r: F.transform(r, lambda c: c["text"]))
    known = F.coalesce(tables.cast(TABLES), F.array().cast(TABLES))
    from_tables = F.flatten(F.transform(known, lambda t: tagged(table_pairs(texts(t)), F.concat(F.lit("table#"), t["table_index"].cast("string")))))
    both = F.concat(from_tables.cast(_CANDIDATES), tagged(label_values(region_text), F.lit("product_dom")).cast(_CANDIDATES), tagged(label_values(image_text), F.lit("ocr")).cast(_CANDIDATES))
    return F.filter(both, lambda c: c["category"].isNotNull())


def values_with_source(candidates: Column, category: str) -> Column:
    """(value, source) of the candidates of a category: stripped, without empty ones, each value where it comes first."""
    own = F.transform(F.filter(candidates, lambda c: c["category"] == category), lambda c: F.named_struct(F.lit("value"), strip(c["value"]), F.lit("source"), c["source"]))
    first = lambda all_: F.filter(all_, lambda c, i: (c["value"] != "") & (F.array_position(F.transform(all_, lambda x: x["value"]), c["value"]) == i + 1))
    return bound(own, first)


def rule_variants(candidates: Column, url: Column) -> Column:
    """One variant for each distinct model (else the model in the URL, else an empty one); all share the specifications."""

    def made(found: Column) -> Column:
        models = F.when(F.size(found["models"]) > 0, found["models"]).otherwise(F.array(F.coalesce(model_in_url(url), F.lit(""))))
        return F.transform(models, lambda m: F.struct(m.alias("model"), found["specs"].alias("specs"))).cast(VARIANTS)

    of = lambda c, category: F.transform(values_with_source(c, category), lambda v: v["value"])
    both = lambda c: bound(F.struct(of(c, config.MODEL).alias("models"), of(c, config.SPEC).alias("specs")), made)
    return bound(candidates, both)


def product_records(pages: DataFrame, mode: str = "full", keep_errors: bool = False) -> DataFrame:
    """``url``, ``host``, ``status``, ``product_name``, ``variants`` and ``elapsed`` of captured pages.

    pages: url, status, title, context, region_text, tables, text, image_text, elapsed and, if a model has been
    asked, model_record (see adapters.ask_model). A page that was not captured gets an empty record with its
    status (``unknown`` for null). A model's record wins; where it is null the rules apply. mode ``full`` gives
    the rules all sources; ``as_called`` only title, context and URL. Pages that ended in an error have no record
    unless keep_errors is set.
    """
    status = F.coalesce("status", F.lit("unknown"))
    found = pages if keep_errors else pages.where(status != "error")
    full = mode == "full"
    region = F.col("region_text") if full else F.lit("")
    name = product_name(F.col("title"), url_host(F.col("url")), region, F.col("text") if full else F.col("context"))["name"]
    tables, images = (F.col("tables"), F.col("image_text")) if full else (F.array().cast(TABLES), F.lit(""))
    variants = rule_variants(spec_candidates(region, tables, images), F.col("url"))
    if "model_record" in pages.columns:
        name = F.coalesce("model_record.product_name", name)
        variants = F.coalesce(F.col("model_record.variants").cast(VARIANTS), variants)
    captured = status == "captured"
    return found.select(
        "url",
        F.coalesce(url_host(F.col("url")), F.lit("unknown")).alias("host"),
        status.alias("status"),
        F.when(captured, name).otherwise(F.lit("")).alias("product_name"),
        F.when(captured, variants).otherwise(F.array().cast(VARIANTS)).alias("variants"),
        "elapsed",
    )


def run_times(pages: DataFrame, *by: str) -> DataFrame:
    """For each run (the columns by): number of URLs, seconds, and mean seconds of a URL; a page without a time counts as 0."""
    seconds = F.coalesce("elapsed", F.lit(0.0))
    return pages.groupBy(*by).agg(F.count(F.lit(1)).alias("urls"), F.sum(seconds).alias("seconds"), F.avg(seconds).alias("mean_seconds"))


def host_report(records: DataFrame) -> DataFrame:
    """For each host: number of URLs and seconds."""
    return records.groupBy("host").agg(F.count(F.lit(1)).alias("urls"), F.sum("elapsed").alias("seconds"))


def v1_to_v2(records: DataFrame) -> DataFrame:
    """Records of the older shape (models and specs side by side) in the newer one."""
    models = F.when(F.size("models") > 0, F.col("models")).otherwise(F.array(F.lit("")))
    return records.select("url", "status", "product_name", F.transform(models, lambda m: F.struct(m.alias("model"), F.col("specs").alias("specs"))).cast(VARIANTS).alias("variants"))
