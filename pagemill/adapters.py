"""Places for what the library does not bring along: browsers, recognition engines, spacing and language models."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import config, ship
from pagemill.functions.responses import normal_response
from pagemill.functions.text import truncated
from pagemill.guard import Guarded

#: Rows of an Arrow batch that Python works on at once; prompts and texts are large.
ROWS_AT_ONCE = 100

SYSTEM_PROMPT = (
    "Extract the product from a shop page. Answer with one JSON object: "
    '{"product_name": string, "variants": [{"model": string, "규격": [string]}]}. Use only what the page says; leave empty what it does not say.'
)


def message_text(url: str, title: str, context: str, image_text: str = config.NO_CONTENT) -> str:
    """The user's message for a page, as prompt() makes it."""
    return _MESSAGE.format(url=url, title=title, context=context, images=image_text)


def message_parts() -> list[str]:
    """The user's message in pieces: fixed texts, and between them the names url, title, context and images."""
    return re.split(r"\{(\w+)\}", _MESSAGE)


_MESSAGE = "URL: {url}\n\n[title]\n{title}\n\n[context]\n{context}\n\n[image text]\n{images}\n\nAnswer with one JSON object."
#: Pairs of a page and its answer that a model is shown: a table with a model in every row, and a page that mixes
#: properties with shipping and customs data.
EXAMPLES = [
    (
        message_text("https://shop.example/p/hex-key", "Hex key, long", "## 규격 테이블\n\n| 모델명 | size (mm) | length (mm) |\n| --- | --- | --- |\n| HK-03 | 3 | 126 |\n| HK-05 | 5 | 165 |"),
        '{"product_name": "Hex key, long", "variants": [{"model": "HK-03", "규격": ["size: 3 mm", "length: 126 mm"]}, {"model": "HK-05", "규격": ["size: 5 mm", "length: 165 mm"]}]}',
    ),
    (
        message_text("https://shop.example/p/77-1204", "Relay base 77-1204", "Model: 77-1204\nWeight: 0.2 kg\nMaterial: PBT\nShips in: 2 days\nCustoms code: 85366990"),
        '{"product_name": "Relay base 77-1204", "variants": [{"model": "77-1204", "규격": ["Weight: 0.2 kg", "Material: PBT"]}]}',
    ),
]


class ModelClient(Protocol):
    """Answers a list of chat messages; raises ConnectionError if it cannot be reached."""

    def __call__(self, messages: list[dict[str, str]]) -> str: ...


class WordReader(Protocol):
    """Finds the words in an image strip: polygons, texts, scores."""

    def __call__(self, image: bytes, y0: int, y1: int) -> tuple[list, list[str], list[float]]: ...


class Spacer(Protocol):
    """Corrects the spacing of one line of text."""

    def __call__(self, line: str) -> str: ...


class EmptyClient:
    """A stand-in that never answers, so that the rules apply."""

    def __call__(self, messages: list[dict[str, str]]) -> str:
        return ""


def prompt(url: Column, title: Column, context: Column, image_text: Column, examples: list[tuple[str, str]] | None = None, settings=config.DEFAULT) -> Column:
    """The chat messages for a page as an array of (role, content): rules, examples (EXAMPLES by default), the page."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    shown = [message(role, F.lit(text)) for pair in (EXAMPLES if examples is None else examples) for role, text in zip(("user", "assistant"), pair)]
    name = F.coalesce(F.nullif(title, F.lit("")), F.lit(config.NO_TITLE))
    parts = {"url": F.coalesce(url, F.lit("")), "title": name, "context": truncated(context, settings.source_chars), "images": truncated(image_text, settings.source_chars)}
    pieces = [F.lit(text) if k % 2 == 0 else parts[text] for k, text in enumerate(message_parts())]
    return F.array(message("system", F.lit(SYSTEM_PROMPT)), *shown, message("user", F.concat(*pieces)))


def request_body(messages: Column, settings=config.DEFAULT) -> Column:
    """The JSON text of a chat request."""
    options = F.struct(F.lit(0).alias("temperature"), F.lit(settings.model_tokens).alias("num_predict"), F.lit(settings.model_context).alias("num_ctx"))
    return F.to_json(
        F.struct(F.lit(settings.model_name).alias("model"), messages.alias("messages"), F.lit("json").alias("format"), F.lit(False).alias("stream"), options.alias("options"))
    )


def ask_model(pages: DataFrame, make_client: Callable[[], ModelClient], settings=config.DEFAULT) -> DataFrame:
    """pages (with column messages) with ``answer``, ``error`` and ``model_record`` (null where the model failed).

    make_client is called once for each task. A client that cannot be reached, or gives no answer in time, is asked again
    after a pause; other failures, empty answers and answers without a JSON object leave the record null, so that the rules
    apply. Every use of the result asks again: ask_once() writes answers first.
    """
    ship(pages.sparkSession)
    schema = T.StructType([*pages.schema.fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])
    at = pages.columns.index("messages")

    def asked(messages: list[dict[str, str]], client: Guarded) -> tuple[str | None, str | None]:
        error = "not asked"
        for attempt in range(settings.attempts):
            if attempt:
                time.sleep(settings.wait_seconds)
            answer, error = client(messages)
            if error is None:
                return (answer, None) if answer and answer.strip() else (None, "empty answer")
            if not error.startswith(("ConnectionError", "TimeoutError")):
                return None, error
        return None, f"unreachable: {error}"

    def answered(batches: Iterator) -> Iterator:
        import pyarrow as pa

        with Guarded(make_client, settings.answer_seconds) as client:
            for batch in batches:
                for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                    b = batch.slice(begin, ROWS_AT_ONCE)
                    got = [asked(m or [], client) for m in b.column(at).to_pylist()]
                    made = [pa.array([g[k] for g in got], pa.string()) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*b.columns, *made], schema.fieldNames())

    return pages.mapInArrow(answered, schema).withColumn("model_record", normal_response(F.col("answer")))


ANSWERS = "request string, answer string, error string, attempt int"


def read_answers(spark: SparkSession, store: str) -> DataFrame:
    """The last attempt of each request in a store of answers; an empty table if there is no store yet."""
    try:
        found = spark.read.schema(ANSWERS).parquet(store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ANSWERS)
    return found.groupBy("request").agg(F.max_by(F.struct("answer", "error", "attempt"), "attempt").alias("last")).select("request", "last.*")


def ask_once(pages: DataFrame, make_client: Callable[[], ModelClient], store: str, settings=config.DEFAULT) -> DataFrame:
    """pages (with column messages) with ``request``, ``answer``, ``error`` and ``model_record``; each distinct request is asked once.

    A request is known by the digest of its body. Requests that the store (a path) has no answer for, after fewer than
    settings.attempts runs, are asked and their answers written; only then is the result read from there. So whatever is done
    with the result asks nobody, equal pages share an answer, and a later run asks what failed. A task that is run again
    after a loss asks its own requests again.
    """
    spark = pages.sparkSession
    body = F.sha2(request_body(F.col("messages"), settings), 256)
    known = read_answers(spark, store)
    settled = known.where(F.col("answer").isNotNull() | (F.col("attempt") >= settings.attempts)).select("request")
    open_ = pages.select(body.alias("request"), "messages").groupBy("request").agg(F.first("messages").alias("messages")).join(settled, "request", "left_anti")
    open_ = open_.join(known.select("request", "attempt"), "request", "left")
    asked = ask_model(open_, make_client, settings)
    asked.select("request", "answer", "error", (F.coalesce("attempt", F.lit(0)) + 1).alias("attempt")).write.mode("append").parquet(store)
    answers = read_answers(spark, store).drop("attempt")
    # a request of very many pages is split by Spark's handling of skewed joins: the other side has one row for it
    return pages.withColumn("request", body).join(answers, "request", "left").withColumn("model_record", normal_response(F.col("answer")))


def correct_spacing(texts: DataFrame, column: str, make_spacer: Callable[[], Spacer]) -> DataFrame:
    """texts with every line of a column that is not blank corrected by a spacer, which is made once for each task.

    It runs after lines and columns are formed, as spacing decides on columns. Null stays null.
    """
    ship(texts.sparkSession)
    names = texts.columns
    at = names.index(column)

    def corrected(batches: Iterator) -> Iterator:
        import pyarrow as pa

        spacer = make_spacer()
        for b in (batch.slice(k, ROWS_AT_ONCE) for batch in batches for k in range(0, batch.num_rows, ROWS_AT_ONCE)):
            lines = [None if t is None else t.split("\n") for t in b.column(at).to_pylist()]
            fixed = pa.array([None if x is None else "\n".join(spacer(y) if y.strip() else y for y in x) for x in lines], pa.string())
            yield pa.RecordBatch.from_arrays([fixed if k == at else b.column(k) for k in range(b.num_columns)], names)

    return texts.mapInArrow(corrected, texts.schema)
