"""Capture folders as a data source of Spark: one folder for each page, with its metadata and its HTML.

Filters are pushed to the reader. Names of folders tell which host they may be of, so a filter on the host, the folder or the
number leaves folders out before any file is opened; what names cannot tell is decided from the small metadata file, and the
HTML of a page is opened only if the page is kept and the column is asked for.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagemill import ship
from pagemill.functions.urls import host_slug

COLUMNS = (
    "folder string, number long, host string, url string, status string, title string, final_url string, table_count int, ocr_asset_count int, "
    "product_selector string, context_file string, elapsed_seconds double, html string, error string"
)
#: Columns that the name of a folder tells; all others but html are read from its metadata.
NAMED = {"folder", "number"}
METADATA_FILE, HTML_FILE = "metadata.json", "page.html"
FOLDERS_PER_PARTITION = 1000
#: Bytes of HTML of a batch that a reader hands on.
BATCH_BYTES = 8 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def file_system(path: str):
    """The file system of a path and the path in it; paths without a scheme are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"[a-z][a-z0-9+.-]*:", path) else f"file://{path}")


def read_file(files, path: str) -> bytes | None:
    """The content of a file; null if there is none."""
    try:
        with files.open_input_stream(path) as f:
            return f.read()
    except FileNotFoundError:
        return None


def host_of(url: str | None) -> str | None:
    found = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:]*)", url or "")
    return found[1].lower() or None if found else None


# Filters in three-valued logic: true, false, or None for unknown

_TESTS: dict[type, Callable] = {
    ds.EqualTo: lambda have, want: have == want,
    ds.In: lambda have, want: have in want,
    ds.StringContains: lambda have, want: want in have,
    ds.StringStartsWith: lambda have, want: have.startswith(want),
    ds.StringEndsWith: lambda have, want: have.endswith(want),
    ds.GreaterThan: lambda have, want: have > want,
    ds.GreaterThanOrEqual: lambda have, want: have >= want,
    ds.LessThan: lambda have, want: have < want,
    ds.LessThanOrEqual: lambda have, want: have <= want,
}


def is_known(f: ds.Filter) -> bool:
    """Whether holds() understands a filter, and it is no filter on what takes opening the HTML."""
    f = f.child if isinstance(f, ds.Not) else f
    kind = type(f) in _TESTS or isinstance(f, (ds.IsNull, ds.IsNotNull, ds.EqualNullSafe))
    return kind and f.attribute[0] not in ("html", "error") and len(f.attribute) == 1


def holds(f: ds.Filter, row: dict) -> bool | None:
    """What a filter says of a row."""
    if isinstance(f, ds.Not):
        inner = holds(f.child, row)
        return None if inner is None else not inner
    have = row.get(f.attribute[0])
    if isinstance(f, ds.IsNull):
        return have is None
    if isinstance(f, ds.IsNotNull):
        return have is not None
    if isinstance(f, ds.EqualNullSafe):
        return have == f.value
    return None if have is None or getattr(f, "value", None) is None else _TESTS[type(f)](have, f.value)


def may_hold(f: ds.Filter, folder: str) -> bool:
    """Whether a filter can hold for a page of a folder, as far as its name tells. Only a false is certain."""
    number, slug = split_name(folder)
    inner = f.child if isinstance(f, ds.Not) else f
    if inner.attribute[0] in NAMED:
        return holds(f, {"folder": folder, "number": number}) is True
    if inner.attribute[0] != "host" or type(inner) not in _TESTS or isinstance(inner, (ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual)):
        return True
    wanted = inner.value if isinstance(inner, ds.In) else (inner.value,)
    plain = tuple((w or "").replace(".", "_") for w in wanted)
    found = any(_TESTS[ds.EqualTo if isinstance(inner, ds.In) else type(inner)](slug, w) for w in plain)
    if isinstance(f, ds.Not):
        # a name has underscores for dots, so a match of names is one of hosts only where there are neither
        return not (found and all("_" not in w for w in plain) and (slug != "unknown"))
    return found


def split_name(folder: str) -> tuple[int | None, str]:
    found = re.fullmatch(r"([0-9]{1,18})_(.*)", folder, re.DOTALL)
    return (int(found[1]), found[2]) if found else (None, folder)


@dataclass
class Folders(ds.InputPartition):
    """A range of the folders of a run."""

    run: str
    names: list[str]


class CaptureReader(ds.DataSourceReader):
    """Reads the columns of schema only; a page whose files are broken has an error and nulls."""

    def __init__(self, schema: StructType, options: dict):
        self.columns = schema.fieldNames()
        self.schema = schema
        self.path = options["path"]
        self.size = int(options.get("foldersPerPartition", FOLDERS_PER_PARTITION))
        self.filters: list[ds.Filter] = []

    def partitions(self) -> list[Folders]:
        from pyarrow import fs

        files, at = file_system(self.path)
        names = sorted(i.base_name for i in files.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.Directory)
        kept = [n for n in names if all(may_hold(f, n) for f in self.filters)]
        return [Folders(self.path, kept[k : k + self.size]) for k in range(0, len(kept), self.size)] or [Folders(self.path, [])]

    def row(self, files, at: str, name: str) -> dict | None:
        """The asked columns of a page, or None if the filters leave it out."""
        row = {"folder": name, "number": split_name(name)[0], "error": None}
        asked = {*self.columns, *((f.child if isinstance(f, ds.Not) else f).attribute[0] for f in self.filters)}
        if asked - NAMED - {"html"}:
            try:
                found = json.loads(read_file(files, f"{at}/{name}/{METADATA_FILE}") or b"{}")
                row |= found if isinstance(found, dict) else {}
            except ValueError as error:
                row["error"] = f"{type(error).__name__}: {error}"
            row["host"] = host_of(row.get("url"))
        if not all(holds(f, row) is True for f in self.filters):
            return None
        if "html" in self.columns:
            html = read_file(files, f"{at}/{name}/{HTML_FILE}")
            row["html"] = None if html is None else html.decode("utf-8", "replace")
        return row

    def read(self, partition: Folders) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        files, at = file_system(partition.run)
        schema = to_arrow_schema(self.schema)
        rows, size = [], 0
        for name in partition.names:
            row = self.row(files, at, name)
            if row is None:
                continue
            rows.append({c: fitting(row.get(c), schema.field(c).type) for c in self.columns})
            size += len(row.get("html") or "") + 1000
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class PushingReader(CaptureReader):
    """A reader that takes the filters it knows off Spark's hands, in full."""

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if is_known(f):
                self.filters.append(f)
            else:
                yield f


def fitting(value, kind):
    """A value of the metadata as a column of a kind takes it; null if it cannot."""
    import pyarrow as pa

    try:
        return None if value is None else str(value) if pa.types.is_string(kind) else float(value) if pa.types.is_floating(kind) else int(value)
    except (TypeError, ValueError):
        return None


class CaptureWriter(ds.DataSourceWriter):
    """Writes each row to a folder of its own. A task that runs again writes the same files again."""

    def __init__(self, schema: StructType, options: dict):
        self.columns = schema.fieldNames()
        self.path = options["path"]

    def write(self, iterator) -> ds.WriterCommitMessage:
        files, at = file_system(self.path)
        for r in iterator:
            row = r.asDict()
            folder = f"{at}/{row.pop('folder')}"
            html = row.pop("html", None)
            files.create_dir(folder, recursive=True)
            metadata = {k: v for k, v in row.items() if v is not None and k not in ("number", "host", "error")}
            for name, content in ((METADATA_FILE, json.dumps(metadata, ensure_ascii=False)), (HTML_FILE, html)):
                if content is not None:
                    with files.open_output_stream(f"{folder}/{name}") as f:
                        f.write(content.encode())
        return ds.WriterCommitMessage()


class CaptureSource(ds.DataSource):
    """``spark.read.format("captures")``, once registered; options ``path`` and ``foldersPerPartition``.

    A schema with some of COLUMNS reads those only.
    """

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        return CaptureReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ds.DataSourceWriter:
        if overwrite:
            raise ValueError("captures are added to a run; there is no overwriting")
        return CaptureWriter(schema, self.options)


class PushedCaptureSource(CaptureSource):
    """The same for sessions that push filters."""

    @classmethod
    def name(cls) -> str:
        return "pushed_captures"

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        return PushingReader(schema, self.options)


_sessions: dict[str, SparkSession] = {}


def pushing_session(spark: SparkSession) -> SparkSession:
    """A session with filters pushed to sources in Python: spark if it is one, else one beside it, the same for the whole application."""
    on = spark.conf.get(PUSHDOWN, "false") == "true"
    session = spark if on else _sessions.get(spark.sparkContext.applicationId) or spark.newSession()
    if session is not _sessions.get(spark.sparkContext.applicationId):
        session.conf.set(PUSHDOWN, "true")
        ship(session)
        session.dataSource.register(PushedCaptureSource)
        _sessions[spark.sparkContext.applicationId] = session
    return session


def capture_folders(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The pages of a run (the columns given, or all), with filters pushed to the reader.

    Pushing is a setting of the session; where it is off, a session beside it is used, and the caller's stays as it is.
    """
    known = StructType.fromDDL(COLUMNS)
    schema = StructType([known[c] for c in columns]) if columns else known
    return pushing_session(spark).read.format("pushed_captures").schema(schema).load(path)


def write_capture_folders(pages: DataFrame, path: str, number: str = "number") -> None:
    """Pages (number, url and html; status, title, … if there) as folders of a run. Numbers are distinct; a null url has an unknown host."""
    ship(pages.sparkSession)
    pages.sparkSession.dataSource.register(CaptureSource)
    folder = F.concat(F.col(number).cast("string"), F.lit("_"), host_slug(F.col("url")))
    known = [c for c in StructType.fromDDL(COLUMNS).fieldNames() if c in pages.columns and c not in ("folder", "number", "host", "error")]
    pages.select(folder.alias("folder"), *known).write.format("captures").mode("append").save(path)
