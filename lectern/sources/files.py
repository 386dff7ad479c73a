"""File scans, identity, MIME, and text extraction by MIME class."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.codes import mime_by_suffix

Extractor = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
#: Characters of extracted texts that a task holds before it hands them on.
OUT_CHARS = 1 << 21
EXTRACTED = "file_id string, text string, title string, method string, error string"


def scan_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        "path",
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
        "content",
    )


def register_files(
    files: DataFrame, existing: DataFrame | None = None, content_col: str = "content"
) -> tuple[DataFrame, DataFrame]:
    """(file rows, chat links). Equal bytes are one file; a known file keeps created_at and status.

    ``files`` needs filename, chat_id, created_at and the content. The content is hashed and dropped
    before any shuffle. The first registration (by time, then name) names the file.
    """
    hashed = files.withColumn("hash", F.sha2(F.col(content_col).cast("binary"), 256)).withColumn(
        "size_bytes", F.octet_length(content_col).cast("bigint")
    ).drop(content_col).withColumn("file_id", F.concat(F.lit("file_"), F.col("hash")))
    links = hashed.groupBy("chat_id", "file_id").agg(F.min("created_at").alias("created_at"))
    first = F.min_by(F.struct("filename", "created_at"), F.struct("created_at", "filename"))
    rows = hashed.groupBy("file_id", "hash", "size_bytes").agg(first.alias("_first")).select(
        "file_id", "hash", "size_bytes", F.col("_first.filename").alias("filename"),
        F.col("_first.created_at").alias("created_at"), F.lit("pending").alias("status"),
    )
    if existing is not None:
        known = existing.select(
            "file_id", F.col("created_at").alias("_created"), F.col("status").alias("_status")
        )
        rows = rows.join(known, "file_id", "left").select(
            "file_id", "hash", "size_bytes", "filename",
            F.coalesce("_created", "created_at").alias("created_at"),
            F.coalesce("_status", "status").alias("status"),
        )
    return rows, links


def detect_mime(df: DataFrame, name_col: str, out: str = "mime") -> DataFrame:
    return df.withColumn(out, mime_by_suffix(F.col(name_col)))


def _decode(content: bytes | None) -> str:
    return (content or b"").decode("utf-8", errors="ignore")


def _plain(content: bytes) -> tuple[str, str | None]:
    return _decode(content), None


def _json_text(content: bytes) -> tuple[str, str | None]:
    text = _decode(content)
    try:
        return json.dumps(json.loads(text), indent=2), None
    except ValueError:
        return text, None


def _csv_text(content: bytes) -> tuple[str, str | None]:
    rows = csv.reader(io.StringIO(_decode(content), newline=""))
    return "\n".join(", ".join(cell.strip() for cell in row) for row in rows), None


class _VisibleText(HTMLParser):
    """Text outside script, style and comments; the first title is kept apart as well."""

    hidden = ("script", "style", "template")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title: list[str] | None = None
        self._in_title = False
        self._skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.hidden:
            self._skip += 1
        elif tag == "title" and self.title is None:
            self.title, self._in_title = [], True

    def handle_endtag(self, tag):
        if tag in self.hidden and self._skip:
            self._skip -= 1
        elif tag == "title":
            self._in_title = False

    def handle_data(self, data):
        if self._skip:
            return
        self.parts.append(data)
        if self._in_title:
            self.title.append(data)


def html_to_text(markup: str) -> tuple[str, str | None]:
    parser = _VisibleText()
    parser.feed(markup)
    parser.close()
    title = "".join(parser.title) if parser.title is not None else None
    return "\n".join(parser.parts), title


def _html(content: bytes) -> tuple[str, str | None]:
    return html_to_text(_decode(content))


def per_file(read: Callable[[bytes], tuple[str, str | None]], method: str) -> Extractor:
    """An extractor over batches; a file that fails becomes a row with an error, never a failed job. Texts are handed on
    as soon as ``OUT_CHARS`` characters of them are held, whatever the size of the batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file_id", "text", "title", "method", "error"]
        for batch in batches:
            rows, held = [], 0
            for file_id, content in zip(batch["file_id"], batch["content"]):
                try:
                    text, title = read(content)
                    rows.append((file_id, text, title, method, None))
                    held += len(text)
                except Exception as exc:
                    rows.append((file_id, None, None, method, f"{type(exc).__name__}: {exc}"))
                if held >= OUT_CHARS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    run.per_file = True
    return run


#: Plain text: UTF-8 without its bad bytes.
PLAIN = per_file(_plain, "plain_text")


def default_registry() -> dict[str, Extractor]:
    """Extractors by exact MIME or ``type/*``; ``*`` is the fallback."""
    return {
        "text/html": per_file(_html, "html_text"),
        "application/json": per_file(_json_text, "plain_text"),
        "text/csv": per_file(_csv_text, "plain_text"),
        "application/xml": PLAIN,
        "text/*": PLAIN,
        "*": PLAIN,
    }


def _by_class(registry: dict[str, Extractor]) -> Extractor:
    """One extractor for the classes of ``registry`` (column _class), whose extractors take each file on its own."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part in batch.groupby("_class", sort=False):
                yield from registry[name](iter([part[["file_id", "content"]]]))

    return run


def extract(files: DataFrame, registry: dict[str, Extractor] | None = None) -> DataFrame:
    """Text of each file by its MIME class; files no extractor takes come back with an error.

    Reads file_id, mime and content; no shuffle. Valid UTF-8 of a plain class is text as it stands and never leaves the
    JVM. The other files are read by Python in one pass, but for extractors that are not ``per_file``, which have one each.
    """
    registry = default_registry() if registry is None else registry
    mime = F.coalesce(F.col("mime"), F.lit(""))
    exact = [m for m in registry if m != "*" and not m.endswith("/*")]
    families = [m for m in registry if m.endswith("/*")]
    choice = F.when(mime.isin(*exact), mime) if exact else F.when(F.lit(False), mime)
    for family in families:
        choice = choice.when(mime.startswith(family[:-1]), F.lit(family))
    choice = choice.otherwise(F.lit("*" if "*" in registry else ""))
    slim = files.select("file_id", "mime", "content", choice.alias("_class"))
    as_is = F.coalesce(F.col("content"), F.lit(b"")).cast("string")
    plain = F.col("_class").isin([name for name, run in registry.items() if run is PLAIN])
    native = plain & F.is_valid_utf8(as_is)
    none = F.lit(None).cast("string")
    taken = F.when(native, as_is).alias("text"), none.alias("title"), F.when(native, "plain_text").alias("method")
    refused = F.when(~native, F.concat(F.lit("ExtractionError: no extractor for "), mime)).alias("error")
    out = slim.filter(native | (F.col("_class") == "")).select("file_id", *taken, refused)
    rest = slim.filter(~native)
    each = {name: run for name, run in registry.items() if getattr(run, "per_file", False)}
    if each:
        read = rest.filter(F.col("_class").isin(list(each))).select("file_id", "_class", "content")
        out = out.unionByName(read.mapInPandas(_by_class(each), EXTRACTED))
    for name, run in registry.items():
        if name not in each:
            part = rest.filter(F.col("_class") == name).select("file_id", "content")
            out = out.unionByName(part.mapInPandas(run, EXTRACTED))
    return out


def extract_text(files: DataFrame) -> DataFrame:
    """Plain-text family: UTF-8 dropping bad bytes, JSON indented, CSV cells trimmed."""
    return extract(files, {k: v for k, v in default_registry().items() if k != "text/html"})


def extract_html(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds the title and visible text of each page."""

    @F.pandas_udf("struct<text:string, title:string>")
    def visible(markup: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([html_to_text(m or "") for m in markup], columns=["text", "title"])

    return pages.withColumn("_page", visible.asNondeterministic()(html_col)).select(
        "*", F.col("_page.text").alias("text"), F.col("_page.title").alias("title")
    ).drop("_page")
