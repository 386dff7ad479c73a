"""Lookup columns: MIME types, languages, error codes, statuses, budgets."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import strip

# Lookup tables. The standard library's table of suffixes, without what the machine's own files add,
# and the suffixes that it lacks or names otherwise.
MIME_BY_SUFFIX = mimetypes.MimeTypes(filenames=()).types_map[True] | {
    ".log": "text/plain",
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".csv": "text/csv",
    ".tsv": "text/tab-separated-values",
    ".json": "application/json",
    ".xml": "application/xml",
    ".yaml": "application/yaml",
    ".yml": "application/yaml",
    ".html": "text/html",
    ".htm": "text/html",
    ".py": "text/x-python",
    ".js": "text/javascript",
    ".css": "text/css",
    ".pdf": "application/pdf",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".gif": "image/gif",
    ".mp3": "audio/mpeg",
    ".wav": "audio/x-wav",
    ".zip": "application/zip",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}
TEXT_SUFFIXES = (".txt", ".log", ".md", ".json", ".csv", ".tsv", ".yaml", ".yml")
UNKNOWN_MIME = "application/octet-stream"

LANGUAGE_BY_SUFFIX = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "tsx",
    ".rs": "rust",
    ".go": "go",
    ".java": "java",
    ".kt": "kotlin",
    ".c": "c",
    ".h": "c",
    ".hpp": "cpp",
    ".cc": "cpp",
    ".cpp": "cpp",
    ".cs": "c_sharp",
    ".rb": "ruby",
    ".php": "php",
    ".swift": "swift",
}
LANGUAGE_BY_MIME = {
    "text/x-python": "python",
    "text/x-python-script": "python",
    "text/x-java-source": "java",
    "text/x-c": "c",
    "text/x-c++": "cpp",
    "text/x-csharp": "c_sharp",
    "text/x-rust": "rust",
    "text/x-go": "go",
    "text/x-javascript": "javascript",
    "application/javascript": "javascript",
    "text/typescript": "typescript",
    "application/typescript": "typescript",
}
ERROR_BY_EXCEPTION = {
    "DeadlineExceeded": "EMBEDDING_TIMEOUT",
    "RateLimitError": "RATE_LIMIT",
    "IndexWriteError": "INDEX_WRITE_FAIL",
    "ExtractionError": "EXTRACTION_FAILED",
    "CorruptFileError": "CORRUPT_FILE",
}
UNKNOWN_ERROR = "UNKNOWN"
TRANSIENT_ERRORS = ("EMBEDDING_TIMEOUT", "RATE_LIMIT", "INDEX_WRITE_FAIL")
STATUS_PREFIX = "FileIngestionStatus."

INGEST_BYTES = 10 * 1024 * 1024
ABSOLUTE_BYTES = 50 * 1024 * 1024
LARGE_SUFFIXES = (".txt", ".log", ".json", ".pdf")

RESERVE_OUTPUT = 0.10
CONTEXT_MARGIN = 0.02
MAX_INPUT = 0.65
SMALL_DOC = 0.90
DEPTH_DEFAULT, DEPTH_SELECTION, DEPTH_SUMMARY, DEPTH_ALL = 12, 6, 16, 14
DETAIL = {1: (3, 0), 2: (5, 0), 3: (7, 1), 4: (9, 1), 5: (12, 2)}
WINDOW_TOKENS = 220
MAX_DEPTH = 64


def lookup(col: Column, table: dict[str, str]) -> Column:
    entries = [F.lit(v) for pair in table.items() for v in pair]
    return F.try_element_at(F.create_map(*entries), col)


def suffix(name: Column) -> Column:
    """Last extension of the base name; dot files have none."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(base, r"[^.](\.[^.]+)$", 1))


def mime_by_suffix(name: Column) -> Column:
    return F.coalesce(lookup(suffix(name), MIME_BY_SUFFIX), F.lit(UNKNOWN_MIME))


def has_text_suffix(name: Column) -> Column:
    return suffix(name).isin(*TEXT_SUFFIXES)


def code_language(name: Column, mime: Column) -> Column:
    return F.coalesce(lookup(suffix(name), LANGUAGE_BY_SUFFIX), lookup(mime, LANGUAGE_BY_MIME))


def error_code(exception_name: Column) -> Column:
    return F.coalesce(lookup(exception_name, ERROR_BY_EXCEPTION), F.lit(UNKNOWN_ERROR))


def normalize_status(col: Column) -> Column:
    pattern = "^" + STATUS_PREFIX.replace(".", "\\.")
    return F.when(col.startswith(STATUS_PREFIX), F.lower(F.regexp_replace(col, pattern, ""))).otherwise(col)


def _part(col: Column, share: float) -> Column:
    return F.floor(col * F.lit(share)).cast("bigint")


def reserved_output(capacity: Column) -> Column:
    return _part(capacity, RESERVE_OUTPUT)


def context_margin(capacity: Column) -> Column:
    return _part(capacity, CONTEXT_MARGIN)


def available_input(capacity: Column, used: Column) -> Column:
    free = capacity - used - reserved_output(capacity) - context_margin(capacity)
    return F.greatest(free.cast("bigint"), F.lit(0).cast("bigint"))


def input_budget(capacity: Column, used: Column) -> Column:
    return _part(available_input(capacity, used), MAX_INPUT)


def retrieval_depth(budget: Column, files: Column, base: Column) -> Column:
    count = F.greatest(files, F.lit(1))
    total = F.greatest(F.floor(budget / WINDOW_TOKENS), F.lit(1))
    per_file = F.greatest(F.floor(total / count), F.lit(1))
    scaled = F.greatest(base, F.least(F.greatest(base, per_file * 2), F.lit(MAX_DEPTH)))
    return F.when(budget <= 0, base).otherwise(scaled).cast("int")


def base_depth(summary: Column, selection: Column) -> Column:
    return F.when(summary, DEPTH_SUMMARY).when(selection, DEPTH_SELECTION).otherwise(DEPTH_DEFAULT)


def window_radius(budget: Column) -> Column:
    return F.when(budget >= 8000, 3).otherwise(2)


def detail_depth(level: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for key, (depth, _) in DETAIL.items():
        out = out.when(level == key, depth)
    return out


def detail_radius(level: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for key, (_, radius) in DETAIL.items():
        out = out.when(level == key, radius)
    return out


def file_cap(total_budget: Column, files: Column) -> Column:
    share = F.floor(F.greatest(total_budget, F.lit(200)) / F.greatest(files, F.lit(1)))
    return F.greatest(F.lit(600), share).cast("int")


def clean_name(col: Column) -> Column:
    return F.coalesce(F.nullif(strip(col), F.lit("")), F.lit("Document"))
