"""Column functions over text. All run inside the JVM except NFC composition."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marker patterns.
BULLET = r"^\s*([*•●○▪‣–-]|\d+[.)])[\s\u200b]+"
PAGE_MARKER = r"(?iU)^---\s*Page\s+(\d+)\s*---$"
MD_HEADING = r"^(#{1,6})\s+(.*)$"
PAGE_LINE = r"(?imdU)^[^\S\n]*page \d+(?:[^\S\n]*of[^\S\n]*\d+)?[^\S\n]*$"
REASONING_TAGS = ("think", "analysis", "reasoning", "thoughts", "scratchpad", "plan", "reflection")
HISTORY_PREFIXES = (
    "User Query:\n",
    "Follow-up Query:\n",
    "Follow-up Query:",
    "Query:\n",
    "Query:",
    "Documents:\n",
    "Context:\n",
)
PROMPT_SECTIONS = ("Long-Term Memory", "Documents", "Context")

# What counts as blank at the ends of a string.
BLANKS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)

BLANK = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: A character that may be a blank other than a space, or one of a few others: without any a text needs no closer look.
ODD = r"[^\x20-\x7E\xA1-\x{167F}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{2060}-\x{2FFF}\x{3001}-\x{10FFFF}]"
EMPTY_STRINGS = "array<string>"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def lstrip(col: Column) -> Column:
    return F.ltrim(col, F.lit(BLANKS))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(BLANKS))


def strip_newlines(col: Column) -> Column:
    return F.btrim(col, F.lit("\n"))


def collapse_ws(col: Column) -> Column:
    """Every run of blanks as one space; single spaces are not touched, so plain prose costs one look for anything else."""
    def one(text: Column) -> Column:
        found = F.contains(text, F.lit("  ")) | text.rlike(ODD)
        return F.when(found, F.regexp_replace(text, f"{BLANK}{BLANK}+|[{BLANK}&&[^ ]]", " ")).otherwise(text)

    return F.transform(F.array(col), one)[0]


def is_blank(col: Column) -> Column:
    return F.coalesce(strip(col), F.lit("")) == ""


def left(col: Column, n: Column | int) -> Column:
    length = F.lit(n) if isinstance(n, int) else n
    return F.substr(col, F.lit(1), length)


def right(col: Column, n: Column | int) -> Column:
    length = F.lit(n) if isinstance(n, int) else n
    return F.substr(col, F.greatest(F.length(col) - length + 1, F.lit(1)), length)


def quote_literal(col: Column) -> Column:
    """A Java regex that matches the text of col literally."""
    return F.concat(F.lit("\\Q"), F.replace(col, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def approx_tokens(col: Column) -> Column:
    text = F.coalesce(col, F.lit(""))
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.when(text == "", F.lit(0)).otherwise(F.greatest(F.lit(1), quarter))


def words(col: Column) -> Column:
    return F.filter(F.split(F.coalesce(col, F.lit("")), BLANK + "+"), lambda w: w != "")


def word_count(col: Column) -> Column:
    return F.size(words(col))


def approx_tokens_words(col: Column) -> Column:
    return F.floor(word_count(col) * F.lit(1.3)).cast("int")


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@cache
def _unsettled() -> str:
    """A pattern of the characters that NFC may replace, reorder or join to the one before: without any of them a text is
    composed already. All lie above U+02FF, which is looked at first."""
    found = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # Hangul vowels and finals join by rule
    for code in range(0x300, sys.maxunicode + 1):
        char = chr(code)
        parts = unicodedata.decomposition(char)
        if unicodedata.combining(char) or (parts and unicodedata.normalize("NFC", char) != char):
            found.add(code)
        elif parts and parts[0] != "<":
            found.add(int(parts.split()[-1], 16))
    found = sorted(c for c in found if c > 0x2FF)
    starts = [c for c, before in zip(found, [None, *found]) if before != c - 1]
    ends = [c for c, after in zip(found, [*found[1:], None]) if after != c + 1]
    return r"(?=[^\x00-\x{2FF}])[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in zip(starts, ends)) + "]"


def compose_nfc(col: Column) -> Column:
    """Only rows that hold a character NFC may change carry their value through Python."""
    needs = col.rlike(_unsettled())
    return F.coalesce(_nfc.asNondeterministic()(F.when(needs, col)), col)


def normalize_text(col: Column, nfc: bool = True) -> Column:
    text = F.coalesce(col, F.lit(""))
    if nfc:
        text = compose_nfc(text)
    # each step runs only where its mark occurs: most texts skip most of the patterns
    text = _where(text, F.contains(text, F.lit("\r")), r"\r\n?", "\n")
    return strip(_tidy(text))


def _where(text: Column, found: Column, pattern: str, replacement: str) -> Column:
    return F.when(found, F.regexp_replace(text, pattern, replacement)).otherwise(text)


def _tidy(whole: Column) -> Column:
    """Joined words, page lines, line ends and blank lines, step by step on a one-element array."""
    steps = (
        lambda t: _where(t, F.contains(t, F.lit("-\n")), r"(?U)(\w)-\n(\w+)", "$1$2"),
        lambda t: _where(t, t.rlike(r"(?i)page [0-9\P{ASCII}]"), PAGE_LINE, ""),
        lambda t: _where(t, t.rlike(r"(?U)\n(?<=[^\S\n]\n)"), r"(?mdU)[^\S\n]+$", ""),
        lambda t: _where(t, F.contains(t, F.lit("\n\n\n")), r"\n{3,}", "\n\n"),
    )
    out = F.array(whole)
    for step in steps:
        out = F.transform(out, step)
    return out[0]


def segments(col: Column) -> Column:
    parts = F.filter(F.transform(F.split(col, "\n\n"), strip), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).when(strip(col) != "", F.array(strip(col))).otherwise(
        F.array().cast(EMPTY_STRINGS)
    )


def content_lines(lines: Column) -> Column:
    return F.filter(lines, lambda s: strip(s) != "")


def looks_like_list(lines: Column) -> Column:
    return _mostly_bullets(content_lines(lines))


def _mostly_bullets(content: Column) -> Column:
    hits = F.size(F.filter(content, lambda s: s.rlike(BULLET)))
    need = F.greatest(F.lit(2), F.floor(F.size(content) * F.lit(0.6)).cast("int"))
    return (F.size(content) >= 2) & (hits >= need)


def strip_bullet(line: Column) -> Column:
    text = strip(line)
    bare = strip(F.regexp_replace(text, BULLET, ""))
    return F.when(bare == "", text).otherwise(bare)


def list_items(lines: Column) -> Column:
    return F.transform(content_lines(lines), strip_bullet)


def split_fixed(col: Column, size: int = 1200, overlap: int = 120) -> Column:
    """Pieces of 4*size characters, each 4*overlap characters back from the last one's end."""
    width = max(1, size) * 4
    back = max(0, overlap) * 4
    back = min(back, width - 1)
    step = width - back
    length = F.length(col)
    count = F.greatest(F.lit(1), (F.ceil((length - width) / step) + 1).cast("int"))
    pieces = F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: strip(F.substr(col, i * step + 1, F.lit(width)))
    )
    return F.filter(pieces, lambda p: p != "")


def chunk_id(file_id: Column, seq: Column, text: Column) -> Column:
    return F.concat(F.lit("chunk_"), F.sha2(F.concat_ws(":", file_id, seq.cast("string"), text), 256))


def snippet(text: Column, start: Column, end: Column, radius: int = 42) -> Column:
    lo = F.greatest(start - radius, F.lit(0))
    hi = F.least(F.length(text), end + radius)
    body = strip(collapse_ws(F.substr(text, lo + 1, hi - lo)))
    return F.concat(
        F.when(lo > 0, F.lit("…")).otherwise(F.lit("")),
        body,
        F.when(hi < F.length(text), F.lit("…")).otherwise(F.lit("")),
    )


def replace_literal(col: Column, needle: Column, replacement: Column, case_sensitive: bool = False) -> Column:
    """Replace every occurrence of the trimmed needle; a blank needle changes nothing."""
    target = strip(needle)
    if case_sensitive:
        done = F.replace(col, target, replacement)
    else:
        pattern = F.concat(F.lit("(?iu)"), quote_literal(target))
        safe = F.regexp_replace(replacement, r"([\\$])", r"\\$1")
        done = F.regexp_replace(col, pattern, safe)
    return F.when(F.coalesce(target, F.lit("")) == "", col).otherwise(done)


def title(col: Column, limit: int = 48) -> Column:
    first = strip(F.element_at(F.split(strip(col), "\n"), 1))
    cut = F.concat(left(first, limit), F.when(F.length(first) > limit, "...").otherwise(""))
    return F.when(first == "", F.lit(None).cast("string")).otherwise(cut)


def preview(col: Column, limit: int = 200) -> Column:
    text = strip(F.coalesce(col, F.lit("")))
    cut = left(text, limit)
    at_space = F.regexp_extract(cut, r"(?s)^(.+) ", 1)
    short = F.when(at_space == "", cut).otherwise(at_space)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(short, F.lit("...")))


def log_preview(col: Column, limit: int = 200) -> Column:
    if limit <= 0:
        return F.lit("")
    return F.when(F.length(col) <= limit, col).otherwise(F.concat(left(col, limit), F.lit("…")))


def head_tokens(col: Column, tokens: Column | int) -> Column:
    n = F.lit(tokens) if isinstance(tokens, int) else tokens
    return F.when(n > 0, left(F.coalesce(col, F.lit("")), n * 4)).otherwise(F.lit(""))


def tail_tokens(col: Column, tokens: Column | int) -> Column:
    n = F.lit(tokens) if isinstance(tokens, int) else tokens
    return F.when(n > 0, right(F.coalesce(col, F.lit("")), n * 4)).otherwise(F.lit(""))


def strip_reasoning(col: Column) -> Column:
    names = "|".join(REASONING_TAGS)
    return F.regexp_replace(col, rf"(?is)<(?:{names})>.*?(?:</(?:{names})>|\z)|</(?:{names})>", "")


def strip_history_prefix(col: Column) -> Column:
    alternatives = "|".join(p.replace("\n", "\\n") for p in HISTORY_PREFIXES)
    return F.regexp_replace(col, rf"(?U)\A(?:{alternatives})\s*", "")


def is_scaffold_message(col: Column) -> Column:
    return strip(col).rlike(r"\A(?:Documents|Context):")


def strip_section(col: Column, heading: str) -> Column:
    names = "|".join(PROMPT_SECTIONS)
    pattern = rf"(?s)(?:\n\n|\A)\Q{heading}\E:\n.*?(?=\n\n(?:{names}):\n|\z)"
    return F.when(col == "", col).otherwise(strip(F.regexp_replace(col, pattern, "")))


def query_only(col: Column) -> Column:
    names = "|".join(PROMPT_SECTIONS)
    pattern = rf"(?s)\A(User Query|Follow-up Query):\n(.*?)(?:\n\n(?:{names}):\n|\z)"
    label = F.regexp_extract(col, pattern, 1)
    body = strip(F.regexp_extract(col, pattern, 2))
    found = strip(F.concat(label, F.lit(":\n"), body))
    return F.when(label == "", strip(col)).otherwise(found)


def extractive_summary(col: Column, sentences: int = 3, limit: int = 600) -> Column:
    """Leading sentences while at most three fit in the limit; else the first limit characters."""
    text = F.coalesce(col, F.lit(""))
    parts = F.slice(F.split(strip(text), r"(?U)(?<=[.!?])\s+"), 1, sentences)
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("n"), F.lit(False).alias("stop"))

    def take(state: Column, sentence: Column) -> Column:
        over = state["stop"] | (F.length(state["done"]) + 1 + F.length(sentence) > limit)
        joined = F.when(state["n"] == 0, sentence).otherwise(F.concat(state["done"], F.lit(" "), sentence))
        return F.struct(
            F.when(over, state["done"]).otherwise(joined).alias("done"),
            F.when(over, state["n"]).otherwise(state["n"] + 1).alias("n"),
            over.alias("stop"),
        )

    summary = strip(F.aggregate(parts, start, take, lambda s: s["done"]))
    return F.when(summary == "", left(text, limit)).otherwise(summary)


def sanitize_memory(col: Column, limit: int = 1200) -> Column:
    text = F.array(strip(collapse_ws(F.coalesce(col, F.lit("")))))  # a one-element array: collapsed once, whatever reads it
    return F.transform(text, lambda t: F.when(F.length(t) > limit, rstrip(left(t, limit))).otherwise(t))[0]


def memory_key(col: Column) -> Column:
    return F.sha2(F.lower(col), 256)


def ordered_distinct(col: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(col, strip), lambda s: s != ""))


def substring_count(haystack: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a non-empty needle."""
    removed = F.length(haystack) - F.length(F.replace(haystack, needle, F.lit("")))
    return (removed / F.length(needle)).cast("int")


def safe_name(col: Column, limit: int | None = None) -> Column:
    """Printable file name on one line; "Document" when nothing is left."""
    name = F.regexp_replace(strip(F.coalesce(col, F.lit(""))), r"[\p{C}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]", "")
    if limit:
        name = F.when(F.length(name) > limit, F.concat(left(name, limit - 3), F.lit("..."))).otherwise(name)
    return F.when(name == "", F.lit("Document")).otherwise(name)


def blocks_from_text(col: Column) -> Column:
    """Typed blocks of normalised text: page marker, heading, list or paragraph.

    Each step is its own transform, so nothing is worked out twice for a paragraph.
    """

    def split(raw: Column) -> Column:
        lines = F.split(strip_newlines(raw), "\n")
        return F.struct(strip(raw).alias("bare"), F.size(lines).alias("n"), content_lines(lines).alias("content"))

    def classify(p: Column) -> Column:
        bare = p["bare"]
        page = F.when(bare.startswith("---"), F.regexp_extract(bare, PAGE_MARKER, 1)).otherwise(F.lit(""))
        marks = F.when((p["n"] == 1) & bare.startswith("#"), F.regexp_extract(bare, MD_HEADING, 1)).otherwise(F.lit(""))
        kind = (
            F.when(page != "", "page_break").when(marks != "", "heading")
            .when(_mostly_bullets(p["content"]), "list").otherwise("paragraph")
        )
        return F.struct(kind.alias("kind"), bare.alias("bare"), p["content"].alias("content"), page.alias("page"), marks.alias("marks"))

    def itemise(p: Column) -> Column:
        items = F.when(p["kind"] == "list", F.transform(p["content"], strip_bullet))
        return F.struct(
            p["kind"].alias("kind"), p["bare"].alias("bare"), p["content"].alias("content"), p["page"].alias("page"),
            p["marks"].alias("marks"), items.alias("items"),
        )

    def finish(p: Column) -> Column:
        kind = p["kind"]
        flat = strip(collapse_ws(F.array_join(F.transform(p["content"], strip), " ")))
        text = (
            F.when(kind == "page_break", F.concat(F.lit("Page "), p["page"].try_cast("int").cast("string")))
            .when(kind == "heading", strip(F.regexp_extract(p["bare"], MD_HEADING, 2)))
            .when(kind == "list", F.array_join(p["items"], "\n"))
            .otherwise(flat)
        )
        meta = F.struct(
            F.when(kind == "page_break", p["page"].try_cast("int")).alias("page"),
            F.when(kind == "heading", F.length(p["marks"])).cast("int").alias("level"),
            p["items"].alias("items"),
            F.lit(None).cast("boolean").alias("ocr"),
            F.lit(None).cast("string").alias("source"),
        )
        return F.struct(kind.alias("kind"), text.alias("text"), meta.alias("metadata"))

    paras = F.filter(F.split(F.coalesce(col, F.lit("")), "\n\n"), lambda p: strip(p) != "")
    out = paras
    for step in (split, classify, itemise, finish):
        out = F.transform(out, step)
    return out


def render_block(kind: Column, text: Column, level: Column, items: Column) -> Column:
    """Markdown-like text of one block, as it is stored in a chunk."""
    raw = strip(F.coalesce(text, F.lit("")))
    depth = F.least(F.greatest(F.coalesce(level, F.lit(2)), F.lit(1)), F.lit(6))
    given = F.when(F.size(F.coalesce(items, F.array().cast(EMPTY_STRINGS))) > 0, items).otherwise(F.split(raw, "\n"))
    bullets = F.transform(
        F.filter(F.transform(given, strip), lambda s: s != ""), lambda s: F.concat(F.lit("- "), s)
    )
    fenced = F.when(raw == "", "").otherwise(F.concat(F.lit("```\n"), raw, F.lit("\n```")))
    name = F.lower(strip(kind))
    return (
        F.when(name == "heading", strip(F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), raw)))
        .when(name == "list", F.array_join(bullets, "\n"))
        .when(name == "code", fenced)
        .otherwise(raw)
    )


def blocks_to_text(blocks: Column) -> Column:
    def one(block: Column) -> Column:
        items = F.filter(F.transform(block["metadata"]["items"], strip), lambda s: s != "")
        listed = (F.lower(block["kind"]) == "list") & (F.size(F.coalesce(items, F.array().cast(EMPTY_STRINGS))) > 0)
        return F.when(listed, F.array_join(items, "\n")).otherwise(strip(F.coalesce(block["text"], F.lit(""))))

    return strip(F.array_join(F.filter(F.transform(blocks, one), lambda s: s != ""), "\n\n"))
