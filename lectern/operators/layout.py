"""Positioned text blocks of pages: furniture, reading order, headings, lists.

Span rows: doc_id, page, block, x0, y0, x1, y1, page_width, page_height, lines ARRAY<STRING>, max_size,
median_size, bold_ratio. A page holds a bounded number of blocks, so windows run over (doc_id, page).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import BULLET, list_items, looks_like_list, strip, strip_bullet, words

PAGE = ["doc_id", "page"]
PAGE_NUMBER = r"^(?:(?:page\s*)?\d+(?:\s*/\s*\d+)?|(?:page\s*)?[ivxlcdm]+)$"
HEADING_NUMBER = r"(?i)^(\d+(?:\.\d+){0,6}|[IVXLCDM]{1,8})[.)]?\s+"
MAX_SPLITS = 3
HEADING_SCORE = 3.5
TITLE_TOP, TITLE_MIN_KEY = 250.0, 14


def _joined(lines: Column) -> Column:
    return strip(F.array_join(F.filter(F.transform(lines, strip), lambda s: s != ""), " "))


def drop_page_furniture(spans: DataFrame) -> DataFrame:
    """Drop short page-number blocks in the top or bottom 6 % unless the page would be left empty."""
    text = _joined(F.col("lines"))
    edge = (F.col("y1") <= F.col("page_height") * 0.06) | (F.col("y0") >= F.col("page_height") * 0.94)
    noise = (F.col("page_height") > 0) & edge & (text != "") & (F.length(text) <= 60) & F.lower(text).rlike(PAGE_NUMBER)
    marked = spans.withColumn("_noise", noise)
    kept = F.max((~F.col("_noise")).cast("int")).over(W.partitionBy(*PAGE))
    return marked.withColumn("_kept", kept).filter("not _noise or _kept = 0").drop("_noise", "_kept")


def reading_order(spans: DataFrame) -> DataFrame:
    """Adds reading_pos: wide blocks at the top first, then column by column, down and across."""
    rows = drop_page_furniture(spans)
    narrow = F.when(F.col("x1") - F.col("x0") <= F.col("page_width") * 0.8, F.col("x0"))
    page = W.partitionBy(*PAGE)
    xs = F.sort_array(F.collect_list(narrow).over(page))
    gap = F.greatest(F.lit(24.0), F.col("page_width") * 0.18)
    pairs = F.arrays_zip(F.slice("_xs", 1, F.greatest(F.size("_xs") - 1, F.lit(0))).alias("a"), F.slice("_xs", 2, F.greatest(F.size("_xs") - 1, F.lit(0))).alias("b"))
    wide = F.filter(pairs, lambda p: p["b"] - p["a"] > F.col("_gap"))
    mids = F.slice(F.sort_array(F.array_distinct(F.transform(wide, lambda p: (p["a"] + p["b"]) / 2.0))), 1, MAX_SPLITS)
    rows = rows.withColumn("_xs", xs).withColumn("_gap", gap).withColumn("_cuts", F.when(F.col("page_width") > 0, mids).otherwise(F.array().cast("array<double>")))
    column = F.size(F.filter("_cuts", lambda c: F.col("x0") > c))
    rows = rows.withColumn("column_no", column)
    columns = F.size(F.collect_set("column_no").over(page))
    top = (F.col("x1") - F.col("x0") >= F.col("page_width") * 0.75) & (F.col("y1") <= F.col("page_height") * 0.18)
    spanner = (columns > 1) & (F.col("page_height") > 0) & top
    rows = rows.withColumn("_group", F.when(spanner, -1).otherwise(F.col("column_no")))
    order = W.partitionBy(*PAGE).orderBy("_group", "y0", "x0", "block")
    return rows.withColumn("reading_pos", F.row_number().over(order)).drop("_xs", "_gap", "_cuts", "_group")


def block_gaps(ordered: DataFrame) -> DataFrame:
    order = W.partitionBy(*PAGE).orderBy("reading_pos")
    before = F.greatest(F.lit(0.0), F.col("y0") - F.coalesce(F.lag("y1").over(order), F.col("y0")))
    after = F.greatest(F.lit(0.0), F.coalesce(F.lead("y0").over(order), F.col("y1")) - F.col("y1"))
    return ordered.withColumn("gap_before", before).withColumn("gap_after", after)


def _title_key(col: Column) -> Column:
    return F.regexp_replace(F.lower(strip(F.coalesce(col, F.lit("")))), "[^a-z0-9]+", "")


def match_outline(ordered: DataFrame, outline: DataFrame) -> DataFrame:
    """Adds outline_level: level of the longest outline title of the page that fits the first line.

    ``outline``: doc_id, page, level, title. Equal keys fit; keys of 14 or more also by prefix.
    """
    titles = outline.select(*PAGE, F.col("level").alias("_level"), _title_key(F.col("title")).alias("_title")).filter("_title <> ''")
    line = _title_key(F.try_element_at("lines", F.lit(1)))
    rows = ordered.withColumn("_line", line)
    prefix = (F.length("_title") >= TITLE_MIN_KEY) & (
        F.col("_line").startswith(F.col("_title")) | F.col("_title").startswith(F.col("_line"))
    )
    fits = rows.filter((F.col("y0") <= TITLE_TOP) & (F.col("_line") != "")).select(*PAGE, "block", "_line").join(titles, PAGE).filter(
        (F.col("_line") == F.col("_title")) | prefix
    )
    best = fits.groupBy(*PAGE, "block").agg(F.max_by("_level", F.length("_title")).alias("outline_level"))
    return rows.drop("_line").join(best, [*PAGE, "block"], "left")


def score_headings(ordered: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """Adds heading_score and heading_level (null for body text)."""
    rows = block_gaps(ordered)
    text = _joined(F.col("lines"))
    number = F.regexp_extract(text, HEADING_NUMBER, 1)
    numbered = text.rlike(HEADING_NUMBER)
    delta = F.col("max_size") - F.col("median_size")
    line = F.greatest(F.lit(8.0), F.col("median_size") * 1.2)
    upper = (F.upper(text) == text) & (F.lower(text) != text)
    score = (
        F.when(delta >= 6, 3.0).when(delta >= 4, 2.0).when(delta >= 2, 1.0).when(delta >= 1, 0.5).otherwise(0.0)
        + F.when(F.col("bold_ratio") >= 0.8, 2.0).when(F.col("bold_ratio") >= 0.5, 1.5).when(F.col("bold_ratio") >= 0.3, 1.0).otherwise(0.0)
        + F.when(F.col("gap_before") >= line * 2.0, 2.0).when(F.col("gap_before") >= line * 1.2, 1.0).otherwise(0.0)
        + F.when(F.col("gap_after") >= line * 1.2, 0.5).otherwise(0.0)
        + F.when(F.col("y0") <= 110, 0.5).otherwise(0.0)
        + F.when(upper, 0.5).otherwise(0.0)
        + F.when(numbered, 0.5).otherwise(0.0)
    )
    possible = (
        (F.size("lines") >= 1) & (F.size("lines") <= 2) & (text != "") & (F.length(text) <= 160)
        & (F.size(words(text)) <= 18) & ~text.rlike(r"[.?!]\z")
    )
    by_size = F.when(delta >= 8, 1).when(delta >= 5, 2).when(delta >= 3, 3).otherwise(4)
    depth = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    by_number = F.greatest(F.lit(2), F.least(F.lit(6), 2 + depth))
    scored = F.when(possible & (F.col("heading_score") >= HEADING_SCORE), F.when(numbered, by_number).otherwise(by_size))
    rows = rows.withColumn("heading_score", F.when(possible, score).otherwise(0.0)).withColumn("heading_level", scored)
    if outline is not None:
        rows = match_outline(rows, outline)
        # greatest passes over nulls: a block that no title fits keeps its own level
        toc = F.when(F.col("outline_level").isNotNull(), F.least(F.greatest(F.col("outline_level"), F.lit(1)), F.lit(6)))
        rows = rows.withColumn("heading_level", F.coalesce(toc, F.col("heading_level"))).drop("outline_level")
    return rows


def is_preformatted(lines: Column) -> Column:
    marked = F.size(F.filter(lines, lambda s: F.contains(s, F.lit("\t")) | F.contains(s, F.lit("|")) | s.rlike(r"\s{2,}")))
    return (F.size(lines) >= 2) & (marked >= F.greatest(F.lit(2), F.floor(F.size(lines) * F.lit(0.5)).cast("int")))


def classify_layout_blocks(scored: DataFrame) -> DataFrame:
    """Blocks of each page in order; runs of list blocks and single bullets become one list.

    Reads the output of score_headings.
    """
    single = (F.size("lines") == 1) & F.col("lines")[0].rlike(BULLET)
    listed = looks_like_list(F.col("lines")) | single
    kind = (
        F.when(listed, "list").when(F.col("heading_level").isNotNull(), "heading")
        .when(is_preformatted(F.col("lines")), "code").otherwise("paragraph")
    )
    items = F.when(single, F.array(strip_bullet(F.col("lines")[0]))).otherwise(list_items(F.col("lines")))
    rows = scored.withColumn("kind", kind).withColumn("_items", items)
    order = W.partitionBy(*PAGE).orderBy("reading_pos")
    opens = (F.col("kind") != "list") | ~F.lag("kind").over(order).eqNullSafe(F.lit("list"))
    rows = rows.withColumn("_run", F.sum(opens.cast("int")).over(order))
    body = F.when(F.col("kind") == "code", F.array_join("lines", "\n")).otherwise(_joined(F.col("lines")))
    entries = F.sort_array(F.collect_list(F.struct("reading_pos", "_items")))
    grouped = rows.withColumn("_body", body).groupBy(*PAGE, "_run").agg(
        F.first("kind").alias("kind"), F.min("reading_pos").alias("reading_pos"), F.max("heading_level").alias("level"),
        F.flatten(F.transform(entries, lambda e: e["_items"])).alias("_all"), F.min_by("_body", "reading_pos").alias("_text"),
    )
    is_list = F.col("kind") == "list"
    return grouped.select(
        *PAGE, "reading_pos", "kind", F.when(F.col("kind") == "heading", F.col("level")).alias("level"),
        F.when(is_list, F.array_join("_all", "\n")).otherwise(F.col("_text")).alias("text"),
        F.when(is_list, F.col("_all")).alias("items"),
    )
