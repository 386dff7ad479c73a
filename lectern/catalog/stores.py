"""Queries over files written from the given tables, and over positioned blocks made from their lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.catalog.base import Tables, query, strip_sql, with_views, words_sql
from lectern.operators import layout
from lectern.session import settle, shared_dir
from lectern.sources import files, logs, tables


def _written(df: DataFrame, name: str, *by: str) -> str:
    """Rows of one string as a folder of text files where every executor reaches them."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*by) if by else df.write
    writer.text(path)
    return path


@query("s1_scan_files", "SELECT source, CAST(sum(strlen(text) + 1) AS BIGINT) AS size_bytes, true AS whole, true AS named FROM documents GROUP BY source")
def scan_files(t: Tables):
    """Every document lies in a text file of its source's folder; marker files beside them have another suffix."""
    found = files.scan_files(t.spark, _written(t.documents.select("source", "text"), "scan", "source"), "*.txt")
    rows = found.withColumn("source", F.regexp_extract("path", "/source=([^/]+)/", 1))
    whole = (F.col("size_bytes") == F.octet_length("content")) & F.col("modified_at").isNotNull()
    named = F.col("filename").rlike("^part-.*[.]txt$") & F.endswith("path", F.concat(F.lit("/"), F.col("filename")))
    return rows.groupBy("source").agg(F.sum("size_bytes").alias("size_bytes"), F.bool_and(whole).alias("whole"), F.bool_and(named).alias("named"))


@query("s7_read_jsonl", "SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, md5(text) AS text_md5 FROM conversations")
def read_jsonl(t: Tables):
    """Turns as JSON lines with blank lines between them."""
    turns = t.read("conversations")
    line = F.concat(F.when(F.col("turn") % 2 == 0, F.lit("  \n")).otherwise(F.lit("")), F.to_json(F.struct("conv_id", "turn", "role", "text")), F.lit(" "))
    rows = logs.read_jsonl(t.spark, _written(turns.select(line.alias("value")), "turns"), "conv_id bigint, turn bigint, role string, text string")
    return rows.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("s8_read_request_log", """
SELECT CAST(event_id AS VARCHAR) AS id, event_type AS endpoint, CAST(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS INTEGER) AS status,
  CAST(user_id AS BIGINT) AS latency_ms FROM events WHERE event_type NOT IN ('view', 'click')""")
def read_request_log(t: Tables):
    """The log of requests in which views are cut off and clicks have a status that is no number: both are skipped."""
    event = t.requests
    entry = F.to_json(F.struct(F.col("id").cast("string").alias("id"), "endpoint", "status", F.col("worker").alias("latency_ms")))
    line = F.when(F.col("endpoint") == "view", F.substring(entry, 1, 20)).when(F.col("endpoint") == "click", F.replace(entry, F.lit(":200"), F.lit(':"odd"'))).otherwise(entry)
    return logs.read_request_log(t.spark, _written(event.select(line.alias("value")), "requests")).select("id", "endpoint", "status", "latency_ms")


@query("s13_write_report", """
SELECT true AS ok, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, array_to_string(list_sort(list_distinct(list(lang))), ' ') AS langs FROM documents""")
def write_report(t: Tables):
    """A report written as JSON, as a reader of the file sees it."""
    report = t.documents.agg(
        F.lit(True).alias("ok"), F.struct(F.count("*").alias("documents"), F.sum("n_chars").alias("chars")).alias("report"),
        F.sort_array(F.collect_set("lang")).alias("threshold_failures"))
    path = f"{shared_dir(t.spark).rstrip('/')}/report-{uuid.uuid4().hex}"
    tables.write_report(report, path)
    read = t.spark.read.schema("ok boolean, report struct<documents: bigint, chars: bigint>, threshold_failures array<string>").json(path)
    return read.select("ok", "report.*", F.array_join("threshold_failures", " ").alias("langs"))


def _spans(t: Tables) -> DataFrame:
    """Twelve lines a page as two columns of blocks, with page numbers, bullets, tables and headings among them."""
    n, line = F.col("line_no") - 1, F.col("line")
    at, kind = n % 12, (n * 7 + F.col("doc_id")) % 8
    wide = kind == 3
    lines = (
        F.when(kind == 0, F.array(F.concat(F.lit("Page "), F.col("line_no").cast("string")))).when(kind.isin(1, 7), F.array(F.concat(F.lit("- "), F.substring(line, 1, 20))))
        .when(kind == 2, F.array(F.concat(F.substring(line, 1, 30), F.lit(" | x")), F.lit("a | b"))).when(wide, F.array(F.substring(line, 1, 24)))
        .when(kind == 4, F.array(F.concat(F.lit("2.1 "), F.substring(line, 1, 30)))).when(kind == 5, F.array(line, F.substring(line, 1, 10))).otherwise(F.array(line)))
    x0 = F.when(wide, 40.0).when(kind == 0, 290.0).when(n % 2 == 0, 40.0).otherwise(320.0)
    y0 = F.when(kind == 0, 770.0).otherwise(40.0 + at * 55.0)
    return t.lines.select(
        "doc_id", (1 + F.floor(n / 12)).cast("int").alias("page"), at.cast("int").alias("block"), x0.alias("x0"), y0.alias("y0"),
        F.when(wide, 560.0).when(kind == 0, 310.0).otherwise(x0 + 240.0).alias("x1"), (y0 + 10.0 + F.length(line) % 30).alias("y1"),
        F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"), lines.alias("lines"),
        F.when(wide, 18.0).when(kind == 4, 12.0).otherwise(10.0).alias("max_size"), F.lit(10.0).alias("median_size"),
        F.when(wide | (kind == 4), 1.0).otherwise(0.0).alias("bold_ratio"))


SPANS = """sp0 AS (SELECT doc_id, line_no, line, (line_no - 1) % 12 AS nth, ((line_no - 1) * 7 + doc_id) % 8 AS k FROM lines),
sp AS (SELECT doc_id, CAST(1 + (line_no - 1) // 12 AS INTEGER) AS page, CAST(nth AS INTEGER) AS block, k,
  CASE WHEN k = 3 THEN 40.0 WHEN k = 0 THEN 290.0 WHEN line_no % 2 = 1 THEN 40.0 ELSE 320.0 END::DOUBLE AS x0, CASE WHEN k = 0 THEN 770 ELSE 40 + nth * 55 END::DOUBLE AS y0,
  CASE WHEN k = 3 THEN 560.0 WHEN k = 0 THEN 310.0 WHEN line_no % 2 = 1 THEN 280.0 ELSE 560.0 END::DOUBLE AS x1, (CASE WHEN k = 0 THEN 770 ELSE 40 + nth * 55 END + 10 + length(line) % 30)::DOUBLE AS y1,
  CASE k WHEN 0 THEN ['Page ' || line_no] WHEN 1 THEN ['- ' || substr(line, 1, 20)] WHEN 7 THEN ['- ' || substr(line, 1, 20)] WHEN 2 THEN [substr(line, 1, 30) || ' | x', 'a | b'] WHEN 3 THEN [substr(line, 1, 24)]
    WHEN 4 THEN ['2.1 ' || substr(line, 1, 30)] WHEN 5 THEN [line, substr(line, 1, 10)] ELSE [line] END AS ls,
  CASE k WHEN 3 THEN 18 WHEN 4 THEN 12 ELSE 10 END - 10 AS delta, CASE WHEN k IN (3, 4) THEN 1.0 ELSE 0.0 END AS bold FROM sp0),
tx AS (SELECT *, """ + strip_sql(f"array_to_string(list_filter(list_transform(ls, lambda s: {strip_sql('s')}), lambda s: s <> ''), ' ')") + r""" AS text FROM sp),
nz AS (SELECT *, (y1 <= 48 OR y0 >= 752) AND text <> '' AND length(text) <= 60 AND regexp_matches(lower(text), '^(?:(?:page\s*)?\d+(?:\s*/\s*\d+)?|(?:page\s*)?[ivxlcdm]+)$') AS noise FROM tx),
kp AS (SELECT * FROM (SELECT *, bool_or(NOT noise) OVER (PARTITION BY doc_id, page) AS "real" FROM nz) WHERE NOT noise OR NOT "real")"""
ORDER = f"""{SPANS},
xs AS (SELECT doc_id, page, list_sort(list(x0) FILTER (x1 - x0 <= 480)) AS xs FROM kp GROUP BY ALL),
ct AS (SELECT doc_id, page, list_sort(list_distinct(list_transform(list_filter(range(1, len(xs)), lambda i: xs[i + 1] - xs[i] > 108), lambda i: (xs[i] + xs[i + 1]) / 2.0)))[1:3] AS cuts FROM xs),
co AS (SELECT kp.*, coalesce(len(list_filter(cuts, lambda c: x0 > c)), 0) AS column_no FROM kp JOIN ct USING (doc_id, page)),
cn AS (SELECT doc_id, page, count(DISTINCT column_no) AS columns FROM co GROUP BY ALL),
ro AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN columns > 1 AND x1 - x0 >= 450 AND y1 <= 144 THEN -1 ELSE column_no END, y0, x0, block) AS INTEGER) AS reading_pos
  FROM co JOIN cn USING (doc_id, page))"""
HEADINGS = rf"""{ORDER},
gp AS (SELECT *, greatest(0, y0 - coalesce(lag(y1) OVER w, y0)) AS gap_before, greatest(0, coalesce(lead(y0) OVER w, y1) - y1) AS gap_after FROM ro WINDOW w AS (PARTITION BY doc_id, page ORDER BY reading_pos)),
nu AS (SELECT *, regexp_extract(text, '(?i)^(\d+(?:\.\d+){{0,6}}|[IVXLCDM]{{1,8}})[.)]?\s+', 1) AS number FROM gp),
hs AS (SELECT *, CASE WHEN len(ls) BETWEEN 1 AND 2 AND text <> '' AND length(text) <= 160 AND len({words_sql('text')}) <= 18 AND NOT regexp_matches(text, '[.?!]$') THEN
  (CASE WHEN delta >= 6 THEN 3.0 WHEN delta >= 4 THEN 2.0 WHEN delta >= 2 THEN 1.0 WHEN delta >= 1 THEN 0.5 ELSE 0.0 END
  + CASE WHEN bold >= 0.8 THEN 2.0 ELSE 0.0 END + CASE WHEN gap_before >= 24 THEN 2.0 WHEN gap_before >= 14.4 THEN 1.0 ELSE 0.0 END
  + CASE WHEN gap_after >= 14.4 THEN 0.5 ELSE 0.0 END + CASE WHEN y0 <= 110 THEN 0.5 ELSE 0.0 END
  + CASE WHEN upper(text) = text AND lower(text) <> text THEN 0.5 ELSE 0.0 END + CASE WHEN number <> '' THEN 0.5 ELSE 0.0 END) ELSE 0.0 END::DOUBLE AS heading_score FROM nu),
hd AS (SELECT *, CASE WHEN heading_score >= 3.5 THEN CASE WHEN number <> '' THEN greatest(2, least(6, 2 + length(number) - length(replace(number, '.', ''))))
  WHEN delta >= 8 THEN 1 WHEN delta >= 5 THEN 2 WHEN delta >= 3 THEN 3 ELSE 4 END END AS heading_level FROM hs)"""
BULLET = r"^\s*([*•●○▪‣–-]|\d+[.)])[\s\x{200b}]+"


@query("t29_page_furniture", with_views("lines", f"WITH {SPANS} SELECT doc_id, page, block FROM kp"))
def page_furniture(t: Tables):
    return layout.drop_page_furniture(_spans(t)).select("doc_id", "page", "block")


@query("t30_reading_order", with_views("lines", f"WITH {ORDER} SELECT doc_id, page, block, CAST(column_no AS INTEGER) AS column_no, reading_pos FROM ro"))
def reading_order(t: Tables):
    return layout.reading_order(_spans(t)).select("doc_id", "page", "block", "column_no", "reading_pos")


@query("t31_score_headings", with_views("lines", f"""WITH {HEADINGS}, o AS (SELECT doc_id, page, 5 AS lv FROM sp WHERE block = 0 AND doc_id % 3 = 0)
SELECT doc_id, page, block, heading_score, CAST(CASE WHEN doc_id % 3 = 0 AND block = 0 AND y0 <= 250 AND length(regexp_replace(lower({strip_sql('ls[1]')}), '[^a-z0-9]+', '', 'g')) > 0 THEN 5 ELSE heading_level END AS INTEGER) AS heading_level FROM hd
WHERE block = 0 OR NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = hd.doc_id AND o.page = hd.page)"""))
def score_headings(t: Tables):
    """Every third document has an outline that names the first block of each page at level 5; there only it is compared."""
    spans = _spans(t)
    outline = spans.filter("block = 0 and doc_id % 3 = 0").select("doc_id", "page", F.lit(5).alias("level"), F.col("lines")[0].alias("title"))
    out = layout.score_headings(settle(layout.reading_order(spans), "ordered"), outline)
    return out.filter("block = 0 or doc_id % 3 <> 0").select("doc_id", "page", "block", "heading_score", "heading_level")


@query("t32_layout_blocks", with_views("lines", rf"""WITH {HEADINGS},
li AS (SELECT *, list_filter(ls, lambda s: {strip_sql('s')} <> '') AS cl FROM hd),
lk AS (SELECT *, (len(ls) = 1 AND regexp_matches(ls[1], '{BULLET}')) OR
  (len(cl) >= 2 AND len(list_filter(cl, lambda s: regexp_matches(s, '{BULLET}'))) >= greatest(2, CAST(floor(len(cl) * 0.6::DOUBLE) AS INTEGER))) AS listed FROM li),
kd AS (SELECT *, CASE WHEN listed THEN 'list' WHEN heading_level IS NOT NULL THEN 'heading'
  WHEN len(ls) >= 2 AND len(list_filter(ls, lambda s: contains(s, chr(9)) OR contains(s, '|') OR regexp_matches(s, '\s{{2,}}'))) >= greatest(2, len(ls) // 2) THEN 'code' ELSE 'paragraph' END AS kind,
  list_transform(CASE WHEN len(ls) = 1 THEN ls ELSE cl END, lambda s: CASE WHEN {strip_sql(f"regexp_replace({strip_sql('s')}, '{BULLET}', '')")} = '' THEN {strip_sql('s')}
    ELSE {strip_sql(f"regexp_replace({strip_sql('s')}, '{BULLET}', '')")} END) AS items FROM lk),
op AS (SELECT *, kind <> 'list' OR lag(kind) OVER (PARTITION BY doc_id, page ORDER BY reading_pos) IS DISTINCT FROM 'list' AS opens FROM kd),
rn AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY doc_id, page ORDER BY reading_pos ROWS UNBOUNDED PRECEDING) AS run FROM op)
SELECT doc_id, page, CAST(min(reading_pos) AS INTEGER) AS reading_pos, any_value(kind) AS kind, CASE WHEN any_value(kind) = 'heading' THEN CAST(max(heading_level) AS INTEGER) END AS level,
  CASE any_value(kind) WHEN 'list' THEN array_to_string(flatten(list(items ORDER BY reading_pos)), chr(10)) WHEN 'code' THEN array_to_string(arg_min(ls, reading_pos), chr(10)) ELSE arg_min(text, reading_pos) END AS text
FROM rn GROUP BY doc_id, page, run"""))
def layout_blocks(t: Tables):
    scored = layout.score_headings(settle(layout.reading_order(_spans(t)), "ordered"))
    return layout.classify_layout_blocks(scored).select("doc_id", "page", "reading_pos", "kind", "level", "text")
