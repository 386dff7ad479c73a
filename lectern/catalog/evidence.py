"""Queries over windows, evidence lists, packs, citations and the end-to-end question job."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.catalog.base import Tables, query, strip_sql, tokens_sql, with_views


from lectern.operators import evidence as E
from lectern.operators import keyword, windows
from lectern.operators.embedding import embed
from lectern.operators.joins import enrich_chunks
from lectern.plans import answers, jobs
from lectern.session import settle

NL = "chr(10)"


@query("slice_cited_evidence", with_views("chunks files", f"""
WITH n AS (SELECT chunk_id, file_id, lower(text) AS body FROM chunks),
q AS (SELECT item_id AS query_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_-]{{1,80}}'), lambda x: lower(x))[1:8] AS terms FROM benchmark),
s AS (SELECT query_id, chunk_id, file_id, list_sum(list_transform(terms, lambda w: (length(body) - length(replace(body, w, ''))) // length(w))) AS c FROM q, n),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, chunk_id) AS r FROM s WHERE c > 0),
a AS (SELECT k.query_id, k.file_id, k.r, c.seq FROM k JOIN chunks c USING (chunk_id) WHERE r <= 5),
w AS (SELECT query_id, a.file_id, a.seq, min(r) AS r, string_agg({strip_sql('c.text')}, {NL} || {NL} ORDER BY c.seq) AS text, min(page_start) AS page_start, max(page_end) AS page_end
  FROM a JOIN chunks c ON c.file_id = a.file_id AND c.seq BETWEEN greatest(a.seq - 2, 0) AND a.seq + 2 GROUP BY ALL),
p AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY query_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM w),
t AS (SELECT * FROM p WHERE used < 2400),
d AS (SELECT query_id, file_id, min(r) AS r, list_sort(list_distinct(flatten(list(range(page_start, page_end + 1))))) AS pages FROM t GROUP BY ALL),
f AS (SELECT d.*, filename, count(*) OVER (PARTITION BY query_id, filename) AS same, row_number() OVER (PARTITION BY query_id, filename ORDER BY r) AS nth FROM d JOIN files USING (file_id))
SELECT query_id, CAST(r AS INTEGER) AS cite_pos, CASE WHEN same > 1 THEN filename || ' (' || nth || ')' ELSE filename END AS filename, array_to_string(pages, ',') AS pages FROM f"""))
def cited_evidence(t: Tables):
    """Keyword hits, widened to windows of two chunks each side, cut to 600 tokens, cited by page."""
    hits = keyword.keyword_scan_topk(t.questions, t.chunks, 5)
    placed = enrich_chunks(hits.select("query_id", "chunk_id", "rank"), t.chunks.select("chunk_id", "file_id", "seq"), t.files)
    spans = windows.seq_windows(placed.withColumnRenamed("rank", "pos"), t.chunks, 2, ["query_id", "pos"])
    named = spans.join(t.files.select("file_id", "filename"), "file_id").select(
        "query_id", "pos", F.col("file_id").alias("doc_id"), "text", "filename", F.lit(None).cast("int").alias("page"), "page_start", "page_end")
    cut = E.budget_trim(settle(named, "windows"), t.questions.select("query_id", F.lit(600).alias("budget")))
    cited = E.citations(cut)
    pages = F.flatten(F.transform("page_ranges", lambda r: F.sequence(r[0], r[1])))
    return cited.select("query_id", "cite_pos", "filename", F.array_join(pages.cast("array<string>"), ",").alias("pages"))


@query("w1_merge_ranges", """
WITH r AS (SELECT DISTINCT event_type AS k, CAST(floor(epoch(ts) / 60) AS BIGINT) AS s, CAST(floor(epoch(ts) / 60) AS BIGINT) + CAST(floor(value / 4) AS BIGINT) AS e FROM events),
p AS (SELECT k, s, e, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r),
i AS (SELECT k, s, e, sum(CASE WHEN m IS NULL OR s > m + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM p)
SELECT k, min(s) AS start, max(e) AS "end" FROM i GROUP BY k, g""")
def merge_ranges(t: Tables):
    """Busy minutes per event type: each event keeps its type busy for a while."""
    minute = F.floor(F.unix_micros("ts") / 60000000)
    rows = t.read("events").select(F.col("event_type").alias("k"), minute.alias("start"), (minute + F.floor(F.col("value") / 4)).alias("end"))
    return windows.merge_ranges(rows, ["k"], span=1440)


@query("w2_seq_windows", with_views("hits", f"""
WITH a AS (SELECT DISTINCT query_id, file_id, greatest(seq - 2, 0) AS seq_start, seq + 2 AS seq_end FROM hits)
SELECT query_id, a.file_id, seq_start, seq_end, coalesce(string_agg({strip_sql('c.text')}, {NL} || {NL} ORDER BY c.seq) FILTER ({strip_sql('c.text')} <> ''), '') AS text, min(page_start) AS page_start, max(page_end) AS page_end
FROM a JOIN chunks c ON c.file_id = a.file_id AND c.seq BETWEEN seq_start AND seq_end GROUP BY ALL"""))
def seq_windows(t: Tables):
    return windows.seq_windows(t.hits, t.chunks, 2)


@query("w3_diverse_anchors")
def diverse_anchors(t: Tables):
    return windows.diverse_anchors(t.hits, 1)


def _spans(t: Tables):
    return windows.budgeted_windows(t.hits.withColumn("cap", F.lit(600)), t.chunks, 2, "cap")


@query("w4_budgeted_windows")
def budgeted_windows(t: Tables):
    return _spans(t)


CUT_SQL = f"{NL} || '… (truncated)'"


@query("w6_compare_windows", with_views("chunks", f"""
WITH b AS (SELECT file_id, min(seq) AS lo, max(seq) AS hi, max(seq) - min(seq) + 1 AS n FROM chunks GROUP BY file_id),
c AS (SELECT c.file_id, lo, hi, n, CAST(ceil(n / 3.0) AS INTEGER) AS seg, c.seq, {strip_sql('text')} AS t, page_start, page_end FROM chunks c JOIN b USING (file_id)),
l AS (SELECT file_id, (seq - lo) // seg AS part, lo, hi, seg, string_agg(t, {NL} || {NL} ORDER BY seq) FILTER (t <> '') AS x, min(page_start) AS page_start, max(page_end) AS page_end FROM c WHERE n >= 3 GROUP BY ALL),
m AS (SELECT *, length(x) AS total, 800 AS m FROM l WHERE x IS NOT NULL),
w AS (SELECT file_id, CAST(lo + part * seg AS INTEGER) AS seq_start, CAST(least(hi, lo + part * seg + seg - 1) AS INTEGER) AS seq_end, CASE WHEN total <= m THEN x
  WHEN part = 0 THEN regexp_replace(substr(x, 1, 800), '\\s+$', '') || {CUT_SQL} WHEN part >= 2 THEN regexp_replace(right(x, 800), '^\\s+', '') || {CUT_SQL}
  ELSE {strip_sql('substr(x, CAST(greatest(0, total // 2 - 400) + 1 AS BIGINT), 800)')} || {CUT_SQL} END AS text, page_start, page_end FROM m),
s AS (SELECT file_id, lo, string_agg(t, {NL} || {NL} ORDER BY seq) FILTER (t <> '') AS x, min(page_start) AS page_start, max(page_end) AS page_end FROM c WHERE n < 3 GROUP BY ALL),
v AS (SELECT *, length(x) AS total FROM s WHERE x IS NOT NULL),
d AS (SELECT *, CASE WHEN total <= 800 THEN [0] ELSE [0, greatest(0, total // 2 - 400), total - 800] END AS st0 FROM v),
e AS (SELECT *, list_filter(st0, lambda z, i: list_position(st0, z) = i) AS st FROM d),
u AS (SELECT file_id, lo, x, total, page_start, page_end, unnest(st) AS f, unnest(range(0, len(st))) AS i FROM e)
SELECT file_id, seq_start, seq_end, text, page_start, page_end FROM w
UNION ALL SELECT file_id, CAST(lo + i AS INTEGER), CAST(lo + i AS INTEGER), {strip_sql('substr(x, CAST(f + 1 AS BIGINT), 800)')} || CASE WHEN f + 800 < total THEN {CUT_SQL} ELSE '' END, page_start, page_end FROM u""".replace("\\\\s", "\\s")))
def compare_windows(t: Tables):
    q = t.docs.select(F.concat(F.lit("chat_"), "source").alias("query_id"), "file_id", F.lit(600).alias("cap"))
    return windows.compare_windows(q, t.chunks).drop("query_id")


@query("w7_windows_to_hits", with_views("hits", """
WITH a AS (SELECT DISTINCT query_id, file_id, greatest(seq - 2, 0) AS s, seq + 2 AS e FROM hits),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_id ORDER BY s, e) - 1 AS i FROM a)
SELECT query_id, n.file_id AS doc_id, 'seq_window:' || s || '-' || e || ':' || i AS chunk_id, filename, 1.0::DOUBLE AS score FROM n JOIN files USING (file_id)"""))
def windows_to_hits(t: Tables):
    spans = windows.seq_windows(t.hits, t.chunks, 2)
    return windows.windows_to_hits(spans, t.files).select("query_id", "doc_id", "chunk_id", "filename", "score")


def _listed(t: Tables):
    """Hits twice over: chunk ids missing on the second pass for half of them."""
    again = t.hits.withColumn("pos", F.col("pos") + 1000).withColumn("chunk_id", F.when(F.col("seq") % 2 == 0, F.col("chunk_id")))
    return t.hits.unionByName(again)


@query("w8_dedup_hits", with_views("hits", """
WITH l AS (SELECT query_id, pos, doc_id, chunk_id, text FROM hits UNION ALL SELECT query_id, pos + 1000, doc_id, CASE WHEN seq % 2 = 0 THEN chunk_id END, text FROM hits),
k AS (SELECT query_id, pos, row_number() OVER (PARTITION BY query_id, doc_id, CASE WHEN chunk_id IS NOT NULL THEN 'c' || chunk_id ELSE 't' || text END ORDER BY pos) AS n FROM l)
SELECT query_id, pos FROM k WHERE n = 1"""))
def dedup_hits(t: Tables):
    return E.dedup_hits(_listed(t)).select("query_id", "pos")


@query("w9_round_robin", with_views("hits", """
WITH o AS (SELECT query_id, pos, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY pos) AS turn, min(pos) OVER (PARTITION BY query_id, doc_id) AS first FROM hits),
r AS (SELECT query_id, pos, CAST(row_number() OVER (PARTITION BY query_id ORDER BY turn, first) AS INTEGER) AS mix_pos FROM o)
SELECT * FROM r WHERE mix_pos <= 14"""))
def round_robin(t: Tables):
    return E.round_robin(t.hits, 14).select("query_id", "pos", "mix_pos")


@query("w10_budget_trim", with_views("hits", """
WITH p AS (SELECT query_id, pos, text, coalesce(sum(length(text)) OVER (PARTITION BY query_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM hits WHERE trim(text) <> '')
SELECT query_id, pos, substr(text, 1, CAST(2000 - used AS BIGINT)) AS text FROM p WHERE used < 2000"""))
def budget_trim(t: Tables):
    return E.budget_trim(t.hits, t.questions.select("query_id", F.lit(500).alias("budget"))).select("query_id", "pos", "text")


@query("w10_budget_balanced", with_views("hits", """
WITH fo AS (SELECT query_id, doc_id, min(pos) AS fp FROM hits GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fp) AS n, count(*) OVER (PARTITION BY query_id) AS c FROM fo),
li AS (SELECT query_id, doc_id, n AS file_pos FROM rk WHERE n < c OR c = 1), nf AS (SELECT query_id, count(*) AS files FROM li GROUP BY query_id),
h AS (SELECT hits.query_id, hits.doc_id, pos, text, file_pos, files, CASE WHEN files < 2 THEN 2000 ELSE greatest(256, 2000 // files) END AS room FROM hits JOIN nf USING (query_id) LEFT JOIN li ON li.query_id = hits.query_id AND li.doc_id = hits.doc_id WHERE trim(text) <> ''),
one AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY query_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM h WHERE files < 2),
own AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY query_id, doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM h WHERE files >= 2 AND file_pos IS NOT NULL),
kept AS (SELECT query_id, pos, substr(text, 1, CAST(room - used AS BIGINT)) AS text FROM own WHERE used < room),
spent AS (SELECT query_id, sum(length(text)) AS s FROM kept GROUP BY query_id),
st AS (SELECT h.*, greatest(0, 2000 - coalesce(s, 0)) AS rest, coalesce(sum(length(text)) OVER (PARTITION BY h.query_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM h LEFT JOIN spent USING (query_id) WHERE files >= 2 AND file_pos IS NULL)
SELECT query_id, pos, text FROM kept UNION ALL SELECT query_id, pos, substr(text, 1, CAST(rest - used AS BIGINT)) FROM st WHERE used < rest
UNION ALL SELECT query_id, pos, substr(text, 1, CAST(2000 - used AS BIGINT)) FROM one WHERE used < 2000"""))
def budget_balanced(t: Tables):
    """All files of a query but its last count as listed."""
    from pyspark.sql import Window as W

    first = t.hits.groupBy("query_id", "doc_id").agg(F.min("pos").alias("fp"))
    ranked = first.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("fp"))).withColumn("c", F.count("*").over(W.partitionBy("query_id")))
    listed = ranked.filter("n < c or c = 1").select("query_id", "doc_id", F.col("n").cast("bigint").alias("file_pos"))
    out = E.budget_trim_balanced(t.hits, t.questions.select("query_id", F.lit(500).alias("budget")), listed)
    return out.select("query_id", "pos", "text")


@query("w11_coverage_fill", with_views("chunks", """
WITH a AS (SELECT file_id, greatest(1, CAST(floor(avg(length(text)) / 4) AS BIGINT)) AS avg_t FROM chunks WHERE seq < 5 GROUP BY file_id),
s AS (SELECT file_id, count(*) AS total FROM chunks GROUP BY file_id),
n AS (SELECT s.file_id, least(total, greatest(1, 400 // avg_t)) - 3 AS need FROM s JOIN a USING (file_id)),
u AS (SELECT c.file_id, c.chunk_id, c.seq, row_number() OVER (PARTITION BY c.file_id ORDER BY c.seq) AS r FROM chunks c WHERE NOT (seq BETWEEN 1 AND 3) AND trim(text) <> '')
SELECT 'q' AS query_id, u.file_id AS doc_id, chunk_id, seq FROM u JOIN n USING (file_id) WHERE r <= need"""))
def coverage_fill(t: Tables):
    """Every file already shows its chunks 1 to 3 and has 400 tokens."""
    q = t.docs.select(F.lit("q").alias("query_id"), "file_id", F.lit(400).alias("budget"))
    shown = q.select("query_id", "file_id", F.lit(1).alias("seq_start"), F.lit(3).alias("seq_end"))
    return windows.coverage_fill(q, shown, t.chunks).select("query_id", "doc_id", "chunk_id", "seq")


@query("j13_uncovered_chunks", with_views("chunks hits", "SELECT c.chunk_id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.file_id = c.file_id AND c.seq BETWEEN h.seq - 1 AND h.seq + 1)"))
def uncovered_chunks(t: Tables):
    seqs = t.hits.select("file_id", F.explode(F.sequence(F.col("seq") - 1, F.col("seq") + 1)).alias("seq")).distinct()
    return t.chunks.join(seqs, ["file_id", "seq"], "left_anti").select("chunk_id")


@query("w15_citations", with_views("hits", """
WITH p AS (SELECT query_id, doc_id, min(pos) AS cite_pos, any_value(filename) AS filename, list_sort(list_distinct(list(page_start))) AS pages FROM hits GROUP BY ALL),
n AS (SELECT *, count(*) OVER (PARTITION BY query_id, filename) AS same, row_number() OVER (PARTITION BY query_id, filename ORDER BY cite_pos) AS nth FROM p)
SELECT query_id, cite_pos, CASE WHEN same > 1 THEN filename || ' (' || nth || ')' ELSE filename END AS filename, array_to_string(pages, ',') AS pages FROM n"""))
def citations(t: Tables):
    out = E.citations(t.hits)
    pages = F.flatten(F.transform("page_ranges", lambda r: F.sequence(r[0], r[1])))
    return out.select("query_id", "cite_pos", "filename", F.array_join(pages.cast("array<string>"), ",").alias("pages"))


@query("w16_context_pack")
def context_pack(t: Tables):
    none = F.lit(None).cast("string")
    q = t.questions.select(
        "query_id", F.lit("Answer the user's request using the provided document evidence.").alias("task"), "text", none.alias("selection_text"),
        none.alias("selection_name"), F.lit(None).cast("int").alias("selection_page"), none.alias("focus_name"), none.alias("pack"), none.alias("pack_name"),
    )
    cut = E.budget_trim(t.hits, t.questions.select("query_id", F.lit(500).alias("budget")))
    memory = t.questions.select("query_id", "text", F.lit(1).alias("rank"))
    scope = t.hits.select("query_id", F.col("pos").alias("file_pos"), "filename")
    return E.context_pack(q, cut, memory, scope)


@query("w17_answerable", with_views("hits", """
WITH q AS (SELECT item_id AS query_id, CASE WHEN length(text) < 200 THEN 'rag' WHEN length(text) < 230 THEN 'small_doc' ELSE 'chat' END AS route FROM benchmark),
h AS (SELECT query_id, count(*) AS hits FROM hits WHERE score > 0.4 GROUP BY query_id)
SELECT query_id, coalesce(hits, 0) AS hits, NOT (route <> 'chat' AND coalesce(hits, 0) = 0) AS answerable,
  CASE WHEN route <> 'chat' AND coalesce(hits, 0) = 0 THEN 'Not found in provided documents.' END AS reply FROM q LEFT JOIN h USING (query_id)"""))
def answerable(t: Tables):
    n = F.length("text")
    q = t.questions.select("query_id", F.when(n < 200, "rag").when(n < 230, "small_doc").otherwise("chat").alias("route"),
                           F.lit(False).alias("has_selection"), F.lit(False).alias("has_small_doc"))
    return E.answerable(q, t.hits.filter("score > 0.4")).select("query_id", "hits", "answerable", "reply")


@query("w24_evidence_mix", with_views("hits", f"SELECT query_id, filename, count(*) AS hits, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum({tokens_sql('text')}) AS BIGINT) AS tokens FROM hits GROUP BY ALL"))
def evidence_mix(t: Tables):
    return E.evidence_mix(t.hits)


@query("g14_cited_names", with_views("hits", """
WITH f AS (SELECT query_id AS message_id, filename, min(pos) AS p FROM hits GROUP BY ALL) SELECT message_id, string_agg(filename, '|' ORDER BY p, filename) AS names FROM f GROUP BY message_id"""))
def cited_names(t: Tables):
    cited = t.hits.select(F.col("query_id").alias("message_id"), "pos", "filename", "file_id")
    return E.cited_names(cited).select("message_id", F.array_join("names", "|").alias("names"))


def turns(t: Tables):
    """The user's messages as turns over the documents of one source, with a selection in the first turn."""
    links = t.documents.select("source").distinct()
    n = F.col("conv_id")
    rows = t.asks.filter("role = 'user'").withColumn("_src", F.concat(F.lit("src"), (n % 20).cast("string")))
    return rows.join(links, rows["_src"] == links["source"]).select(
        "query_id", F.concat(F.lit("chat_"), "source").alias("chat_id"), F.col("ask").alias("text"), F.array().cast("array<string>").alias("turn_doc_ids"),
        F.lit(None).cast("string").alias("focus_document_id"), F.lit(None).cast("boolean").alias("doc_pane_open"),
        F.lit(None).cast("string").alias("selection_file_id"), F.lit(None).cast("string").alias("selection_text"),
        F.lit(32768).cast("bigint").alias("capacity"), (F.length("ask") * 3).cast("bigint").alias("used"),
    )


def _index(t: Tables):
    return embed(t.chunks.select("file_id", "chunk_id", "text")).drop("text")


def _retrieved(t: Tables):
    files = t.files.withColumn("policy", F.lit("ingest"))
    return jobs.retrieve(turns(t), t.chat_files, files, t.chunks, _index(t))


@query("d2_retrieve")
def retrieve(t: Tables):
    _, hits = _retrieved(t)
    return hits.select("query_id", "pos", "doc_id", "chunk_id", F.length("text").alias("n_chars"), "score", "restored")


@query("d3_compare")
def compare(t: Tables):
    pos = F.col("doc_id")
    q = t.docs.select(F.concat(F.lit("chat_"), "source").alias("query_id"), "file_id", F.lit(600).alias("cap"), pos.alias("file_pos"))
    budgets = q.groupBy("query_id").agg((F.count("*") * 600).alias("budget"))
    return jobs.compare(q, t.chunks, t.files, budgets).select("query_id", "doc_id", "chunk_id", F.length("text").alias("n_chars"))


def _routed(t: Tables):
    """Turns of every route, by conversation: with their own document attached, with a selection in the first turn, in a chat of
    one large file (each document once more under a name of its own), and as they are."""
    n, own = F.col("query_id"), F.concat(F.lit("file_"), F.split("query_id", "_")[0])
    kind = F.split(n, "_")[0].cast("long") % 4
    none = F.lit(None).cast("string")
    asked = turns(t).withColumn("_kind", kind)
    asked = asked.withColumns({
        "turn_doc_ids": F.when(F.col("_kind") == 1, F.array(own)).otherwise(F.col("turn_doc_ids")),
        "selection_text": F.when(F.col("_kind") == 2, F.col("text")).otherwise(none),
        "selection_file_id": F.when(F.col("_kind") == 2, own).otherwise(none),
        "chat_id": F.when(F.col("_kind") == 3, F.concat(F.lit("raw_"), own)).otherwise(F.col("chat_id")),
        "selection_page": F.when(F.col("_kind") == 2, 1),
    }).drop("_kind")
    copies = t.files.select(F.concat(F.lit("raw_"), F.col("file_id")).alias("file_id"), "filename", F.lit("raw_large").alias("policy"))
    files = t.files.select("file_id", "filename", F.lit("ingest").alias("policy")).unionByName(copies)
    links = t.chat_files.unionByName(copies.select(F.col("file_id").alias("chat_id"), "file_id", F.lit(0).cast("bigint").alias("linked_ord")))
    return asked, links, files


@query("d5_answer_packs")
def answer_packs(t: Tables):
    asked, links, files = _routed(t)
    texts = t.docs.select("file_id", F.col("text").alias("plain_text"))
    raw = t.docs.select(F.concat(F.lit("raw_"), F.col("file_id")).alias("file_id"), "text")
    store = asked.select("chat_id", F.concat(F.lit("s_"), "query_id").alias("memory_id"), "text", F.col("used").alias("created_at"))
    made = answers.answer(asked, links, files, t.chunks, _index(t), texts, raw, store)
    cites = made.citations.groupBy("query_id").agg(F.count("*").alias("citations"))
    return made.packs.join(cites, "query_id", "left").select(
        "query_id", "route", F.length("pack_text").alias("n_chars"), "hits", "answerable", F.coalesce("citations", F.lit(0)).alias("citations"))


@query("d9_selection_hits")
def selection_hits(t: Tables):
    """Every question selects its own text, over the ten files of the indexed documents."""
    picked = t.asked.select("query_id", F.lit(True).alias("has_selection"), F.col("text").alias("selection_text"), F.lit(6).alias("base_depth"))
    files = t.indexed.agg(F.sort_array(F.collect_set("file_id")).alias("f")).scalar()
    pairs = picked.select("query_id", files.alias("_files")).select("query_id", F.explode("_files").alias("file_id"))
    chunks = t.indexed.select("chunk_id", "file_id", "text", F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))
    index = embed(t.indexed.select("file_id", "chunk_id", "text")).drop("text")
    names = t.indexed.select("file_id", F.concat("file_id", F.lit(".txt")).alias("filename")).distinct()
    return jobs.selection_hits(picked, pairs, chunks, index, names).select("query_id", "doc_id", "chunk_id", "rank")


