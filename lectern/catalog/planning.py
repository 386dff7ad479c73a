"""Queries over questions, scopes, upload rules, readiness and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.catalog.base import Tables, ordered_distinct_sql, query, strip_sql, with_views
from lectern.functions import codes, questions
from lectern.functions.questions import (
    ANCHORS, CHITCHAT, CHITCHAT_PATTERN, COMPARE_EXACT, DEICTIC, DEICTIC_VERBS, EXPLAIN_PARTS, EXTRACT_PARTS, GENERIC, GOALS,
    GOAL_DEFAULT, LOOKUP_PARTS, RELEVANCE_STOP, SCAN_STOP, SUMMARY_EXACT, SUMMARY_PARTS, TASK_CHAT, TASK_DEFAULT, TASK_GENERIC, TASKS,
)
from lectern.operators import filters as P
from lectern.operators import ranking

NL = "chr(10)"


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_quote(v) for v in values) + ")"


def _any(col: str, parts) -> str:
    return "(" + " OR ".join(f"contains({col}, {_quote(p)})" for p in parts) + ")"


ANALYSED = rf"""
n AS (SELECT query_id, conv_id, ask, lower({strip_sql('ask')}) AS q, {strip_sql(r"regexp_replace(lower(ask), '\s+', ' ', 'g')")} AS c FROM asks),
f AS (SELECT *, c = '' OR c IN {_in(CHITCHAT)} OR regexp_matches(c, '{CHITCHAT_PATTERN}') AS chitchat,
  q IN {_in(SUMMARY_EXACT)} OR {_any('q', SUMMARY_PARTS)} AS summary,
  regexp_replace(c, '^[.!?;:]+|[.!?;:]+$', '', 'g') AS d FROM n),
g AS (SELECT *, d IN {_in(COMPARE_EXACT)} OR (starts_with(d, 'compare ') AND len(string_split(d, ' ')) <= 3) AS compare,
  q <> '' AND ({_any('q', ANCHORS)} OR (regexp_matches(q, '{DEICTIC}') AND {_any('q', DEICTIC_VERBS)})) AS anchored FROM f),
i AS (SELECT *, CASE WHEN chitchat THEN 'chat' WHEN compare THEN 'compare' WHEN summary THEN 'summarize'
  WHEN {_any('q', EXTRACT_PARTS)} THEN 'extract' WHEN {_any('q', EXPLAIN_PARTS)} THEN 'explain'
  WHEN {_any('q', LOOKUP_PARTS)} THEN 'lookup' ELSE 'chat' END AS intent FROM g),
a AS (SELECT *, c = '' OR c IN {_in(GENERIC)} OR (intent IN ('summarize', 'explain') AND len(regexp_extract_all(c, '[a-z0-9'']+')) <= 2) AS generic FROM i)
"""


@query("p8_classify_intent", with_views("asks", f"WITH {ANALYSED} SELECT query_id, intent FROM a"))
def intent(t: Tables):
    return t.asks.select("query_id", questions.intent(F.col("ask")).alias("intent"))


@query("p9_query_flags", with_views("asks", f"WITH {ANALYSED} SELECT query_id, summary, compare, anchored, generic, chitchat FROM a"))
def flags(t: Tables):
    c = F.col("ask")
    return t.asks.select(
        "query_id", questions.is_summary_request(c).alias("summary"), questions.is_compare_request(c).alias("compare"),
        questions.is_doc_anchored(c).alias("anchored"), questions.is_generic_request(c, questions.intent(c)).alias("generic"),
        questions.is_chitchat(c).alias("chitchat"),
    )


def _routed(t: Tables):
    c = F.col("ask")
    rows = t.asks.withColumn("intent", questions.intent(c)).withColumn("has_selection", F.col("role") == "system")
    return rows.withColumn(
        "route",
        questions.route(
            F.length("ask") > 900, F.length("ask") < 8, F.col("has_selection"), F.col("role") == "assistant", F.lit(True), F.col("intent"),
            questions.is_doc_anchored(c), questions.is_generic_request(c, F.col("intent")),
        ),
    )


ROUTED = f"""{ANALYSED},
r AS (SELECT a.*, s.role, CASE WHEN length(a.ask) > 900 THEN 'raw_large' WHEN length(a.ask) < 8 AND s.role <> 'system' THEN 'small_doc'
  WHEN s.role = 'system' THEN 'selection_rag' WHEN intent = 'compare' THEN 'rag'
  WHEN (anchored OR s.role = 'assistant' OR generic) AND intent IN ('lookup', 'extract', 'summarize', 'explain') THEN 'rag' ELSE 'chat' END AS route
  FROM a JOIN asks s USING (query_id))"""


@query("p10_select_route", with_views("asks", f"WITH {ROUTED} SELECT query_id, route FROM r"))
def route(t: Tables):
    return _routed(t).select("query_id", "route")


def _case(col: str, table: dict[str, str], default: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {_quote(k)} THEN {_quote(v)}" for k, v in table.items()) + f" ELSE {_quote(default)} END"


@query("p11_rewrite_query", with_views("asks", f"""WITH {ROUTED},
q AS (SELECT *, CASE WHEN {strip_sql('ask')} = '' THEN 'document overview' ELSE {strip_sql('ask')} END AS b FROM r)
SELECT query_id, {strip_sql(f"concat_ws({NL}, CASE WHEN generic THEN {_case('intent', GOALS, GOAL_DEFAULT)} || {NL} || 'User request: ' || b ELSE b END, 'Focus file: notes.txt', CASE WHEN role = 'system' THEN 'Selection focus:' || {NL} || substr({strip_sql('ask')}, 1, 1400) END)")} AS retrieval_query,
  CASE WHEN route = 'chat' THEN {_quote(TASK_CHAT)} || {NL} || 'User request: ' || {strip_sql('ask')}
  ELSE concat_ws({NL}, {_case('intent', TASKS, TASK_DEFAULT)}, CASE WHEN role = 'system' THEN 'Prioritize the selected excerpt when it is relevant.' END,
    CASE WHEN generic THEN '{TASK_GENERIC}' END, 'User request: ' || {strip_sql('ask')}) END AS task FROM q"""))
def rewrite(t: Tables):
    rows = _routed(t)
    selection = F.when(F.col("has_selection"), F.col("ask"))
    return rows.select(
        "query_id",
        questions.retrieval_query(F.col("ask"), F.col("intent"), F.lit(True), selection, F.lit("notes.txt")).alias("retrieval_query"),
        questions.task_instruction(F.col("ask"), F.col("intent"), F.col("route"), F.lit(True), F.col("has_selection")).alias("task"),
    )


REL = f"list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_-]{{2,80}}'), lambda x: lower(x)), lambda x: x NOT IN {_in(RELEVANCE_STOP)})"


@query("p16_relevance_terms", f"""
WITH l AS (SELECT doc_id, {REL} AS l FROM documents), e AS (SELECT doc_id, unnest(l) AS x, unnest(range(0, len(l))) AS i FROM l),
f AS (SELECT doc_id, x, min(i) AS i, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS n FROM e GROUP BY doc_id, x)
SELECT d.doc_id, coalesce(string_agg(x, ' ' ORDER BY i), '') AS terms FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id AND n <= 12 GROUP BY d.doc_id""")
def relevance_terms(t: Tables):
    return t.documents.select("doc_id", F.array_join(questions.relevance_terms(F.col("text")), " ").alias("terms"))


IDS = "list_filter(regexp_extract_all(ask, '[A-Za-z0-9][A-Za-z0-9_-]{3,80}'), lambda x: regexp_matches(x, '[0-9_-]'))"
PHRASES = f"""list_filter(list_transform(regexp_extract_all(ask, '"([^"]{{2,80}})"|''([^'']{{2,80}})'''), lambda x: {strip_sql('x[2:length(x) - 1]')}), lambda x: x <> '')"""
KEYS = f"list_filter(regexp_extract_all(ask, '[A-Za-z][A-Za-z]{{4,80}}'), lambda x: lower(x) NOT IN {_in(SCAN_STOP)})"


@query("p17_scan_terms", with_views("asks", f"""
WITH p AS (SELECT query_id, {PHRASES} || {IDS} || {KEYS} AS l FROM asks), d AS (SELECT query_id, {ordered_distinct_sql('l')} AS l FROM p)
SELECT query_id, array_to_string(l[1:8], '|') AS terms FROM d"""))
def scan_terms(t: Tables):
    return t.asks.select("query_id", F.array_join(questions.scan_terms(F.col("ask")), "|").alias("terms"))


@query("p18_exact_terms", with_views("asks", f"""
WITH p AS (SELECT query_id, ({PHRASES} || {IDS})[1:8] AS l FROM asks) SELECT query_id, array_to_string({ordered_distinct_sql('l')}, '|') AS terms FROM p"""))
def exact_terms(t: Tables):
    return t.asks.select("query_id", F.array_join(questions.exact_terms(F.col("ask")), "|").alias("terms"))


@query("p1_scope_filter", """
SELECT 'file_' || doc_id AS file_id FROM documents WHERE source IN ('src1', 'src2') AND lang IN ('en', 'fr') AND n_chars BETWEEN 200 AND 5000""")
def scope_filter(t: Tables):
    rows = t.docs.select("file_id", F.lit("u").alias("user_id"), F.col("n_chars").alias("created_at"), F.array("source", "lang").alias("tags"),
                         F.when(F.col("lang").isin("en", "fr"), "c").otherwise("d").alias("chat_id"))
    return P.scope_filter(rows, user="u", chat="c", tags=["src1", "src2"], between=(200, 5000)).select("file_id")


@query("p2_scope_join", with_views("chunks", """
WITH q AS (SELECT doc_id, 'chat_' || source AS chat_id, quality FROM documents JOIN labels USING (doc_id))
SELECT q.doc_id AS query_id, c.chunk_id FROM q JOIN chunks c ON c.file_id = 'file_' || q.doc_id WHERE quality = 1
UNION ALL SELECT q.doc_id, c.chunk_id FROM q JOIN chunks c ON c.chat_id = q.chat_id WHERE quality = 0"""))
def scope_join(t: Tables):
    """Labelled documents ask: good ones within their own file, the others within their chat."""
    q = t.docs.join(t.read("labels"), "doc_id").select(
        F.col("doc_id").alias("query_id"), F.concat(F.lit("chat_"), "source").alias("chat_id"),
        F.when(F.col("quality") == 1, F.array("file_id")).alias("file_ids"),
    )
    return P.scope_join(q, t.chunks.select("chunk_id", "file_id", "chat_id")).select("query_id", "chunk_id")


def _uploads(t: Tables):
    ext = F.when(F.col("lang") == "en", ".txt").when(F.col("lang") == "fr", ".log").when(F.col("lang") == "de", ".docx").otherwise(".PDF")
    return t.docs.select("doc_id", F.concat(F.lit("chat_"), "source").alias("chat_id"), F.concat("source", ext).alias("filename"), (F.col("n_chars") * 4000).alias("size_bytes"))


UPLOADS = """SELECT doc_id, 'chat_' || source AS chat_id, n_chars * 4000 AS size_bytes, CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.log' WHEN 'de' THEN '.docx' ELSE '.pdf' END AS ext FROM documents"""
VERDICT = "CASE WHEN size_bytes > 52428800 THEN 'file_too_large' WHEN size_bytes > 10485760 AND ext NOT IN ('.txt', '.log', '.json', '.pdf') THEN 'large_file_type_not_supported' END"


@query("p3_classify_file_size", f"""
WITH u AS ({UPLOADS}), r AS (SELECT *, {VERDICT} AS reject_reason FROM u)
SELECT doc_id, CASE WHEN reject_reason IS NOT NULL THEN 'rejected' WHEN size_bytes > 10485760 THEN 'raw_large' ELSE 'ingest' END AS policy, reject_reason FROM r""")
def classify_file_size(t: Tables):
    return P.classify_file_size(_uploads(t)).select("doc_id", "policy", "reject_reason")


@query("p4_upload_policy", f"""
WITH u AS (SELECT 'up_' || doc_id // 3 AS chat_id, size_bytes, ext FROM ({UPLOADS})), r AS (SELECT *, {VERDICT} AS v FROM u),
i AS (SELECT chat_id, count(*) AS n, bool_or(v = 'file_too_large') AS big, bool_or(v = 'large_file_type_not_supported') AS bad, bool_or(size_bytes > 10485760) AS large FROM r GROUP BY chat_id),
e AS (SELECT 'up_' || doc_id // 5 AS chat_id, count(*) AS m, bool_or(n_chars * 4000 > 10485760) AS locked FROM documents WHERE lang = 'es' GROUP BY ALL)
SELECT i.chat_id, CASE WHEN coalesce(big, false) THEN 'file_too_large' WHEN coalesce(bad, false) THEN 'large_file_type_not_supported' WHEN coalesce(locked, false) THEN 'large_file_chat_locked'
  WHEN coalesce(m, 0) > 0 AND large THEN 'large_file_requires_new_chat' WHEN coalesce(m, 0) = 0 AND large AND n <> 1 THEN 'large_file_must_be_alone' END AS reason
FROM i LEFT JOIN e USING (chat_id)""")
def upload_policy(t: Tables):
    group = lambda n: F.concat(F.lit("up_"), F.floor(F.col("doc_id") / n).cast("string"))
    incoming = _uploads(t).withColumn("chat_id", group(3))
    existing = t.documents.filter("lang = 'es'").select(group(5).alias("chat_id"), (F.col("n_chars") * 4000).alias("size_bytes"))
    return P.check_upload_policy(incoming, existing).select("chat_id", "reason")


@query("p5_normalize_status", "SELECT doc_id, CASE lang WHEN 'en' THEN 'processing' ELSE 'Failed' END AS status FROM documents")
def normalize_status(t: Tables):
    raw = F.when(F.col("lang") == "en", "FileIngestionStatus.PROCESSING").otherwise("Failed")
    return t.documents.select("doc_id", codes.normalize_status(raw).alias("status"))


@query("p6_parse_messages", """
SELECT 'm_' || conv_id || '_' || turn AS message_id, text, CASE role WHEN 'user' THEN 'a.txt' WHEN 'assistant' THEN 'v.txt' ELSE 'c.txt' END AS source_name,
  CASE role WHEN 'user' THEN 'file_' || conv_id END AS focus_document_id FROM conversations""")
def parse_messages(t: Tables):
    """User turns become objects with a versioned source, assistant turns too but with citations only, system turns bare strings."""
    src = lambda name: F.array(F.struct(F.lit(name).alias("filename"), F.array(F.array(F.lit(1), F.lit(2))).alias("page_ranges")))
    user = F.to_json(F.struct("text", F.concat(F.lit("file_"), F.split_part("chat_id", F.lit("_"), F.lit(2))).alias("focus_document_id"),
                              F.lit(1).alias("activeVersionIndex"), F.array(src("x.txt"), src("a.txt")).alias("versionSources")))
    agent = F.to_json(F.struct("text", F.lit(5).alias("activeVersionIndex"), F.array(src("x.txt")).alias("versionSources")))
    bare = F.regexp_replace(F.regexp_replace(F.to_json(F.struct("text")), r'^\{"text":', ""), r"\}$", "")
    content = F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", agent).otherwise(bare)
    cited = F.to_json(F.when(F.col("role") == "assistant", src("v.txt")).otherwise(src("c.txt")))
    rows = t.messages.select("message_id", content.alias("content_json"), cited.alias("citations_json"))
    return P.parse_messages(rows).select("message_id", "text", F.col("sources")[0]["filename"].alias("source_name"), "focus_document_id")


@query("p7_transcript", with_views("messages", f"""
SELECT chat_id, message_id, role, content, created_s FROM (SELECT chat_id, message_id, role, {strip_sql('text')} AS content, created_s,
  row_number() OVER (PARTITION BY chat_id ORDER BY created_s DESC, message_id DESC) AS n FROM messages) WHERE n <= 4 AND content <> ''"""))
def transcript(t: Tables):
    return P.transcript(t.messages, last_n=4)


@query("l2_latest_n", with_views("messages", """
SELECT chat_id, message_id, created_s FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY created_s DESC, message_id DESC) AS n FROM messages) WHERE n <= 3"""))
def latest_n(t: Tables):
    return ranking.latest_n(t.messages.select("chat_id", "message_id", "created_s"), 3, ["created_s", "message_id"], ["chat_id"])


@query("l1_top_n", "SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 9999)")
def top_n(t: Tables):
    return ranking.top_n(t.documents.select("doc_id", "n_chars"), 9999, 1, 10000, [F.desc("n_chars"), "doc_id"])


@query("l3_listing", with_views("jobs", "SELECT job_id, status, created_at FROM jobs"))
def listing(t: Tables):
    return ranking.listing(t.jobs.select("job_id", "status", "created_at"), [F.desc("created_at"), "job_id"])


@query("u1_union_first", """
SELECT doc_id, quality AS score, 'label' AS origin FROM labels UNION ALL SELECT doc_id, -1, 'document' FROM documents ANTI JOIN labels USING (doc_id)""")
def union_first(t: Tables):
    a = t.read("labels").select("doc_id", F.col("quality").alias("score"), F.lit("label").alias("origin"))
    b = t.documents.select("doc_id", F.lit(-1).alias("score"), F.lit("document").alias("origin"))
    return ranking.union_first(a, b, ["doc_id"])


@query("u5_backfill_links", """
SELECT 'chat_' || source AS chat_id, 'file_' || doc_id AS file_id, doc_id AS created_at FROM documents WHERE lang = 'en'
UNION ALL SELECT 'chat_old', 'file_' || doc_id, -doc_id FROM documents WHERE lang <> 'en'""")
def backfill_links(t: Tables):
    links = t.docs.filter("lang = 'en'").select(F.concat(F.lit("chat_"), "source").alias("chat_id"), "file_id", F.col("doc_id").alias("created_at"))
    legacy = F.when(F.col("lang") == "en", F.concat(F.lit("chat_"), "source")).otherwise("chat_old")
    files = t.docs.select("file_id", legacy.alias("chat_id"), (-F.col("doc_id")).alias("created_at"))
    return ranking.backfill_links(files, links)


def _turns(t: Tables):
    """One turn per document of the labels: what it attaches, focuses or selects follows its language and labels."""
    rows = t.docs.join(t.read("labels"), "doc_id")
    lang = F.col("lang")
    none = F.lit(None).cast("string")
    return rows.select(
        F.col("doc_id").alias("query_id"), F.concat(F.lit("chat_"), "source").alias("chat_id"),
        F.when(lang == "fr", F.array("file_id", F.lit(" file_0 "), "file_id")).when(lang == "de", F.array("file_id")).otherwise(F.array().cast("array<string>")).alias("turn_doc_ids"),
        F.when((lang == "en") & (F.col("toxic") == 1), F.lit("file_none")).when((lang == "en") & (F.col("quality") == 0), F.col("file_id")).otherwise(none).alias("focus_document_id"),
        F.lit(None).cast("boolean").alias("doc_pane_open"),
        F.when((lang == "es") & (F.col("quality") == 1), F.col("file_id")).otherwise(none).alias("selection_file_id"),
        F.when((lang == "es") & (F.col("quality") == 0), "all").otherwise("").alias("doc_scope_mode"),
    )


TURNS = """
x AS (SELECT d.doc_id AS query_id, 'chat_' || source AS chat_id, 'file_' || d.doc_id AS me, lang, quality, toxic FROM documents d JOIN labels USING (doc_id)),
late AS (SELECT chat_id, arg_max(file_id, linked_ord) AS latest FROM chat_files GROUP BY chat_id),
m AS (SELECT x.*, latest, CASE WHEN lang = 'es' AND quality = 1 THEN 'selection' WHEN lang = 'fr' THEN CASE WHEN me = 'file_0' THEN 'one' ELSE 'many' END
  WHEN lang = 'de' THEN 'one' WHEN lang = 'en' AND toxic = 1 THEN 'lost' WHEN lang = 'en' AND quality = 0 THEN 'focus' ELSE 'closed' END AS mode FROM x JOIN late USING (chat_id))
"""


@query("p12_resolve_scope", with_views("chat_files", f"""WITH {TURNS}
SELECT query_id, CASE WHEN mode IN ('many', 'closed') THEN 'all' ELSE 'focused' END AS scope,
  CASE mode WHEN 'selection' THEN me WHEN 'one' THEN me WHEN 'lost' THEN latest WHEN 'focus' THEN me END AS focus FROM m"""))
def resolve_scope(t: Tables):
    plan, _ = P.resolve_scope(_turns(t), t.chat_files)
    return plan.select("query_id", "scope", "focus")


@query("p12_scope_members", with_views("chat_files", f"""WITH {TURNS}
SELECT m.query_id, c.file_id, CASE WHEN mode = 'closed' THEN 'scope' ELSE 'secondary' END AS role FROM m JOIN chat_files c USING (chat_id)
WHERE mode = 'closed' OR (mode IN ('one', 'focus') AND c.file_id <> me) OR (mode = 'lost' AND c.file_id <> latest)
UNION ALL SELECT query_id, me, 'scope' FROM m WHERE mode = 'many' UNION ALL SELECT query_id, 'file_0', 'scope' FROM m WHERE mode = 'many'"""))
def scope_members(t: Tables):
    _, members = P.resolve_scope(_turns(t), t.chat_files)
    return members.select("query_id", "file_id", "role")


@query("p13_readiness", with_views("chat_files files", f"""WITH {TURNS},
r AS (SELECT query_id, chat_id, me AS file_id FROM m WHERE mode IN ('selection', 'one', 'many', 'focus')
  UNION SELECT query_id, chat_id, 'file_0' FROM m WHERE mode = 'many' UNION SELECT query_id, chat_id, 'file_none' FROM m WHERE mode = 'lost'
  UNION SELECT m.query_id, m.chat_id, c.file_id FROM m JOIN chat_files c USING (chat_id) WHERE lang = 'es' AND quality = 0
  UNION SELECT query_id, chat_id, latest FROM m WHERE mode = 'closed' AND NOT (lang = 'es' AND quality = 0)),
s AS (SELECT DISTINCT c.chat_id, c.file_id, f.status FROM chat_files c JOIN files f USING (file_id)),
j AS (SELECT r.*, status FROM r LEFT JOIN s USING (chat_id, file_id))
SELECT query_id, count(*) AS required, count(*) FILTER (status IS NULL) AS missing, count(*) FILTER (status IS NULL OR status NOT IN ('completed', 'failed')) AS not_ready,
  count(*) FILTER (status = 'failed') AS failed, bool_and(coalesce(status = 'completed', false)) AS ready FROM j GROUP BY query_id"""))
def readiness(t: Tables):
    return P.readiness_by_turn(_turns(t), t.files, t.chat_files)


@query("p14_relevance_gate", with_views("hits", f"""
WITH b AS (SELECT item_id AS query_id, 1 AS k, text FROM benchmark),
l AS (SELECT query_id, {REL} AS l FROM b), d AS (SELECT query_id, {ordered_distinct_sql('l')} AS l FROM l),
q AS (SELECT query_id, CASE WHEN length(b.text) < 160 THEN [] ELSE list_transform(d.l[1:12], lambda x: x || 'zz') END AS terms,
  CASE WHEN length(b.text) < 230 THEN 'lookup' ELSE 'explain' END AS intent, CASE WHEN length(b.text) < 200 THEN 'all' ELSE 'focused' END AS scope FROM b JOIN d USING (query_id)),
j AS (SELECT h.*, scope, CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda x: contains(lower(substr(h.text, 1, 8000)), x))) > 0
    OR score >= CASE WHEN intent = 'lookup' THEN 0.8 ELSE 0.7 END ELSE score >= 0.7 END AS pass FROM hits h JOIN q USING (query_id)),
y AS (SELECT *, bool_or(pass) OVER (PARTITION BY query_id) AS any_pass FROM j),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY pos) AS turn, min(pos) OVER (PARTITION BY query_id, doc_id) AS first FROM y WHERE NOT any_pass AND scope = 'all'),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn, first) AS n FROM o),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM y WHERE NOT any_pass AND scope <> 'all')
SELECT query_id, pos, false AS restored FROM y WHERE any_pass AND pass
UNION ALL SELECT query_id, pos, true FROM p WHERE n <= 6 UNION ALL SELECT query_id, pos, true FROM z WHERE n <= 6"""))
def relevance_gate(t: Tables):
    """Terms are made rare (zz) so that every branch of the gate is taken."""
    n = F.length("text")
    q = t.questions.select(
        "query_id",
        F.when(n < 160, questions.empty_terms()).otherwise(F.transform(questions.relevance_terms(F.col("text")), lambda x: F.concat(x, F.lit("zz")))).alias("terms"),
        F.when(n < 230, "lookup").otherwise("explain").alias("intent"), F.when(n < 200, "all").otherwise("focused").alias("scope"),
    )
    return P.relevance_gate(t.hits, q).select("query_id", "pos", "restored")


@query("p20_effective_document", with_views("chat_files files chunks", f"""
WITH d AS (SELECT *, 'file_' || doc_id AS file_id FROM documents),
r AS (SELECT file_id, string_agg({strip_sql('text')}, {NL} || {NL} ORDER BY seq) FILTER ({strip_sql('text')} <> '') AS t FROM chunks GROUP BY file_id)
SELECT c.chat_id, c.file_id, CASE d.lang WHEN 'en' THEN CASE WHEN length(d.text) > 500 THEN 'page' ELSE 'blocks' END WHEN 'fr' THEN 'blocks' ELSE CASE WHEN r.t IS NULL THEN 'none' ELSE 'chunks' END END AS origin,
  CASE WHEN d.lang = 'en' AND length(d.text) > 500 THEN NULL WHEN d.lang IN ('en', 'fr') THEN d.source ELSE r.t END AS text, d.lang = 'en' AND length(d.text) > 1000 AS source_is_stale
FROM (SELECT DISTINCT chat_id, file_id FROM chat_files) c JOIN d USING (file_id) LEFT JOIN r USING (file_id)"""))
def effective_document(t: Tables):
    """English documents have an edited page when long, stale when longer; French ones blocks; the rest only chunks."""
    d = t.docs
    block = F.array(F.struct(F.lit("paragraph").alias("kind"), F.col("source").alias("text"), F.struct(
        F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("array<string>").alias("items"),
        F.lit(None).cast("boolean").alias("ocr"), F.lit(None).cast("string").alias("source")).alias("metadata")))
    texts = d.filter("lang in ('en', 'fr')").select("file_id", block.alias("blocks"), F.timestamp_seconds("doc_id").alias("updated_at"))
    n = F.length("text")
    pages = d.filter("lang = 'en'").join(t.chat_files.select("chat_id", "file_id"), "file_id").select(
        "chat_id", "file_id", F.lit("").alias("title"), F.lit("{}").alias("doc"), (n > 500).alias("is_user_edited"),
        F.timestamp_seconds(F.col("doc_id") + F.when(n > 1000, 1).otherwise(0)).alias("source_file_updated_at"),
    )
    return P.effective_document(t.chat_files, t.files, texts, pages, t.chunks).select("chat_id", "file_id", "origin", "text", "source_is_stale")


@query("r11_plan_depth", """
WITH q AS (SELECT doc_id AS query_id, n_chars * 3 AS budget, 1 + length(source) AS files, CASE lang WHEN 'en' THEN 12 WHEN 'fr' THEN 16 ELSE 6 END AS base, length(lang || source) - 4 AS detail FROM documents)
SELECT query_id, CAST(CASE WHEN budget <= 0 THEN base ELSE greatest(base, least(greatest(base, greatest(1, greatest(1, budget // 220) // files) * 2), 64)) END AS INTEGER) AS depth,
  CASE WHEN budget >= 8000 THEN 3 ELSE 2 END AS radius, CASE detail WHEN 1 THEN 3 WHEN 2 THEN 5 WHEN 3 THEN 7 WHEN 4 THEN 9 WHEN 5 THEN 12 END AS detail_depth,
  CASE detail WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 2 END AS detail_radius FROM q""")
def plan_depth(t: Tables):
    rows = t.documents.select(
        F.col("doc_id").alias("query_id"), (F.col("n_chars") * 3).alias("budget"), (1 + F.length("source")).alias("files"),
        codes.base_depth(F.col("lang") == "fr", F.col("lang").isin("de", "es")).alias("base"), (F.length(F.concat("lang", "source")) - 4).alias("detail"),
    )
    return rows.select(
        "query_id", codes.retrieval_depth(F.col("budget"), F.col("files"), F.col("base")).alias("depth"), codes.window_radius(F.col("budget")).alias("radius"),
        codes.detail_depth(F.col("detail")).alias("detail_depth"), codes.detail_radius(F.col("detail")).alias("detail_radius"),
    )


@query("w5_file_budget", "SELECT doc_id, CAST(greatest(600, greatest(200, n_chars) // (1 + length(lang || source) % 4)) AS INTEGER) AS cap FROM documents")
def file_budget(t: Tables):
    return t.documents.select("doc_id", codes.file_cap(F.col("n_chars"), 1 + F.length(F.concat("lang", "source")) % 4).alias("cap"))


@query("w12_input_budget", """
WITH q AS (SELECT doc_id, 8192::BIGINT AS capacity, n_chars AS used FROM documents)
SELECT doc_id, CAST(floor(greatest(0, capacity - used - CAST(floor(capacity * 0.1::DOUBLE) AS BIGINT) - CAST(floor(capacity * 0.02::DOUBLE) AS BIGINT)) * 0.65::DOUBLE) AS BIGINT) AS budget FROM q""")
def input_budget(t: Tables):
    return t.documents.select("doc_id", codes.input_budget(F.lit(8192).cast("bigint"), F.col("n_chars")).alias("budget"))

