"""Queries for progress, summaries, quality, latency, growth and storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.catalog.base import Tables, query, strip_sql, tokens_sql, with_views
from lectern.operators import reports as R
from lectern.plans import jobs
from lectern.sources import logs


@query("g1_ingestion_progress", with_views("files chat_files jobs", """
WITH l AS (SELECT DISTINCT chat_id, file_id FROM chat_files),
s AS (SELECT chat_id, count(*) AS total, count(*) FILTER (status IN ('completed', 'failed')) AS done, count(*) FILTER (status = 'pending') AS pending,
  count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM l JOIN files USING (file_id) GROUP BY chat_id),
a AS (SELECT chat_id, count(*) AS n FROM l JOIN jobs USING (file_id) WHERE status IN ('queued', 'running') GROUP BY chat_id)
SELECT s.*, CAST(coalesce(n, 0) AS BIGINT) AS active_jobs, round(done / total * 100.0::DOUBLE, 2) AS percent FROM s LEFT JOIN a USING (chat_id)"""))
def ingestion_progress(t: Tables):
    return R.ingestion_progress(t.files, t.chat_files, t.jobs)


@query("g2_session_summaries", f"""
WITH m AS (SELECT 'chat_src' || (conv_id % 40) AS chat_id, role, text, 1700000000 + conv_id * 10000 + turn * 60 AS created_s FROM conversations),
cf AS (SELECT 'chat_' || source AS chat_id, 'file_' || doc_id AS file_id, doc_id AS linked_ord, source || '_' || lang || '.txt' AS filename FROM documents
  UNION ALL SELECT 'chat_' || lang, 'file_' || doc_id, doc_id + 1000000, source || '_' || lang || '.txt' FROM documents WHERE lang <> 'en'),
c AS (SELECT chat_id, count(DISTINCT file_id) AS file_count FROM cf GROUP BY chat_id),
t AS (SELECT chat_id, max(created_s) AS last_at, {strip_sql("arg_min(text, created_s) FILTER (role = 'user')")} AS ft, {strip_sql("arg_max(text, created_s)")} AS lt FROM m GROUP BY chat_id),
u AS (SELECT *, {strip_sql("string_split(ft, chr(10))[1]")} AS f1, substr(lt, 1, 200) AS cut FROM t)
SELECT u.chat_id, 0 AS branch, last_at, CASE WHEN f1 = '' THEN NULL ELSE substr(f1, 1, 48) || CASE WHEN length(f1) > 48 THEN '...' ELSE '' END END AS title,
  CASE WHEN lt = '' THEN NULL WHEN length(lt) <= 200 THEN lt WHEN regexp_extract(cut, '(?s)^(.+) ', 1) = '' THEN cut || '...' ELSE regexp_extract(cut, '(?s)^(.+) ', 1) || '...' END AS last_message,
  coalesce(file_count, 0) AS file_count FROM u LEFT JOIN c USING (chat_id)
UNION ALL SELECT chat_id, 1, max(linked_ord), arg_min(filename, linked_ord), NULL, count(DISTINCT file_id) FROM cf WHERE chat_id NOT IN (SELECT chat_id FROM m) GROUP BY chat_id""")
def session_summaries(t: Tables):
    """Conversations are folded onto forty chats, half of which also hold files."""
    n = F.split_part("chat_id", F.lit("_"), F.lit(2)).cast("bigint") % 40
    talk = t.messages.withColumn("chat_id", F.concat(F.lit("chat_src"), n.cast("string")))
    return R.session_summaries(talk, t.chat_files, t.files)


@query("g3_seq_stats", with_views("files chunks", """
SELECT file_id, count(seq) AS count, coalesce(min(seq), 0) AS min_seq, coalesce(max(seq), 0) AS max_seq FROM files LEFT JOIN chunks USING (file_id) GROUP BY file_id"""))
def seq_stats(t: Tables):
    return R.seq_stats(t.chunks, t.files)


@query("g4_counts", with_views("chunks jobs", "SELECT (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM jobs WHERE status IN ('queued', 'running')) AS jobs"))
def counts(t: Tables):
    return R.count_chunks(t.chunks).select("chunks", R.count_jobs(t.jobs).scalar().alias("jobs"))


def _eval_rows(t: Tables):
    """Each labelled document expects its own id; what was retrieved follows its labels."""
    me = F.col("doc_id").cast("string")
    rows = t.documents.join(t.read("labels"), "doc_id")
    # letter by letter, as one that has no single capital (ß) stays
    loud = F.transform(F.split(F.substr("text", F.lit(1), F.lit(20)), ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c))
    good = F.array(F.lit("x"), F.concat(F.lit(" "), me), F.lit("y"))
    late = F.array(*[F.lit(c) for c in "abcdef"], me)
    return rows.select(
        me.alias("id"), F.when(F.col("lang") == "de", F.array().cast("array<string>")).otherwise(F.array(me, F.lit("z"))).alias("relevant_doc_ids"),
        F.when(F.col("quality") == 1, good).when(F.col("toxic") == 1, late).otherwise(F.array(me)).alias("retrieved_doc_ids"),
        F.when(F.col("lang") == "en", F.concat(F.lit(" "), F.array_join(loud, ""), F.lit(" "))).when(F.col("lang") == "fr", "nowhere").alias("expected_snippet"),
        F.col("text").alias("answer"), F.col("n_chars").cast("double").alias("latency_ms"),
    )


EVAL = """
e AS (SELECT d.doc_id, lang, text, n_chars, CASE WHEN lang = 'de' THEN NULL WHEN quality = 1 THEN 2 WHEN toxic = 1 THEN NULL ELSE 1 END AS r FROM documents d JOIN labels USING (doc_id)),
a AS (SELECT count(*) AS samples, 5 AS k, count(r) AS hits_at_k, round(count(r) / count(*), 6) AS hit_rate_at_k, round(sum(coalesce(1.0::DOUBLE / r, 0)) / count(*), 6) AS mrr_at_k FROM e)
"""
GROUND = """g AS (SELECT count(*) AS with_snippet, count(*) FILTER (contains(lower(text), lower(trim(s)))) AS passed FROM
  (SELECT text, CASE lang WHEN 'en' THEN regexp_replace(upper(substr(text, 1, 20)), '^\\s+|\\s+$', '', 'g') WHEN 'fr' THEN 'nowhere' END AS s FROM e) WHERE s IS NOT NULL AND s <> '')"""


@query("g5_evaluate_retrieval", f"WITH {EVAL} SELECT * FROM a")
def evaluate_retrieval(t: Tables):
    out = R.evaluate_retrieval(_eval_rows(t), 5)
    return out.withColumns({c: F.round(c, 6) for c in ("hit_rate_at_k", "mrr_at_k")})


@query("g6_evaluate_grounding", f"WITH {EVAL}, {GROUND} SELECT with_snippet, passed, round(passed / with_snippet, 6) AS pass_rate FROM g".replace("\\\\s", "\\s"))
def evaluate_grounding(t: Tables):
    return R.evaluate_grounding(_eval_rows(t)).withColumn("pass_rate", F.round("pass_rate", 6))


@query("g7_latency_summary", with_views("requests", """
SELECT endpoint, count(*) AS count, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms, round(avg(latency_ms), 6) AS mean_ms,
  round(median(latency_ms), 6) AS median_ms FROM requests GROUP BY endpoint"""))
def latency_summary(t: Tables):
    out = R.latency_summary(t.requests, "latency_ms", ["endpoint"])
    return out.withColumns({c: F.round(c, 6) for c in ("p50_ms", "p95_ms", "mean_ms", "median_ms")})


@query("g8_quality_gate", f"""WITH {EVAL}, {GROUND}, l AS (SELECT quantile_cont(n_chars::DOUBLE, 0.95) AS p95 FROM e)
SELECT false AS ok, format('Recall@{{}} {{:.4f}} < required {{:.4f}}', 5, hit_rate_at_k, 0.99) || '; ' || format('Grounding pass rate {{:.4f}} < required {{:.4f}}', passed / with_snippet, 0.98)
  || '; ' || format('Latency p95 {{:.2f}}ms > allowed {{:.2f}}ms', p95, 10.0) AS failures FROM a, g, l""".replace("\\\\s", "\\s"))
def quality_gate(t: Tables):
    report = jobs.evaluate(_eval_rows(t), None, 5, min_hit_rate=0.99, min_grounding=0.98, max_p95_ms=10.0)
    return report.select("ok", F.array_join("failures", "; ").alias("failures"))


@query("d7_evaluate", f"""WITH {EVAL}, {GROUND}
SELECT samples, hits_at_k, mrr_at_k, passed, round((SELECT quantile_cont(n_chars::DOUBLE, 0.95) FROM e), 6) AS p95_ms, true AS ok FROM a, g""".replace("\\\\s", "\\s"))
def evaluate(t: Tables):
    report = jobs.evaluate(_eval_rows(t), None, 5, min_hit_rate=0.0)
    return report.select("samples", "hits_at_k", F.round("mrr_at_k", 6).alias("mrr_at_k"), "passed", F.round("p95_ms", 6).alias("p95_ms"), "ok")


@query("g9_load_latency", with_views("requests", """
WITH s AS (SELECT endpoint, list_sort(list(latency_ms)) AS l FROM requests GROUP BY endpoint)
SELECT endpoint, len(l) AS samples, round(list_median(l), 6) AS p50, round(l[CAST(floor(0.95::DOUBLE * (len(l) - 1)) AS BIGINT) + 1], 6) AS p95 FROM s""".replace("list_median(l)", "list_aggregate(l, 'median')")))
def load_latency(t: Tables):
    out = R.load_latency(t.requests, ["endpoint"])
    return out.select("endpoint", "samples", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("g10_failure_summary", """
WITH f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'error'),
m AS (SELECT user_id, string_agg('request ' || event_id, '|' ORDER BY n) AS m FROM f WHERE n <= 10 GROUP BY user_id)
SELECT e.user_id AS worker, count(*) AS requests, count(*) FILTER (event_type = 'error') AS failures, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS failure_rate,
  coalesce(any_value(m), '') AS first_failures FROM events e LEFT JOIN m USING (user_id) GROUP BY e.user_id""")
def failure_summary(t: Tables):
    out = R.failure_summary(t.requests, ["worker"], ["id"], F.col("status") >= 400, F.concat(F.lit("request "), F.col("id").cast("string")))
    return out.select("worker", "requests", "failures", F.round("failure_rate", 6).alias("failure_rate"), F.array_join("first_failures", "|").alias("first_failures"))


@query("g11_growth_check", """
WITH g AS (SELECT user_id AS worker, count(*) AS samples, arg_min(value, (ts, event_id)) FILTER (value > 0) AS first, arg_max(value, (ts, event_id)) FILTER (value > 0) AS last,
  min(value) FILTER (value > 0) AS min, max(value) FILTER (value > 0) AS max FROM events GROUP BY user_id)
SELECT worker, samples, first, last, min, max, round((last - first) / first * 100.0::DOUBLE, 6) AS growth_pct, CASE WHEN samples >= 5 AND first IS NOT NULL THEN (last - first) / first * 100.0 > 80 END AS failed FROM g""")
def growth_check(t: Tables):
    out = R.growth_check(t.requests, ["worker"], "latency_ms", ["ts", "id"])
    return out.withColumn("growth_pct", F.round("growth_pct", 6))


@query("g12_storage_usage", """
WITH p AS (SELECT CASE lang WHEN 'en' THEN 'uploads' WHEN 'fr' THEN 'cache' WHEN 'de' THEN 'db' ELSE 'other' END AS component, n_chars FROM documents)
SELECT component, CAST(sum(n_chars) AS BIGINT) AS bytes, count(*) AS files FROM p GROUP BY component""")
def storage_usage(t: Tables):
    part = F.when(F.col("lang") == "en", "uploads/").when(F.col("lang") == "fr", "cache/a/").when(F.col("lang") == "de", "db.sqlite").otherwise("misc/")
    rows = t.documents.select(F.concat(F.lit("file:/ws/"), part, F.when(F.col("lang") != "de", F.col("source")).otherwise(F.lit(""))).alias("path"), F.col("n_chars").alias("length"))
    return R.storage_usage(rows, "/ws")


@query("g13_context_status", with_views("messages", f"""
WITH u AS (SELECT chat_id, CAST(sum({tokens_sql('text')}) AS BIGINT) AS used_tokens FROM messages GROUP BY chat_id)
SELECT chat_id, used_tokens, 1024::BIGINT AS capacity_tokens, round(used_tokens / 1024::DOUBLE * 100, 2) AS percent,
  CAST(floor(greatest(0, 1024 - used_tokens - 102 - 20) * 0.65::DOUBLE) AS BIGINT) AS input_budget FROM u"""))
def context_status(t: Tables):
    return R.context_status(t.messages, 1024)


@query("s9_recent_requests", "SELECT event_id AS id, event_type AS endpoint FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 900)")
def recent_requests(t: Tables):
    return logs.recent_requests(t.requests, 900, "ts", "id").select("id", "endpoint")


@query("s9_request_by_id", "SELECT event_id AS id, event_type AS endpoint, value AS latency_ms FROM events WHERE event_id = (SELECT max(event_id) // 2 FROM events)")
def request_by_id(t: Tables):
    middle = t.requests.agg(F.floor(F.max("id") / 2).alias("m")).select("m").scalar()
    return logs.request_by_id(t.requests, middle).select("id", "endpoint", "latency_ms")
