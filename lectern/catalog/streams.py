"""Batch twins of the streaming operators, over the events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.catalog.base import Tables, query, with_views
from lectern.functions.text import REASONING_TAGS
from lectern.streaming import jobs as J
from lectern.streaming import requests as Q
from lectern.streaming import texts as X

TAGS = "|".join(REASONING_TAGS)


@query("k2_apply_cancellations", with_views("chat_files", """
WITH g AS (SELECT DISTINCT chat_id, file_id FROM chat_files WHERE chat_id IN ('chat_src3', 'chat_es')),
k AS (SELECT file_id FROM chat_files WHERE chat_id NOT IN ('chat_src3', 'chat_es'))
SELECT chat_id, file_id FROM chat_files WHERE (chat_id, file_id) NOT IN (SELECT chat_id, file_id FROM g WHERE file_id NOT IN (SELECT file_id FROM k))"""))
def apply_cancellations(t: Tables):
    jobs = t.chat_files.select(F.concat_ws(":", "chat_id", "file_id").alias("job_id"), "chat_id", "file_id")
    gone = t.chat_files.filter(F.col("chat_id").isin("chat_src3", "chat_es")).select("chat_id")
    return J.apply_cancellations(jobs, gone, t.chat_files).select("chat_id", "file_id")


@query("k3_job_states", with_views("job_events", """
WITH r AS (SELECT job_id, min(ts) AS run FROM job_events WHERE status = 'running' GROUP BY job_id),
e AS (SELECT job_id, ts AS end_ts, status AS end_status FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, ord) AS n FROM job_events WHERE status IN ('completed', 'failed', 'cancelled')) WHERE n = 1),
j AS (SELECT DISTINCT job_id FROM job_events), n AS (SELECT max(ts) AS now FROM job_events),
s AS (SELECT job_id, run, end_ts, end_status, end_ts IS NOT NULL AND (run IS NULL OR end_ts <= run + INTERVAL 20 MINUTE) AS early, now FROM j LEFT JOIN r USING (job_id) LEFT JOIN e USING (job_id), n)
SELECT job_id, CASE WHEN early THEN end_status WHEN run IS NOT NULL AND now >= run + INTERVAL 20 MINUTE THEN 'failed' WHEN run IS NOT NULL THEN 'running' ELSE 'queued' END AS status,
  CASE WHEN NOT early AND run IS NOT NULL AND now >= run + INTERVAL 20 MINUTE THEN 'watchdog timeout' END AS error FROM s"""))
def job_states(t: Tables):
    return J.job_states(t.job_events).select("job_id", "status", "error")


@query("k4_file_status_view", with_views("job_events", "SELECT job_id AS file_id, arg_max(status, (ts, ord)) AS status FROM job_events GROUP BY job_id"))
def file_status_view(t: Tables):
    return J.file_status_view(t.job_events.withColumnRenamed("job_id", "file_id")).select("file_id", "status")


def _metrics_sql(starts: str) -> str:
    return with_views("requests", f"""
WITH w AS (SELECT {starts} AS s, latency_ms, status FROM requests)
SELECT CAST(s AS BIGINT) AS window_start, count(*) AS requests, count(*) FILTER (status >= 400) AS failures, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms,
  round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms FROM w GROUP BY s""")


def _shown(df):
    return df.select(F.unix_timestamp("window_start").alias("window_start"), "requests", "failures", F.round("p50_ms", 6).alias("p50_ms"), F.round("p95_ms", 6).alias("p95_ms"))


@query("k5_request_metrics_tumbling", _metrics_sql("floor(epoch(ts) / 3600) * 3600"))
def metrics_tumbling(t: Tables):
    return _shown(Q.request_metrics(t.requests, "1 hour"))


@query("k5_request_metrics_sliding", _metrics_sql("unnest([floor(epoch(ts) / 1800) * 1800, floor(epoch(ts) / 1800) * 1800 - 1800])"))
def metrics_sliding(t: Tables):
    return _shown(Q.request_metrics(t.requests, "1 hour", "30 minutes"))


@query("k6_recent_history", with_views("requests", "SELECT endpoint, id FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY ts DESC, id DESC) AS n FROM requests) WHERE n <= 500"))
def recent_history(t: Tables):
    return Q.recent_batch(t.requests).select("endpoint", "id")


@query("k7_memory_stream_twin", """
WITH m AS (SELECT user_id, event_type || ' ' || CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS text, max(ts) AS seen FROM events GROUP BY ALL), n AS (SELECT max(ts) AS now FROM events)
SELECT user_id, text FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, text) AS r FROM m), n WHERE r <= 8 AND seen >= now - INTERVAL 30 DAY""")
def memory_twin(t: Tables):
    """Event notes as memories: the newest of equal notes stays, eight per user, thirty days at most."""
    from lectern.operators.ranking import top_per_group

    note = F.concat("event_type", F.lit(" "), F.floor(F.col("value") / 10).cast("string"))
    newest = t.read("events").select("user_id", note.alias("text"), "ts").groupBy("user_id", "text").agg(F.max("ts").alias("at"))
    kept = top_per_group(newest, ["user_id"], [F.desc("at"), "text"], 8)
    now = t.read("events").agg(F.max("ts").alias("n")).select("n").scalar()
    return kept.filter(F.col("at") >= now - F.expr("interval 30 days")).select("user_id", "text")


def _tokens(t: Tables):
    """Messages as streamed tokens of ten characters, hidden spans cut across tokens."""
    tagged = F.when(F.col("role") == "assistant", F.concat(F.lit("<think>"), F.substr("text", F.lit(1), F.lit(25)), F.lit("</think>"), "text")).otherwise(F.col("text"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("_t") - 1) / 10).cast("int")), lambda i: F.substr("_t", i * 10 + 1, F.lit(10)))
    # pieces get a column of their own: beside a generator they would be worked out for every token
    cut = t.messages.withColumn("_t", tagged).filter("_t <> ''").select(F.col("message_id").alias("request_id"), pieces.alias("pieces"))
    rows = cut.select("request_id", F.posexplode("pieces").alias("ord", "token"), F.size("pieces").alias("n"))
    return rows.select("request_id", "ord", "token", (F.col("ord") == F.col("n") - 1).alias("is_end"))


@query("k8_visible_text", with_views("messages", rf"""
SELECT message_id AS request_id, regexp_replace(CASE role WHEN 'assistant' THEN '<think>' || substr(text, 1, 25) || '</think>' || text ELSE text END,
  '(?is)<(?:{TAGS})>.*?(?:</(?:{TAGS})>|\z)|</(?:{TAGS})>', '', 'g') AS text FROM messages WHERE role = 'assistant' OR text <> ''"""))
def visible_text(t: Tables):
    return X.visible_text(_tokens(t))


@query("k9_assemble_messages", with_views("messages", """
SELECT message_id AS request_id, CASE role WHEN 'assistant' THEN '<think>' || substr(text, 1, 25) || '</think>' || text ELSE text END AS text, CASE WHEN role = 'user' THEN chat_id END AS sources
FROM messages WHERE role = 'assistant' OR text <> ''"""))
def assemble_messages(t: Tables):
    sources = t.messages.filter("role = 'user'").select(F.col("message_id").alias("request_id"), F.col("chat_id").alias("sources"))
    return X.assemble_batch(_tokens(t), sources)
