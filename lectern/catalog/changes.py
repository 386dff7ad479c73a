"""Queries for keyed table changes, messages, memories, chats, jobs and column encryption."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.catalog.base import Tables, query, strip_sql, tokens_sql, with_views
from lectern.operators import maintenance as M
from lectern.sources import audit, tables

NOW = 1700000000


def _labels(t: Tables):
    return t.read("labels").select("doc_id", F.col("quality").cast("string").alias("status"), F.lit(-1).cast("bigint").alias("created_at"), F.col("toxic").alias("ord"))


def _base(t: Tables):
    return t.documents.select("doc_id", F.col("lang").alias("status"), F.col("doc_id").alias("created_at"))


@query("s10_upsert", """
WITH c AS (SELECT doc_id, CAST(quality AS VARCHAR) AS status FROM labels UNION ALL SELECT doc_id + 1000000, 'new' FROM labels)
SELECT coalesce(c.doc_id, d.doc_id) AS doc_id, coalesce(c.status, d.lang) AS status, coalesce(d.doc_id, -1) AS created_at FROM documents d FULL OUTER JOIN c ON c.doc_id = d.doc_id""")
def upsert(t: Tables):
    """Labels change known documents twice, the later change wins, and add as many new ones."""
    changes = _labels(t).withColumn("ord", F.lit(2))
    stale = changes.withColumn("status", F.lit("stale")).withColumn("ord", F.lit(1))
    new = changes.withColumn("doc_id", F.col("doc_id") + 1000000).withColumn("status", F.lit("new"))
    return tables.upsert(_base(t), changes.unionByName(stale).unionByName(new), ["doc_id"], ["created_at"], ["ord"])


@query("s11_insert_ignore", """
SELECT doc_id, lang AS status, doc_id AS created_at FROM documents UNION ALL SELECT doc_id + 1000000, CAST(quality AS VARCHAR), -1 FROM labels""")
def insert_ignore(t: Tables):
    changes = _labels(t).drop("ord")
    new = changes.withColumn("doc_id", F.col("doc_id") + 1000000)
    return tables.insert_ignore(_base(t), changes.unionByName(new).unionByName(new), ["doc_id"])


@query("s12_split_by_dimension", "SELECT label, count(*) FILTER (label < 5) AS accepted, count(*) FILTER (label >= 5) AS rejected FROM embeddings GROUP BY label")
def split_by_dimension(t: Tables):
    """Versions below 5 expect 64 values, the others 32."""
    rows = t.read("embeddings").select("label", F.col("embedding").alias("vector"), F.lit("m").alias("embedding_model"), F.col("label").alias("embedding_version"))
    dims = rows.groupBy("embedding_model", "embedding_version").agg(F.when(F.first("label") < 5, 64).otherwise(32).alias("dim"))
    good, bad = tables.split_by_dimension(rows, dims)
    both = good.select("label", F.lit(1).alias("ok")).unionByName(bad.select("label", F.lit(0).alias("ok")))
    return both.groupBy("label").agg(F.count_if(F.col("ok") == 1).alias("accepted"), F.count_if(F.col("ok") == 0).alias("rejected"))


@query("s14_verify_checksums", """
SELECT doc_id, lang <> 'es' AS "exists", CASE WHEN lang = 'es' THEN NULL ELSE lang <> 'de' END AS sha256_match FROM documents""")
def verify_checksums(t: Tables):
    """Spanish files are gone, German ones changed."""
    path = F.concat(F.lit("/f/"), F.col("doc_id").cast("string"))
    files = t.documents.filter("lang <> 'es'").select(path.alias("path"), F.when(F.col("lang") == "de", F.lit("changed")).otherwise(F.col("text")).cast("binary").alias("content"))
    registry = t.documents.select("doc_id", path.alias("path"), F.upper(F.sha2(F.col("text").cast("binary"), 256)).alias("expected_sha256"))
    out = audit.verify_checksums(registry.drop("doc_id"), files)
    return out.select(F.substring_index("path", "/", -1).cast("bigint").alias("doc_id"), "exists", "sha256_match")


@query("s15_encryption_round_trip", """
SELECT doc_id, text AS opened, CASE WHEN text = '' THEN '' ELSE 'enc:v1:' END AS prefix, '' AS wrong_key FROM documents""")
def encryption(t: Tables):
    key, other = b"0123456789abcdef", b"fedcba9876543210"
    rows = t.documents.select("doc_id", audit.encrypt_text(audit.encrypt_text(F.col("text"), key), key).alias("sealed"))
    return rows.select("doc_id", audit.decrypt_text(F.col("sealed"), key).alias("opened"), F.substr("sealed", F.lit(1), F.lit(7)).alias("prefix"),
                       audit.decrypt_text(F.col("sealed"), other).alias("wrong_key"))


@query("m1_apply_updates", "SELECT d.doc_id, CASE WHEN quality = 1 THEN 'indexed' ELSE lang END AS status, d.doc_id AS created_at FROM documents d LEFT JOIN labels USING (doc_id)")
def apply_updates(t: Tables):
    changes = t.read("labels").select("doc_id", F.when(F.col("quality") == 1, "indexed").alias("status"))
    return M.apply_updates(_base(t), changes, ["doc_id"])


CUT = "c AS (SELECT chat_id, min(created_s) AS cut FROM messages WHERE role = 'assistant' AND length(text) > 150 GROUP BY chat_id)"


@query("m2_truncate_after", with_views("messages", f"WITH {CUT} SELECT m.message_id FROM messages m LEFT JOIN c USING (chat_id) WHERE cut IS NULL OR created_s <= cut"))
def truncate_after(t: Tables):
    cut = t.messages.filter("role = 'assistant' and length(text) > 150").select("message_id")
    return M.truncate_after(t.messages, cut).select("message_id")


@query("m3_edit_message", with_views("messages", """
WITH u AS (SELECT chat_id, min(pos) AS p FROM messages WHERE role = 'user' GROUP BY chat_id)
SELECT message_id, CASE WHEN pos = p THEN 'new text' ELSE text END AS text FROM messages LEFT JOIN u USING (chat_id) WHERE p IS NULL OR pos <= p"""))
def edit_message(t: Tables):
    """The first message of every role is edited; only the user's edits apply."""
    first = t.messages.groupBy("chat_id", "role").agg(F.min_by("message_id", "pos").alias("message_id"))
    edits = first.select("chat_id", "message_id", F.lit(" new text ").alias("new_text"))
    return M.edit_message(t.messages, edits)[0].select("message_id", "text")


@query("m3_rejected_edits", with_views("messages", """
SELECT arg_min(message_id, pos) AS message_id, 'only user messages can be edited' AS reason FROM messages WHERE role <> 'user' GROUP BY chat_id, role"""))
def rejected_edits(t: Tables):
    first = t.messages.groupBy("chat_id", "role").agg(F.min_by("message_id", "pos").alias("message_id"))
    edits = first.select("chat_id", "message_id", F.lit(" new text ").alias("new_text"))
    return M.edit_message(t.messages, edits)[1].select("message_id", "reason")


@query("m4_branch_chats", with_views("chat_files", """
SELECT chat_id, file_id FROM chat_files UNION ALL SELECT 'child_' || chat_id, file_id FROM chat_files WHERE chat_id <> 'chat_fr'"""))
def branch_chats(t: Tables):
    """Every chat is branched; the French one keeps its documents to itself."""
    pages = t.chat_files.select("chat_id", "file_id", F.lit("{}").alias("doc"))
    asks = t.chat_files.select("chat_id").distinct().select(
        F.concat(F.lit("child_"), "chat_id").alias("child_chat_id"), F.col("chat_id").alias("parent_chat_id"), F.concat(F.lit("b_"), "chat_id").alias("message_id"),
        F.lit("user").alias("role"), F.lit("go on").alias("text"), (F.col("chat_id") != "chat_fr").alias("share_docs"), F.lit(NOW).cast("bigint").alias("created_s"),
        F.lit(1).cast("bigint").alias("linked_ord"),
    )
    return M.branch_chats(asks, t.chat_files, pages, t.messages)[0].select("chat_id", "file_id")


def _memories(t: Tables):
    day = 86400
    return t.documents.select(
        F.col("doc_id").cast("string").alias("memory_id"), F.concat(F.lit("chat_"), "source").alias("chat_id"), F.lit("summary").alias("type"), "text",
        F.when(F.col("lang") == "es", 0).otherwise(F.lit(NOW) - (F.col("doc_id") % 60) * day).cast("bigint").alias("created_at"),
    )


@query("m5_save_memories", rf"""
WITH old AS (SELECT CAST(doc_id AS VARCHAR) AS memory_id, 'chat_' || source AS chat_id, text, CASE WHEN lang = 'es' THEN 0 ELSE {NOW} - (doc_id % 60) * 86400 END AS made, 0 AS fresh FROM documents),
new AS (SELECT 'n' || doc_id AS memory_id, 'chat_' || source AS chat_id, text, {NOW} AS made, 1 AS fresh FROM (
  SELECT d.doc_id, source, regexp_replace({strip_sql(r"regexp_replace(text, '\s+', ' ', 'g')")}[1:1200], '\s+$', '') AS text FROM documents d JOIN labels USING (doc_id) WHERE source <> 'src1' AND toxic = 1) WHERE text <> ''),
b AS (SELECT * FROM old UNION ALL SELECT * FROM new),
w AS (SELECT *, chat_id IN (SELECT chat_id FROM new) AS touched, row_number() OVER (PARTITION BY chat_id, lower(text) ORDER BY fresh DESC, made DESC, memory_id) AS n FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY made DESC, fresh DESC, memory_id) AS r FROM w WHERE touched AND n = 1)
SELECT memory_id, CAST(made AS BIGINT) AS created_at FROM w WHERE NOT touched UNION ALL SELECT memory_id, made FROM k WHERE r <= 8 AND (made = 0 OR made >= {NOW - 30 * 86400})""")
def save_memories(t: Tables):
    """Toxic documents of all sources but one bring a new memory to their chat."""
    new = t.documents.join(t.read("labels").filter("toxic = 1"), "doc_id").filter("source <> 'src1'").select(
        F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("memory_id"), F.concat(F.lit("chat_"), "source").alias("chat_id"), F.lit("summary").alias("type"), "text")
    return M.save_memories(_memories(t), new, NOW).select("memory_id", "created_at")


def _versioned(t: Tables):
    none = F.lit(None)
    return t.messages.select(
        "message_id", "text", none.cast("array<string>").alias("versions"), none.cast("array<array<string>>").alias("version_sources"),
        none.cast("int").alias("active_version"), F.when(F.col("role") == "user", F.array(F.lit("a"))).alias("citations"),
    )


@query("m6_append_version", with_views("messages", """
SELECT message_id, CASE WHEN role = 'assistant' THEN 'again' ELSE text END AS text, CASE WHEN role = 'assistant' THEN text || '|again' ELSE '' END AS versions,
  CASE WHEN role = 'assistant' THEN '|s' ELSE '' END AS sources, CASE WHEN role = 'assistant' THEN 1 END AS active_version FROM messages WHERE text <> ''"""))
def append_version(t: Tables):
    """The assistant answers once more, with one source."""
    more = t.messages.filter("role = 'assistant'").select("message_id", F.lit("again").alias("new_text"), F.array(F.lit("s")).alias("new_sources"))
    out = M.append_version(_versioned(t).filter("text <> ''"), more)
    flat = F.transform("version_sources", lambda s: F.array_join(s, ","))
    return out.select("message_id", "text", F.coalesce(F.array_join("versions", "|"), F.lit("")).alias("versions"), F.coalesce(F.array_join(flat, "|"), F.lit("")).alias("sources"), "active_version")


@query("m6_switch_version", with_views("messages", """
SELECT message_id, CASE WHEN role = 'user' THEN 'c' WHEN role = 'assistant' THEN 'b' ELSE text END AS text, CASE WHEN role = 'user' THEN 2 WHEN role = 'assistant' THEN 1 ELSE 0 END AS active_version FROM messages"""))
def switch_version(t: Tables):
    """Users step back past the first version, assistants step forward, the rest have nothing to switch to."""
    rows = _versioned(t).join(t.messages.select("message_id", "role"), "message_id").withColumn(
        "versions", F.when(F.col("role") != "system", F.array(F.lit("a"), F.lit("b"), F.lit("c")))).withColumn("active_version", F.lit(0))
    moves = t.messages.select("message_id", F.when(F.col("role") == "user", -1).otherwise(1).alias("direction"))
    return M.switch_version(rows, moves).select("message_id", "text", "active_version")


@query("m7_delete_chats", with_views("chat_files chunks", """
WITH g AS (SELECT DISTINCT file_id FROM chat_files WHERE chat_id IN ('chat_src1', 'chat_de') AND file_id NOT IN (SELECT file_id FROM chat_files WHERE chat_id NOT IN ('chat_src1', 'chat_de')))
SELECT 'chat_files' AS "table", count(*) FILTER (chat_id IN ('chat_src1', 'chat_de')) AS deleted FROM chat_files
UNION ALL SELECT 'files', (SELECT count(*) FROM g) UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE file_id IN (SELECT file_id FROM g)"""))
def delete_chats(t: Tables):
    ids = t.chat_files.filter(F.col("chat_id").isin("chat_src1", "chat_de")).select("chat_id")
    return M.delete_chats(ids, {"chat_files": t.chat_files, "files": t.files, "chunks": t.chunks})[1]


@query("m8_delete_where", with_views("chunks", "SELECT chunk_id FROM chunks WHERE file_id NOT IN (SELECT 'file_' || doc_id FROM labels)"))
def delete_where(t: Tables):
    keys = t.read("labels").select(F.concat(F.lit("file_"), F.col("doc_id").cast("string")).alias("file_id"))
    return M.delete_where(t.chunks, keys).select("chunk_id")


FULL = f"""u AS (SELECT chat_id, sum({tokens_sql('text')}) AS used FROM messages GROUP BY chat_id),
f AS (SELECT chat_id FROM u WHERE used >= 0.7 * 512), n AS (SELECT m.*, row_number() OVER (PARTITION BY chat_id ORDER BY pos DESC) AS r FROM messages m JOIN f USING (chat_id) WHERE role <> 'system')"""


@query("m9_compact_kept", with_views("messages", f"WITH {FULL} SELECT message_id FROM messages WHERE message_id NOT IN (SELECT message_id FROM n WHERE r > 4)"))
def compact_kept(t: Tables):
    return M.compact(t.messages, 512)[0].select("message_id")


@query("m9_compact_summaries", with_views("messages", rf"""WITH {FULL},
o AS (SELECT chat_id, string_agg(text, ' ' ORDER BY pos) AS text FROM n WHERE r > 4 AND text <> '' GROUP BY chat_id),
s AS (SELECT chat_id, text, list_filter(list_transform(regexp_extract_all({strip_sql('text')}, '(?s).*?(?:[.!?](?:\s+|\z)|\z)'), lambda x: {strip_sql('x')}), lambda x: x <> '')[1:3] AS p FROM o),
l AS (SELECT *, 1 + length(p[1]) AS l1, 1 + length(p[1]) + length(p[2]) AS l2, 2 + length(p[1]) + length(p[2]) + length(p[3]) AS l3 FROM s),
k AS (SELECT *, CASE WHEN len(p) < 1 OR l1 > 600 THEN 0 WHEN len(p) < 2 OR l2 > 600 THEN 1 WHEN len(p) < 3 OR l3 > 600 THEN 2 ELSE 3 END AS k FROM l)
SELECT chat_id, CASE WHEN k = 0 THEN substr(text, 1, 600) ELSE array_to_string(p[1:k], ' ') END AS text FROM k"""))
def compact_summaries(t: Tables):
    return M.compact(t.messages, 512)[1]


@query("m10_plan_retries", """
WITH f AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'RATE_LIMIT' WHEN 'fr' THEN 'EMBEDDING_TIMEOUT' WHEN 'de' THEN 'EXTRACTION_FAILED' ELSE 'UNKNOWN' END AS error_code, length(source) - 3 AS n FROM documents)
SELECT doc_id, error_code, error_code IN ('RATE_LIMIT', 'EMBEDDING_TIMEOUT') AND n < 3 AS retry,
  CASE WHEN error_code IN ('RATE_LIMIT', 'EMBEDDING_TIMEOUT') AND n < 3 THEN least(900, 15 * pow(2, n))::DOUBLE END AS delay_s FROM f""")
def plan_retries(t: Tables):
    name = F.when(F.col("lang") == "en", "RateLimitError").when(F.col("lang") == "fr", "DeadlineExceeded").when(F.col("lang") == "de", "ExtractionError").otherwise("Oops")
    rows = t.documents.select("doc_id", name.alias("exception_name"), (F.length("source") - 3).alias("retry_count"))
    return M.plan_retries(rows, NOW, jitter=0.0).select("doc_id", "error_code", "retry", "delay_s")


@query("m11_reconcile_jobs", with_views("jobs", """
SELECT job_id, CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('queued', 'running') THEN 'stale job from previous run' END AS error FROM jobs"""))
def reconcile_jobs(t: Tables):
    return M.reconcile_jobs(t.jobs, t.files)[0].select("job_id", "status", "error")


@query("m11_reconcile_files", with_views("jobs files", """
SELECT f.file_id, CASE WHEN j.status IN ('queued', 'running') THEN 'failed' ELSE f.status END AS status FROM files f JOIN jobs j USING (file_id)"""))
def reconcile_files(t: Tables):
    return M.reconcile_jobs(t.jobs, t.files)[1].select("file_id", "status")


@query("k10_due_retries", "SELECT doc_id FROM documents WHERE lang <> 'en' AND n_chars <= 2000")
def due_retries(t: Tables):
    rows = t.documents.select("doc_id", F.when(F.col("lang") != "en", F.timestamp_seconds("n_chars")).alias("next_retry_at"))
    return M.due_retries(rows, F.timestamp_seconds(F.lit(2000))).select("doc_id")
