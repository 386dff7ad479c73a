"""Queries over vectors, the keyword index, fusion and lookups."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from lectern.catalog.base import Tables, query, strip_sql, with_views
from lectern.functions import codes, vectors
from lectern.operators import cells, hybrid, joins, keyword
from lectern.operators.dense import topk_above, vector_topk
from lectern.operators.embedding import embed, hashed_bag
from lectern.plans import jobs
from lectern.session import settle

K = 10


@query("r1_embed")
def embed_documents(t: Tables):
    rows = embed(t.docs.select("file_id", "text"), factory=hashed_bag(64))
    return rows.select("file_id", F.size("vector").alias("dim"), F.round(vectors.norm(F.col("vector")), 4).alias("norm"))


def _asked_vectors(t: Tables, *more: str):
    """A stated query set: every vector whose id fifty divides, against all."""
    return t.vectors.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector", *more)


@query("r2_vector_topk", f"""
WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)
SELECT query_id, chunk_id, score, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM p) WHERE n <= {K}""")
def dense_topk(t: Tables):
    return vector_topk(_asked_vectors(t), t.vectors, K)


@query("r2_vector_topk_scoped", f"""
WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 50 = 0)
SELECT query_id, chunk_id, score, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM p) WHERE n <= {K}""")
def dense_topk_scoped(t: Tables):
    return vector_topk(_asked_vectors(t, "scope"), t.vectors, K, scope=["scope"])


@query("r3_vector_topk_approx")
def dense_topk_approx(t: Tables):
    """Lines near the lines of every fiftieth document, from the cells around them; ``looked_at`` is the share of rows they
    are compared with. Recall is measured for the lines of every five hundredth document and null for the others."""
    rows = settle(embed(t.chunks.select("chunk_id", "file_id", "text"), factory=hashed_bag(64)).drop("text"), "line-vectors")
    number = F.replace("file_id", F.lit("file_"), F.lit("")).cast("long")
    q = rows.filter(number % 50 == 0).select(F.col("chunk_id").alias("query_id"), "vector", (number % 500 == 0).alias("measured"))
    known = cells.fit_cells(rows)
    placed, near = settle(cells.in_cells(rows, known), "placed"), settle(cells.in_cells(q.drop("measured"), known, cells.PROBES), "near")
    found = settle(vector_topk(near, placed, K, approx=True, centroids=known), "approximate")
    # what the cells found bounds the true best from below
    floors = found.groupBy("query_id").agg(F.when(F.count("*") == K, F.min("score")).alias("floor"))
    exact = topk_above(q.filter("measured").join(floors, "query_id", "left"), rows, K).select("query_id", "chunk_id")
    right = exact.join(found.select("query_id", "chunk_id", F.lit(1).alias("_in")), ["query_id", "chunk_id"], "left")
    recall = right.groupBy("query_id").agg(F.round(F.count("_in") / F.count("*"), 6).alias("recall"))
    share = F.round(F.col("candidates") / rows.agg(F.count("*")).scalar(), 6).alias("looked_at")
    seen = cells.looked_at(near, placed, known).select("query_id", share)
    return found.join(seen, "query_id").join(recall, "query_id", "left")


@query("j10_query_chunk_scores", """
WITH p AS (SELECT i.item_id AS query_id, b.vec_id AS chunk_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
  FROM benchmark i JOIN embeddings a ON a.vec_id = i.item_id JOIN embeddings b ON b.label = a.label)
SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM p) WHERE n <= 64""")
def query_chunk_scores(t: Tables):
    """Scores of each question within its vector's scope, to the deepest retrieval depth."""
    scopes = t.vectors.select(F.col("chunk_id").alias("query_id"), "scope")
    return vector_topk(t.asked.join(scopes, "query_id"), t.vectors, codes.MAX_DEPTH, scope=["scope"]).select("query_id", "chunk_id", "score")


@query("r4_l2_normalize", """
WITH s AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3) AS v FROM embeddings),
n AS (SELECT vec_id, v, greatest(sqrt(list_inner_product(v, v)), 1e-6) AS n FROM s)
SELECT vec_id, round(v[1] / n, 6) AS first, round(list_sum(list_transform(v, lambda x: x / n)), 6) AS total FROM n""")
def l2_normalize(t: Tables):
    tripled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3)
    rows = t.read("embeddings").select("vec_id", vectors.l2_normalize(tripled).alias("v"))
    return rows.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("r4_mean_pool", """
WITH e AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings)
SELECT label, i AS dim, round(avg(x), 6) AS mean FROM e GROUP BY ALL""")
def mean_pool(t: Tables):
    pooled = vectors.mean_pool(t.read("embeddings"), ["label"], "embedding")
    rows = pooled.select("label", F.posexplode("embedding").alias("dim", "mean"))
    return rows.select("label", F.col("dim").cast("bigint").alias("dim"), F.round("mean", 6).alias("mean"))


WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query("r5_term_index", with_views("chunks", f"""
WITH w AS (SELECT chunk_id, {WORDS} AS l FROM chunks), e AS (SELECT chunk_id, unnest(l) AS term, len(l) AS doc_len FROM w)
SELECT term, chunk_id, CAST(count(*) AS INTEGER) AS tf, CAST(any_value(doc_len) AS INTEGER) AS doc_len FROM e GROUP BY term, chunk_id"""))
def term_index(t: Tables):
    return keyword.build_term_index(t.chunks).select("term", "chunk_id", "tf", "doc_len")


@query("r5_refresh_index", f"""
WITH w AS (SELECT doc_id, 'file_' || doc_id AS file_id, {WORDS.replace('text', "CASE WHEN lang = 'en' THEN source || ' ' || text ELSE text END")} AS l, lang FROM documents),
e AS (SELECT file_id, unnest(l) AS term, lang FROM w)
SELECT term, file_id, CAST(count(*) AS INTEGER) AS tf FROM e WHERE lang <> 'de' GROUP BY term, file_id""")
def refresh_index(t: Tables):
    """English documents changed, German ones were deleted."""
    base = t.docs.select(F.col("file_id").alias("chunk_id"), "file_id", "text")
    changed = t.docs.filter("lang = 'en'").select(F.col("file_id").alias("chunk_id"), "file_id", F.concat("source", F.lit(" "), "text").alias("text"))
    gone = t.docs.filter("lang = 'de'").select("file_id")
    return keyword.refresh_term_index(keyword.build_term_index(base), changed, gone).select("term", "file_id", "tf")


@query("r6_keyword_query", r"""
WITH p AS (SELECT item_id AS query_id, regexp_extract_all(lower(replace(text, ' the ', ' the-')), '[A-Za-z0-9][A-Za-z0-9_-]{1,80}')[1:8] AS l FROM benchmark),
e AS (SELECT query_id, unnest(l) AS phrase, unnest(range(0, len(l))) AS phrase_no FROM p)
SELECT query_id, CAST(phrase_no AS INTEGER) AS phrase_no, array_to_string(regexp_extract_all(phrase, '[\p{L}\p{N}]+'), ' ') AS words FROM e""")
def keyword_query(t: Tables):
    q = t.questions.withColumn("text", F.replace("text", F.lit(" the "), F.lit(" the-")))
    return keyword.keyword_query(q).select("query_id", "phrase_no", F.array_join("words", " ").alias("words"))


def _bm25_sql(text: str) -> str:
    return with_views("chunks", rf"""
WITH w AS (SELECT chunk_id, {WORDS} AS l FROM chunks WHERE len({WORDS}) > 0),
st AS (SELECT count(*) AS n, avg(len(l)) AS avgdl FROM w),
p AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower({text}), '[A-Za-z0-9][A-Za-z0-9_-]{{1,80}}')[1:8]) AS phrase FROM benchmark),
q AS (SELECT query_id, regexp_extract_all(phrase, '[\p{{L}}\p{{N}}]+') AS ws, count(*) AS times FROM p GROUP BY ALL),
d AS (SELECT DISTINCT ws, len(ws) AS n FROM q),
tf AS (SELECT ws, chunk_id, len(l) AS dl, len(list_filter(range(1, len(l) - d.n + 2), lambda i: l[i:i + d.n - 1] = ws)) AS tf FROM d JOIN w ON list_contains(w.l, d.ws[1])),
df AS (SELECT ws, count(*) AS df FROM tf WHERE tf > 0 GROUP BY ws),
need AS (SELECT query_id, count(*) AS need FROM q GROUP BY query_id),
s AS (SELECT q.query_id, tf.chunk_id, count(*) AS got, sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s
  FROM q JOIN tf USING (ws) JOIN df USING (ws), st WHERE tf.tf > 0 GROUP BY ALL),
f AS (SELECT query_id, chunk_id, round(-s, 6) AS score FROM s JOIN need USING (query_id) WHERE got = need)
SELECT query_id, chunk_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS r FROM f) WHERE r <= 20""")


@query("r7_bm25_topk", _bm25_sql("text"))
def bm25(t: Tables):
    return keyword.bm25_topk(t.questions, t.term_index, 20).drop("file_id")


@query("r7_bm25_phrases", _bm25_sql("regexp_extract(text, '[A-Za-z]+ [A-Za-z]+', 0).replace(' ', '-')"))
def bm25_phrases(t: Tables):
    """The first two words of each question as one phrase."""
    phrase = F.replace(F.regexp_extract("text", "[A-Za-z]+ [A-Za-z]+", 0), F.lit(" "), F.lit("-"))
    return keyword.bm25_topk(t.questions.withColumn("text", phrase), t.term_index, 20).drop("file_id")


COUNT = "list_sum(list_transform(terms, lambda w: (length(body) - length(replace(body, w, ''))) // length(w)))"
TERMS = "list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_-]{1,80}'), lambda x: lower(x))[1:8]"


@query("r8_keyword_scan", with_views("chunks", f"""
WITH n AS (SELECT chunk_id, lower(text) AS body FROM chunks),
q AS (SELECT item_id AS query_id, {TERMS} AS terms FROM benchmark),
s AS (SELECT query_id, chunk_id, CAST(-{COUNT} AS DOUBLE) AS score FROM q, n)
SELECT query_id, chunk_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS r FROM s WHERE score < 0) WHERE r <= 20"""))
def keyword_scan(t: Tables):
    return keyword.keyword_scan_topk(t.questions, t.chunks, 20).drop("file_id")


DENSE = """p AS (SELECT a.query_id, i.chunk_id, i.file_id, round(list_cosine_similarity(a.vector::DOUBLE[], i.vector::DOUBLE[]), 6) AS score FROM asked a, indexed i)"""
EXACT = r"""list_filter(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_-]{3,80}'), lambda x: regexp_matches(x, '[0-9_-]'))[1:8]"""


def _legs(partition: str, depth: int) -> str:
    return f"""{DENSE}, d AS (SELECT query_id, chunk_id, file_id, row_number() OVER (PARTITION BY {partition} ORDER BY score DESC, chunk_id) AS r FROM p),
n AS (SELECT chunk_id, file_id, lower(text) AS body FROM indexed),
q AS (SELECT query_id, {TERMS} AS terms FROM asked),
k AS (SELECT query_id, chunk_id, file_id, -{COUNT} AS score FROM q, n),
s AS (SELECT query_id, chunk_id, file_id, row_number() OVER (PARTITION BY {partition} ORDER BY score, chunk_id) AS r FROM k WHERE score < 0),
b AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.chunk_id, s.chunk_id) AS chunk_id, d.r AS dr, s.r AS sr
  FROM (SELECT * FROM d WHERE r <= {depth}) d FULL OUTER JOIN (SELECT * FROM s WHERE r <= {depth}) s ON d.query_id = s.query_id AND d.chunk_id = s.chunk_id),
x AS (SELECT query_id, list_filter({EXACT}, lambda e, i: list_position({EXACT}, e) = i) AS ex FROM asked),
f AS (SELECT b.query_id, i.file_id, b.chunk_id, i.seq, round(coalesce(0.6::DOUBLE / ln(2.0::DOUBLE + dr), 0) + coalesce(0.4::DOUBLE / ln(2.0::DOUBLE + sr), 0)
  + 0.15::DOUBLE * len(list_filter(ex, lambda e: contains(lower(substr(i.text, 1, 2000)), lower(e)))), 6) AS score FROM b JOIN indexed i USING (chunk_id) JOIN x USING (query_id))"""


@query("r9_hybrid_topk", with_views("indexed asked", f"""WITH {_legs('query_id', 14)}
SELECT query_id, file_id, chunk_id, seq, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM f) WHERE r <= 14"""))
def hybrid_topk(t: Tables):
    dense = vector_topk(t.asked, t.indexed, 14)
    sparse = keyword.keyword_scan_topk(t.asked, t.indexed, 14)
    return hybrid.hybrid_topk(dense, sparse, t.asked.select("query_id", "text"), t.indexed, 14)


@query("r10_per_file_fairness", with_views("indexed asked", f"""WITH {_legs('query_id, file_id', 12)}
SELECT query_id, file_id, chunk_id, seq, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file_id ORDER BY score DESC, chunk_id) AS r FROM f) WHERE r <= 2"""))
def per_file(t: Tables):
    """Every question over all ten files, ceil(14 / 10) = 2 hits each, both legs run per file."""
    # ten labels, so ten files
    files = t.indexed.agg(F.sort_array(F.collect_set("file_id")).alias("f")).scalar()
    pairs = t.asked.withColumn("_files", files).withColumn("file_id", F.explode("_files")).drop("_files")
    asked = pairs.join(pairs.groupBy("query_id").agg(F.count("*").alias("n_files")), "query_id")
    fused = jobs.hybrid_per_file(
        asked.select("query_id", "file_id", "text"), t.indexed, t.indexed, 12,
        lambda q: q.join(t.asked.select("query_id", "vector"), "query_id"),
    )
    share = asked.select("query_id", "file_id", F.ceil(F.lit(14) / F.col("n_files")).alias("k"))
    return fused.join(share, ["query_id", "file_id"]).filter(F.col("rank") <= F.col("k")).drop("k")


@query("u2_fused_ids", with_views("indexed asked", f"WITH {_legs('query_id', 12)} SELECT query_id, chunk_id FROM b"))
def fused_ids(t: Tables):
    dense = vector_topk(t.asked, t.indexed, 12).select("query_id", "chunk_id")
    sparse = keyword.keyword_scan_topk(t.asked, t.indexed, 12).select("query_id", "chunk_id")
    return dense.join(sparse, ["query_id", "chunk_id"], "full_outer")


@query("r12_shape_hits", with_views("chunks", """
SELECT chunk_id, CASE WHEN seq % 2 = 0 THEN page_start ELSE 7 END AS page, CASE WHEN seq % 2 = 0 THEN page_start ELSE 7 END AS page_start,
  CASE WHEN seq % 2 = 0 THEN page_start ELSE 7 END AS page_end, CASE WHEN seq % 2 = 0 THEN 'a > b' END AS path, CASE WHEN seq % 2 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM chunks"""))
def shape_hits(t: Tables):
    even = F.col("seq") % 2 == 0
    rows = t.chunks.select(
        "chunk_id", "text", F.when(~even, 7).alias("page"), F.when(even, F.col("page_start")).alias("page_start"), F.lit(None).cast("int").alias("page_end"),
        F.when(even, F.array(F.lit(" a "), F.lit(""), F.lit("b"))).otherwise(F.array(F.lit(" "))).alias("section_path"), F.when(even, 0.5).alias("score"),
    )
    return hybrid.shape_hits(rows).select("chunk_id", "page", "page_start", "page_end", F.array_join("section_path", " > ").alias("path"), "score")


@query("r13_head_chunks", with_views("chunks", "SELECT chunk_id, file_id, seq FROM chunks WHERE seq < 8"))
def head_chunks(t: Tables):
    return hybrid.head_chunks(t.chunks).select("chunk_id", "file_id", "seq")


@query("r14_latest_file", with_views("chat_files", "SELECT chat_id, arg_max(file_id, linked_ord) AS file_id FROM chat_files GROUP BY chat_id"))
def latest_file(t: Tables):
    return hybrid.latest_file(t.chat_files)


@query("r15_recall_memory", f"""
WITH s AS (SELECT 'chat_' || source AS chat_id, doc_id AS memory_id, {strip_sql(r"regexp_replace(text, '\s+', ' ', 'g')")} AS t FROM documents),
c AS (SELECT chat_id, memory_id, regexp_replace(substr(t, 1, 1200), '\\s+$', '') AS text, row_number() OVER (PARTITION BY chat_id ORDER BY memory_id DESC) AS i FROM s),
h AS (SELECT *, row_number() OVER (PARTITION BY chat_id, lower(text) ORDER BY i) AS d FROM c WHERE i <= 50 AND text <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY i) AS rank FROM h WHERE d = 1)
SELECT chat_id, memory_id, text, round(greatest(0, 1 - 0.01::DOUBLE * (i - 1)), 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def recall_memory(t: Tables):
    mem = t.documents.select(F.concat(F.lit("chat_"), "source").alias("chat_id"), F.col("doc_id").alias("memory_id"), "text", F.col("doc_id").alias("created_at"))
    return hybrid.recall_memory(mem, 5).drop("created_at")


@query("r17_search", with_views("indexed asked", rf"""WITH {DENSE}, d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM p)
SELECT query_id, CAST(r AS INTEGER) AS rank, d.chunk_id, score, regexp_replace(replace(substr(i.text, 1, 400), chr(10), ' '), '\s+', ' ', 'g') AS preview
FROM d JOIN indexed i USING (chunk_id) WHERE r <= 5"""))
def search(t: Tables):
    hits = vector_topk(t.asked, t.indexed, 5)
    chunks = t.indexed.select("chunk_id", "file_id", "text")
    return hybrid.search(hits, chunks, t.files).drop("file_id", "filename")


@query("r17_search_filtered", with_views("asked", r"""
WITH i AS (SELECT 'd_' || doc_id AS chunk_id, 'file_' || label AS file_id, text, embedding AS vector FROM embeddings JOIN documents ON vec_id = doc_id
  WHERE lang = 'en' AND source = (SELECT min(source) FROM documents) AND label <= 4 AND n_chars > 300 AND n_chars BETWEEN 100 AND 100000),
p AS (SELECT a.query_id, i.chunk_id, i.text, i.file_id, round(list_cosine_similarity(a.vector::DOUBLE[], i.vector::DOUBLE[]), 6) AS score FROM asked a, i)
SELECT query_id, CAST(r AS INTEGER) AS rank, chunk_id, file_id, score, regexp_replace(replace(substr(text, 1, 400), chr(10), ' '), '\s+', ' ', 'g') AS preview
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM p) WHERE r <= 5"""))
def search_filtered(t: Tables):
    """All filters at once: a user's chunks in one chat, of five files, with one of two tags, from a span of time."""
    about = t.documents.select(
        F.concat(F.lit("d_"), "doc_id").alias("chunk_id"), F.when(F.col("lang") == "en", "ann").otherwise("bob").alias("user_id"),
        F.col("source").alias("chat_id"), F.array(F.lit("all"), F.when(F.col("n_chars") > 300, "long").otherwise("short")).alias("tags"), F.timestamp_seconds("n_chars").alias("created_at"))
    chunks = t.indexed.select("chunk_id", "file_id", "text").join(about, "chunk_id")
    first = t.documents.agg(F.min("source")).first()[0]
    found = jobs.search_chunks(
        t.asked.select("query_id", "vector"), chunks, t.indexed.select("chunk_id", "vector"), t.files, 5, user="ann", chat=first,
        file_ids=[f"file_{n}" for n in range(5)], tags=["long", "huge"], between=(datetime.fromtimestamp(100, UTC), datetime.fromtimestamp(100000, UTC)))
    return found.drop("filename")


@query("j1_enrich_chunks", with_views("hits", "SELECT query_id, chunk_id, file_id, seq, filename FROM hits"))
def enrich_chunks(t: Tables):
    return joins.enrich_chunks(t.hits.select("query_id", "chunk_id"), t.chunks, t.files).select("query_id", "chunk_id", "file_id", "seq", "filename")


@query("j2_merge_hit_metadata", """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.source ELSE 'label' END AS source, d.lang AS lang, CASE WHEN l.doc_id IS NULL THEN 'payload' ELSE 'stored' END AS origin,
  CASE WHEN l.doc_id IS NOT NULL THEN CAST(quality AS VARCHAR) END AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def merge_hit_metadata(t: Tables):
    """Documents as hits whose payload the labels table overrides."""
    hits = t.documents.select(F.col("doc_id").alias("chunk_id"), "source", F.create_map(F.lit("lang"), "lang", F.lit("origin"), F.lit("payload")).alias("metadata"))
    detail = t.read("labels").select(F.col("doc_id").alias("chunk_id"), F.lit("label").alias("source"),
                                     F.create_map(F.lit("origin"), F.lit("stored"), F.lit("quality"), F.col("quality").cast("string")).alias("metadata"))
    out = joins.merge_hit_metadata(hits, detail, ["source"])
    key = lambda k: F.try_element_at("metadata", F.lit(k)).alias(k)
    return out.select(F.col("chunk_id").alias("doc_id"), "source", key("lang"), key("origin"), key("quality"))


@query("j3_files_for_chat", with_views("chat_files files", "SELECT chat_id, linked_ord, file_id, filename FROM chat_files JOIN files USING (file_id)"))
def files_for_chat(t: Tables):
    return joins.files_for_chat(t.chat_files, t.files)


@query("j4_file_status_for_chat", with_views("chat_files files", "SELECT file_id, status FROM files WHERE file_id IN (SELECT file_id FROM chat_files WHERE chat_id = 'chat_fr')"))
def file_status_for_chat(t: Tables):
    return joins.file_status_for_chat(t.chat_files, t.files, "chat_fr").select("file_id", "status")


@query("j5_active_jobs", with_views("chat_files files jobs", """
SELECT chat_id, job_id, status, filename, CAST(n AS INTEGER) AS job_rank FROM (SELECT c.chat_id, j.job_id, j.status, f.filename, row_number() OVER (PARTITION BY chat_id ORDER BY j.created_at DESC, job_id) AS n
  FROM jobs j JOIN chat_files c USING (file_id) JOIN files f USING (file_id) WHERE j.status IN ('queued', 'running'))"""))
def active_jobs(t: Tables):
    return joins.active_jobs(t.jobs, t.chat_files, t.files).select("chat_id", "job_id", "status", "filename", "job_rank")


@query("j6_seq_range_join", with_views("hits", "SELECT h.query_id, h.chunk_id AS anchor, c.chunk_id FROM hits h JOIN chunks c ON c.file_id = h.file_id AND c.seq BETWEEN h.seq - 2 AND h.seq + 2"))
def seq_range_join(t: Tables):
    windows = t.hits.select("query_id", F.col("chunk_id").alias("anchor"), "file_id", (F.col("seq") - 2).alias("seq_start"), (F.col("seq") + 2).alias("seq_end"))
    return joins.seq_range_join(windows, t.chunks.select("file_id", "seq", "chunk_id")).select("query_id", "anchor", "chunk_id")


@query("j7_line_range_join", with_views("lines", "SELECT d.doc_id, line_no, line FROM documents d JOIN lines l ON l.file_id = 'file_' || d.doc_id AND line_no BETWEEN n_chars // 1000 AND n_chars // 500"))
def line_range_join(t: Tables):
    windows = t.docs.select(F.col("doc_id").alias("w"), "file_id", F.floor(F.col("n_chars") / 1000).alias("line_start"), F.floor(F.col("n_chars") / 500).alias("line_end"))
    return joins.line_range_join(windows, t.lines.drop("doc_id")).select(F.col("w").alias("doc_id"), "line_no", "line")


INDEX_SQL = """
s AS (SELECT 'file_' || lang AS file_id, doc_id AS chunk_id FROM documents WHERE source <> 'src1'),
v AS (SELECT 'file_' || lang AS file_id, doc_id AS chunk_id FROM documents WHERE source <> 'src2'),
b AS (SELECT coalesce(s.file_id, v.file_id) AS file_id, coalesce(s.chunk_id, v.chunk_id) AS chunk_id, s.chunk_id IS NOT NULL AS stored, v.chunk_id IS NOT NULL AS indexed FROM s FULL OUTER JOIN v ON s.chunk_id = v.chunk_id)"""


def _stores(t: Tables):
    rows = t.documents.select(F.concat(F.lit("file_"), "lang").alias("file_id"), F.col("doc_id").alias("chunk_id"), "text", "source")
    return rows.filter("source <> 'src1'"), rows.filter("source <> 'src2'")


@query("j8_validate_index", f"""WITH {INDEX_SQL}
SELECT file_id, count(*) FILTER (stored) AS stored_chunks, count(*) FILTER (indexed) AS indexed_points, count(*) FILTER (NOT indexed) AS missing,
  count(*) FILTER (NOT stored) AS orphan, bool_and(stored AND indexed) AS ok FROM b GROUP BY file_id""")
def validate_index(t: Tables):
    return joins.validate_index(*_stores(t))


@query("u3_index_difference", f"WITH {INDEX_SQL} SELECT chunk_id, CASE WHEN stored THEN 'missing' ELSE 'orphan' END AS issue FROM b WHERE NOT (stored AND indexed)")
def index_difference(t: Tables):
    return joins.index_issues(*_stores(t)).filter("issue is not null").select("chunk_id", "issue")


@query("j9_repair_index", f"""WITH {INDEX_SQL}
SELECT file_id, count(*) FILTER (NOT indexed) AS missing, count(*) FILTER (NOT stored) AS orphan, count(*) FILTER (NOT indexed) AS repaired, 0::BIGINT AS missing_after, 0::BIGINT AS orphan_after FROM b GROUP BY file_id""")
def repair_index(t: Tables):
    stored, indexed = _stores(t)
    _, report = joins.repair_index(stored, embed(indexed).select("file_id", "chunk_id", "vector"), embed, delete_orphans=True)
    return report.select("file_id", "missing", "orphan", "repaired", "missing_after", "orphan_after")


@query("d8_index_health")
def index_health(t: Tables):
    stored, indexed = _stores(t)
    _, fixed, _ = jobs.index_health(stored, embed(indexed).select("file_id", "chunk_id", "vector"), delete_orphans=True)
    return fixed.select("file_id", "chunk_id", F.size("vector").alias("dim"))


@query("j11_merge_predictions", """
SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NOT NULL AND quality = 1 THEN NULL WHEN l.doc_id IS NOT NULL THEN 'predicted' ELSE d.source END AS answer,
  CASE WHEN l.doc_id IS NOT NULL AND toxic = 1 THEN 1.5 ELSE 0.5 END::DOUBLE AS latency_ms FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def merge_predictions(t: Tables):
    gold = t.documents.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("answer"), F.lit(0.5).alias("latency_ms"))
    pred = t.read("labels").select(
        F.concat(F.lit(" "), F.col("doc_id").cast("string")).alias("id"), F.when(F.col("quality") == 0, "predicted").alias("answer"), F.lit(True).alias("has_answer"),
        F.lit(1.5).alias("latency_ms"), (F.col("toxic") == 1).alias("has_latency_ms"), F.lit(1).alias("ord"),
    )
    return joins.merge_predictions(gold, pred, ["answer", "latency_ms"]).withColumn("id", F.col("id").cast("bigint"))


@query("j12_unreferenced_files", with_views("chat_files", """
SELECT DISTINCT file_id FROM chat_files c WHERE chat_id IN ('chat_src1', 'chat_src2', 'chat_fr') AND NOT EXISTS
  (SELECT 1 FROM chat_files o WHERE o.file_id = c.file_id AND o.chat_id NOT IN ('chat_src1', 'chat_src2', 'chat_fr'))"""))
def unreferenced_files(t: Tables):
    gone = t.chat_files.filter(F.col("chat_id").isin("chat_src1", "chat_src2", "chat_fr")).select("chat_id")
    return joins.unreferenced_files(gone, t.chat_files)
