"""Registry of named queries, the derived input tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import words
from lectern.operators.keyword import build_term_index
from lectern.operators.ranking import top_per_group
from lectern.operators.scan import to_lines
from lectern.plans.jobs import line_chunks
from lectern.session import settle
from lectern.sources.tables import spread_small_source

Query = Callable[["Tables"], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
HITS_PER_QUERY = 40


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


class Tables:
    """The provided tables and the tables derived from them, by attribute."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df

    @cached_property
    def documents(self) -> DataFrame:
        return spread_small_source(self.read("documents"), "doc_id")

    @cached_property
    def docs(self) -> DataFrame:
        return self.documents.withColumn("file_id", _file_id())

    @cached_property
    def lines(self) -> DataFrame:
        return to_lines(self.docs.select("file_id", "doc_id", "text"))

    @cached_property
    def chunks(self) -> DataFrame:
        rows = line_chunks(self.docs.select("file_id", "doc_id", "source", "text")).drop("content_id")
        page = (1 + F.floor((F.col("line_no") - 1) / 5)).cast("int")
        return rows.select(
            "file_id", "seq",
            F.concat(F.lit("c_"), F.col("doc_id").cast("string"), F.lit("_"), F.col("line_no").cast("string")).alias("chunk_id"),
            "text", F.concat(F.lit("chat_"), F.col("source")).alias("chat_id"),
            (F.col("doc_id") * 100000 + F.col("line_no")).alias("created_ord"), page.alias("page_start"), page.alias("page_end"),
        )

    @cached_property
    def term_index(self) -> DataFrame:
        """The keyword index as the stored table it is meant to be."""
        return settle(build_term_index(self.chunks), "terms")

    @cached_property
    def questions(self) -> DataFrame:
        return self.read("benchmark").select(F.col("item_id").alias("query_id"), "text")

    @cached_property
    def files(self) -> DataFrame:
        status = (
            F.when(F.col("lang") == "en", "completed").when(F.col("lang") == "fr", "processing")
            .when(F.col("lang") == "de", "failed").otherwise("pending")
        )
        return self.documents.select(
            _file_id(), F.concat("source", F.lit("_"), "lang", F.lit(".txt")).alias("filename"),
            (F.col("n_chars") * 2000).alias("size_bytes"), status.alias("status"), F.col("doc_id").alias("created_ord"),
        )

    @cached_property
    def chat_files(self) -> DataFrame:
        own = self.documents.select(
            F.concat(F.lit("chat_"), "source").alias("chat_id"), _file_id(), F.col("doc_id").alias("linked_ord")
        )
        shared = self.documents.filter("lang <> 'en'").select(
            F.concat(F.lit("chat_"), "lang").alias("chat_id"), _file_id(), (F.col("doc_id") + 1000000).alias("linked_ord")
        )
        return own.unionByName(shared)

    @cached_property
    def messages(self) -> DataFrame:
        conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
        return self.read("conversations").select(
            F.concat(F.lit("m_"), conv, F.lit("_"), turn).alias("message_id"), F.concat(F.lit("chat_"), conv).alias("chat_id"),
            "role", "text", (F.lit(1700000000) + F.col("conv_id") * 10000 + F.col("turn") * 60).alias("created_s"),
            F.col("turn").alias("pos"),
        )

    @cached_property
    def asks(self) -> DataFrame:
        """Questions of every intent, made from the conversations' texts by turn."""
        t = F.col("turn")
        ask = (
            F.when(t == 0, F.lit("Hello!")).when(t == 1, F.lit("Compare  docs.")).when(t == 2, F.lit(" Summarize this "))
            .when(t == 3, F.concat(F.lit('extract "'), F.substr("text", F.lit(1), F.lit(30)), F.lit('" and doc_id-7 from '), "text"))
            .when(t == 4, F.concat(F.lit("Why "), "text")).when(t == 5, F.concat(F.lit("where is "), "text", F.lit(" on page 3?")))
            .when(t == 6, F.col("text")).otherwise(F.lit("explain"))
        )
        return self.read("conversations").select(
            F.concat(F.col("conv_id").cast("string"), F.lit("_"), t.cast("string")).alias("query_id"), "conv_id", "turn", "role",
            ask.alias("ask"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.read("embeddings").select(
            F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"),
            F.concat(F.lit("scope_"), F.col("label").cast("string")).alias("scope"),
        )

    @cached_property
    def indexed(self) -> DataFrame:
        """Documents that also have a vector; ten files by label, seq by document number."""
        vecs = self.read("embeddings")
        return vecs.join(self.documents, F.col("vec_id") == F.col("doc_id")).select(
            F.concat(F.lit("file_"), F.col("label").cast("string")).alias("file_id"), F.col("doc_id").cast("int").alias("seq"),
            F.concat(F.lit("d_"), F.col("doc_id").cast("string")).alias("chunk_id"), "text",
            F.col("embedding").alias("vector"), F.col("doc_id").alias("created_ord"),
        )

    @cached_property
    def asked(self) -> DataFrame:
        """Benchmark texts with a vector each."""
        vecs = self.read("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
        return self.questions.join(vecs, "query_id")

    @cached_property
    def requests(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_id").alias("id"), "ts", F.col("event_type").alias("endpoint"), F.col("user_id").alias("worker"),
            F.col("value").alias("latency_ms"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        )

    @cached_property
    def job_events(self) -> DataFrame:
        kind = F.col("event_type")
        status = (
            F.when(kind == "signup", "queued").when(kind.isin("click", "view"), "running")
            .when(kind == "purchase", "completed").otherwise("failed")
        )
        return self.read("events").select(
            F.concat(F.lit("job_"), F.col("user_id").cast("string")).alias("job_id"), "ts", F.col("event_id").alias("ord"),
            status.alias("status"),
        )

    @cached_property
    def jobs(self) -> DataFrame:
        """One job per document; its state follows the document's language."""
        status = (
            F.when(F.col("lang") == "en", "completed").when(F.col("lang") == "fr", "running")
            .when(F.col("lang") == "de", "failed").otherwise("queued")
        )
        return self.documents.select(
            F.concat(F.lit("job_"), F.col("doc_id").cast("string")).alias("job_id"), _file_id(), status.alias("status"),
            F.lit(None).cast("string").alias("error"), F.col("doc_id").alias("created_at"),
        )

    @cached_property
    def hits(self) -> DataFrame:
        """Ranked hits: chunks sharing the most words of seven letters or more with a benchmark text, forty per query."""
        long_words = F.filter(F.array_distinct(words(F.lower("text"))), lambda w: F.length(w) >= 7)
        mine = self.questions.select("query_id", F.explode(long_words).alias("word"))
        theirs = self.chunks.select("chunk_id", F.explode(long_words).alias("word"))
        shared = mine.join(theirs, "word").groupBy("query_id", "chunk_id").agg(F.count("*").alias("n"))
        best = top_per_group(shared, ["query_id"], [F.desc("n"), "chunk_id"], HITS_PER_QUERY, rank_col="pos")
        detail = self.chunks.select("chunk_id", "file_id", "seq", "text", "page_start", "page_end")
        rows = best.join(detail, "chunk_id").join(self.files.select("file_id", "filename"), "file_id").select(
            "query_id", "pos", F.col("file_id").alias("doc_id"), "file_id", "chunk_id", "seq", "text",
            F.round(F.col("n") / 8.0, 6).alias("score"), "filename", F.lit(None).cast("int").alias("page"), "page_start", "page_end",
        )
        return settle(rows, "hits")

    @cached_property
    def blocks(self) -> DataFrame:
        """Blocks made from lines: short lines are headings, long ones name a page."""
        n = F.length("line")
        return self.lines.filter("line <> ''").select(
            "file_id", (F.col("line_no") - 1).alias("idx"),
            F.when(n < 90, "heading").when(n < 200, "list").otherwise("paragraph").alias("kind"),
            F.col("line").alias("text"), F.when(n > 400, F.col("line_no")).alias("page"),
            F.when(n < 90, (n % 6 + 1).cast("int")).alias("level"),
            F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("boolean").alias("ocr"),
        )


def _file_id():
    return F.concat(F.lit("file_"), F.col("doc_id").cast("string")).alias("file_id")


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words_sql(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def ordered_distinct_sql(x: str) -> str:
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def tokens_sql(x: str) -> str:
    return f"CASE WHEN length({x}) = 0 THEN 0 ELSE greatest(1, length({x}) // 4) END"


# The same derived tables in DuckDB.
VIEWS = {
    "docs": "SELECT *, 'file_' || doc_id AS file_id FROM documents",
    "lines": """SELECT file_id, doc_id, CAST(unnest(range(1, len(s) + 1)) AS INTEGER) AS line_no, unnest(s) AS line
        FROM (SELECT doc_id, 'file_' || doc_id AS file_id, string_split(text, chr(10)) AS s FROM documents)""",
    "chunks": """SELECT l.file_id, CAST(row_number() OVER (PARTITION BY l.doc_id ORDER BY line_no) - 1 AS INTEGER) AS seq,
        'c_' || l.doc_id || '_' || line_no AS chunk_id, line AS text, 'chat_' || d.source AS chat_id,
        l.doc_id * 100000 + line_no AS created_ord, CAST(1 + (line_no - 1) // 5 AS INTEGER) AS page_start,
        CAST(1 + (line_no - 1) // 5 AS INTEGER) AS page_end
        FROM lines l JOIN documents d ON d.doc_id = l.doc_id WHERE length(line) > 0""",
    "questions": "SELECT item_id AS query_id, text FROM benchmark",
    "files": """SELECT 'file_' || doc_id AS file_id, source || '_' || lang || '.txt' AS filename, n_chars * 2000 AS size_bytes,
        CASE lang WHEN 'en' THEN 'completed' WHEN 'fr' THEN 'processing' WHEN 'de' THEN 'failed' ELSE 'pending' END AS status,
        doc_id AS created_ord FROM documents""",
    "chat_files": """SELECT 'chat_' || source AS chat_id, 'file_' || doc_id AS file_id, doc_id AS linked_ord FROM documents
        UNION ALL SELECT 'chat_' || lang, 'file_' || doc_id, doc_id + 1000000 FROM documents WHERE lang <> 'en'""",
    "messages": """SELECT 'm_' || conv_id || '_' || turn AS message_id, 'chat_' || conv_id AS chat_id, role, text,
        1700000000 + conv_id * 10000 + turn * 60 AS created_s, turn AS pos FROM conversations""",
    "asks": """SELECT conv_id || '_' || turn AS query_id, conv_id, turn, role, CASE turn WHEN 0 THEN 'Hello!' WHEN 1 THEN 'Compare  docs.'
        WHEN 2 THEN ' Summarize this ' WHEN 3 THEN 'extract "' || substr(text, 1, 30) || '" and doc_id-7 from ' || text
        WHEN 4 THEN 'Why ' || text WHEN 5 THEN 'where is ' || text || ' on page 3?' WHEN 6 THEN text ELSE 'explain' END AS ask
        FROM conversations""",
    "vectors": "SELECT vec_id AS chunk_id, embedding AS vector, 'scope_' || label AS scope FROM embeddings",
    "indexed": """SELECT 'file_' || label AS file_id, CAST(doc_id AS INTEGER) AS seq, 'd_' || doc_id AS chunk_id, text,
        embedding AS vector, doc_id AS created_ord FROM embeddings JOIN documents ON vec_id = doc_id""",
    "asked": "SELECT item_id AS query_id, text, embedding AS vector FROM benchmark JOIN embeddings ON vec_id = item_id",
    "requests": """SELECT event_id AS id, ts, event_type AS endpoint, user_id AS worker, value AS latency_ms,
        CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status FROM events""",
    "job_events": """SELECT 'job_' || user_id AS job_id, ts, event_id AS ord, CASE event_type WHEN 'signup' THEN 'queued'
        WHEN 'click' THEN 'running' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status
        FROM events""",
    "jobs": """SELECT 'job_' || doc_id AS job_id, 'file_' || doc_id AS file_id, CASE lang WHEN 'en' THEN 'completed'
        WHEN 'fr' THEN 'running' WHEN 'de' THEN 'failed' ELSE 'queued' END AS status, doc_id AS created_at FROM documents""",
    "hits": f"""SELECT b.query_id, b.pos, c.file_id AS doc_id, c.file_id, c.chunk_id, c.seq, c.text, round(b.n / 8.0, 6)::DOUBLE AS score,
        f.filename, CAST(NULL AS INTEGER) AS page, c.page_start, c.page_end FROM (
          SELECT query_id, chunk_id, n, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n DESC, chunk_id) AS INTEGER) AS pos FROM (
            SELECT q.query_id, t.chunk_id, count(*) AS n FROM
              (SELECT query_id, unnest(list_filter(list_distinct({words_sql("lower(text)")}), lambda w: length(w) >= 7)) AS word FROM questions) q JOIN
              (SELECT chunk_id, unnest(list_filter(list_distinct({words_sql("lower(text)")}), lambda w: length(w) >= 7)) AS word FROM chunks) t USING (word)
            GROUP BY ALL)) b
        JOIN chunks c USING (chunk_id) JOIN files f USING (file_id) WHERE b.pos <= {HITS_PER_QUERY}""",
    "blocks": """SELECT file_id, line_no - 1 AS idx, CASE WHEN length(line) < 90 THEN 'heading' WHEN length(line) < 200 THEN 'list'
        ELSE 'paragraph' END AS kind, line AS text, CASE WHEN length(line) > 400 THEN line_no END AS page,
        CASE WHEN length(line) < 90 THEN CAST(length(line) % 6 + 1 AS INTEGER) END AS level FROM lines WHERE line <> ''""",
}
NEEDS = {"chunks": ["lines"], "blocks": ["lines"], "hits": ["questions", "chunks", "files"]}


def with_views(names: str, body: str) -> str:
    """``body`` behind a WITH clause that defines the named derived tables and what they read."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    rest = body.strip()
    if rest[:5].upper() == "WITH ":
        return f"WITH {views},\n{rest[5:]}"
    return f"WITH {views}\n{rest}"
