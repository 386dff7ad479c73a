"""Scopes, upload rules, message parsing, turn scope, readiness and the relevance gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import codes
from lectern.functions.text import blocks_to_text, is_blank, ordered_distinct, strip
from lectern.operators.evidence import round_robin
from lectern.operators.ranking import top_per_group
from lectern.operators.spread import fan_join, salted_join
from lectern.schemas import BLOCKS, MESSAGE_CONTENT, SOURCES

SCORE_STRICT, SCORE_RELAXED = 0.80, 0.70
STRICT_INTENTS = ("lookup", "extract", "compare")
GATE_CHARS, GATE_RESTORE = 8000, 6
WINDOW_ID = "seq_window:"


def scope_filter(
    df: DataFrame,
    user: str | None = None,
    chat: str | None = None,
    file_ids: Sequence[str] | None = None,
    tags: Sequence[str] | None = None,
    between: tuple | None = None,
) -> DataFrame:
    """Keep rows of one scope; parts not given do not filter."""
    if user:
        df = df.filter(F.col("user_id") == user)
    if chat:
        df = df.filter(F.col("chat_id") == chat)
    if file_ids:
        df = df.filter(F.col("file_id").isin(list(file_ids)))
    if tags:
        df = df.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if between:
        df = df.filter(F.col("created_at").between(F.lit(between[0]), F.lit(between[1])))
    return df


def scope_join(q: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each query with the chunks of its files; a query without file_ids sees every chunk of its chat.

    ``q`` has query_id, chat_id, file_ids ARRAY; ``chunks`` has file_id, chat_id. Both forms are
    equi-joins; the queries of a chat come to its chunks as lists, since there the rows made are many times those read.
    """
    wanted = F.coalesce(F.col("file_ids"), F.array().cast("array<string>"))
    by_file = q.filter(F.size(wanted) > 0).select("query_id", F.explode(F.array_distinct("file_ids")).alias("file_id"))
    by_chat = q.filter(F.size(wanted) == 0).select("query_id", "chat_id")
    named = salted_join(chunks, by_file, ["file_id"], ["chunk_id"])
    every = fan_join(chunks, by_chat, ["chat_id"], ["chunk_id"])
    cols = ["query_id", *chunks.columns]
    return named.select(*cols).unionByName(every.select(*cols))


def classify_file_size(
    files: DataFrame, name: str = "filename", size: str = "size_bytes", ingest_bytes: int | None = codes.INGEST_BYTES,
    most_bytes: int | None = codes.ABSOLUTE_BYTES, large_suffixes: Sequence[str] | None = codes.LARGE_SUFFIXES,
) -> DataFrame:
    """Adds policy and reject_reason. Without ``ingest_bytes`` no file is large, without ``most_bytes`` none too large,
    without ``large_suffixes`` a large file may be of any type."""
    none = F.lit(False)
    large = none if ingest_bytes is None else F.col(size) > ingest_bytes
    over = none if most_bytes is None else F.col(size) > most_bytes
    odd = none if large_suffixes is None else ~codes.suffix(F.col(name)).isin(*large_suffixes)
    reason = F.when(over, "file_too_large").when(large & odd, "large_file_type_not_supported")
    policy = F.when(reason.isNotNull(), "rejected").when(large, "raw_large").otherwise("ingest")
    return files.withColumn("policy", policy).withColumn("reject_reason", reason)


def check_upload_policy(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """One verdict per chat; the first broken rule is the reason.

    ``incoming`` has chat_id, filename, size_bytes; ``existing`` has chat_id, size_bytes.
    """
    sized = classify_file_size(incoming)
    ask = sized.groupBy("chat_id").agg(
        F.count("*").alias("n_incoming"),
        F.max((F.col("reject_reason") == "file_too_large").cast("int")).alias("_too_large"),
        F.max((F.col("reject_reason") == "large_file_type_not_supported").cast("int")).alias("_bad_type"),
        F.max((F.col("size_bytes") > codes.INGEST_BYTES).cast("int")).alias("_large"),
    )
    have = existing.groupBy("chat_id").agg(
        F.count("*").alias("_n"), F.max((F.col("size_bytes") > codes.INGEST_BYTES).cast("int")).alias("_locked")
    )
    joined = ask.join(have, "chat_id", "left")
    n_existing = F.coalesce(F.col("_n"), F.lit(0))
    reason = (
        F.when(F.col("_too_large") == 1, "file_too_large")
        .when(F.col("_bad_type") == 1, "large_file_type_not_supported")
        .when(F.col("_locked") == 1, "large_file_chat_locked")
        .when((n_existing > 0) & (F.col("_large") == 1), "large_file_requires_new_chat")
        .when((n_existing == 0) & (F.col("_large") == 1) & (F.col("n_incoming") != 1), "large_file_must_be_alone")
    )
    return joined.select(
        "chat_id", "n_incoming", n_existing.alias("n_existing"), reason.isNull().alias("allowed"),
        reason.alias("reason"),
    )


def parse_messages(df: DataFrame, content: str = "content_json", citations: str = "citations_json") -> DataFrame:
    """Message JSON to columns; bare strings and broken JSON stay text.

    The active version's sources win over the citations column.
    """
    raw = F.coalesce(F.col(content), F.lit(""))
    obj = F.from_json(F.when(F.ltrim(raw).startswith("{"), raw), MESSAGE_CONTENT)
    bare = F.get_json_object(F.concat(F.lit('{"v":'), F.when(F.ltrim(raw).startswith('"'), raw), F.lit("}")), "$.v")
    out = df.withColumn("_o", obj)
    idx = F.when(F.col("_o.activeVersionIndex") >= 0, F.col("_o.activeVersionIndex"))
    picked = F.try_element_at(F.col("_o.versionSources"), idx + 1)
    cited = F.from_json(F.col(citations), SOURCES)
    nonempty = lambda c: F.when(F.size(c) > 0, c)
    return out.select(
        *df.columns,
        F.coalesce(F.col("_o.text"), bare, raw).alias("text"),
        nonempty(F.filter(F.col("_o.attachments"), lambda a: a.isNotNull())).alias("attachments"),
        F.col("_o.selection").alias("selection"),
        F.nullif(strip(F.col("_o.focus_document_id")), F.lit("")).alias("focus_document_id"),
        nonempty(F.filter(F.col("_o.versions"), lambda v: v.isNotNull())).alias("versions"),
        idx.alias("active_version"),
        F.coalesce(picked, cited).alias("sources"),
    )


def transcript(df: DataFrame, last_n: int | None = None, key: str = "message_id", time: str = "created_s") -> DataFrame:
    """Trimmed texts of each chat, blanks dropped after the newest last_n rows are taken."""
    rows = df
    if last_n:
        rows = top_per_group(rows, ["chat_id"], [F.desc(time), F.desc(key)], last_n)
    rows = rows.withColumn("content", strip(F.col("text"))).filter(F.col("content") != "")
    return rows.select("chat_id", key, "role", "content", time)


def resolve_scope(turns: DataFrame, chat_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per turn, one row per turn and file).

    Turns: query_id, chat_id, turn_doc_ids, focus_document_id, doc_pane_open, selection_file_id.
    Links: chat_id, file_id, linked_ord. The member rows carry role "scope" or "secondary" and a
    position, so a chat of any size never becomes one array.
    """
    none = F.array().cast("array<string>")
    focus_asked = F.nullif(strip(F.coalesce("focus_document_id", F.lit(""))), F.lit(""))
    base = turns.select(
        "query_id",
        "chat_id",
        F.coalesce(ordered_distinct(F.col("turn_doc_ids")), none).alias("_turn"),
        focus_asked.alias("_asked"),
        F.coalesce(F.col("doc_pane_open"), focus_asked.isNotNull()).alias("doc_pane_open"),
        F.nullif(F.col("selection_file_id"), F.lit("")).alias("_sel"),
    )
    chats = chat_files.groupBy("chat_id").agg(
        F.max_by("file_id", F.struct("linked_ord", "file_id")).alias("_latest"),
        F.count_distinct("file_id").alias("_n_chat"),
    )
    linked = chat_files.select("chat_id", F.col("file_id").alias("_asked"), F.lit(True).alias("_in_chat")).distinct()
    joined = base.join(chats, "chat_id", "left").join(linked, ["chat_id", "_asked"], "left")
    n_turn = F.size("_turn")
    last_turn = F.try_element_at("_turn", F.lit(-1))
    latest = F.coalesce(last_turn, F.col("_latest"))
    has_chat = F.coalesce(F.col("_n_chat"), F.lit(0)) > 0
    mode = (
        F.when(F.col("_sel").isNotNull(), "selection")
        .when(n_turn > 1, "turn_all")
        .when(n_turn == 1, "turn_one")
        .when(~F.col("doc_pane_open") & has_chat, "chat_all")
        .when(~F.col("doc_pane_open"), "nothing")
        .otherwise("focus")
    )
    focus = (
        F.when(F.col("_mode") == "selection", F.col("_sel"))
        .when(F.col("_mode") == "turn_one", last_turn)
        .when(F.col("_mode") == "focus", F.coalesce(F.when(F.col("_in_chat"), F.col("_asked")), F.col("_latest")))
    )
    plan = joined.withColumn("_mode", mode).withColumn("focus", focus).select(
        "query_id", "chat_id", "doc_pane_open", "_mode", "_turn", "focus",
        F.when(F.col("_mode").isin("turn_all", "chat_all"), "all").otherwise("focused").alias("scope"),
        latest.alias("latest"),
        (has_chat | (n_turn > 0)).alias("has_doc_scope"),
    )
    from_turn = plan.filter("_mode = 'turn_all'").select(
        "query_id", F.posexplode("_turn").alias("pos", "file_id"), F.lit("scope").alias("role")
    )
    links = chat_files.select("chat_id", "file_id", "linked_ord")
    need = plan.filter("_mode in ('chat_all', 'turn_one', 'focus')").select("query_id", "chat_id", (F.col("_mode") == "chat_all").alias("_all"), "focus")
    from_chat = fan_join(links, need, ["chat_id"], ["file_id"])
    from_chat = from_chat.filter(F.col("_all") | (F.col("focus").isNotNull() & (F.col("file_id") != F.col("focus"))))
    from_chat = from_chat.select(
        "query_id", F.col("linked_ord").alias("pos"), "file_id",
        F.when(F.col("_all"), "scope").otherwise("secondary").alias("role"),
    )
    members = from_turn.select("query_id", F.col("pos").cast("bigint").alias("pos"), "file_id", "role").unionByName(
        from_chat.select("query_id", F.col("pos").cast("bigint").alias("pos"), "file_id", "role")
    )
    return plan.drop("_mode", "_turn"), members


def _required(turns: DataFrame, chat_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, chat_id, file_id) of the files that turns need by name, and (query_id, chat_id) of those that need their whole chat."""
    none = F.array().cast("array<string>")
    asked = F.nullif(strip(F.coalesce("focus_document_id", F.lit(""))), F.lit(""))
    base = turns.select(
        "query_id", "chat_id",
        F.coalesce(ordered_distinct(F.col("turn_doc_ids")), none).alias("_turn"),
        asked.alias("_asked"),
        F.coalesce(F.col("doc_pane_open"), asked.isNotNull()).alias("_pane"),
        F.nullif(strip(F.coalesce("selection_file_id", F.lit(""))), F.lit("")).alias("_sel"),
        (F.lower(strip(F.coalesce("doc_scope_mode", F.lit("")))) == "all").alias("_all"),
    )
    listed = (
        F.when(F.col("_sel").isNotNull(), F.array("_sel"))
        .when(F.col("_all"), F.col("_turn"))
        .when(F.col("_pane") & F.col("_asked").isNotNull() & (F.size("_turn") == 0), F.array("_asked"))
        .otherwise(F.col("_turn"))
    )
    base = base.withColumn("_listed", listed)
    named = base.select("query_id", "chat_id", F.explode("_listed").alias("file_id"))
    links = chat_files.select("chat_id", "file_id", "linked_ord")
    whole = base.filter(F.col("_all") & F.col("_sel").isNull()).select("query_id", "chat_id")
    latest = links.groupBy("chat_id").agg(F.max_by("file_id", F.struct("linked_ord", "file_id")).alias("file_id"))
    bare = base.filter(~F.col("_pane") & (F.size("_listed") == 0) & ~F.col("_all")).select("query_id", "chat_id")
    newest = bare.join(latest, "chat_id").select("query_id", "chat_id", "file_id")
    return named.unionByName(newest).distinct(), whole.distinct()


def required_files(turns: DataFrame, chat_files: DataFrame) -> DataFrame:
    """Rows (query_id, chat_id, file_id) a turn needs to be ready.

    A selection needs its own file; mode "all" every file of the chat plus the new ones; else the
    focused file (pane open, nothing new) and the new ones; else the chat's latest file.
    """
    named, whole = _required(turns, chat_files)
    every = salted_join(chat_files.select("chat_id", "file_id"), whole, ["chat_id"], ["file_id"]).select("query_id", "chat_id", "file_id")
    return named.unionByName(every).distinct()


def readiness(required: DataFrame, files: DataFrame, chat_files: DataFrame) -> DataFrame:
    """State of each required file: missing, not_ready, failed or ready (a missing file is not ready too)."""
    status = chat_files.select("chat_id", "file_id").distinct().join(files.select("file_id", "status"), "file_id")
    seen = required.join(status, ["chat_id", "file_id"], "left")
    normal = codes.normalize_status(F.col("status"))
    state = (
        F.when(normal.isNull(), "missing").when(normal == "failed", "failed").when(normal == "completed", "ready")
        .otherwise("not_ready")
    )
    return seen.select("query_id", "chat_id", "file_id", state.alias("state"))


def readiness_summary(states: DataFrame) -> DataFrame:
    n = lambda *names: F.count_if(F.col("state").isin(*names))
    return states.groupBy("query_id").agg(
        F.count("*").alias("required"), n("missing").alias("missing"),
        n("missing", "not_ready").alias("not_ready"), n("failed").alias("failed"),
        (n("ready") == F.count("*")).alias("ready"),
    )


def readiness_by_turn(turns: DataFrame, files: DataFrame, chat_files: DataFrame) -> DataFrame:
    """What ``readiness_summary`` says of a turn's required files, with no row for each turn and file of its chat.

    A chat's files are counted once; turns that need all of them take the counts, and add the named files that the chat lacks.
    """
    def counts(states: DataFrame, key: str) -> DataFrame:
        n = lambda *names: F.count_if(F.col("state").isin(*names))
        return states.groupBy(key).agg(
            F.count("*").alias("required"), n("missing").alias("missing"), n("missing", "not_ready").alias("not_ready"),
            n("failed").alias("failed"), n("ready").alias("_ready"))

    named, whole = _required(turns, chat_files)
    links = chat_files.select("chat_id", "file_id").distinct()
    chats = counts(readiness(links.withColumn("query_id", F.col("chat_id")), files, chat_files), "chat_id")
    known = links.withColumn("_linked", F.lit(True))
    extra = named.join(whole.withColumn("_whole", F.lit(True)), ["query_id", "chat_id"], "left").join(known, ["chat_id", "file_id"], "left")
    extra = extra.filter("_whole is null or _linked is null").select("query_id", "chat_id", "file_id")
    rows = counts(readiness(extra, files, chat_files), "query_id").unionByName(whole.join(chats, "chat_id").drop("chat_id"))
    total = lambda c: F.sum(c).alias(c)
    return rows.groupBy("query_id").agg(
        *[total(c) for c in ("required", "missing", "not_ready", "failed")], (F.sum("_ready") == F.sum("required")).alias("ready"))


def gate_verdict(text: Column, score: Column, chunk_id: Column, terms: Column, intent: Column) -> Column:
    head = F.lower(F.substr(text, F.lit(1), F.lit(GATE_CHARS)))
    is_window = F.coalesce(chunk_id, F.lit("")).startswith(WINDOW_ID)
    points = F.coalesce(score, F.lit(0.0))
    overlap = F.exists(terms, lambda t: F.contains(head, t))
    floor = F.when(intent.isin(*STRICT_INTENTS), SCORE_STRICT).otherwise(SCORE_RELAXED)
    with_terms = overlap | (~is_window & (points >= floor))
    without = is_window | (points >= SCORE_RELAXED)
    verdict = F.when(F.size(terms) > 0, with_terms).otherwise(without)
    return ~is_blank(text) & F.coalesce(verdict, F.lit(False))


def relevance_gate(hits: DataFrame, q: DataFrame) -> DataFrame:
    """Drop irrelevant hits; a query that would lose all of them gets its first six back.

    Hits: query_id, pos, doc_id, chunk_id, text, score. Queries: query_id, terms, intent, scope.
    """
    judged = hits.join(q.select("query_id", "terms", "intent", "scope"), "query_id").withColumn(
        "_pass",
        gate_verdict(F.col("text"), F.col("score"), F.col("chunk_id"), F.col("terms"), F.col("intent")),
    )
    some = judged.groupBy("query_id").agg(F.max(F.col("_pass").cast("int")).alias("_any"))
    judged = judged.join(some, "query_id")
    passed = judged.filter("_any = 1 and _pass").withColumn("restored", F.lit(False))
    lost = judged.filter("_any = 0").withColumn("restored", F.lit(True))
    plain = top_per_group(lost.filter("scope <> 'all'"), ["query_id"], ["pos"], GATE_RESTORE)
    mixed = round_robin(lost.filter("scope = 'all'"), GATE_RESTORE)
    keep = [*hits.columns, "restored"]
    return passed.select(*keep).unionByName(plain.select(*keep)).unionByName(mixed.select(*keep))


def effective_document(
    chat_files: DataFrame, files: DataFrame, file_text: DataFrame, doc_pages: DataFrame, chunks: DataFrame
) -> DataFrame:
    """The document a chat shows for a file: edited page, else blocks, else text rebuilt from chunks."""
    texts = file_text.select("file_id", "blocks", F.col("updated_at").alias("_source_at"))
    pages = doc_pages.select(
        "chat_id", "file_id", F.col("title").alias("_page_title"), "doc", "is_user_edited",
        "source_file_updated_at",
    )
    rows = (
        chat_files.select("chat_id", "file_id").distinct()
        .join(files.select("file_id", "filename"), "file_id")
        .join(texts, "file_id", "left")
        .join(pages, ["chat_id", "file_id"], "left")
    )
    has_blocks = F.size(F.coalesce("blocks", F.array().cast(BLOCKS))) > 0
    edited = F.coalesce(F.col("is_user_edited"), F.lit(False)) & F.col("doc").isNotNull()
    bare = texts.filter(has_blocks).select("file_id")
    pieces = F.sort_array(F.collect_list(F.struct("seq", F.col("text").alias("t"))))
    rebuilt = (
        chunks.join(bare, "file_id", "left_anti").filter(~is_blank(F.col("text")))
        .groupBy("file_id").agg(F.array_join(F.transform(pieces, lambda p: strip(p["t"])), "\n\n").alias("_rebuilt"))
    )
    rows = rows.join(rebuilt, "file_id", "left")
    stale = F.col("_source_at").isNotNull() & F.col("doc").isNotNull() & (
        ~F.col("_source_at").eqNullSafe(F.col("source_file_updated_at"))
    )
    return rows.select(
        "chat_id", "file_id",
        F.coalesce(F.nullif("_page_title", F.lit("")), "filename").alias("title"),
        F.when(edited, "page").when(has_blocks, "blocks").when(F.col("_rebuilt").isNotNull(), "chunks").otherwise("none").alias("origin"),
        F.when(edited, F.col("doc")).alias("doc"),
        F.when(~edited & has_blocks, F.col("blocks")).alias("blocks"),
        F.when(~edited & has_blocks, blocks_to_text(F.col("blocks"))).when(~edited, F.col("_rebuilt")).alias("text"),
        stale.alias("source_is_stale"),
    )
