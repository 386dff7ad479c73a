"""Row changes as set operations: each function returns the new table(s)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import codes
from lectern.functions.text import (
    approx_tokens, extractive_summary, is_blank, is_scaffold_message, memory_key, sanitize_memory, strip, strip_history_prefix,
)
from lectern.operators.joins import unreferenced_files
from lectern.operators.ranking import top_per_group
from lectern.operators.spread import prefix_fold
from lectern.schemas import ACTIVE_JOB_STATUSES
from lectern.session import settle
from lectern.sources.tables import insert_ignore

KEEP_SUMMARIES, MAX_AGE_S = 8, 30 * 86400
COMPACT_SHARE, KEEP_TAIL = 0.70, 4
#: Characters that are summarised at once, and positions of a chat that one task runs over.
PART_CHARS, SPAN = 200_000, 1000
BASE_DELAY_S, MAX_DELAY_S, MAX_RETRIES, JITTER = 15.0, 900.0, 3, 0.2
STALE_JOB = "stale job from previous run"


def apply_updates(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns of ``changes`` that are not null replace those of the matching base rows."""
    keys = list(keys)
    cols = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols])
    joined = base.join(new, keys, "left")
    return joined.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in cols else F.col(c) for c in base.columns])


def delete_where(base: DataFrame, keys: DataFrame) -> DataFrame:
    return base.join(keys, list(keys.columns), "left_anti")


def truncate_after(messages: DataFrame, cut: DataFrame) -> DataFrame:
    """Drop every message of a chat after its cut message, by time and then insertion order.

    ``messages`` has message_id, chat_id, created_s, pos; ``cut`` has message_id. With several cuts in a
    chat the earliest counts.
    """
    marks = messages.join(cut.select("message_id"), "message_id", "left_semi").groupBy("chat_id").agg(
        F.min(F.struct("created_s", "pos")).alias("_cut")
    )
    joined = messages.join(marks, "chat_id", "left")
    return joined.filter(F.col("_cut").isNull() | (F.struct("created_s", "pos") <= F.col("_cut"))).select(*messages.columns)


def edit_message(messages: DataFrame, edits: DataFrame, truncate: bool = True) -> tuple[DataFrame, DataFrame]:
    """(new messages, rejected edits). Only non-blank edits of user messages in their own chat apply.

    ``edits``: chat_id, message_id, new_text.
    """
    known = messages.select("message_id", F.col("chat_id").alias("_chat"), F.col("role").alias("_role"))
    checked = edits.join(known, "message_id", "left").withColumn("new_text", strip(F.coalesce("new_text", F.lit(""))))
    reason = (
        F.when(F.col("new_text") == "", "content is required")
        .when(F.col("_chat").isNull(), "message not found")
        .when(F.col("_chat") != F.col("chat_id"), "message does not belong to chat")
        .when(F.col("_role") != "user", "only user messages can be edited")
    )
    checked = checked.withColumn("reason", reason)
    good = checked.filter("reason is null")
    changed = apply_updates(messages, good.select("message_id", F.col("new_text").alias("text")), ["message_id"])
    if truncate:
        changed = truncate_after(changed, good)
    return changed, checked.filter("reason is not null").select(*edits.columns, "reason")


def branch_chats(
    requests: DataFrame, chat_files: DataFrame, doc_pages: DataFrame, messages: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chat_files, doc_pages, messages) with the branched chats added.

    ``requests``: child_chat_id, parent_chat_id, message_id, role, text, share_docs, created_s, linked_ord.
    Invalid requests (role, blank text) add nothing.
    """
    valid = requests.filter(F.col("role").isin("user", "assistant") & (strip(F.coalesce("text", F.lit(""))) != ""))
    share = valid.filter(F.coalesce("share_docs", F.lit(True)))
    parents = chat_files.select(F.col("chat_id").alias("parent_chat_id"), "file_id")
    links = share.join(parents, "parent_chat_id").select(F.col("child_chat_id").alias("chat_id"), "file_id", "linked_ord")
    new_links = insert_ignore(chat_files, links, ["chat_id", "file_id"], ["linked_ord"])
    pages = doc_pages.withColumnRenamed("chat_id", "parent_chat_id").filter(F.col("doc").isNotNull())
    shared = share.select("child_chat_id", "parent_chat_id").join(pages, "parent_chat_id").join(
        parents, ["parent_chat_id", "file_id"], "left_semi"
    )
    new_pages = insert_ignore(doc_pages, shared.withColumnRenamed("child_chat_id", "chat_id"), ["chat_id", "file_id"])
    seeds = valid.select(
        "message_id", F.col("child_chat_id").alias("chat_id"), "role", strip(F.col("text")).alias("text"), "created_s",
        F.lit(0).cast(messages.schema["pos"].dataType).alias("pos"),
    )
    return new_links, new_pages, messages.unionByName(seeds.select(*messages.columns))


def save_memories(mem: DataFrame, new: DataFrame, now: Column | int, keep: int = KEEP_SUMMARIES, max_age_s: int = MAX_AGE_S) -> DataFrame:
    """Memories with the new ones in: same text replaced, newest ``keep`` per chat, old ones dropped.

    Rows: memory_id, chat_id, type, text, created_at (epoch s). A timestamp of 0 never expires. Only
    chats that receive a memory are pruned.
    """
    stamp = F.lit(now) if isinstance(now, int) else now
    # a text is empty once sanitised where it is blank before
    fresh = new.filter(~is_blank(F.col("text"))).withColumn("text", sanitize_memory(F.col("text"))).withColumn("created_at", stamp.cast("bigint"))
    # stored, so that their sizes are known: few chats and few kept rows go to the texts, which are not shuffled for them
    touched = settle(fresh.select("chat_id", F.lit(True).alias("_touched")).distinct(), "touched")
    both = mem.withColumn("_new", F.lit(0)).unionByName(fresh.select(*mem.columns).withColumn("_new", F.lit(1)))
    marked = both.join(touched, "chat_id", "left").withColumn("_key", memory_key(F.col("text")))
    rest = marked.filter(F.col("_touched").isNull())
    live = marked.filter(F.col("_touched").isNotNull())
    # texts stay where they are until the few rows that remain are known by their narrow columns
    spot = ["chat_id", "type", "_key", "_new", "created_at", "memory_id"]
    first = live.groupBy("chat_id", "type", "_key").agg(
        F.min_by(F.struct("_new", "created_at", "memory_id"), F.struct(-F.col("_new"), F.col("created_at").isNull(), -F.col("created_at"), "memory_id")).alias("_first"))
    newest = [F.desc("created_at"), F.desc("_new"), "memory_id"]
    kept = top_per_group(first.select("chat_id", "type", "_key", "_first.*"), ["chat_id", "type"], newest, keep)
    kept = settle(kept.select(*spot), "kept")
    same = [F.col(c).eqNullSafe(F.col(f"_kept_{c}")) for c in spot]
    live = live.join(kept.select(*(F.col(c).alias(f"_kept_{c}") for c in spot)), reduce(and_, same), "left_semi")
    last = W.partitionBy("chat_id", "type", "_key").orderBy(F.desc("_new"), F.desc("created_at"), "memory_id")
    live = live.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1")
    live = live.filter((F.coalesce("created_at", F.lit(0)) == 0) | (F.col("created_at") >= stamp - max_age_s))
    return rest.select(*mem.columns).unionByName(live.select(*mem.columns))


def append_version(messages: DataFrame, additions: DataFrame) -> DataFrame:
    """Add a version of a message with its own sources; earlier versions keep theirs.

    ``messages``: message_id, text, versions, version_sources, active_version, citations (last four may
    be null). ``additions``: message_id, new_text, new_sources.
    """
    joined = messages.join(additions, "message_id", "left")
    source_type = messages.schema["version_sources"].dataType
    none = F.array().cast(source_type)
    no_text = F.array().cast("array<string>")
    seeded = F.when(F.size(F.coalesce("versions", no_text)) > 0, F.col("versions")).when(
        F.coalesce("text", F.lit("")) != "", F.array("text")
    ).otherwise(no_text)
    versions = F.array_append(seeded, F.col("new_text"))
    cited = F.when(F.col("citations").isNotNull(), F.array("citations").cast(source_type)).otherwise(none)
    known = F.when(F.size(F.coalesce("version_sources", none)) > 0, F.col("version_sources")).otherwise(cited)
    empty = F.array().cast(source_type.elementType)
    missing = F.greatest(F.size(versions) - 1 - F.size(known), F.lit(0))
    padded = F.concat(known, F.array_repeat(empty, missing).cast(source_type))
    sources = F.array_append(padded, F.coalesce("new_sources", empty))
    grown = F.col("new_text").isNotNull()
    return joined.withColumns(
        {
            "_v": F.when(grown, versions).otherwise(F.col("versions")),
            "_s": F.when(grown, sources).otherwise(F.col("version_sources")),
            "_c": F.when(grown, F.coalesce("new_sources", empty)).otherwise(F.col("citations")),
        }
    ).select(
        *[
            F.col("_v").alias(c) if c == "versions" else F.col("_s").alias(c) if c == "version_sources"
            else F.col("_c").alias(c) if c == "citations"
            else F.when(grown, F.col("new_text")).otherwise(F.col(c)).alias(c) if c == "text"
            else F.when(grown, F.size("_v") - 1).otherwise(F.col(c)).alias(c) if c == "active_version"
            else F.col(c)
            for c in messages.columns
        ]
    )


def switch_version(messages: DataFrame, moves: DataFrame) -> DataFrame:
    """Move the active version by ``direction`` (+1/-1), wrapping around."""
    joined = messages.join(moves.select("message_id", "direction"), "message_id", "left")
    n = F.size(F.coalesce("versions", F.array().cast("array<string>")))
    can = F.col("direction").isNotNull() & (n > 1)
    target = F.pmod(F.coalesce("active_version", F.lit(0)) + F.col("direction"), n)
    return joined.withColumn("_to", F.when(can, target)).select(
        *[
            F.coalesce(F.try_element_at("versions", F.col("_to") + 1), F.col(c)).alias(c) if c == "text"
            else F.coalesce(F.col("_to"), F.col(c)).alias(c) if c == "active_version"
            else F.col(c)
            for c in messages.columns
        ]
    )


CHAT_TABLES = ("messages", "doc_pages", "chat_files", "memories")
FILE_TABLES = ("files", "file_text", "chunks", "vectors", "jobs", "doc_pages")


def delete_chats(ids: DataFrame, tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(new tables, counts). Rows of files go only when no other chat links them."""
    chats = ids.select("chat_id").distinct()
    gone = unreferenced_files(chats, tables["chat_files"])
    out = dict(tables)
    for name in CHAT_TABLES:
        if name in out:
            out[name] = delete_where(out[name], chats)
    for name in FILE_TABLES:
        if name in out:
            out[name] = delete_where(out[name], gone)
    parts = []
    for name, before in tables.items():
        n = before.agg(F.count("*").alias("before"))
        m = out[name].agg(F.count("*").alias("after"))
        parts.append(n.select(F.lit(name).alias("table"), (F.col("before") - m.scalar()).alias("deleted")))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return out, report


def compact(messages: DataFrame, capacity: int, summarize=extractive_summary, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept messages, summaries). A chat at 70 % of capacity or more keeps its system messages and last four.

    ``messages``: chat_id, message_id, role, text, pos. The older messages become one summary per chat;
    chats with at most four messages stay whole. Every character of them reaches ``summarize`` (see ``reduce_texts``).
    """
    used = messages.groupBy("chat_id").agg(F.sum(approx_tokens(F.col("text"))).alias("_used"))
    full = used.filter(F.lit(force) | (F.col("_used") >= F.lit(COMPACT_SHARE * capacity))).select("chat_id")
    talk = messages.filter("role <> 'system'")
    tail = top_per_group(talk.join(full, "chat_id", "left_semi"), ["chat_id"], [F.desc("pos"), F.desc("message_id")], KEEP_TAIL)
    tail_ids = tail.select("chat_id", "message_id")
    old = talk.join(full, "chat_id", "left_semi").join(tail_ids, ["chat_id", "message_id"], "left_anti")
    kept = messages.join(old.select("chat_id", "message_id"), ["chat_id", "message_id"], "left_anti")
    clean = old.withColumn("text", strip_history_prefix(F.coalesce("text", F.lit("")))).filter(~is_scaffold_message(F.col("text")))
    return kept, reduce_texts(clean.filter("text <> ''").select("chat_id", "pos", "message_id", "text"), summarize)


def reduce_texts(rows: DataFrame, summarize, part_chars: int = PART_CHARS) -> DataFrame:
    """(chat_id, text): one summary of each chat's texts, in order, by a tree of summaries.

    ``rows``: chat_id, pos, message_id, text. Running lengths cut a chat into parts of about ``part_chars`` characters;
    each part is put together and summarised by itself, and the summaries are the next level's texts, until each chat
    has one. A row holds one part (or one message, where that is longer), whatever the length of the chat, and the
    number of levels is logarithmic in it. A chat of one part is summarised as a whole.
    """
    rows = rows.select("chat_id", F.col("pos").cast("bigint").alias("pos"), F.col("message_id").cast("string").alias("message_id"), "text")
    before = None
    while True:
        sized = rows.withColumn("_chars", F.length("text") + 1)
        sized = prefix_fold(sized, ["chat_id"], ["pos", "message_id"], F.floor(F.col("pos") / SPAN), {"_start": ("_chars", "sum")})
        parts = F.sort_array(F.collect_list(F.struct("pos", "message_id", "text")))
        level = sized.groupBy("chat_id", F.floor(F.col("_start") / part_chars).alias("pos")).agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("_t"))
        rows = settle(level.select("chat_id", "pos", F.lit("").alias("message_id"), summarize(F.col("_t")).alias("text")), "summaries")
        n, chats = rows.agg(F.count("*"), F.count_distinct("chat_id")).first()
        if n == chats:
            return rows.select("chat_id", "text")
        if before is not None and n >= before:
            raise ValueError("summaries do not get shorter: part_chars is too small for this summariser")
        before = n


def plan_retries(failures: DataFrame, now_s: Column | int, jitter: float = JITTER, seed: int = 11) -> DataFrame:
    """Error code, whether to retry, and when. ``failures``: exception_name, retry_count."""
    code = codes.error_code(F.col("exception_name"))
    attempt = F.col("retry_count") + 1
    delay = F.least(F.lit(MAX_DELAY_S), F.lit(BASE_DELAY_S) * F.pow(F.lit(2.0), attempt - 1))
    if jitter > 0:
        delay = delay * (1 + (F.rand(seed) * 2 - 1) * jitter)
    retry = F.col("error_code").isin(*codes.TRANSIENT_ERRORS) & (F.col("retry_count") < MAX_RETRIES)
    stamp = F.lit(now_s) if isinstance(now_s, int) else now_s
    return failures.withColumn("error_code", code).withColumn("retry", retry).withColumn(
        "attempt", F.when(F.col("retry"), attempt)
    ).withColumn("delay_s", F.when(F.col("retry"), delay)).withColumn(
        "next_retry_s", F.when(F.col("retry"), stamp + F.col("delay_s"))
    )


def due_retries(files: DataFrame, now: Column) -> DataFrame:
    return files.filter(F.col("next_retry_at").isNotNull() & (F.col("next_retry_at") <= now))


def reconcile_jobs(jobs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs still queued or running at start-up fail with a reason, and so do their files."""
    stale = F.col("status").isin(*ACTIVE_JOB_STATUSES)
    lost = jobs.filter(stale).select("file_id").distinct().withColumn("status", F.lit("failed"))
    done = jobs.withColumn("error", F.when(stale, STALE_JOB).otherwise(F.col("error"))).withColumn(
        "status", F.when(stale, "failed").otherwise(F.col("status"))
    )
    return done, apply_updates(files, lost, ["file_id"])
