"""Lookups, range joins, index checks and reference-counted sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.codes import normalize_status
from lectern.functions.text import is_blank, strip
from lectern.operators.ranking import top_per_group
from lectern.operators.spread import band_join
from lectern.schemas import ACTIVE_JOB_STATUSES



def enrich_chunks(hits: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Hits with chunk text, place and file name; only the few hit ids meet the wide chunk rows."""
    detail = chunks.drop(*[c for c in hits.columns if c != "chunk_id" and c in chunks.columns])
    names = files.select("file_id", "filename")
    return hits.join(detail, "chunk_id").join(names, "file_id", "left")


def merge_hit_metadata(hits: DataFrame, detail: DataFrame, cols: list[str]) -> DataFrame:
    """Stored detail overrides the index payload column by column; the maps merge key by key."""
    stored = detail.select("chunk_id", *[F.col(c).alias(f"_d_{c}") for c in cols], F.col("metadata").alias("_d_meta"))
    joined = hits.join(stored, "chunk_id", "left")
    no_meta = F.create_map().cast("map<string,string>")
    payload = F.coalesce(F.col("metadata"), no_meta)
    own = F.coalesce(F.col("_d_meta"), no_meta)
    kept = F.map_filter(payload, lambda k, v: ~F.map_contains_key(own, k))
    out = joined.withColumn("metadata", F.map_concat(kept, own))
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(f"_d_{c}"), F.col(c)))
    return out.drop("_d_meta", *[f"_d_{c}" for c in cols])


def files_for_chat(chat_files: DataFrame, files: DataFrame) -> DataFrame:
    """Files of each chat; (chat_id, linked_ord, file_id) is the listing order."""
    return chat_files.join(files, "file_id").select("chat_id", "linked_ord", "file_id", "filename")


def file_status_for_chat(chat_files: DataFrame, files: DataFrame, chat_id: str | None = None) -> DataFrame:
    links = chat_files if chat_id is None else chat_files.filter(F.col("chat_id") == chat_id)
    return files.join(links.select("file_id"), "file_id", "left_semi").withColumn(
        "status", normalize_status(F.col("status"))
    )


def active_jobs(jobs: DataFrame, chat_files: DataFrame, files: DataFrame, limit: int | None = None) -> DataFrame:
    """Queued and running jobs of each chat, newest first; with ``limit`` only so many of them."""
    live = jobs.filter(F.col("status").isin(*ACTIVE_JOB_STATUSES))
    rows = live.join(chat_files.select("chat_id", "file_id"), "file_id").join(
        files.select("file_id", "filename"), "file_id"
    )
    newest = W.partitionBy("chat_id").orderBy(F.desc("created_at"), "job_id")
    ranked = rows.withColumn("job_rank", F.row_number().over(newest))
    return ranked if limit is None else ranked.filter(F.col("job_rank") <= limit)


def seq_range_join(windows: DataFrame, chunks: DataFrame, width: int = 64) -> DataFrame:
    """Chunks of a file with seq in [seq_start, seq_end]."""
    return band_join(chunks, windows, ["file_id"], "seq", "seq_start", "seq_end", width)


def line_range_join(windows: DataFrame, lines: DataFrame, width: int = 256) -> DataFrame:
    """Lines of a file with line_no in [line_start, line_end]."""
    return band_join(lines, windows, ["file_id"], "line_no", "line_start", "line_end", width)


def index_issues(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row per id that is only stored (missing) or only indexed (orphan)."""
    stored = chunks.select("file_id", "chunk_id").distinct().withColumn("_stored", F.lit(1))
    indexed = vectors.select(F.col("file_id").alias("_file"), "chunk_id").distinct().withColumn("_indexed", F.lit(1))
    both = stored.join(indexed, "chunk_id", "full_outer")
    issue = F.when(F.col("_indexed").isNull(), "missing").when(F.col("_stored").isNull(), "orphan")
    return both.select(
        F.coalesce("file_id", "_file").alias("file_id"), "chunk_id", issue.alias("issue"),
        F.col("_stored").isNotNull().alias("stored"), F.col("_indexed").isNotNull().alias("indexed"),
    )


def validate_index(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Counts per file; the ids themselves come from index_issues."""
    return index_issues(chunks, vectors).groupBy("file_id").agg(
        F.count_if("stored").alias("stored_chunks"),
        F.count_if("indexed").alias("indexed_points"),
        F.count_if(F.col("issue") == "missing").alias("missing"),
        F.count_if(F.col("issue") == "orphan").alias("orphan"),
        (F.count("issue") == 0).alias("ok"),
    )


def repair_index(
    chunks: DataFrame,
    vectors: DataFrame,
    embed,
    delete_orphans: bool = False,
    max_repairs: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(new vector table, per-file report). ``embed`` takes a DataFrame with text and adds vector.

    Missing ids with text are embedded; with ``max_repairs``, the lowest so many ids of a file per run, and a later
    run takes the rest.
    """
    issues = index_issues(chunks, vectors)
    missing = issues.filter("issue = 'missing'").select("file_id", "chunk_id")
    due = missing if max_repairs is None else top_per_group(missing, ["file_id"], ["chunk_id"], max_repairs)
    rows = due.join(chunks.select("chunk_id", "text"), "chunk_id")
    usable = rows.filter(~is_blank(F.col("text")))
    fixed = embed(usable).select(*vectors.columns)
    kept = vectors
    if delete_orphans:
        kept = vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    after = kept.select("file_id", "chunk_id").unionByName(usable.select("file_id", "chunk_id"))
    before_counts = validate_index(chunks, vectors)
    after_counts = validate_index(chunks, after).select(
        "file_id", F.col("missing").alias("missing_after"), F.col("orphan").alias("orphan_after"), "ok"
    )
    skipped = rows.groupBy("file_id").agg(
        F.count_if(~is_blank(F.col("text"))).alias("repaired"), F.count_if(is_blank(F.col("text"))).alias("skipped")
    )
    report = before_counts.drop("ok").join(after_counts, "file_id", "left").join(skipped, "file_id", "left").select(
        "file_id", "stored_chunks", "indexed_points", "missing", "orphan",
        F.coalesce("repaired", F.lit(0)).alias("repaired"), F.coalesce("skipped", F.lit(0)).alias("skipped"),
        F.coalesce("missing_after", F.lit(0)).alias("missing_after"),
        F.coalesce("orphan_after", F.lit(0)).alias("orphan_after"), F.coalesce("ok", F.lit(True)).alias("ok"),
    )
    return kept.unionByName(fixed), report


def merge_predictions(gold: DataFrame, pred: DataFrame, fields: list[str], order: str = "ord") -> DataFrame:
    """Fields a prediction carries (``has_<field>``) replace the gold ones; the last prediction of an id wins."""
    named = pred.withColumn("id", strip(F.col("id"))).filter(F.col("id") != "")
    cols = [f for f in fields] + [f"has_{f}" for f in fields]
    last = named.groupBy("id").agg(F.max_by(F.struct(*cols), F.col(order)).alias("_p"))
    joined = gold.withColumn("_id", strip(F.col("id"))).join(last.withColumnRenamed("id", "_id"), "_id", "left")
    for f in fields:
        joined = joined.withColumn(f, F.when(F.col(f"_p.has_{f}"), F.col(f"_p.{f}")).otherwise(F.col(f)))
    return joined.drop("_id", "_p")


def unreferenced_files(chat_ids: DataFrame, chat_files: DataFrame) -> DataFrame:
    """Files linked to the given chats and to no other chat."""
    gone = chat_files.join(chat_ids.select("chat_id").distinct(), "chat_id", "left_semi")
    stay = chat_files.join(chat_ids.select("chat_id").distinct(), "chat_id", "left_anti")
    return gone.select("file_id").distinct().join(stay.select("file_id"), "file_id", "left_anti")
