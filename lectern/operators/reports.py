"""Progress, summaries, quality, latency, growth and storage reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import codes
from lectern.functions.text import approx_tokens, preview, strip, title
from lectern.operators.ranking import top_per_group
from lectern.operators.spread import exact_quantiles, linear_rank, nearest_low_rank
from lectern.schemas import ACTIVE_JOB_STATUSES, FILE_STATUSES

GROWTH_LIMIT, GROWTH_SAMPLES = 80.0, 5
FAILURES_SHOWN = 10

# Components of a workspace.
COMPONENTS = ("uploads", "qdrant", "kv_sessions", "cache", "logs", "db.sqlite")


def ingestion_progress(files: DataFrame, chat_files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per chat: totals, counts by status, active jobs and percent done."""
    links = chat_files.select("chat_id", "file_id").distinct()
    states = links.join(files.select("file_id", codes.normalize_status(F.col("status")).alias("status")), "file_id")
    n = lambda *names: F.count_if(F.col("status").isin(*names))
    totals = states.groupBy("chat_id").agg(
        F.count("*").alias("total"), n("completed", "failed").alias("done"),
        *[n(s).alias(s) for s in FILE_STATUSES],
    )
    live = jobs.filter(F.col("status").isin(*ACTIVE_JOB_STATUSES)).groupBy("file_id").agg(F.count("*").alias("_n"))
    active = links.join(live, "file_id").groupBy("chat_id").agg(
        F.sum("_n").alias("active_jobs")
    )
    percent = F.when(F.col("total") > 0, F.round(F.col("done") / F.col("total") * 100.0, 2)).otherwise(100.0)
    return totals.join(active, "chat_id", "left").withColumn(
        "active_jobs", F.coalesce("active_jobs", F.lit(0).cast("bigint"))
    ).withColumn("percent", percent)


def progress_counts(progress: DataFrame) -> DataFrame:
    """The per-status counts of ingestion_progress as one map."""
    entries = F.array(*[F.struct(F.lit(s).alias("k"), F.col(s).alias("v")) for s in FILE_STATUSES])
    shown = F.map_from_entries(F.filter(entries, lambda e: e["v"] > 0))
    return progress.withColumn("counts", shown).drop(*[s for s in FILE_STATUSES if s != "failed"])


def session_summaries(messages: DataFrame, chat_files: DataFrame, files: DataFrame) -> DataFrame:
    """One row per chat: chats with messages first, then chats that only hold files, newest first in each."""
    at = F.struct("created_s", "message_id")
    is_user = F.col("role") == "user"
    counts = chat_files.groupBy("chat_id").agg(F.count_distinct("file_id").alias("file_count"))
    talk = messages.groupBy("chat_id").agg(
        F.max("created_s").alias("last_at"),
        title(F.min_by("text", F.when(is_user, at))).alias("title"),
        preview(F.max_by("text", at)).alias("last_message"),
    )
    talk = talk.join(counts, "chat_id", "left").select(
        "chat_id", F.lit(0).alias("branch"), "last_at", "title",
        F.nullif("last_message", F.lit("")).alias("last_message"), F.coalesce("file_count", F.lit(0)).alias("file_count"),
    )
    quiet = chat_files.join(messages.select("chat_id").distinct(), "chat_id", "left_anti").join(
        files.select("file_id", "filename"), "file_id"
    )
    linked = F.struct("linked_ord", "file_id")
    bare = quiet.groupBy("chat_id").agg(
        F.max("linked_ord").alias("last_at"), F.nullif(strip(F.min_by("filename", linked)), F.lit("")).alias("title"),
        F.count_distinct("file_id").alias("file_count"),
    ).select(
        "chat_id", F.lit(1).alias("branch"), "last_at", "title", F.lit(None).cast("string").alias("last_message"), "file_count"
    )
    return talk.unionByName(bare)


def seq_stats(chunks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    stats = chunks.groupBy("file_id").agg(
        F.count("*").alias("count"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq")
    )
    if files is None:
        return stats
    zero = F.lit(0)
    return files.select("file_id").join(stats, "file_id", "left").select(
        "file_id", F.coalesce("count", zero).alias("count"), F.coalesce("min_seq", zero).alias("min_seq"),
        F.coalesce("max_seq", zero).alias("max_seq"),
    )


def count_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"))


def count_jobs(jobs: DataFrame, statuses: Sequence[str] = ACTIVE_JOB_STATUSES) -> DataFrame:
    return jobs.agg(F.count_if(F.col("status").isin(*statuses)).alias("jobs"))


def first_rank(relevant, retrieved, k: int):
    """1-based place of the first relevant id in the top k; null when there is none."""
    top = F.slice(F.filter(F.transform(retrieved, strip), lambda s: s != ""), 1, max(0, k))
    wanted = F.filter(F.transform(relevant, strip), lambda s: s != "")
    places = F.filter(F.transform(top, lambda t, i: F.when(F.array_contains(wanted, t), i + 1)), lambda p: p.isNotNull())
    return F.array_min(places)


def evaluate_retrieval(rows: DataFrame, k: int) -> DataFrame:
    """Hit rate and reciprocal rank over all rows, those without relevant ids included."""
    ranked = rows.select(first_rank(F.col("relevant_doc_ids"), F.col("retrieved_doc_ids"), k).alias("_r"))
    n = F.greatest(F.count("*"), F.lit(1))
    return ranked.agg(
        F.count("*").alias("samples"), F.lit(k).alias("k"), F.count("_r").alias("hits_at_k"),
        (F.count("_r") / n).alias("hit_rate_at_k"), (F.sum(F.coalesce(1.0 / F.col("_r"), F.lit(0.0))) / n).alias("mrr_at_k"),
    )


def evaluate_grounding(rows: DataFrame) -> DataFrame:
    want = strip(F.coalesce("expected_snippet", F.lit("")))
    asked = rows.select(want.alias("_w"), F.lower(F.coalesce("answer", F.lit(""))).alias("_a")).filter("_w <> ''")
    held = F.count_if(F.contains(F.col("_a"), F.lower("_w")))
    return asked.agg(
        F.count("*").alias("with_snippet"), held.alias("passed"),
        F.when(F.count("*") > 0, held / F.count("*")).otherwise(0.0).alias("pass_rate"),
    )


def latency_summary(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, exact p50 and p95 with linear interpolation, mean and median; zeros when empty."""
    by = list(by)
    base = df.filter(F.col(col).isNotNull()).groupBy(*by).agg(F.count("*").alias("count"), F.avg(col).alias("mean_ms"))
    cuts = exact_quantiles(df, by, col, {"p50_ms": linear_rank(0.5), "p95_ms": linear_rank(0.95)})
    joined = base.join(cuts, by, "left") if by else base.select(
        "*", cuts.select("p50_ms").scalar().alias("p50_ms"), cuts.select("p95_ms").scalar().alias("p95_ms")
    )
    zero = F.lit(0.0)
    return joined.select(
        *by, "count", F.coalesce("p50_ms", zero).alias("p50_ms"), F.coalesce("p95_ms", zero).alias("p95_ms"),
        F.coalesce("mean_ms", zero).alias("mean_ms"), F.coalesce("p50_ms", zero).alias("median_ms"),
    )


def quality_gate(
    report: DataFrame, min_hit_rate: float | None = None, min_grounding: float | None = None, max_p95_ms: float | None = None
) -> DataFrame:
    """``report`` is one row with k, hit_rate_at_k, pass_rate, p95_ms; adds failures and ok."""
    checks = []
    if min_hit_rate is not None:
        text = F.format_string("Recall@%d %.4f < required %.4f", "k", "hit_rate_at_k", F.lit(float(min_hit_rate)))
        checks.append(F.when(F.col("hit_rate_at_k") < min_hit_rate, text))
    if min_grounding is not None:
        text = F.format_string("Grounding pass rate %.4f < required %.4f", "pass_rate", F.lit(float(min_grounding)))
        checks.append(F.when(F.col("pass_rate") < min_grounding, text))
    if max_p95_ms is not None:
        text = F.format_string("Latency p95 %.2fms > allowed %.2fms", "p95_ms", F.lit(float(max_p95_ms)))
        checks.append(F.when(F.col("p95_ms") > max_p95_ms, text))
    every = F.array(*checks) if checks else F.array().cast("array<string>")
    return report.withColumn("failures", F.filter(every, lambda m: m.isNotNull())).withColumn("ok", F.size("failures") == 0)


def load_latency(df: DataFrame, by: Sequence[str], col: str = "latency_ms") -> DataFrame:
    """Median, and p95 as the element at int(0.95 (n-1)) of the sorted values."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by).agg(F.count("*").alias("samples"))
    cuts = exact_quantiles(df, by, col, {"p50": linear_rank(0.5), "p95": nearest_low_rank(0.95)})
    return counts.join(cuts, list(by))


def failure_summary(df: DataFrame, by: Sequence[str], order: Sequence[str], failed, message) -> DataFrame:
    """Requests, failures, rate, and the first ten failure messages of each group."""
    rows = df.withColumn("_failed", failed)
    counts = rows.groupBy(*by).agg(F.count("*").alias("requests"), F.count_if("_failed").alias("failures"))
    first = top_per_group(rows.filter("_failed"), by, list(order), FAILURES_SHOWN, rank_col="_n")
    shown = first.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_n", message.alias("m")))).alias("_m"))
    return counts.join(shown, list(by), "left").select(
        *by, "requests", "failures", (F.col("failures") / F.col("requests")).alias("failure_rate"),
        F.coalesce(F.transform("_m", lambda m: m["m"]), F.array().cast("array<string>")).alias("first_failures"),
    )


def growth_check(samples: DataFrame, by: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """First, last, least and largest positive value, growth in percent, and whether it is above 80 %.

    Fewer than five samples leave the verdict open (null).
    """
    at = F.struct(*order)
    positive = F.when(F.col(value) > 0, F.col(value))
    when = F.when(F.col(value) > 0, at)
    stats = samples.groupBy(*by).agg(
        F.count("*").alias("samples"), F.min_by(value, when).alias("first"), F.max_by(value, when).alias("last"),
        F.min(positive).alias("min"), F.max(positive).alias("max"),
    )
    growth = F.when(F.col("first") > 0, (F.col("last") - F.col("first")) / F.col("first") * 100.0)
    enough = (F.col("samples") >= GROWTH_SAMPLES) & F.col("first").isNotNull()
    return stats.withColumn("growth_pct", growth).withColumn("failed", F.when(enough, growth > GROWTH_LIMIT))


def storage_usage(listing: DataFrame, base: str, components: Sequence[str] = COMPONENTS) -> DataFrame:
    """Bytes and files by component below ``base``; what no component names is "other"."""
    root = base.rstrip("/") + "/"
    bare = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")  # without scheme and host
    inside = listing.filter(bare.startswith(root))
    below = F.substring(bare, len(root) + 1, 1 << 30)
    name = F.substring_index(below, "/", 1)
    part = F.when(name.isin(*components), F.regexp_replace(name, r"\.sqlite$", "")).otherwise("other")
    return inside.groupBy(part.alias("component")).agg(
        F.sum("length").alias("bytes"), F.count("*").alias("files")
    )


def context_status(messages: DataFrame, capacity: int) -> DataFrame:
    used = messages.groupBy("chat_id").agg(F.sum(approx_tokens(F.col("text"))).alias("used_tokens"))
    cap = F.lit(capacity).cast("bigint")
    return used.select(
        "chat_id", "used_tokens", cap.alias("capacity_tokens"),
        F.round(F.col("used_tokens") / cap * 100, 2).alias("percent"),
        codes.input_budget(cap, F.col("used_tokens")).alias("input_budget"),
    )


