"""Job state: cancellations, the time-out watch, and status views. Each has a batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

MAX_RUNNING_S = 20 * 60
TERMINAL = ("completed", "failed", "cancelled")
TIMEOUT_ERROR = "watchdog timeout"
MONITOR = "job_id string, status string, error string, at timestamp"
RANK = {"queued": 0, "running": 1}


def apply_cancellations(jobs: DataFrame, cancels: DataFrame, links: DataFrame) -> DataFrame:
    """Jobs left after cancellation; a job whose file another chat links goes on.

    ``jobs`` (batch or stream): job_id, chat_id, file_id. ``cancels``: chat_id. ``links``: chat_id, file_id.
    """
    gone = cancels.select("chat_id").distinct()
    kept = links.join(gone, "chat_id", "left_anti").select("file_id")
    doomed = links.join(gone, "chat_id", "left_semi").select("chat_id", "file_id").distinct().join(
        kept, "file_id", "left_anti"
    )
    return jobs.join(doomed, ["chat_id", "file_id"], "left_anti")


def job_states(events: DataFrame, max_age_s: int = MAX_RUNNING_S) -> DataFrame:
    """Batch twin of job_monitor: (job_id, status, error, at) as of the newest event.

    The first terminal event decides unless the job ran past its age before it; what follows is ignored.
    Only conditional minima are aggregated, so a job with many events needs no ordered list.
    """
    place = F.struct("ts", "ord", "status")
    ended = F.col("status").isin(*TERMINAL)
    per_job = events.groupBy("job_id").agg(
        F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("_run"),
        F.min(F.when(ended, place)).alias("_end"), F.min("ts").alias("_first"),
    )
    now = events.agg(F.max("ts").alias("_now")).select("_now").scalar()
    due = F.col("_run") + F.make_dt_interval(secs=F.lit(max_age_s))
    early_end = F.col("_end.ts").isNotNull() & (F.col("_run").isNull() | (F.col("_end.ts") <= due))
    late = F.col("_run").isNotNull() & ~early_end & (now >= due)
    return per_job.select(
        "job_id",
        F.when(early_end, F.col("_end.status")).when(late, "failed").when(F.col("_run").isNotNull(), "running").otherwise("queued").alias("status"),
        F.when(~early_end & late, F.lit(TIMEOUT_ERROR)).alias("error"),
        F.when(early_end, F.col("_end.ts")).when(late, due).otherwise(F.coalesce("_run", "_first")).alias("at"),
    )


class _Monitor(StatefulProcessor):
    def __init__(self, max_age_ms: int) -> None:
        self.max_age_ms = max_age_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, started bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, started = self.state.get() if self.state.exists() else (None, None)
        before = status
        at = None
        events = pd.concat(list(rows)).sort_values(["ts", "ord"])
        error = None
        for ts, new in zip(events["ts"], events["status"]):
            if status in TERMINAL:
                break
            ms = int(ts.value // 1_000_000)
            if started is not None and ms > started + self.max_age_ms:
                status, error, at = "failed", TIMEOUT_ERROR, pd.Timestamp(started + self.max_age_ms, unit="ms")
                break
            if new == "running" and started is None:
                started = ms
                self.handle.registerTimer(started + self.max_age_ms)
            if new in TERMINAL or RANK[new] > RANK.get(status, -1):
                status, at = new, ts
        self.state.update((status, started))
        if status != before:
            yield pd.DataFrame({"job_id": [key[0]], "status": [status], "error": [error], "at": [at]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, started = self.state.get() if self.state.exists() else (None, None)
        if status is not None and status not in TERMINAL:
            self.state.update(("failed", started))
            at = pd.Timestamp(started + self.max_age_ms, unit="ms")
            yield pd.DataFrame({"job_id": [key[0]], "status": ["failed"], "error": [TIMEOUT_ERROR], "at": [at]})

    def close(self) -> None:
        pass


def job_monitor(events: DataFrame, max_age_s: int = MAX_RUNNING_S, late: str = "10 minutes") -> DataFrame:
    """Stream of status changes per job; the newest row per job equals job_states.

    Needs the RocksDB state store. ``events``: job_id, ts, ord, status.
    """
    from pyspark.sql.types import StructType

    return events.withWatermark("ts", late).groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=_Monitor(max_age_s * 1000), outputStructType=StructType.fromDDL(MONITOR),
        outputMode="Update", timeMode="EventTime",
    )


def file_status_view(events: DataFrame, keys: list[str] = ["file_id"]) -> DataFrame:  # noqa: B006
    """Latest status per file; batch or stream (update mode)."""
    return events.filter(F.col("status").isNotNull()).groupBy(*keys).agg(
        F.max_by("status", F.struct("ts", "ord")).alias("status"), F.max("ts").alias("at")
    )
