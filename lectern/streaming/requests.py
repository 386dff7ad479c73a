"""Request metrics by time window and bounded recent history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lectern.operators.ranking import top_per_group
from lectern.operators.spread import exact_quantiles, linear_rank

HISTORY = 500


def _windowed(log: DataFrame, width: str, slide: str | None) -> DataFrame:
    return log.withColumn("_w", F.window("ts", width, slide) if slide else F.window("ts", width))


def request_metrics(log: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Requests, failures, p50/p95 and tokens per window.

    Percentiles are exact on a batch and approximate on a stream, where rows later than the
    watermark are dropped.
    """
    tokens = F.sum("total_tokens") if "total_tokens" in log.columns else F.lit(None).cast("bigint")
    sums = [
        F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("failures"),
        F.avg("latency_ms").alias("mean_ms"), tokens.alias("tokens"),
    ]
    if log.isStreaming:
        rows = _windowed(log.withWatermark("ts", late), width, slide)
        out = rows.groupBy("_w").agg(
            *sums, F.percentile_approx("latency_ms", 0.5, 10000).alias("p50_ms"),
            F.percentile_approx("latency_ms", 0.95, 10000).alias("p95_ms"),
        )
    else:
        rows = _windowed(log, width, slide)
        cuts = exact_quantiles(rows, ["_w"], "latency_ms", {"p50_ms": linear_rank(0.5), "p95_ms": linear_rank(0.95)})
        out = rows.groupBy("_w").agg(*sums).join(cuts, "_w", "left")
    return out.select(
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "requests", "failures",
        "p50_ms", "p95_ms", "mean_ms", "tokens",
    )


def recent_batch(log: DataFrame, n: int = HISTORY) -> DataFrame:
    return top_per_group(log, ["endpoint"], [F.desc("ts"), F.desc("id")], n)


class _Recent(StatefulProcessor):
    def __init__(self, n: int, row: str) -> None:
        self.n, self.row = n, row

    def init(self, handle) -> None:
        self.kept = handle.getListState("kept", self.row)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows))[["ts", "id", "latency_ms", "status"]]
        held = list(self.kept.get()) if self.kept.exists() else []
        every = held + [tuple(r) for r in fresh.itertuples(index=False)]
        naive = lambda t: pd.Timestamp(t).tz_localize(None).to_pydatetime()
        every = [(naive(ts), int(i), float(ms), int(status)) for ts, i, ms, status in every]
        every = sorted(every)[-self.n :]
        self.kept.put(every)
        out = pd.DataFrame(every, columns=["ts", "id", "latency_ms", "status"])
        out.insert(0, "endpoint", [key[0]] * len(out))
        yield out

    def close(self) -> None:
        pass


def recent_history(stream: DataFrame, n: int = HISTORY) -> DataFrame:
    """Newest n requests per endpoint after each trigger. Needs the RocksDB state store.

    ``stream``: endpoint, ts, id, latency_ms, status.
    """
    from pyspark.sql.types import StructType

    row = "ts timestamp, id bigint, latency_ms double, status int"
    return stream.groupBy("endpoint").transformWithStateInPandas(
        statefulProcessor=_Recent(n, row), outputStructType=StructType.fromDDL("endpoint string, " + row),
        outputMode="Update", timeMode="None",
    )
