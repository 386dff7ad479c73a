"""Token streams: hidden-reasoning filter, message assembly; memory stream."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from lectern.functions.text import REASONING_TAGS, strip_reasoning
from lectern.operators.maintenance import KEEP_SUMMARIES, MAX_AGE_S

_TAG = re.compile("<(/?)(?:" + "|".join(REASONING_TAGS) + ")>", re.IGNORECASE)
_LONGEST = max(len(t) for t in REASONING_TAGS) + 3
TEXT_MAX = 1200


def strip_pending(pending: str, hidden: bool, final: bool) -> tuple[str, str, bool]:
    """(shown, still pending, hidden): drop tags and hidden spans; hold back what may start a tag."""
    shown, at = [], 0
    for tag in _TAG.finditer(pending):
        if not hidden:
            shown.append(pending[at : tag.start()])
            hidden = tag.group(1) == ""
        elif tag.group(1):
            hidden = False
        at = tag.end()
    rest = pending[at:]
    if final:
        return "".join(shown) + ("" if hidden else rest), "", hidden
    cut = rest.rfind("<", max(0, len(rest) - _LONGEST + 1))
    hold = rest[cut:] if cut >= 0 else ""
    if not hidden:
        shown.append(rest[: len(rest) - len(hold)])
    return "".join(shown), hold, hidden


def visible_text(tokens: DataFrame) -> DataFrame:
    """Batch twin of strip_reasoning_stream: whole visible text per request."""
    parts = F.sort_array(F.collect_list(F.struct("ord", "token")))
    whole = F.array_join(F.transform(parts, lambda p: p["token"]), "")
    return tokens.groupBy("request_id").agg(strip_reasoning(whole).alias("text"))


class _Stripper(StatefulProcessor):
    def init(self, handle) -> None:
        self.state = handle.getValueState("filter", "pending string, hidden boolean, sent int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pending, hidden, sent = self.state.get() if self.state.exists() else ("", False, 0)
        batch = pd.concat(list(rows)).sort_values("ord")
        ended = bool(batch["is_end"].fillna(False).any())
        shown, pending, hidden = strip_pending(pending + "".join(batch["token"].fillna("")), hidden, ended)
        if ended:
            self.state.clear()
        else:
            self.state.update((pending, hidden, sent + 1))
        yield pd.DataFrame({"request_id": [key[0]], "part": [sent], "text": [shown], "done": [ended]})

    def close(self) -> None:
        pass


def strip_reasoning_stream(tokens: DataFrame) -> DataFrame:
    """Visible text parts per request and trigger; joined by part they equal visible_text.

    ``tokens``: request_id, ord, token, is_end. Tokens of a request must arrive in order across
    triggers. Needs the RocksDB state store.
    """
    out = StructType.fromDDL("request_id string, part int, text string, done boolean")
    return tokens.groupBy("request_id").transformWithStateInPandas(
        statefulProcessor=_Stripper(), outputStructType=out, outputMode="Append", timeMode="None"
    )


class _Assembler(StatefulProcessor):
    def init(self, handle) -> None:
        self.parts = handle.getListState("parts", "ord int, token string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        held = list(self.parts.get()) if self.parts.exists() else []
        held += [(int(o), t or "") for o, t in zip(batch["ord"], batch["token"])]
        ends = batch.loc[batch["is_end"].fillna(False), "ts"]
        if len(ends):
            self.parts.clear()
            text = "".join(t for _, t in sorted(held))
            yield pd.DataFrame({"request_id": [key[0]], "ended_at": [ends.iloc[0]], "text": [text]})
        else:
            self.parts.put(held)

    def close(self) -> None:
        pass


def assemble_batch(tokens: DataFrame, sources: DataFrame) -> DataFrame:
    """Messages of ended requests with their sources, which may have come later."""
    parts = F.sort_array(F.collect_list(F.struct("ord", F.coalesce("token", F.lit("")).alias("t"))))
    done = tokens.groupBy("request_id").agg(
        F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"), F.bool_or("is_end").alias("_done")
    ).filter("_done").drop("_done")
    return done.join(sources.select("request_id", "sources"), "request_id", "left")


def assemble_messages(tokens: DataFrame, sources: DataFrame, bound: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """Streamed messages, each emitted once its sources came or the time bound passed.

    ``tokens``: request_id, ts, ord, token, is_end. ``sources``: request_id, source_ts, sources.
    """
    shape = StructType.fromDDL("request_id string, ended_at timestamp, text string")
    whole = tokens.withWatermark("ts", late).groupBy("request_id").transformWithStateInPandas(
        statefulProcessor=_Assembler(), outputStructType=shape, outputMode="Append", timeMode="EventTime",
        eventTimeColumnName="ended_at",
    )
    cited = sources.select(F.col("request_id").alias("_req"), "source_ts", "sources").withWatermark("source_ts", late)
    near = (
        (F.col("request_id") == F.col("_req"))
        & (F.col("source_ts") >= F.col("ended_at") - F.expr(f"interval {bound}"))
        & (F.col("source_ts") <= F.col("ended_at") + F.expr(f"interval {bound}"))
    )
    return whole.join(cited, near, "left_outer").select("request_id", "text", "sources")


class _Memory(StatefulProcessor):
    def __init__(self, keep: int, max_age_ms: int) -> None:
        self.keep, self.max_age_ms = keep, max_age_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("kept", "hash string", "text string, at bigint")

    def _rows(self, chat_id: str) -> pd.DataFrame:
        rows = sorted(((int(at), text) for _, (text, at) in self.kept.iterator()), reverse=True) or [(None, None)]
        return pd.DataFrame({"chat_id": [chat_id] * len(rows), "text": [t for _, t in rows], "created_ms": [a for a, _ in rows]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("ts")
        for ts, raw in zip(batch["ts"], batch["text"]):
            text = re.sub(r"\s+", " ", raw or "").strip()[:TEXT_MAX].rstrip()
            if not text:
                continue
            at = int(ts.value // 1_000_000)
            name = (hashlib.sha256(text.lower().encode("utf-8")).hexdigest(),)
            self.kept.updateValue(name, (text, at))
            self.handle.registerTimer(at + self.max_age_ms)
        every = sorted(((int(v[1]), k[0]) for k, v in self.kept.iterator()), reverse=True)
        for _, old in every[self.keep :]:
            self.kept.removeKey((old,))
        yield self._rows(key[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = expiredTimerInfo.getExpiryTimeInMs() - self.max_age_ms
        stale = [k[0] for k, v in self.kept.iterator() if int(v[1]) <= limit]
        for old in stale:
            self.kept.removeKey((old,))
        if stale:
            yield self._rows(key[0])

    def close(self) -> None:
        pass


def memory_stream(new: DataFrame, keep: int = KEEP_SUMMARIES, max_age_s: int = MAX_AGE_S, late: str = "1 minute") -> DataFrame:
    """The memories of a chat after each change; at most ``keep``, none older than the age. A chat whose
    last memory expired gives one row without text.

    ``new``: chat_id, ts, text. Needs the RocksDB state store.
    """
    shape = StructType.fromDDL("chat_id string, text string, created_ms bigint")
    return new.withWatermark("ts", late).groupBy("chat_id").transformWithStateInPandas(
        statefulProcessor=_Memory(keep, max_age_s * 1000), outputStructType=shape, outputMode="Update", timeMode="EventTime"
    )
