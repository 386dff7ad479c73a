"""Ordering, limits, first-wins unions and ordered distinct rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.sources.tables import insert_ignore


def clamp(n: int, lo: int, hi: int) -> int:
    return max(lo, min(int(n), hi))


def top_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int | Column, rank_col: str | None = None
) -> DataFrame:
    """First n rows of each group; the order must end in a unique key."""
    name = rank_col or "_rank"
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= n)
    return kept if rank_col else kept.drop(name)


def top_n(
    df: DataFrame, n: int, lo: int, hi: int, order: Sequence[Column | str], by: Sequence[str] = ()
) -> DataFrame:
    """First n rows (of each group); an n outside lo..hi is refused."""
    if not lo <= n <= hi:
        raise ValueError(f"n must be between {lo} and {hi}, not {n}")
    if by:
        return top_per_group(df, by, order, n)
    return df.orderBy(*order).limit(n)


def latest_n(df: DataFrame, n: int, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Newest n rows (per group), put back into oldest-first order."""
    newest = [F.desc(c) for c in order]
    kept = top_per_group(df, by, newest, n) if by else df.orderBy(*newest).limit(n)
    return kept.orderBy(*by, *order)


def listing(df: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    return df.orderBy(*keys)


def union_first(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """All rows of a, and those of b whose key a does not hold."""
    rest = b.join(a.select(*key).distinct(), list(key), "left_anti")
    return a.unionByName(rest, allowMissingColumns=True)


def backfill_links(files: DataFrame, chat_files: DataFrame) -> DataFrame:
    """Bridge rows for files that still name their chat in a legacy column."""
    legacy = files.filter(F.col("chat_id").isNotNull() & (F.col("chat_id") != "")).select(
        "chat_id", "file_id", "created_at"
    )
    return insert_ignore(chat_files, legacy, ["chat_id", "file_id"], ["created_at"])
