"""Keyed table changes as set operations, and Parquet sinks by embedding version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def spread_small_source(df: DataFrame, key: str) -> DataFrame:
    """Rows of a source that would be read by fewer tasks than the cluster has cores, dealt out by key.

    A large source is read by many tasks and left as it is, without a shuffle. Only the number of read tasks is looked at.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def last_write(changes: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the last by order, ties cut by the whole row so that re-runs agree."""
    spec = W.partitionBy(*keys).orderBy(*[F.desc(o) if isinstance(o, str) else o for o in order])
    return changes.withColumn("_rn", F.row_number().over(spec)).filter("_rn = 1").drop("_rn")


def upsert(
    base: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    preserve: Sequence[str] = ("created_at",),
    order: Sequence[Column | str] = (),
) -> DataFrame:
    """New table: changed keys take the change's values, but keep the preserved columns of the base."""
    keys = list(keys)
    latest = last_write(changes, keys, order) if order else changes.dropDuplicates(keys)
    kept = base.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in preserve], F.lit(True).alias("_known"))
    merged = latest.join(kept, keys, "left")
    for c in preserve:
        merged = merged.withColumn(c, F.when(F.col("_known"), F.col(f"_old_{c}")).otherwise(F.col(c)))
    merged = merged.select(*base.columns)
    return base.join(latest.select(*keys), keys, "left_anti").unionByName(merged)


def insert_ignore(
    base: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[Column | str] = ()
) -> DataFrame:
    """Base plus those changes whose key is new; the first by order wins among repeats."""
    keys = list(keys)
    if order:
        first = W.partitionBy(*keys).orderBy(*order)
        fresh = changes.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
    else:
        fresh = changes.dropDuplicates(keys)
    fresh = fresh.join(base.select(*keys), keys, "left_anti")
    return base.unionByName(fresh.select(*base.columns))


def write_chunks(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).partitionBy("embedding_model", "embedding_version").parquet(path)


def split_by_dimension(df: DataFrame, dims: DataFrame, vector_col: str = "vector") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a vector must have its version's dimension.

    ``dims`` holds one row per (embedding_model, embedding_version) with ``dim``.
    """
    keys = ["embedding_model", "embedding_version"]
    checked = df.join(dims.select(*keys, "dim"), keys, "left")
    fits = F.coalesce(F.size(vector_col) == F.col("dim"), F.lit(False))
    good = checked.filter(fits).drop("dim")
    bad = checked.filter(~fits).select(
        "*", F.format_string("vector has %d values, version expects %d", F.size(vector_col), F.col("dim")).alias("error")
    )
    return good, bad


def write_vectors(df: DataFrame, dims: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Write vectors of the right dimension; return the rejected rows."""
    good, bad = split_by_dimension(df, dims)
    good.write.mode(mode).partitionBy("embedding_model", "embedding_version").parquet(path)
    return bad


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per row; a report is a single row."""
    df.coalesce(1).write.mode(mode).json(path)
