"""Column functions over ARRAY<FLOAT|DOUBLE> vectors, accumulated in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NORM_FLOOR = 1e-6


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequal-length or zero vectors."""
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    size = norm(a) * norm(b)
    return F.when(usable & (size > 0), dot(a, b) / size).otherwise(F.lit(0.0))


def l2_normalize(vector: Column) -> Column:
    size = F.greatest(norm(vector), F.lit(NORM_FLOOR))
    return F.transform(as_double(vector), lambda x: x / size)


def mean_pool(tokens: DataFrame, keys: list[str], vector_col: str = "vector", mask_col: str | None = None) -> DataFrame:
    """Average of the unmasked token vectors of each key, position by position."""
    rows = tokens if mask_col is None else tokens.filter(F.col(mask_col) == 1)
    cells = rows.select(*keys, F.posexplode(as_double(F.col(vector_col))).alias("_dim", "_value"))
    means = cells.groupBy(*keys, "_dim").agg(F.avg("_value").alias("_mean"))
    ordered = F.sort_array(F.collect_list(F.struct("_dim", "_mean")))
    return means.groupBy(*keys).agg(F.transform(ordered, lambda s: s["_mean"]).alias(vector_col))
