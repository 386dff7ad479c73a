"""Vectors of whole numbers and their exact inner products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums of products up to here are exact in float64.
EXACT = float(1 << 53)
LONGEST = (1 << 63) - 1


def scaled(vector: Column, by: int = 256) -> Column:
    """floor(by * x) of each component, x as double. ``floor`` gives a long; from 2^53 on a double is whole already."""
    def whole(x: Column) -> Column:
        y = x.cast("double") * by
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, whole)


def finite(vector: Column) -> Column:
    """Whether a vector is there and every component is a finite number."""
    return vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def numbered(df: DataFrame) -> DataFrame:
    """A number of its own for every row, wherever its id is repeated; it holds once the result is written."""
    return df.withColumn("row", F.monotonically_increasing_id())


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with those of ``b``: float64 where sums stay exact in it, else Python's
    integers, which are slow but never round; beyond a long they become the outermost long."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1) < EXACT:
        return a @ b.T
    whole = [np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (a, b)]
    return np.frompyfunc(lambda s: max(-LONGEST - 1, min(LONGEST, s)), 1, 1)(np.dot(whole[0], whole[1].T))
