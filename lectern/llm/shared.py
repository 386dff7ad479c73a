"""What several operators of this subpackage need."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Entries of a worker's memory of words before its older half goes.
REMEMBERED = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a session in one process (a test) that names none gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a result to the shared folder and read it back: lineage ends there, lost executors do no harm."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def unnamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """``docs`` with plain names c0, c1, …, so that no column of an operator's own can clash with one; the plain name of
    each column, and the columns under their old names."""
    plain = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*plain), dict(zip(docs.columns, plain)), [F.col(p).alias(n) for p, n in zip(plain, docs.columns)]


class Memory(dict):
    """A dict of bounded size: when the newer half is full, the older one goes."""

    def __init__(self, make, limit: int = REMEMBERED):
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
