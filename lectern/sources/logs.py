"""JSON-lines sources and request-log lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.schemas import REQUEST_LOG


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict read: blank lines are skipped, anything but a JSON object fails with its file and text."""
    lines = spark.read.text(path).select(
        F.trim("value").alias("_line"), F.col("_metadata.file_path").alias("_file")
    ).filter("_line <> ''")
    shape = f"{schema}, _corrupt string"
    parsed = lines.withColumn(
        "_row", F.from_json("_line", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    )
    bad = F.col("_row").isNull() | F.col("_row._corrupt").isNotNull() | ~F.col("_line").startswith("{")
    message = F.concat(F.lit("bad JSON line in "), F.col("_file"), F.lit(": "), F.col("_line"))
    checked = F.when(bad, F.raise_error(message).cast(f"struct<{shape}>")).otherwise(F.col("_row"))
    return parsed.select(checked.alias("_row")).select("_row.*").drop("_corrupt")


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    """Lenient read: lines that are not JSON objects of the log's shape are skipped."""
    return spark.read.schema(REQUEST_LOG).option("mode", "DROPMALFORMED").json(path)


def recent_requests(log: DataFrame, n: int, time_col: str = "timestamp", key: str = "id") -> DataFrame:
    """Newest n entries, oldest first."""
    if n < 1:
        raise ValueError("n must be positive")
    newest = log.orderBy(F.desc(time_col), F.desc(key)).limit(n)
    return newest.orderBy(time_col, key)


def request_by_id(log: DataFrame, entry_id: str, key: str = "id") -> DataFrame:
    return log.filter(F.col(key) == entry_id)
