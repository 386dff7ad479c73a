"""Continuous ingest: new files are chunked, embedded and registered batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.plans.jobs import ingest

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"
#: Written in this order: a batch is known only once all of its tables are there.
TABLES = ("links", "file_text", "chunks", "vectors", "raw_large", "failures", "files")
#: The hashes of what has been read.
REGISTRY = "registry"


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A table of all batches written so far; none before the first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def known_files(spark: SparkSession, sink: str, but: int | None = None) -> DataFrame | None:
    """(file_id) of every file that a batch other than ``but`` has read; failed ones are to be tried again."""
    found = _stored(spark, f"{sink}/{REGISTRY}")
    return found if found is None or but is None else found.filter(F.col("batch_id") != but)


def is_known(spark: SparkSession, sink: str, sha256: str) -> bool:
    """Whether bytes of this hash have been read."""
    found = known_files(spark, sink)
    return found is not None and bool(found.filter(F.col("file_id") == f"file_{sha256}").take(1))


def batch_writer(sink: str, chat_id: str, cancelled: DataFrame | None = None, **options) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over files with bytes. Each batch overwrites its own folders and looks at those of the
    others only, so a replay changes nothing, and bytes that came in an earlier batch are not read again.

    The registry of hashes is narrow, sorted within a batch and carries a Bloom filter a row group: ``is_known`` skips
    what cannot hold a hash, and a batch brings its own few hashes to it, so that it is read but never shuffled.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        files = batch.select(
            "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.col("length").alias("size_bytes"),
            F.col("modificationTime").alias("created_at"), "content",
            F.col("chat_id") if "chat_id" in batch.columns else F.lit(chat_id).alias("chat_id"),
        )
        if cancelled is not None:
            files = files.join(cancelled.select("path"), "path", "left_anti")
        links = _stored(spark, f"{sink}/links")
        if links is not None:
            links = links.filter(F.col("batch_id") != batch_id)
        made = ingest(files, known=known_files(spark, sink, batch_id), known_links=links, **options)
        for name in TABLES:
            made[name].write.mode("overwrite").parquet(f"{sink}/{name}/batch_id={batch_id}")
        read = spark.read.schema(made["files"].schema).parquet(f"{sink}/files/batch_id={batch_id}").filter("status = 'completed'")
        read.select("file_id").sortWithinPartitions("file_id").write.mode("overwrite").option(
            "parquet.bloom.filter.enabled#file_id", "true").parquet(f"{sink}/{REGISTRY}/batch_id={batch_id}")

    return write


def current_files(spark: SparkSession, sink: str) -> DataFrame:
    """The files table: of each file the row of its last batch (a failed file may come again)."""
    rows = spark.read.parquet(f"{sink}/files")
    cols = [c for c in rows.columns if c not in ("file_id", "batch_id")]
    return rows.groupBy("file_id").agg(F.max_by(F.struct(*cols), "batch_id").alias("_last")).select("file_id", "_last.*")


def ingest_stream(
    spark: SparkSession, path: str, sink: str, checkpoint: str, chat_id: str = "inbox", glob: str | None = None,
    max_files: int = 1000, available_now: bool = False, cancelled: DataFrame | None = None, **options,
) -> StreamingQuery:
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    writer = reader.load(path).writeStream.foreachBatch(batch_writer(sink, chat_id, cancelled, **options)).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
