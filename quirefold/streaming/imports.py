"""Import of arriving files as a stream."""

from __future__ import annotations

import hashlib

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirefold.plans.importing import import_batch
from quirefold.sources.corpus import MAX_FILE_BYTES, TOO_LARGE, decode_text, route_source_type
from quirefold.sources.store import CorpusStore

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Files below ``path`` as they arrive, ``max_files`` per micro-batch at most."""
    return (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", str(max_files))
        .load(path)
    )


def import_stream(
    files: DataFrame, store: CorpusStore, workspace_id: str, checkpoint: str, outcomes_path: str | None = None
) -> StreamingQuery:
    """Parse and store every file of the stream ``(source_path, text, reject_reason)`` once.

    A bad file becomes a failed row. The import batch id holds the stream's checkpoint,
    which is its identity, and the number of the micro-batch: one that runs again after a
    failure writes the same rows, and another stream writes others.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def store_batch(arrived: DataFrame, epoch: int) -> None:
        no_pages = arrived.sparkSession.createDataFrame([], "source_path string, page_index int, text string")
        # Files are fetched and decoded once for their parse and for rejects.
        kept = arrived.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            batch = import_batch(store, kept, no_pages, workspace_id, f"{workspace_id}-{stream}-{epoch}")
            if outcomes_path:
                rows = batch.outcomes().withColumn("epoch", F.lit(epoch))
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(outcomes_path)
            batch.release()
        finally:
            kept.unpersist()

    return (
        files.writeStream.foreachBatch(store_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def import_files_stream(
    spark: SparkSession,
    path: str,
    store: CorpusStore,
    workspace_id: str,
    checkpoint: str,
    outcomes_path: str | None = None,
    max_files: int = 1000,
) -> StreamingQuery:
    """``import_stream`` over the files that arrive below ``path``."""
    small = F.col("length") <= MAX_FILE_BYTES
    arrived = route_source_type(
        file_stream(spark, path, max_files).select(F.col("path").alias("source_path"), "length", F.when(small, F.col("content")).alias("content"))
    ).withColumnRenamed("reject_reason", "_unknown")
    decoded = decode_text(arrived)
    # Encoding and size are tested for text files; others are judged by type alone.
    bad = F.when(~small, F.lit(TOO_LARGE)).otherwise(F.col("reject_reason"))
    listed = decoded.select(
        "source_path",
        F.when(F.col("source_type") == "markdown", F.col("text")).alias("text"),
        F.when(F.col("source_type") == "markdown", bad).otherwise(F.col("_unknown")).alias("reject_reason"),
    )
    return import_stream(listed, store, workspace_id, checkpoint, outcomes_path)
