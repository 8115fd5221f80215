"""Reading files and page tables, routing by type, and the JSON interchange form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions.text import file_extension

# Extension -> source type.
EXTENSIONS = {"md": "markdown", "markdown": "markdown", "txt": "markdown", "pdf": "pdf"}

# Fixed value: reject reason for bad bytes; the other one is our own.
BAD_ENCODING = "Unsupported text encoding"
TOO_LARGE = "File exceeds the size of one value"
# A file is one value of a row, and a value holds less than 2 GB.
MAX_FILE_BYTES = (1 << 31) - (1 << 20)
CORPUS_COLUMNS = ["source_path", "source_type", "text", "reject_reason"]


def source_type_of(path: Column) -> Column:
    extension = file_extension(path)
    kind = F.lit(None).cast("string")
    for name, value in EXTENSIONS.items():
        kind = F.when(extension == name, F.lit(value)).otherwise(kind)
    return kind


def route_source_type(files: DataFrame, path: str = "source_path") -> DataFrame:
    """Add ``source_type`` and, for an unknown extension, ``reject_reason``."""
    kind = source_type_of(F.col(path))
    return files.withColumn("source_type", kind).withColumn(
        "reject_reason",
        F.when(kind.isNull(), F.concat(F.lit("Unsupported file type: ."), file_extension(F.col(path)))),
    )


def binary_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``(source_path, length, content)`` of all files below ``path``; content stays unread unless used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(F.col("path").alias("source_path"), "length", "content")


def decode_text(files: DataFrame) -> DataFrame:
    """Content to text; what is not UTF-8 keeps a null text and a ``reject_reason``."""
    text = F.col("content").cast("string")
    good = F.is_valid_utf8(text)
    return files.withColumn("text", F.when(good, text)).withColumn(
        "reject_reason", F.when(~good, F.lit(BAD_ENCODING))
    ).drop("content")


def corpus_rows(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """``(source_path, length, content)`` to text rows and rejects, one row per file.

    A paged file keeps a null text and no reason: its text comes as a page table.

    The size test comes first and is answered by the file listing, so the content of
    an over-large file is never read.
    """
    routed = route_source_type(files)
    texts = routed.where(F.col("source_type") == "markdown").drop("reject_reason")
    no_text = F.lit(None).cast("string").alias("text")
    decoded = decode_text(texts.where(F.col("length") <= max_bytes)).select(*CORPUS_COLUMNS)
    large = texts.where(F.col("length") > max_bytes).select(
        "source_path", "source_type", no_text, F.lit(TOO_LARGE).alias("reject_reason")
    )
    others = routed.where(F.col("source_type").isNull() | (F.col("source_type") != "markdown"))
    return decoded.unionByName(large).unionByName(others.select("source_path", "source_type", no_text, "reject_reason"))


def read_corpus(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Files below ``path`` as ``(source_path, source_type, text, reject_reason)``."""
    return corpus_rows(binary_files(spark, path), max_bytes)


def read_artifacts(spark: SparkSession, path: str, model_id: Column, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Files for the checksum audit: ``(model_id, content)``, null content where over-large."""
    files = binary_files(spark, path)
    small = files.where(F.col("length") <= max_bytes).select(model_id.alias("model_id"), "content")
    large = files.where(F.col("length") > max_bytes).select(
        model_id.alias("model_id"), F.lit(None).cast("binary").alias("content")
    )
    return small.unionByName(large)


def to_interchange(documents: DataFrame) -> DataFrame:
    """Document records with the page list as JSON text."""
    return documents.withColumn("low_quality_pages_json", F.to_json("low_quality_pages")).drop("low_quality_pages")


def from_interchange(documents: DataFrame) -> DataFrame:
    """Back to an array column; JSON that is no list of integers fails the job."""
    pages = F.from_json("low_quality_pages_json", "array<int>", {"mode": "FAILFAST"})
    return documents.withColumn("low_quality_pages", pages).drop("low_quality_pages_json")


def write_interchange(documents: DataFrame, path: str) -> None:
    to_interchange(documents).write.mode("overwrite").parquet(path)


def read_interchange(spark: SparkSession, path: str) -> DataFrame:
    return from_interchange(spark.read.parquet(path))
