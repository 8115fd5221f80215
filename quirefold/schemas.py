"""Schemas of the stored tables."""

from pyspark.sql import types as T

CHUNKS = T.StructType([
    T.StructField("chunk_id", T.StringType(), False),
    T.StructField("document_id", T.StringType(), False),
    T.StructField("ordinal", T.IntegerType(), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("source_page_index", T.IntegerType(), True),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("updated_at", T.TimestampType(), False),
    # The text in lower case, for searching; null in files from before the column.
    T.StructField("text_lc", T.StringType(), True),
])

SECTIONS = T.StructType([
    T.StructField("section_id", T.StringType(), False),
    T.StructField("document_id", T.StringType(), False),
    T.StructField("level", T.IntegerType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("chunk_start_ordinal", T.IntegerType(), False),
])

DOCUMENTS = T.StructType([
    T.StructField("document_id", T.StringType(), False),
    T.StructField("source_path", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("source_type", T.StringType(), False),
    T.StructField("chunk_count", T.IntegerType(), False),
    T.StructField("low_quality_pages", T.ArrayType(T.IntegerType()), False),
    T.StructField("imported_at", T.TimestampType(), False),
    # When the record was written last; null in files from before the column.
    T.StructField("updated_at", T.TimestampType(), True),
])

# The two kinds of source document.
SOURCE_TYPES = ("markdown", "pdf")
