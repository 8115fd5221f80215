"""Merging a batch into a table, as DataFrame jobs; the store writes the results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merge_latest(existing: DataFrame, batch: DataFrame, key: Sequence[str], position: str, now: Column) -> DataFrame:
    """Insert or overwrite by key: the last batch row wins, ``created_at`` is kept.

    ``position`` orders the batch. Existing rows come before every batch row. The
    merge is one aggregation, so copies of one key shrink before the shuffle.
    """
    key = list(key)
    values = [name for name in batch.columns if name not in (*key, position)]
    old = existing.withColumn(position, F.lit(-1).cast("long"))
    new = batch.withColumn(position, F.col(position).cast("long")).withColumn("created_at", now).withColumn("updated_at", now)
    rows = old.unionByName(new)
    merged = rows.groupBy(*key).agg(
        F.max_by(F.struct(*values, "updated_at"), position).alias("_last"),
        F.min_by("created_at", position).alias("created_at"),
    )
    return merged.select(*key, *[F.col(f"_last.{name}").alias(name) for name in values], "created_at", "_last.updated_at")


def upsert_chunks(existing: DataFrame, batch: DataFrame, position: str, now: Column) -> DataFrame:
    return merge_latest(existing, batch, ["chunk_id"], position, now)


def upsert_documents(existing: DataFrame, batch: DataFrame, position: str, now: Column) -> DataFrame:
    """Same by document id; a record has no creation time of its own, and ``updated_at`` when it was written last."""
    names = [name for name in batch.columns if name not in ("document_id", "updated_at", position)] + ["updated_at"]
    rows = existing.select("document_id", *names, F.lit(-1).cast("long").alias(position)).unionByName(
        batch.withColumn(position, F.col(position).cast("long")).withColumn("updated_at", now)
    )
    merged = rows.groupBy("document_id").agg(F.max_by(F.struct(*names), position).alias("_last"))
    return merged.select("document_id", "_last.*")


def replace_sections(existing: DataFrame, batch_documents: DataFrame, new: DataFrame) -> DataFrame:
    """Drop all sections of the batch's documents, then add the new ones.

    The anti-join is on the documents, not on the new sections: a document whose
    outline became empty loses its old rows.
    """
    ids = batch_documents.select("document_id").distinct()
    return existing.join(ids, "document_id", "left_anti").unionByName(new)


def evolve_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bring rows of an earlier version to ``schema``: new nullable columns become null."""
    have = set(df.columns)
    missing = [f.name for f in schema if f.name not in have and not f.nullable]
    if missing:
        raise ValueError(f"columns without a default: {', '.join(missing)}")
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ])
