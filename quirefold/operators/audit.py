"""Row validity and file checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.ids import is_valid_id
from quirefold.schemas import SOURCE_TYPES


def row_reject_reason(id_columns: list[str], source_type: str | None = None) -> Column:
    """Null for a row that can be read, else what is wrong with it."""
    reason = F.lit(None).cast("string")
    if source_type is not None:
        known = F.coalesce(F.col(source_type).isin(*SOURCE_TYPES), F.lit(False))
        reason = F.when(~known, F.lit(f"unknown {source_type}")).otherwise(reason)
    for name in reversed(id_columns):
        valid = F.coalesce(is_valid_id(F.col(name)), F.lit(False))
        reason = F.when(~valid, F.lit(f"malformed {name}")).otherwise(reason)
    return reason


def valid_rows(df: DataFrame, id_columns: list[str], source_type: str | None = None) -> DataFrame:
    """Rows with well-formed ids and a known source type; others are dropped."""
    return df.where(row_reject_reason(id_columns, source_type).isNull())


def invalid_rows(df: DataFrame, id_columns: list[str], source_type: str | None = None) -> DataFrame:
    """The dropped rows, with ``reject_reason``."""
    reason = row_reject_reason(id_columns, source_type)
    return df.withColumn("reject_reason", reason).where(F.col("reject_reason").isNotNull())


def artifact_audit(artifacts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Checksum state per artifact: ``ok``, ``mismatch``, ``not_found`` or ``too_large``.

    ``artifacts(model_id, content)``, null content meaning a file over the size that
    fits one value; ``manifest(model_id, sha256, position)``, where the first entry of
    an id counts. Hashing happens before the join, so contents are not shuffled.
    """
    hashed = artifacts.select("model_id", F.sha2("content", 256).alias("actual_sha256"))
    first = manifest.groupBy("model_id").agg(F.min_by("sha256", "position").alias("expected_sha256"))
    same = F.lower("expected_sha256") == F.col("actual_sha256")
    state = (
        F.when(F.col("expected_sha256").isNull(), F.lit("not_found"))
        .when(F.col("actual_sha256").isNull(), F.lit("too_large"))
        .when(same, F.lit("ok"))
        .otherwise(F.lit("mismatch"))
    )
    return hashed.join(first, "model_id", "left").select("model_id", "actual_sha256", state.alias("state"))
