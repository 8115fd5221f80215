"""What a second parse of low-quality pages changed, on document records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import pages as P
from quirefold.operators.jobs import doc_latest_job


def _no_pages() -> Column:
    return F.array().cast("array<int>")


def resolved_pages(documents: DataFrame, still_low: DataFrame, requested: str = "low_quality_pages") -> DataFrame:
    """Requested pages that are not low any more; always empty for markdown.

    ``still_low(document_id, still_low)`` holds the page lists of the new parse.
    """
    found = P.pages_without(F.col(requested), F.coalesce("still_low", _no_pages()))
    return documents.join(still_low, "document_id", "left").withColumn(
        "resolved_pages", F.when(F.col("source_type") == "pdf", found).otherwise(_no_pages())
    )


def reparse_apply(documents: DataFrame, resolved: DataFrame, now: Column) -> DataFrame:
    """Records after a re-parse: remaining pages and a new import time, the rest unchanged.

    Documents without a row in ``resolved(document_id, resolved_pages)`` pass through.
    """
    joined = documents.join(resolved.select("document_id", "resolved_pages"), "document_id", "left")
    ran = F.col("resolved_pages").isNotNull()
    remaining = P.pages_without(F.col("low_quality_pages"), F.col("resolved_pages"))
    return (
        joined.withColumn("low_quality_pages", F.when(ran, remaining).otherwise(F.col("low_quality_pages")))
        .withColumn("imported_at", F.when(ran, now).otherwise(F.col("imported_at")))
        .drop("resolved_pages")
    )


def job_comparison(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every document that has a job compared with its newest one, with the job's status, progress, message and time.

    ``jobs(document_id, job_id, created_at, page_indices, status, progress, message)``; the pages before are
    those that the newest job was given. Documents without a job have nothing to compare.
    """
    newest = doc_latest_job(documents, jobs).where(F.col("job").isNotNull())
    said = ("status", "progress", "message", "page_indices")
    named = newest.select(*documents.columns, *(F.col(f"job.{name}").alias(name) for name in said), F.col("job.created_at").alias("updated_at"))
    return reparse_comparison(named)


def reparse_comparison(pairs: DataFrame, job_pages: str = "page_indices", now_pages: str = "low_quality_pages") -> DataFrame:
    """Before/after columns for documents paired with their newest job."""
    before, after = F.col("before_pages"), F.col("after_pages")
    listed = pairs.withColumn("before_pages", P.distinct_pages(F.col(job_pages))).withColumn(
        "after_pages", P.distinct_pages(F.col(now_pages))
    )
    counted = (
        listed.withColumn("resolved_pages", P.pages_except(before, after))
        .withColumn("remaining_pages", after)
        .withColumn("after_count", F.size(after))
        .withColumn("before_count", F.greatest(F.size(before), F.size(after)))
        .withColumn("resolved_count", F.greatest(F.lit(0), F.col("before_count") - F.col("after_count")))
    )
    ratio = F.when(F.col("before_count") > 0, F.col("resolved_count") / F.col("before_count")).otherwise(F.lit(0.0))
    return counted.withColumn("resolved_ratio", ratio.cast("double"))


# Name of a scope -> column that lists its pages.
SCOPES = {"resolved": "resolved_pages", "remaining": "remaining_pages", "input": "before_pages"}


def reparse_scope(comparison: DataFrame, scope: str | None = None) -> DataFrame:
    """Pages of one scope, or of all three, one row each: ``(document_id, scope, page_index)``."""
    wanted = SCOPES if scope is None else {scope: SCOPES[scope]}
    lists = F.array(*[F.struct(F.lit(name).alias("scope"), F.col(column).alias("pages")) for name, column in wanted.items()])
    return (
        comparison.select("document_id", F.explode(lists).alias("s"))
        .select("document_id", "s.scope", F.explode("s.pages").alias("page_index"))
    )
