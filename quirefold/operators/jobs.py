"""Job tables: newest job per document, active jobs, snapshots and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import report as R
from quirefold.operators.blocks import last_before

# Job states and the progress each one reports.
ACTIVE_STATES = ("queued", "running")
IMPORT_PROGRESS = {"queued": 0.0, "parsing": 0.2, "indexed": 1.0, "failed": 1.0}
REPARSE_PROGRESS = {"queued": 0.0, "running": 0.2, "completed": 1.0, "failed": 1.0}

REQUEST, FINISH = "enqueue", "finish"


def state_progress(status: Column, table: dict[str, float]) -> Column:
    result = F.lit(None).cast("double")
    for name, value in table.items():
        result = F.when(status == name, F.lit(value)).otherwise(result)
    return R.clamp_progress(result)


def doc_latest_job(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every document with its newest job (``created_at``, ties by ``job_id``), null if it has none."""
    names = [name for name in jobs.columns if name != "document_id"]
    newest = jobs.groupBy("document_id").agg(
        F.max_by(F.struct(*names), F.struct("created_at", "job_id")).alias("job")
    )
    return documents.join(newest, "document_id", "left")


def active_job_semi(documents: DataFrame, jobs: DataFrame, active: bool = True) -> DataFrame:
    """Documents with a queued or running job, or (``active=False``) without one."""
    busy = jobs.where(F.col("status").isin(*ACTIVE_STATES)).select("document_id").distinct()
    return documents.join(busy, "document_id", "left_semi" if active else "left_anti")


# What a job says of its last event, and what it keeps from its first one.
LAST = ["status", "progress", "message"]
FIRST = ["document_title", "source_path", "created_at"]


def job_snapshot(events: DataFrame) -> DataFrame:
    """State of every job after its last event; ``enqueued`` gives the order of the list.

    ``events(job_id, seq, status, progress, message, document_title, source_path, created_at)``.
    Status, progress and message are those of the last event, title, path and time those of the first.
    """
    rows = events.withColumn("progress", R.clamp_progress(F.col("progress")))
    return fold_jobs(rows.withColumn("enqueued", F.col("seq")).withColumn("updated", F.col("seq")))


def fold_jobs(states: DataFrame) -> DataFrame:
    """One row per job of its states at several times; the same states twice change nothing."""
    merged = states.groupBy("job_id").agg(
        F.max_by(F.struct(*LAST), "updated").alias("_last"),
        F.min_by(F.struct(*FIRST), "enqueued").alias("_first"),
        F.min("enqueued").alias("enqueued"),
        F.max("updated").alias("updated"),
    )
    return merged.select("job_id", "_last.*", "_first.*", "enqueued", "updated")


def admit_reparse(log: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Which re-parse requests are taken: ``(document_id, seq, admitted)``.

    ``log(document_id, seq, kind, has_low_pages)`` holds requests and finishes. A
    request counts if the document has low pages; it is taken if the entry before it
    is a finish or there is none, since any other entry means a job is active.

    ``known(document_id, last_seq, active)`` is what is known from before the log. An
    entry that is not after its document's ``last_seq`` is late: a late request is refused, and a
    late finish has no effect.
    """
    entries = log.select("document_id", "seq", "kind", "has_low_pages")
    late = F.lit(False)
    if known is not None:
        # The last known entry goes in front; it is no request of the log, so it has no pages.
        kept = known.select("document_id", F.col("last_seq").alias("seq"), F.when(F.col("active"), REQUEST).otherwise(FINISH).alias("kind"))
        entries = entries.withColumn("given", F.lit(True)).unionByName(
            kept.withColumn("has_low_pages", F.lit(True)).withColumn("given", F.lit(False))
        )
        entries = entries.join(known.select("document_id", "last_seq"), "document_id", "left")
        late = F.coalesce(F.col("seq") <= F.col("last_seq"), F.lit(False)) & F.col("given")
    else:
        entries = entries.withColumn("given", F.lit(True)).withColumn("last_seq", F.lit(None).cast("bigint"))
    entries = entries.withColumn("late", late)
    counts = ((F.col("kind") == FINISH) | F.col("has_low_pages")) & ~F.col("late")
    seen = last_before(entries, ["document_id"], "seq", F.when(counts, F.col("kind")), "previous")
    free = F.col("previous").isNull() | (F.col("previous") == FINISH)
    taken = F.coalesce(F.col("has_low_pages"), F.lit(False)) & free & ~F.col("late")
    return seen.where(F.col("given") & (F.col("kind") == REQUEST)).select("document_id", "seq", taken.alias("admitted"))


def admission_state(log: DataFrame) -> DataFrame:
    """What is known after a log: ``(document_id, last_seq, active)`` from its last entry that counts."""
    counted = log.where((F.col("kind") == FINISH) | F.col("has_low_pages"))
    return counted.groupBy("document_id").agg(
        F.max("seq").alias("last_seq"), F.max_by(F.col("kind") == REQUEST, "seq").alias("active")
    )


def import_outcomes(good: DataFrame, rejects: DataFrame) -> DataFrame:
    """One final job row per file: indexed with counts, or failed with the reason.

    ``good(source_path, chunk_count, fallback_page_count)``, ``rejects(source_path, reject_reason)``.
    """
    done = good.select(
        "source_path",
        F.lit("indexed").alias("status"),
        F.lit(IMPORT_PROGRESS["indexed"]).alias("progress"),
        R.import_message(F.col("chunk_count"), F.col("fallback_page_count")).alias("message"),
    )
    failed = rejects.select(
        "source_path",
        F.lit("failed").alias("status"),
        F.lit(IMPORT_PROGRESS["failed"]).alias("progress"),
        F.col("reject_reason").alias("message"),
    )
    return done.unionByName(failed)
