"""The re-parse job: low-quality pages of requested documents are parsed again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.functions import pages as P
from quirefold.functions import report as R
from quirefold.functions import text as X
from quirefold.operators import chunking as C
from quirefold.operators import reparse
from quirefold.operators.jobs import REPARSE_PROGRESS, REQUEST, admit_reparse
from quirefold.session import cut_lineage, release
from quirefold.sources.folded import FoldedTable, written_once
from quirefold.sources.store import CorpusStore


# A job of the re-parse queue. Jobs are keyed by document and request, so a request has one job at most.
JOB = (
    "job_id string, document_id string, document_title string, source_path string, page_indices array<int>, resolved_pages array<int>, "
    "status string, progress double, message string, created_at timestamp, seq bigint"
)


def run_jobs(
    stored: DataFrame,
    pages: DataFrame,
    reparse_fn: Callable[[DataFrame], DataFrame] | None = None,
    threshold: float = P.FALLBACK_THRESHOLD,
) -> DataFrame:
    """Document records with the outcome of a new parse: ``resolved_pages``, ``status``, ``progress``, ``message``.

    ``pages(document_id, page_index, text)`` are the pages as they are now;
    ``reparse_fn`` may put better texts in their place.
    """
    fresh = pages.join(stored.select("document_id"), "document_id", "left_semi")
    fresh = fresh if reparse_fn is None else reparse_fn(fresh)
    lists = C.low_page_lists(C.low_pages(fresh, threshold)).withColumnRenamed("low_quality_pages", "still_low")
    readable = fresh.where(X.trim_unicode(F.col("text")) != "").select("document_id").distinct().withColumn("readable", F.lit(True))
    found = reparse.resolved_pages(stored, lists).join(readable, "document_id", "left")
    failed = (F.col("source_type") == "pdf") & F.col("readable").isNull()
    remaining = P.pages_without(F.col("low_quality_pages"), F.col("resolved_pages"))
    message = R.reparse_message(F.size("resolved_pages"), F.size(remaining))
    return found.withColumns({
        "status": F.when(failed, F.lit("failed")).otherwise(F.lit("completed")),
        "progress": F.lit(REPARSE_PROGRESS["completed"]),
        "message": F.when(failed, F.lit(C.NO_PAGE_TEXT)).otherwise(message),
    }).drop("still_low", "readable")


def store_outcomes(store: CorpusStore, workspace_id: str, ran: DataFrame, now: Column) -> None:
    """Records of completed jobs get their remaining pages and a new import time; sections are written again, chunks stay.

    ``ran(document_id, low_quality_pages, resolved_pages)`` says what each job found, so doing it twice
    gives the same records.
    """
    own = ran.select("document_id")
    # Written out, since the store is overwritten below while its rows are in use.
    stored = cut_lineage(store.table("documents", workspace_id).join(own, "document_id", "left_semi").drop("low_quality_pages"))
    sections = cut_lineage(store.table("sections", workspace_id).join(own, "document_id", "left_semi"))
    before = stored.join(ran.select("document_id", "low_quality_pages", now.alias("_now")), "document_id")
    applied = reparse.reparse_apply(before, ran, F.col("_now")).drop("_now")
    store.upsert_documents(applied.withColumn("position", F.lit(0).cast("long")), sections, now=F.col("imported_at"))
    release(stored, sections)


def reparse_batch(
    store: CorpusStore,
    workspace_id: str,
    requests: DataFrame,
    pages: DataFrame,
    now: Column | None = None,
    reparse_fn: Callable[[DataFrame], DataFrame] | None = None,
    threshold: float = P.FALLBACK_THRESHOLD,
) -> DataFrame:
    """Run admitted ``requests(document_id)``; returns the final state of each job."""
    now = F.current_timestamp() if now is None else now
    wanted = requests.select("document_id").distinct()
    stored = store.table("documents", workspace_id).join(wanted, "document_id", "left_semi").where(F.size("low_quality_pages") > 0)
    outcome = run_jobs(stored, pages, reparse_fn, threshold)
    ran = cut_lineage(outcome.select("document_id", "low_quality_pages", "resolved_pages", "status", "progress", "message"))
    store_outcomes(store, workspace_id, ran.where(F.col("status") == "completed"), now)
    return ran.select("document_id", "status", "progress", "message")


def _newest_jobs(rows: DataFrame) -> DataFrame:
    """One row per job; a job's row is the same whenever it is made."""
    names = [f.name for f in T._parse_datatype_string(JOB) if f.name != "job_id"]
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*names), "seq").alias("_job")).select("job_id", "_job.*")


def reparse_jobs(store: CorpusStore, root: str, buckets: int = 16) -> FoldedTable:
    """The jobs of ``reparse_step``, one row each."""
    return FoldedTable(store.spark, f"{root}/jobs", "job_id", JOB, _newest_jobs, buckets)


def reparse_step(
    store: CorpusStore,
    workspace_id: str,
    requests: DataFrame,
    pages: DataFrame,
    root: str,
    epoch: int,
    now: Column | None = None,
    reparse_fn: Callable[[DataFrame], DataFrame] | None = None,
    threshold: float = P.FALLBACK_THRESHOLD,
) -> None:
    """One micro-batch of ``requests(document_id, seq)``, exactly once: admission, run, stored record, job row.

    A request is taken if its document has low-quality pages and no earlier request of the
    micro-batch was taken for it; the jobs of earlier micro-batches have ended. What the jobs
    find is written below ``root`` before the records change. Replayed after a failure, the
    micro-batch finds its jobs there, and the records and job rows it writes are the same ones.
    """
    now = F.current_timestamp() if now is None else now

    def run() -> DataFrame:
        records = store.table("documents", workspace_id)
        asked = requests.select("document_id", "seq").join(
            records.select("document_id", (F.size("low_quality_pages") > 0).alias("has_low_pages")), "document_id"
        )
        taken = admit_reparse(asked.withColumn("kind", F.lit(REQUEST))).where("admitted").select("document_id", "seq")
        jobs = records.join(taken, "document_id")
        job_id = F.concat_ws(":", "document_id", F.col("seq").cast("string"))
        return run_jobs(jobs, pages, reparse_fn, threshold).select(
            job_id.alias("job_id"), "document_id", F.col("title").alias("document_title"), "source_path",
            F.col("low_quality_pages").alias("page_indices"), "resolved_pages", "status", "progress", "message",
            now.alias("created_at"), "seq",
        )

    jobs = written_once(store.spark, f"{root}/runs/epoch={epoch}", run)
    done = jobs.where(F.col("status") == "completed").withColumnRenamed("page_indices", "low_quality_pages")
    store_outcomes(store, workspace_id, done, F.col("created_at"))
    reparse_jobs(store, root).fold(jobs)
