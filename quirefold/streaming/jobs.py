"""Job-state streams: snapshots, admission of re-parse requests, and the re-parse job.

State lies in folded tables, one row per job or document, and is merged with each micro-batch. A
micro-batch writes what it decides before the decision takes effect; replayed, it finds
that and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirefold.operators.jobs import admission_state, admit_reparse, fold_jobs, job_snapshot
from quirefold.plans.reparsing import reparse_step
from quirefold.sources.folded import FoldedTable, written_once
from quirefold.sources.store import CorpusStore

JOB = (
    "job_id bigint, status string, progress double, message string, document_title string, source_path string, "
    "created_at timestamp, enqueued bigint, updated bigint"
)
KNOWN = "document_id bigint, last_seq bigint, active boolean, seen_at timestamp"


def _start(rows: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def job_table(spark: SparkSession, path: str, buckets: int = 16) -> FoldedTable:
    """The state of all jobs, as ``snapshot_stream`` keeps it."""
    return FoldedTable(spark, path, "job_id", JOB, fold_jobs, buckets)


def snapshot_stream(events: DataFrame, path: str, checkpoint: str, once: bool = True, buckets: int = 16) -> StreamingQuery:
    """Keep the state of all jobs at ``path``: the batch operator on each micro-batch, folded into the table."""

    def step(batch: DataFrame, epoch: int) -> None:
        job_table(batch.sparkSession, path, buckets).fold(job_snapshot(batch))

    return _start(events, step, checkpoint, once)


def known_documents(spark: SparkSession, path: str, buckets: int = 16) -> FoldedTable:
    """The last entry that counts of each document, as ``admit_stream`` keeps it."""

    def newest(rows: DataFrame) -> DataFrame:
        last = F.max_by(F.struct("active", "seen_at"), "last_seq").alias("_last")
        return rows.groupBy("document_id").agg(F.max("last_seq").alias("last_seq"), last).select("document_id", "last_seq", "_last.*")

    return FoldedTable(spark, path, "document_id", KNOWN, newest, buckets)


def admit_step(log: DataFrame, epoch: int, root: str, now: Column | None = None, idle_seconds: int | None = None) -> DataFrame:
    """One micro-batch of admission: its decisions, written below ``root``, and the state after it.

    A document that was silent for ``idle_seconds`` is taken as free, as if it were new.
    """
    spark = log.sparkSession
    now = F.current_timestamp() if now is None else now
    state = known_documents(spark, f"{root}/known")

    def decide() -> DataFrame:
        known = state.read()
        if idle_seconds is not None:
            known = known.where(F.unix_seconds("seen_at") + idle_seconds > F.unix_seconds(now))
        return admit_reparse(log, known)

    decided = written_once(spark, f"{root}/decided/epoch={epoch}", decide)
    state.fold(admission_state(log).withColumn("seen_at", now))
    return decided


def admit_stream(
    log: DataFrame, root: str, checkpoint: str, once: bool = True, now: Column | None = None, idle_seconds: int | None = None
) -> StreamingQuery:
    """Admission of re-parse requests; ``read_decisions`` gives what was decided.

    ``log(document_id bigint, seq bigint, kind string, has_low_pages boolean)``. Entries of a micro-batch
    come in any order and of a document in any number: the batch operator orders them by
    blocks. An entry of an earlier ``seq`` than its document's last known one is late
    (``admit_reparse``).
    """
    return _start(log, lambda batch, epoch: admit_step(batch, epoch, root, now, idle_seconds), checkpoint, once)


def read_decisions(spark: SparkSession, root: str) -> DataFrame:
    """All decisions of ``admit_stream``: ``(document_id, seq, admitted)``."""
    return spark.read.parquet(f"{root}/decided").drop("epoch")


def reparse_stream(
    requests: DataFrame, store: CorpusStore, workspace_id: str, pages: DataFrame, root: str, checkpoint: str, once: bool = True, **options
) -> StreamingQuery:
    """The re-parse job over a stream of requests: ``reparse_step`` on each micro-batch."""

    def step(batch: DataFrame, epoch: int) -> None:
        reparse_step(store, workspace_id, batch, pages, root, epoch, **options)

    return _start(requests, step, checkpoint, once)
