import os
import random

import pytest
from pyspark.sql import functions as F

from quirefold.functions import report as R2
from quirefold.operators import jobs as J
from quirefold.operators import reparse as R
from quirefold.plans import reparsing
from quirefold.plans.reparsing import reparse_jobs, reparse_step
from quirefold.session import scratch_path
from quirefold.sources.store import CorpusStore
from quirefold.streaming import jobs as stream_jobs

EVENT = "job_id long, seq long, status string, progress double"


def told(events):
    """Events with the texts and times that jobs carry."""
    return events.select(
        "*", F.concat_ws(" ", "status", "seq").alias("message"), F.concat(F.lit("T"), "job_id").alias("document_title"),
        F.lit("a/b.md").alias("source_path"), F.timestamp_seconds("seq").alias("created_at"),
    )


RECORD = "document_id long, source_type string, title string, chunk_count int, low_quality_pages array<int>, imported_at timestamp"


def records(spark, rows):
    flat = spark.createDataFrame(rows, RECORD.replace("imported_at timestamp", "at long"))
    return flat.withColumn("imported_at", F.timestamp_seconds("at")).drop("at")


def test_import_states(spark):
    """Success ends indexed at 1.0, failure ends failed."""
    rows = [(2, 10, "queued"), (1, 11, "queued"), (1, 12, "parsing"), (2, 13, "parsing"), (1, 14, "indexed"), (2, 15, "failed")]
    events = spark.createDataFrame(rows, "job_id long, seq long, status string").withColumn("progress", J.state_progress(F.col("status"), J.IMPORT_PROGRESS))
    events = told(events)
    snapshot = [tuple(r) for r in J.job_snapshot(events).orderBy("enqueued").select("job_id", "status", "progress").collect()]
    assert snapshot == [(2, "failed", 1.0), (1, "indexed", 1.0)]
    half = J.job_snapshot(events.where("seq < 14")).orderBy("enqueued").select("progress").collect()
    assert [r[0] for r in half] == [0.2, 0.2]


def test_reparse_updates_the_record(spark):
    """Low pages [0, 2, 3], resolved [0, 2], one page left."""
    docs = records(spark, [(1, "pdf", "t", 7, [0, 2, 3], 5), (2, "markdown", "m", 1, [1], 5), (3, "pdf", "u", 2, [4, 4, 1], 5)])
    still = spark.createDataFrame([(1, [3]), (2, []), (3, [1, 9])], "document_id long, still_low array<int>")
    resolved = R.resolved_pages(docs, still)
    assert {r["document_id"]: r["resolved_pages"] for r in resolved.collect()} == {1: [0, 2], 2: [], 3: [4, 4]}
    after = R.reparse_apply(docs, resolved.where("document_id < 3"), F.timestamp_seconds(F.lit(99)))
    rows = {r["document_id"]: r for r in after.withColumn("at", F.unix_seconds("imported_at")).collect()}
    assert rows[1]["low_quality_pages"] == [3] and rows[1]["at"] == 99 and rows[1]["chunk_count"] == 7
    assert rows[2]["low_quality_pages"] == [1] and rows[2]["at"] == 99
    assert rows[3]["low_quality_pages"] == [4, 4, 1] and rows[3]["at"] == 5


def test_comparison(spark):
    pairs = spark.createDataFrame(
        [(1, [3, 0, 3], [3]), (2, [], []), (3, [1], [1, 5, 7]), (4, [2, 1], [])],
        "document_id long, page_indices array<int>, low_quality_pages array<int>",
    )
    compared = R.reparse_comparison(pairs)
    rows = {r["document_id"]: r for r in compared.collect()}
    assert (rows[1]["before_pages"], rows[1]["resolved_pages"], rows[1]["before_count"], rows[1]["after_count"], rows[1]["resolved_ratio"]) == ([0, 3], [0], 2, 1, 0.5)
    assert (rows[2]["before_count"], rows[2]["resolved_ratio"]) == (0, 0.0)
    assert (rows[3]["before_count"], rows[3]["resolved_count"], rows[3]["remaining_pages"], rows[3]["resolved_pages"]) == (3, 0, [1, 5, 7], [])
    assert rows[4]["resolved_ratio"] == 1.0
    scopes = sorted((r["scope"], r["page_index"]) for r in R.reparse_scope(compared).where("document_id = 1").collect())
    assert scopes == [("input", 0), ("input", 3), ("remaining", 3), ("resolved", 0)]
    assert R.reparse_scope(compared, "resolved").where("document_id = 4").count() == 2


def test_second_request_is_refused(spark):
    """Enqueued twice, taken once."""
    log = spark.createDataFrame([(1, 1, "enqueue", True), (1, 2, "enqueue", True), (2, 3, "enqueue", False)], "document_id long, seq long, kind string, has_low_pages boolean")
    assert {r["seq"]: r["admitted"] for r in J.admit_reparse(log).collect()} == {1: True, 2: False, 3: False}


def admission_log(rows=2500):
    rng = random.Random(4)
    log, active, expected = [], {}, {}
    for seq in range(rows):
        document = 0 if rng.random() < 0.5 else rng.randint(1, 50)
        kind = rng.choice(["enqueue", "enqueue", "finish"])
        pages = rng.random() < 0.8
        log.append((document, seq, kind, pages))
        if kind == "finish":
            active[document] = False
        else:
            expected[seq] = pages and not active.get(document, False)
            active[document] = active.get(document, False) or expected[seq]
    return log, expected


SCHEMA = "document_id long, seq long, kind string, has_low_pages boolean"


def test_admission_matches_a_state_machine(spark):
    log, expected = admission_log()
    got = {r["seq"]: r["admitted"] for r in J.admit_reparse(spark.createDataFrame(log, SCHEMA)).collect()}
    assert got == expected


def test_job_texts(spark):
    """Title, path and time are those of the first event, the message that of the last."""
    events = told(spark.createDataFrame([(1, 5, "queued", 0.0), (1, 7, "parsing", 0.2), (1, 6, "failed", 7.0)], EVENT))
    row = J.job_snapshot(events).withColumn("at", F.unix_seconds("created_at")).first()
    assert (row["message"], row["progress"], row["document_title"], row["source_path"], row["at"]) == ("parsing 7", 0.2, "T1", "a/b.md", 5)
    said = spark.range(1).select(R2.parsing_message(F.lit("in/x y.md")).alias("m")).first()["m"]
    assert (said, R2.QUEUED, R2.REPARSING) == ("Parsing x y.md", "Queued", "Re-parsing PDF")


def arriving(spark, rows, schema, size):
    """A stream with one micro-batch for each ``size`` rows."""
    root = scratch_path(spark, "log")
    for start in range(0, len(rows), size):
        spark.createDataFrame(rows[start : start + size], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    return root, spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(f"{root}/in")


def decisions(spark, root):
    return {r["seq"]: r["admitted"] for r in stream_jobs.read_decisions(spark, root).collect()}


def test_admission_stream_over_micro_batches(spark):
    log, expected = admission_log(600)
    root, stream = arriving(spark, log, SCHEMA, 200)
    stream_jobs.admit_stream(stream, f"{root}/out", f"{root}/ck").awaitTermination()
    assert decisions(spark, f"{root}/out") == expected


def test_late_replayed_and_idle_entries(spark):
    root = scratch_path(spark, "admit")
    step = lambda epoch, rows, at=0, **o: stream_jobs.admit_step(spark.createDataFrame(rows, SCHEMA), epoch, root, F.timestamp_seconds(F.lit(at)), **o)
    step(0, [(1, 10, "enqueue", True), (2, 11, "enqueue", False)])
    # Sequence 9 is late: its finish has no effect, and a late request is refused.
    late = [(1, 9, "finish", True), (1, 12, "enqueue", True), (3, 13, "enqueue", True), (1, 8, "enqueue", True)]
    step(1, late)
    assert decisions(spark, root) == {10: True, 11: False, 12: False, 13: True, 8: False}
    step(1, late)
    assert decisions(spark, root) == {10: True, 11: False, 12: False, 13: True, 8: False}
    step(2, [(1, 14, "finish", True)])
    step(3, [(1, 15, "enqueue", True), (3, 16, "enqueue", True)])
    assert (decisions(spark, root)[15], decisions(spark, root)[16]) == (True, False)
    step(4, [(3, 17, "enqueue", True)], at=59, idle_seconds=60)
    step(5, [(3, 18, "enqueue", True)], at=119, idle_seconds=60)
    assert (decisions(spark, root)[17], decisions(spark, root)[18]) == (False, True)


def test_snapshot_stream_over_micro_batches(spark):
    rng = random.Random(9)
    events = [(rng.randint(1, 20), seq, rng.choice(["queued", "parsing", "indexed", "failed"]), rng.random() * 1.2) for seq in range(300)]
    root, stream = arriving(spark, events, EVENT, 60)
    stream_jobs.snapshot_stream(told(stream), f"{root}/jobs", f"{root}/ck", buckets=4).awaitTermination()
    got = {tuple(r) for r in stream_jobs.job_table(spark, f"{root}/jobs", 4).read().select("job_id", "status", "progress", "message", "enqueued").collect()}
    expected = {tuple(r) for r in J.job_snapshot(told(spark.createDataFrame(events, EVENT))).select("job_id", "status", "progress", "message", "enqueued").collect()}
    assert got == expected and len(got) == 20
    # Five micro-batches leave one file for each bucket.
    assert len([f for _, _, names in os.walk(f"{root}/jobs") for f in names if f.endswith(".parquet")]) <= 4
    stream_jobs.job_table(spark, f"{root}/jobs", 4).fold(J.job_snapshot(told(spark.createDataFrame(events[240:], EVENT))))
    assert {tuple(r) for r in stream_jobs.job_table(spark, f"{root}/jobs", 4).read().select("job_id", "status", "progress", "message", "enqueued").collect()} == expected


def reparse_store(spark):
    store = CorpusStore(spark, scratch_path(spark, "store"), buckets=2)
    rows = [("a", "in/a.pdf", "A", "pdf", 3, [0, 2, 3], 100, "w", 0), ("b", "in/b.pdf", "B", "pdf", 1, [1], 100, "w", 0), ("c", "in/c.pdf", "C", "pdf", 1, [], 100, "w", 0), ("d", "in/d.pdf", "D", "pdf", 1, [5], 100, "w", 0)]
    schema = "document_id string, source_path string, title string, source_type string, chunk_count int, low_quality_pages array<int>, at long, workspace_id string, position long"
    records = spark.createDataFrame(rows, schema).withColumn("imported_at", F.timestamp_seconds("at")).drop("at")
    sections = spark.createDataFrame([("s", "a", 1, "T", 0, "w")], "section_id string, document_id string, level int, title string, chunk_start_ordinal int, workspace_id string")
    store.upsert_documents(records, sections)
    long, short = "word " * 60, "word"
    pages = [("a", 0, long), ("a", 2, long), ("a", 3, short), ("b", 1, " "), ("d", 5, long)]
    return store, spark.createDataFrame(pages, "document_id string, page_index int, text string"), scratch_path(spark, "jobs")


def stored_records(store):
    return {r["document_id"]: (r["low_quality_pages"], r["at"]) for r in store.table("documents", "w").withColumn("at", F.unix_seconds("imported_at")).collect()}


def told_jobs(store, root):
    return {r["job_id"]: (r["status"], r["message"], r["page_indices"], r["at"]) for r in reparse_jobs(store, root).read().withColumn("at", F.unix_seconds("created_at")).collect()}


def test_reparse_steps_are_exactly_once(spark, monkeypatch):
    store, pages, root = reparse_store(spark)
    requests = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), ("c", 4), ("zz", 5)], "document_id string, seq long")
    step = lambda epoch, rows, at: reparse_step(store, "w", rows, pages, root, epoch, F.timestamp_seconds(F.lit(at)))
    # The first try fails after the runs are written and the records stored, before the job rows are.
    with monkeypatch.context() as broken:
        broken.setattr(reparsing, "reparse_jobs", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            step(0, requests, 500)
    expected = {"a": ([3], 500), "b": ([1], 100), "c": ([], 100), "d": ([5], 100)}
    assert stored_records(store) == expected
    for at in (900, 901):
        step(0, requests, at)
        assert stored_records(store) == expected
        assert told_jobs(store, root) == {
            "a:1": ("completed", "Resolved 2, remaining 1", [0, 2, 3], 500), "b:3": ("failed", "PDF has no extractable text", [1], 500)
        }
    step(1, spark.createDataFrame([("a", 9)], "document_id string, seq long"), 1000)
    assert told_jobs(store, root)["a:9"] == ("completed", "Resolved 0, remaining 1", [3], 1000) and stored_records(store)["a"] == ([3], 1000)
    assert store.table("sections", "w").count() == 1


def test_reparse_stream(spark):
    store, pages, root = reparse_store(spark)
    source, stream = arriving(spark, [("a", 1), ("a", 2), ("d", 3), ("a", 4)], "document_id string, seq long", 2)
    stream_jobs.reparse_stream(stream, store, "w", pages, root, f"{source}/ck").awaitTermination()
    assert {j: s for j, (s, *_) in told_jobs(store, root).items()} == {"a:1": "completed", "d:3": "completed", "a:4": "completed"}
    assert {d: p for d, (p, _) in stored_records(store).items()} == {"a": [3], "b": [1], "c": [], "d": []}


def test_comparison_with_the_newest_job(spark):
    docs = spark.createDataFrame([(1, [3]), (2, [1]), (3, [])], "document_id long, low_quality_pages array<int>")
    jobs = spark.createDataFrame(
        [(1, 10, 5, [9], "failed", 1.0, "x"), (1, 11, 7, [0, 3, 0], "completed", 1.0, "y"), (3, 12, 1, [], "queued", 0.0, "z")],
        "document_id long, job_id long, created_at long, page_indices array<int>, status string, progress double, message string",
    )
    rows = {r["document_id"]: r for r in R.job_comparison(docs, jobs).collect()}
    assert set(rows) == {1, 3}
    assert (rows[1]["before_pages"], rows[1]["resolved_pages"], rows[1]["message"], rows[1]["updated_at"], rows[1]["resolved_ratio"]) == ([0, 3], [0], "y", 7, 0.5)
    assert (rows[3]["before_count"], rows[3]["resolved_ratio"], rows[3]["status"]) == (0, 0.0, "queued")


def test_document_jobs(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "document_id long")
    jobs = spark.createDataFrame([(1, 10, "completed", 5), (1, 11, "queued", 7), (2, 12, "failed", 6), (2, 13, "completed", 6)], "document_id long, job_id long, status string, created_at long")
    latest = {r["document_id"]: r["job"] and r["job"]["job_id"] for r in J.doc_latest_job(docs, jobs).collect()}
    assert latest == {1: 11, 2: 13, 3: None}
    assert [r[0] for r in J.active_job_semi(docs, jobs).collect()] == [1]
    assert sorted(r[0] for r in J.active_job_semi(docs, jobs, active=False).collect()) == [2, 3]
