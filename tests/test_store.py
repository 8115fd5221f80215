import hashlib
import os

import pytest
from pyspark.sql import functions as F

from quirefold.functions import ids
from quirefold.operators import audit, upsert
from quirefold.operators import chunking as C
from quirefold.operators import sections as S
from quirefold.operators.search import keyword_topk
from quirefold.plans.importing import import_batch, parse_batch
from quirefold.plans.reparsing import reparse_batch
from quirefold.schemas import CHUNKS
from quirefold.sources import corpus, export
from quirefold.sources.store import CorpusStore
from quirefold.streaming.imports import import_files_stream

CHUNK = "chunk_id string, document_id string, ordinal int, text string, source_page_index int, workspace_id string, position long"
RECORD = "document_id string, source_path string, title string, source_type string, chunk_count int, low_quality_pages array<int>, imported_at timestamp, workspace_id string, position long"
SECTION = "section_id string, document_id string, level int, title string, chunk_start_ordinal int, workspace_id string"


def record(spark, rows):
    flat = RECORD.replace("imported_at timestamp", "at long")
    return spark.createDataFrame(rows, flat).withColumn("imported_at", F.timestamp_seconds("at")).drop("at")


def files_of(folder):
    return {os.path.join(p, f) for p, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_persist_and_search(spark, tmp_path):
    """Three chunks, one record, two sections in order."""
    store = CorpusStore(spark, str(tmp_path / "s"), buckets=4)
    chunks = [(f"c{i}", "d", i, t, None, "w", i) for i, t in enumerate(["silver copper", "marble iron", "copper tin"])]
    store.upsert_chunks(spark.createDataFrame(chunks, CHUNK))
    assert [r["ordinal"] for r in keyword_topk(store.table("chunks", "w"), "copper", 10).collect()] == [0, 2]
    rows = record(spark, [("d", "/p.md", "T", "markdown", 3, [], 100, "w", 0)])
    sections = spark.createDataFrame([("s2", "d", 2, "Ores", 2, "w"), ("s1", "d", 1, "Alloys", 0, "w")], SECTION)
    store.upsert_documents(rows, sections)
    assert [r["title"] for r in S.recent_documents(store.table("documents"), 10).collect()] == ["T"]
    assert [r["title"] for r in S.sections_of_document(store.table("sections"), "d").collect()] == ["Alloys", "Ores"]


def test_upsert_rewrites_only_buckets_with_conflicts(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "s"), buckets=16)
    rows = [(f"c{i}", "d" if i < 10 else f"d{i}", i, f"v1 {i}", None, "w", 0) for i in range(100)]
    store.upsert_chunks(spark.createDataFrame(rows, CHUNK), now=F.timestamp_seconds(F.lit(1)))
    before = files_of(tmp_path / "s" / "chunks")
    batch = [("c7", "d", 7, "first", None, "w", 0), ("c7", "e", 70, "last", 3, "w", 1), ("new", "e", 0, "n", None, "w", 2), ("c7", "d", 7, "other", None, "x", 0)]
    store.upsert_chunks(spark.createDataFrame(batch, CHUNK), now=F.timestamp_seconds(F.lit(9)))
    kept = before & files_of(tmp_path / "s" / "chunks")
    assert 1 <= len(before - kept) <= 2  # the chunk's old document and its new one, of sixteen buckets
    got = {(r["workspace_id"], r["chunk_id"]): r for r in store.table("chunks").withColumn("c", F.unix_seconds("created_at")).withColumn("u", F.unix_seconds("updated_at")).collect()}
    assert len(got) == 102
    row = got[("w", "c7")]
    assert (row["document_id"], row["ordinal"], row["text"], row["source_page_index"], row["c"], row["u"]) == ("e", 70, "last", 3, 1, 9)
    assert (got[("w", "c8")]["c"], got[("w", "c8")]["u"], got[("w", "new")]["c"]) == (1, 1, 9)
    # The bucket count is a property of the store.
    assert CorpusStore(spark, str(tmp_path / "s"), buckets=5).buckets == 16
    store.upsert_chunks(spark.createDataFrame([], CHUNK))
    assert store.table("chunks").count() == 102


def test_an_import_looks_at_its_own_buckets_only(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "s"), buckets=16)
    rows = [(f"c{d}-{i}", f"d{d}", i, "text", None, "w", 0) for d in range(40) for i in range(5)]
    store.upsert_chunks(spark.createDataFrame(rows, CHUNK), unique=True, documents=spark.createDataFrame([(f"d{d}", "w") for d in range(40)], "document_id string, workspace_id string"))
    before = files_of(tmp_path / "s" / "chunks")
    keys = store._filed(spark.createDataFrame([("d7", "w")], "document_id string, workspace_id string"), "chunks")
    near = store.stored_near(keys, "chunks")
    scan = next(line for line in near._jdf.queryExecution().explainString(near._jvm().org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).splitlines() if "PartitionFilters" in line) if hasattr(near, "_jvm") else str(near._jdf.queryExecution().executedPlan())
    assert "bucket" in scan.split("PartitionFilters")[1]
    again = [(f"c7-{i}", "d7", i, "text", None, "w", 0) for i in range(5)]
    store.upsert_chunks(spark.createDataFrame(again, CHUNK), unique=True, documents=spark.createDataFrame([("d7", "w")], "document_id string, workspace_id string"))
    gone = before - files_of(tmp_path / "s" / "chunks")
    assert len({os.path.dirname(str(f[0] if isinstance(f, tuple) else f)) for f in gone}) == 1 and store.table("chunks").count() == 200


def test_a_clash_of_types_is_an_error(spark, tmp_path):
    CorpusStore(spark, str(tmp_path / "s"), buckets=2)
    (tmp_path / "s" / "chunks").mkdir()
    (tmp_path / "s" / "chunks" / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        CorpusStore(spark, str(tmp_path / "s")).table("chunks").collect()


def test_a_file_without_text_is_rejected(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "s"), buckets=2)
    files = spark.createDataFrame([("a.md", None, None), ("b.md", "# T", None), ("c.pdf", None, None)], "source_path string, text string, reject_reason string")
    batch = import_batch(store, files, spark.createDataFrame([], "source_path string, page_index int, text string"), "w", "b")
    assert {(r["source_path"], r["status"]) for r in batch.outcomes().collect()} == {("a.md", "failed"), ("b.md", "indexed"), ("c.pdf", "failed")}


def test_ids_of_different_parts_differ(spark):
    rows = spark.createDataFrame([("w", "a|b", "c"), ("w|a", "b", "c"), ("w", "a", "b|c")], "w string, p string, b string")
    assert rows.select(ids.document_id(F.col("w"), F.col("p"), F.col("b"))).distinct().count() == 3


def test_sections_are_replaced_as_a_whole(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "s"), buckets=2)
    first = record(spark, [(d, "p", "t", "markdown", 1, [], 5, "w", 0) for d in "abc"])
    sections = spark.createDataFrame([(f"{d}{i}", d, 1, f"{d}{i}", i, "w") for d in "abc" for i in range(3)], SECTION)
    store.upsert_documents(first, sections)
    # a gets a new outline, b and c lose theirs, so a bucket may run empty.
    again = record(spark, [(d, "p2", "t2", "markdown", 1, [], 6, "w", 0) for d in "abc"])
    store.upsert_documents(again, spark.createDataFrame([("a9", "a", 2, "fresh", 4, "w")], SECTION))
    assert [(r["document_id"], r["title"]) for r in store.table("sections").collect()] == [("a", "fresh")]
    assert {r["source_path"] for r in store.table("documents").collect()} == {"p2"} and store.table("documents").count() == 3


def test_records_say_when_they_were_written(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "s"), buckets=1)
    none = spark.createDataFrame([], SECTION)
    at = lambda n: F.timestamp_seconds(F.lit(n))
    store.upsert_documents(record(spark, [("a", "p", "t", "markdown", 1, [], 5, "w", 0), ("b", "p", "t", "markdown", 1, [], 5, "w", 0)]), none, now=at(10))
    store.upsert_documents(record(spark, [("b", "p", "t2", "markdown", 1, [], 6, "w", 0)]), none, now=at(20))
    rows = store.table("documents").withColumn("u", F.unix_seconds("updated_at")).withColumn("i", F.unix_seconds("imported_at")).collect()
    assert {r["document_id"]: (r["i"], r["u"]) for r in rows} == {"a": (5, 10), "b": (6, 20)}


def test_workspace_partitions_are_pruned(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "s"), buckets=2)
    store.upsert_chunks(spark.createDataFrame([("c", "d", 0, "t", None, w, 0) for w in ("one", "two/three")], CHUNK))
    table = store.table("chunks", "two/three")
    assert table.count() == 1
    assert "PartitionFilters: [isnotnull(workspace_id" in table._jdf.queryExecution().executedPlan().toString()


def test_schema_evolution(spark):
    old = spark.createDataFrame([("c", "d", 0, "t")], "chunk_id string, document_id string, ordinal int, text string")
    stamped = old.withColumn("created_at", F.current_timestamp()).withColumn("updated_at", F.current_timestamp())
    new = upsert.evolve_schema(stamped, CHUNKS)
    assert new.columns == [f.name for f in CHUNKS] and new.first()["source_page_index"] is None
    assert upsert.evolve_schema(new, CHUNKS).columns == new.columns
    with pytest.raises(ValueError):
        upsert.evolve_schema(old, CHUNKS)


def test_interchange(spark, tmp_path):
    rows = spark.createDataFrame([("a", [0, 2]), ("b", [])], "document_id string, low_quality_pages array<int>")
    corpus.write_interchange(rows, str(tmp_path / "d"))
    text = {r[0]: r[1] for r in spark.read.parquet(str(tmp_path / "d")).select("document_id", "low_quality_pages_json").collect()}
    assert text == {"a": "[0,2]", "b": "[]"}
    assert {r[0]: r[1] for r in corpus.read_interchange(spark, str(tmp_path / "d")).select("document_id", "low_quality_pages").collect()} == {"a": [0, 2], "b": []}
    bad = spark.createDataFrame([("a", "[0,")], "document_id string, low_quality_pages_json string")
    with pytest.raises(Exception):
        corpus.from_interchange(bad).collect()


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in" / "deep er"
    root.mkdir(parents=True)
    contents = {
        "a.md": b"# Alpha\n\nText one.\r\n\r\nText two.", "B.MD": "Grüße, ohne Überschrift".encode(), "c.txt": b"plain\n\n# Sub", "bad.md": b"\xff\xfe oops",
        "blank.md": b" \n\n ", "x.docx": b"zip", "noext": b"?", "p.pdf": b"%PDF",
    }
    for name, data in contents.items():
        (root / name).write_bytes(data)
    return tmp_path / "in"


def name_of(path):
    return path.rsplit("/", 1)[1]


def test_read_corpus(spark, folder):
    rows = {name_of(r["source_path"]): r for r in corpus.read_corpus(spark, str(folder), max_bytes=29).collect()}
    assert "deep er/" in next(iter(rows.values()))["source_path"]
    assert {n: r["reject_reason"] for n, r in rows.items()} == {
        "a.md": corpus.TOO_LARGE, "B.MD": None, "c.txt": None, "bad.md": corpus.BAD_ENCODING, "blank.md": None,
        "x.docx": "Unsupported file type: .docx", "noext": "Unsupported file type: .", "p.pdf": None,
    }
    assert rows["B.MD"]["text"] == "Grüße, ohne Überschrift" and rows["bad.md"]["text"] is None


def imported(spark, folder):
    files = corpus.read_corpus(spark, str(folder)).select("source_path", "text", "reject_reason")
    pdf = corpus.binary_files(spark, str(folder), "*.pdf").select("source_path", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("reject_reason"))
    empty = pdf.withColumn("source_path", F.lit("/in/empty.pdf"))
    listed = files.unionByName(empty)
    page = pdf.select("source_path", F.explode(F.array(*[F.struct(F.lit(i).alias("page_index"), F.lit(t).alias("text")) for i, t in enumerate(["short", "", "x" * 300])])).alias("p"))
    pages = page.select("source_path", "p.*").unionByName(spark.createDataFrame([("/in/empty.pdf", 0, "  ")], "source_path string, page_index int, text string"))
    return listed, pages


def test_import_is_idempotent(spark, folder, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "s"), buckets=4)
    listed, pages = imported(spark, folder)
    when = F.timestamp_seconds(F.lit(50))
    batch = import_batch(store, listed, pages, "w", "b1", when)
    outcomes = {name_of(r["source_path"]): (r["status"], r["message"]) for r in batch.outcomes().collect()}
    assert outcomes == {
        "a.md": ("indexed", "Indexed 3 chunks"), "B.MD": ("indexed", "Indexed 1 chunks"), "c.txt": ("indexed", "Indexed 2 chunks"),
        "p.pdf": ("indexed", "Indexed 2 chunks (2 pages flagged for VLM fallback)"), "bad.md": ("failed", "Unsupported text encoding"),
        "blank.md": ("failed", "Empty markdown document"), "x.docx": ("failed", "Unsupported file type: .docx"),
        "noext": ("failed", "Unsupported file type: ."), "empty.pdf": ("failed", "PDF has no extractable text"),
    }
    first = {name: sorted(map(tuple, store.table(name).drop("created_at", "updated_at").collect()), key=repr) for name in ("chunks", "documents", "sections")}
    titles = {name_of(r["source_path"]): (r["title"], r["chunk_count"], r["low_quality_pages"]) for r in store.table("documents").collect()}
    assert titles == {"a.md": ("Alpha", 3, []), "B.MD": ("B", 1, []), "c.txt": ("Sub", 2, []), "p.pdf": ("p", 2, [0, 1])}
    assert len(first["chunks"]) == 8 and len(first["sections"]) == 3
    import_batch(store, listed, pages, "w", "b1", when)
    for name, rows in first.items():
        assert sorted(map(tuple, store.table(name).drop("created_at", "updated_at").collect()), key=repr) == rows
    # Another batch of the same files makes other documents.
    import_batch(store, listed, pages, "w", "b2", when)
    assert store.table("documents").count() == 8 and store.commits().count() == 3
    good = audit.valid_rows(store.table("documents"), ["document_id"], "source_type")
    assert good.count() == 8


@pytest.mark.parametrize("bound", [1 << 18, 0])
def test_page_texts_do_not_move_to_the_list_of_files(spark, folder, monkeypatch, bound):
    monkeypatch.setattr(C, "BROADCAST_PAGES", bound)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    listed, pages = imported(spark, folder)
    foreign = spark.createDataFrame([("/in/unlisted.pdf", 0, "z"), (None, 0, "n")], "source_path string, page_index int, text string")
    planned, parse = [], C.parsed_pages
    monkeypatch.setattr(C, "parsed_pages", lambda rows, *a, **k: planned.append(rows._jdf.queryExecution().executedPlan().toString()) or parse(rows, *a, **k))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = parse_batch(listed, pages.unionByName(foreign), "w", "b", F.timestamp_seconds(F.lit(50)))
        paged = batch.chunks.where(F.col("source_page_index").isNotNull())
        assert sorted((r["ordinal"], r["source_page_index"], r["text"]) for r in paged.collect()) == [(0, 0, "short"), (1, 2, "x" * 300)]
        assert {name_of(r["source_path"]): r["chunk_count"] for r in batch.documents.collect()}["p.pdf"] == 2
        assert batch.documents.count() == 4 and batch.rejects.count() == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning" not in planned[0]


def test_lower_cased_text_does_not_move(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "s"), buckets=2)
    rows = spark.range(1).selectExpr("'c' AS chunk_id", "cast(id AS string) AS document_id", "0 AS ordinal", "concat('AB', id) AS text", "0 AS source_page_index", "'w' AS workspace_id", "cast(id AS int) AS bucket", "now() AS created_at", "now() AS updated_at")
    dealt = store._dealt(rows, "chunks")
    tree = dealt._jdf.queryExecution().executedPlan().toString()
    assert "lower(" in tree[: tree.index("Exchange")] and "lower(" not in tree[tree.index("Exchange") :]
    assert dealt.first()["text_lc"] == "ab0"


def test_import_stream_takes_each_file_once(spark, folder, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "s"), buckets=4)

    def run():
        import_files_stream(spark, str(folder), store, "w", str(tmp_path / "ck"), str(tmp_path / "out")).awaitTermination()

    run()
    assert store.table("documents").count() == 3
    (folder / "late.md").write_text("# Late")
    run()
    assert {r["title"] for r in store.table("documents").collect()} == {"Alpha", "B", "Sub", "Late"}
    states = {name_of(r["source_path"]): r["status"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert states["late.md"] == "indexed" and states["bad.md"] == "failed" and len(states) == 9


def test_artifact_audit(spark, folder):
    def sha(name):
        return hashlib.sha256((folder / "deep er" / name).read_bytes()).hexdigest()

    manifest = spark.createDataFrame(
        [("a.md", sha("a.md").upper(), 0), ("c.txt", sha("a.md"), 1), ("c.txt", sha("c.txt"), 2), ("p.pdf", sha("p.pdf"), 3)],
        "model_id string, sha256 string, position int",
    )
    model_id = F.regexp_extract("source_path", "[^/]*$", 0)
    rows = audit.artifact_audit(corpus.read_artifacts(spark, str(folder), model_id, max_bytes=29), manifest)
    states = {r["model_id"]: r["state"] for r in rows.collect()}
    assert states == {"a.md": "too_large", "c.txt": "mismatch", "p.pdf": "ok", "B.MD": "not_found", "bad.md": "not_found", "blank.md": "not_found", "x.docx": "not_found", "noext": "not_found"}
    every = audit.artifact_audit(corpus.read_artifacts(spark, str(folder), model_id), manifest)
    assert {r["model_id"]: r["state"] for r in every.collect()}["a.md"] == "ok"


def test_valid_rows(spark):
    good, uuid = "a" * 64, "6F9619FF-8B86-D011-B42D-00CF4FC964FF"
    rows = spark.createDataFrame([(good, "pdf"), (uuid, "markdown"), ("zz", "pdf"), (None, "pdf"), (good, "epub"), (good, None)], "document_id string, source_type string")
    assert audit.valid_rows(rows, ["document_id"], "source_type").count() == 2
    assert sorted(r["reject_reason"] for r in audit.invalid_rows(rows, ["document_id"], "source_type").collect()) == ["malformed document_id"] * 2 + ["unknown source_type"] * 2


def test_ids_are_stable(spark):
    one = spark.range(1).select(ids.document_id(F.lit("w"), F.lit("p"), F.lit("b"))).first()[0]
    assert one == hashlib.sha256(b"1:w1:p1:b").hexdigest()


def test_text_exports(spark, tmp_path):
    sections = spark.createDataFrame([("d", 1 + i % 3, f"t{i:02}", i) for i in range(15)], "document_id string, level int, title string, chunk_start_ordinal int")
    outline = export.outline_export(sections).first()["outline"].split("\n")
    assert len(outline) == 10 and outline[:3] == ["• t00", "  • t01", "    • t02"]
    export.write_text(export.outline_export(sections), "outline", str(tmp_path / "o"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "o")).collect()] == outline
    lines = spark.createDataFrame([("b", 0, 0, "# b"), ("a", 2, 0, "## a2"), ("a", 0, 0, "# a"), ("a", 0, 1, "## child")], "document_id string, line_no int, child_no int, line string")
    export.write_tree_lines(lines, str(tmp_path / "t"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "t")).collect()] == ["# a", "## child", "## a2", "# b"]


def test_reparse_job(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "s"), buckets=2)
    rows = [("p", "p", "P", "pdf", 4, [0, 2, 3], 5, "w", 0), ("m", "m", "M", "markdown", 1, [1], 5, "w", 0), ("e", "e", "E", "pdf", 1, [0], 5, "w", 0), ("c", "c", "C", "pdf", 1, [], 5, "w", 0)]
    sections = spark.createDataFrame([("s1", "p", 1, "P", 0, "w"), ("s2", "c", 1, "C", 0, "w")], SECTION)
    store.upsert_documents(record(spark, rows), sections)
    pages = spark.createDataFrame([("p", 0, "x"), ("p", 2, "y" * 90), ("p", 3, "z"), ("e", 0, " "), ("c", 0, "x")], "document_id string, page_index int, text string")
    better = lambda df: df.withColumn("text", F.when(F.col("page_index") == 0, F.repeat("text", 100)).otherwise(F.col("text")))
    requests = spark.createDataFrame([(d,) for d in "pmec"], "document_id string")
    states = {r["document_id"]: (r["status"], r["message"]) for r in reparse_batch(store, "w", requests, pages, F.timestamp_seconds(F.lit(99)), better).collect()}
    assert states == {"p": ("completed", "Resolved 2, remaining 1"), "m": ("completed", "Resolved 0, remaining 1"), "e": ("failed", "PDF has no extractable text")}
    stored = {r["document_id"]: (r["low_quality_pages"], r["at"], r["chunk_count"]) for r in store.table("documents").withColumn("at", F.unix_seconds("imported_at")).collect()}
    assert stored == {"p": ([3], 99, 4), "m": ([1], 99, 1), "e": ([0], 5, 1), "c": ([], 5, 1)}
    assert {(r["document_id"], r["title"]) for r in store.table("sections").collect()} == {("p", "P"), ("c", "C")}
    assert S.recent_documents(store.table("documents"), 1).first()["document_id"] == "m"
