from pyspark.sql import functions as F

from quirefold.operators import chunking as C
from quirefold.operators import sections as S


def test_small_markdown(spark):
    """Three paragraphs, one of them a heading."""
    docs = spark.createDataFrame([(1, "# Tides\n\nWater rises.\n\nLater it falls again.")], "document_id long, md string")
    assert [tuple(r) for r in C.md_chunks(docs).orderBy("ordinal").select("ordinal", "text").collect()] == [
        (0, "# Tides"), (1, "Water rises."), (2, "Later it falls again."),
    ]
    assert [tuple(r) for r in C.md_sections(docs).collect()] == [(1, 1, "Tides", 0)]


def test_section_starts_follow_split_segments(spark):
    body = " ".join(["word"] * 100)
    text = f"# A\n\n{body}\r\n\r\n## B\r\n\r\n{body}\n\n###\n\n#tag"
    docs = spark.createDataFrame([(1, text), (2, " \n\n ")], "document_id long, md string")
    sections = C.md_sections(docs, limit=200).orderBy("chunk_start_ordinal").collect()
    assert [(s["level"], s["title"], s["chunk_start_ordinal"]) for s in sections] == [(1, "A", 0), (2, "B", 4), (1, "tag", 9)]
    assert C.md_chunks(docs, limit=200).where("document_id = 2").count() == 0
    assert docs.select(C.is_blank_markdown(F.col("md"))).collect()[1][0] is True


def test_page_chunks_run_on_over_pages(spark):
    long = " ".join(["page"] * 100)
    pages = spark.createDataFrame(
        [(1, 0, long), (1, 1, "  "), (1, 2, "short"), (1, 9000, long), (2, 0, ""), (3, 5, "only")],
        "document_id long, page_index int, text string",
    )
    rows = C.page_chunks(pages, limit=200).orderBy("document_id", "ordinal").collect()
    assert [(r["document_id"], r["ordinal"], r["source_page_index"]) for r in rows] == [
        (1, 0, 0), (1, 1, 0), (1, 2, 0), (1, 3, 2), (1, 4, 9000), (1, 5, 9000), (1, 6, 9000), (3, 0, 5),
    ]
    assert {(r[0], r[1]) for r in C.low_pages(pages).collect()} == {(1, 1), (1, 2), (2, 0), (3, 5)}
    lists = {r[0]: r[1] for r in C.low_page_lists(C.low_pages(pages), block=2).collect()}
    assert lists == {1: [1, 2], 2: [0], 3: [5]}


def test_page_scores_take_a_column(spark):
    pages = spark.createDataFrame([(1, 0, "x")], "document_id long, page_index int, text string")
    routed = C.route_pages(C.page_scores(pages, score=F.lit(0.65))).first()
    assert routed["requires_fallback"] is False


def test_asof_over_hot_document(spark):
    chunks = spark.range(10000).select((F.col("id") % 10 == 0).cast("int").alias("document_id"), F.col("id").cast("int").alias("ordinal"))
    sections = spark.createDataFrame([(0, 1, "a", 3), (0, 2, "b", 5000), (0, 1, "c", 9999)], "document_id int, level int, title string, chunk_start_ordinal int")
    found = S.chunk_section_asof(chunks, sections)
    assert found.count() == 10000
    counts = {r[0]: r[1] for r in found.groupBy("section_title").count().collect()}
    expected = {None: 0, "a": 0, "b": 0, "c": 0}
    for i in range(10000):
        title = None if i % 10 == 0 or i < 3 else "a" if i < 5000 else "b" if i < 9999 else "c"
        expected[title] += 1
    assert counts == expected
    hits = found.select("document_id", "ordinal")
    for bound in (10, 10**9):
        other = S.section_of_hits(hits, sections, bound).groupBy("section_title").count()
        assert {r[0]: r[1] for r in other.collect()} == expected


def test_recent_and_sections(spark):
    docs = spark.createDataFrame([(i, f"d{i}", i // 2) for i in range(6)], "document_id long, title string, m int").withColumn(
        "imported_at", F.timestamp_seconds(F.col("m"))
    )
    sections = spark.createDataFrame([(4, 1, "x", 0), (4, 2, "y", 2), (1, 1, "z", 0)], "document_id long, level int, title string, chunk_start_ordinal int")
    assert [r[0] for r in S.recent_documents(docs, 3).collect()] == [4, 5, 2]
    assert S.recent_documents(docs, -1).count() == 0
    joined = S.docs_with_sections(docs.withColumnRenamed("title", "name"), sections, 3)
    assert sorted((r["document_id"], r["title"]) for r in joined.collect() if r["title"]) == [(4, "x"), (4, "y")]
    assert joined.count() == 4
    assert [r["title"] for r in S.sections_of_document(sections, 4).collect()] == ["x", "y"]


def formatted(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_page_texts_are_parsed_once_and_never_sorted(spark, monkeypatch):
    pages = spark.createDataFrame(
        [(1, 0, "a b"), (1, 0, "a b"), (1, 0, "c"), (2, 3, None), (2, 4, "x " * 300), (2, 9000, "y")],
        "document_id long, page_index int, text string",
    )
    found = {}
    for bound in (0, 1 << 18):
        monkeypatch.setattr(C, "BROADCAST_PAGES", bound)
        chunks = C.page_chunks(pages, limit=200)
        found[bound] = sorted(map(tuple, chunks.collect()))
        plan = formatted(chunks)
        assert "pack" not in plan and "regexp" not in plan  # the chunks read the written parse
        sorts = [block for block in plan.split("\n\n") if ") Sort" in block]
        assert sorts and not any("pieces#" in block.replace("n_pieces#", "") for block in sorts)
    assert found[0] == found[1 << 18]
    ordinals = {}
    for document, ordinal, _, _ in found[0]:
        ordinals.setdefault(document, []).append(ordinal)
    # Repeated rows of a page are numbered apart; a page without text has no chunk.
    assert ordinals == {1: [0, 1, 2], 2: list(range(len(ordinals[2])))}


def test_pieces_move_to_as_many_tasks_as_they_need(spark, monkeypatch):
    pages = spark.createDataFrame([(d, p, f"page {p}") for d in range(5) for p in range(9)], "document_id long, page_index int, text string")
    few = sorted(map(tuple, C.page_chunks(pages).collect()), key=repr)
    monkeypatch.setattr(C, "BROADCAST_PAGES", 0)
    monkeypatch.setattr(C, "PIECES_OF_TASK", 4)
    chunks = C.page_chunks(pages)
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 12), REPARTITION_BY_NUM") == 2
    assert sorted(map(tuple, chunks.collect()), key=repr) == few
    monkeypatch.setattr(C, "PIECES_OF_TASK", 1 << 16)
    moved = C.page_chunks(pages)
    moved.collect()
    ran = moved._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert ran.count("REPARTITION_BY_NUM") == 2  # the pieces once, the numbers once
