import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirefold.operators import grams as G
from quirefold.operators import search as S
from quirefold.plans.retrieval import keyword_search_with_sections, search_many
from quirefold.sources.store import CorpusStore

WORDS = ["silver", "Copper", "iron", "Été", "100%", "a_b", "back\\slash", "tin"]


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(2)
    rows = [(d, o, " ".join(rng.choice(WORDS) for _ in range(6)), o % 3 if d % 2 else None) for d in range(30) for o in range(rng.randint(1, 9))]
    return spark.createDataFrame(rows, "document_id long, ordinal int, text string, source_page_index int").cache()


def test_substring_case(spark):
    chunks = spark.createDataFrame([(1, 0, "silver copper"), (1, 1, "marble iron"), (1, 2, "copper tin")], "document_id long, ordinal int, text string")
    assert [r["ordinal"] for r in S.keyword_topk(chunks, "copper", 10).collect()] == [0, 2]


@pytest.mark.parametrize("keyword", ["copper", " IRON\n", "été", "", "  ", "%", "_", "\\", "zzz", "r i"])
def test_contains(chunks, keyword):
    wanted = keyword.strip().lower()
    rows = chunks.collect()
    expected = sorted((r["ordinal"], r["document_id"]) for r in rows if wanted and wanted in r["text"].lower())
    got = [(r["ordinal"], r["document_id"]) for r in S.keyword_topk(chunks, keyword, 1000).collect()]
    assert got == expected
    assert S.keyword_topk(chunks, keyword, 0).count() == 0
    assert S.keyword_topk(chunks, keyword, -1).count() == 0


@pytest.mark.parametrize("keyword", ["copper", "%", "_", "a_b", "100%p", "\\s", "été", "ÉTÉ", "iron%a"])
def test_like(chunks, keyword):
    """SQLite's rule: ASCII letters fold, % and _ are wildcards, backslash is itself."""
    import re

    def fold(text):
        return "".join(c.lower() if c.isascii() else c for c in text)

    pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in fold(keyword.strip().lower()))
    expected = sorted((r["document_id"], r["ordinal"]) for r in chunks.collect() if re.search(pattern, fold(r["text"]), re.S))
    assert sorted((r["document_id"], r["ordinal"]) for r in S.keyword_like(chunks, keyword).collect()) == expected
    queries = chunks.sparkSession.createDataFrame([(7, keyword, 1000)], "query_id long, keyword string, k int")
    many = S.keyword_topk_many(chunks, queries, mode="like")
    assert sorted((r["document_id"], r["ordinal"]) for r in many.collect()) == expected


def test_slices_equal_one_pass(spark, chunks):
    queries = spark.createDataFrame([(i, WORDS[i % 8], 1 + i % 4) for i in range(40)], "query_id long, keyword string, k int")
    whole = {tuple(r) for r in S.keyword_topk_many(chunks, queries).collect()}
    sliced = {tuple(r) for r in S.keyword_topk_many(chunks, queries, bound=5).collect()}
    assert whole == sliced and len(whole) == sum(1 + i % 4 for i in range(40))


def vector_tables(spark, copies=400):
    rng = np.random.default_rng(3)
    rows = [(i, 0, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    # One group of copies holds most rows, so most scores tie.
    rows += [(1000 + i, 0, [1.0, 0.0, 0.0, 0.0]) for i in range(copies)]
    rows += [(5000, 0, [0.0] * 4), (5001, 0, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "document_id long, ordinal int, embedding array<float>")
    queries = spark.createDataFrame(
        [(1, "", [1.0, 0.1, 0.0, 0.0], 30), (2, "iron", [1.0, 0.0, 0.0, 0.0], 5), (3, "tin", [], 9), (4, "zzz", [0.0, 1.0, 0.5, 0.0], 0), (5, "silver", [3.0, 1.0], 4)],
        "query_id long, keyword string, embedding array<float>, k int",
    )
    return vectors, queries, rows


def brute_vector(queries, rows):
    hits = {}
    for q in queries:
        scored = []
        for document, ordinal, vector in rows:
            if q["embedding"] and len(vector) == len(q["embedding"]):
                a, b = np.array(q["embedding"], dtype=float), np.array([np.float32(x) for x in vector], dtype=float)
                norm = np.linalg.norm(a) * np.linalg.norm(b)
                scored.append((-round(float(a @ b / norm) if norm else 0.0, 6), document, ordinal))
        hits[q["query_id"]] = [(d, o) for _, d, o in sorted(scored)[: q["k"]]]
    return hits


def test_vector_topk(spark):
    vectors, queries, rows = vector_tables(spark)
    expected = brute_vector(queries.collect(), rows)
    for bound in (4096, 1):
        got = {}
        found = S.vector_topk_many(vectors.repartition(5), queries, bound=bound)
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["document_id"], r["ordinal"]))
        assert got == {q: hits for q, hits in expected.items() if hits}


def test_hybrid_against_dictionary(spark, chunks):
    vectors, queries, rows = vector_tables(spark)
    vec = brute_vector(queries.collect(), rows)
    all_chunks = chunks.collect()
    expected = {}
    for q in queries.collect():
        wanted = q["keyword"].strip().lower()
        keyword = sorted((r["ordinal"], r["document_id"]) for r in all_chunks if wanted and wanted in r["text"].lower())[: q["k"]]
        scores = {}
        for i, (ordinal, document) in enumerate(keyword):
            scores[(document, ordinal)] = 0.4 * (1.0 / (i + 1))
        for i, key in enumerate(vec[q["query_id"]]):
            scores[key] = scores.get(key, 0.0) + 0.6 * (1.0 / (i + 1))
        ranked = sorted(scores.items(), key=lambda item: (-item[1], item[0]))[: q["k"]]
        expected[q["query_id"]] = [(key, round(score, 9)) for key, score in ranked]
    got = {}
    for r in S.hybrid_search(chunks, vectors, queries).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(((r["document_id"], r["ordinal"]), round(r["score"], 9)))
    assert got == {q: hits for q, hits in expected.items() if hits}


def test_app_search_and_page_filter(spark, chunks):
    """Weights 1 and 0 without a vector, as the app calls it; the page filter cuts below k."""
    sections = spark.createDataFrame([(d, 1, f"s{d}", 1) for d in range(30)], "document_id long, level int, title string, chunk_start_ordinal int")
    vectors = spark.createDataFrame([], "document_id long, ordinal int, embedding array<float>")
    queries = spark.createDataFrame([(1, "iron", [], 30)], "query_id long, keyword string, embedding array<float>, k int")
    found = search_many(chunks, sections, vectors, queries, keyword_weight=1.0, vector_weight=0.0).orderBy("rank").collect()
    assert len(found) == 30
    assert [r["score_label"] for r in found[:3]] == ["1.000", "0.500", "0.333"] and found[15]["score_label"] == "0.062"
    assert all(r["section_title"] == (f"s{r['document_id']}" if r["ordinal"] >= 1 else None) for r in found)
    paged = search_many(chunks, sections, vectors, queries, page=0, keyword_weight=1.0, vector_weight=0.0).collect()
    assert {r["source_page_index"] for r in paged} == {0} and len(paged) < 30
    assert {r["page_label"] for r in paged} == {"P1"}
    one = keyword_search_with_sections(chunks, sections, "iron", 30).count()
    assert one == 30


def test_stub(spark, chunks):
    assert S.first_chunks(chunks, [], 5).count() == 0
    assert [r["ordinal"] for r in S.first_chunks(chunks, [0.1], 5).collect()] == [0] * 5
    _, queries, _ = vector_tables(spark)
    many = S.first_chunks_many(chunks, queries).groupBy("query_id").count()
    assert {r[0]: r[1] for r in many.collect()} == {1: 30, 2: 5, 5: 4}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keyword_reaches_the_scan(spark, chunks, tmp_path):
    """Over the store the test is pushed down; rows of files without the stored text are found as well."""
    store = CorpusStore(spark, str(tmp_path / "s"), buckets=2)
    rows = chunks.select(
        F.concat_ws("-", "document_id", "ordinal").alias("chunk_id"), F.col("document_id").cast("string"), "ordinal", "text",
        "source_page_index", F.lit("w").alias("workspace_id"), F.lit(0).cast("long").alias("position"),
    )
    store.upsert_chunks(rows.where("document_id % 2 = 0"))
    now = F.current_timestamp()
    old = store._filed(rows.where("document_id % 2 = 1"), "chunks").withColumn("created_at", now).withColumn("updated_at", now)
    old.drop("position").write.mode("append").partitionBy("workspace_id", "bucket").parquet(str(tmp_path / "s" / "chunks"))
    stored = store.table("chunks", "w")
    assert {r[0] for r in stored.groupBy(F.col("text_lc").isNull()).count().collect()} == {True, False}
    for keyword in ("Iron", "ÉTÉ", "%", "", "r s"):
        found = {(int(r["document_id"]), r["ordinal"]) for r in S.keyword_filter(stored, keyword).collect()}
        assert found == {(r["document_id"], r["ordinal"]) for r in S.keyword_filter(chunks, keyword).collect()}, keyword
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = plan_of(S.keyword_filter(stored, "Iron"))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "StringContains(text_lc,iron)" in plan.split("PushedFilters")[1]
    queries = spark.createDataFrame([(1, "Iron", 999), (2, "été", 999)], "query_id long, keyword string, k int")
    many = S.keyword_topk_many(stored, queries).groupBy("query_id").count().collect()
    assert {r[0]: r[1] for r in many} == {i: S.keyword_filter(chunks, w).count() for i, w in ((1, "iron"), (2, "été"))}
    assert "TakeOrderedAndProject" in plan_of(S.keyword_topk(stored, "iron", 5))


def test_thousands_of_keywords_in_one_scan(spark, tmp_path):
    rng = random.Random(4)
    texts = [(d, 0, " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(12))) for d in range(60)]
    words = sorted({"".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 6))) for _ in range(5000)} - {""})
    spark.createDataFrame(texts, "document_id long, ordinal int, text string").write.parquet(str(tmp_path / "c"))
    chunks = spark.read.parquet(str(tmp_path / "c"))
    queries = spark.createDataFrame([(i, w, 1000) for i, w in enumerate(words)], "query_id long, keyword string, k int")
    found = S.keyword_matches(chunks, queries)
    plan = plan_of(found)
    assert plan.count("FileScan parquet") == 1 and "BroadcastHashJoin" in plan and "CartesianProduct" not in plan
    expected = {(i, d) for i, w in enumerate(words) for d, _, t in texts if w.strip() and w.strip() in t}
    assert {(r["query_id"], r["document_id"]) for r in found.collect()} == expected
    assert found.count() == len(expected)


@pytest.mark.parametrize("keyword, held", [("é", b"\xc3\xa9"), ("a", b"a"), ("zzz", b"zzz"), ("", None)])
def test_short_keywords_are_their_own_gram(keyword, held):
    assert G.rarest_gram([keyword], Counter()) == held


def test_rarest_gram_of_a_keyword(spark):
    counts = G.gram_counts(spark.createDataFrame([("the theme",), ("them",), (None,)], "t string"), "t")
    assert counts[b"the"] == 2 and G.rarest_gram(["them"], counts) == b"hem"
    assert S.literal_runs("a%the_x", "like") == ["a", "the", "x"] and S.literal_runs("%_", "like") == []


def test_grams_of_rows(spark):
    texts = [(1, "abcabc"), (2, None), (3, ""), (4, "xbc"), (5, "ab"), (6, "c"), (7, "é")]
    df = spark.createDataFrame(texts, "i int, t string").coalesce(1)
    found = G.with_grams(df, "t", [b"abc", b"bc", b"c", "é".encode(), b"cab"])
    names = {G.gram_code(g): g for g in (b"abc", b"bc", b"c", "é".encode(), b"cab")}
    got = {r["i"]: {names[g] for g in r["_grams"]} for r in found.collect()}
    assert got == {1: {b"abc", b"bc", b"c", b"cab"}, 2: set(), 3: set(), 4: {b"bc", b"c"}, 5: set(), 6: {b"c"}, 7: {"é".encode()}}


def test_no_list_is_cut_below_its_k(spark):
    chunks = spark.range(120).selectExpr("id AS document_id", "0L AS ordinal", "concat('tin ', id) AS text", "array(cast(id AS float), 1f) AS embedding")
    queries = spark.createDataFrame([(1, "tin", [1.0, 2.0], 50), (2, "tin", [1.0, 1.0], 7)], "query_id long, keyword string, embedding array<float>, k int")
    vectors = chunks.select("document_id", "ordinal", "embedding")
    for found in (S.keyword_topk_many(chunks, queries), S.vector_topk_many(vectors, queries), S.first_chunks_many(chunks, queries), S.hybrid_search(chunks, vectors, queries)):
        assert {r["query_id"]: r["count"] for r in found.groupBy("query_id").count().collect()} == {1: 50, 2: 7}


def test_broken_vectors_never_match(spark):
    rows = [(1, [1.0, 0.0]), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 0.0]), (5, None), (6, [])]
    vectors = spark.createDataFrame([(i, 0, v) for i, v in rows], "document_id long, ordinal long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0], 5), (2, [float("nan"), 0.0], 5)], "query_id long, embedding array<float>, k int")
    assert [(r["query_id"], r["document_id"]) for r in S.vector_topk_many(vectors, queries).collect()] == [(1, 1)]
    assert sorted(r["document_id"] for r in S.rejected_vectors(vectors).collect()) == [2, 3, 4, 5, 6]


def test_a_task_gives_out_its_best_rows_once(spark):
    vectors = spark.range(3000).selectExpr("id AS document_id", "0L AS ordinal", "array(cast(id % 97 AS float), 1f) AS embedding").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 5.0], 3)], "query_id long, embedding array<float>, k int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert S.vector_matches(vectors, queries).count() == 3
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_task_keeps_rows_by_each_query_s_own_k():
    """One query with a large k leaves the rows held for the others as they are."""
    chosen = np.random.default_rng(3)
    vectors = chosen.integers(-3, 4, (600, 4)).astype(float)
    asked = [{"query_id": i, "k": k, "embedding": chosen.integers(-3, 4, 4).astype(float).tolist()} for i, k in enumerate([500, 1, 2, 0, 3, 3])]
    batches = [
        pa.RecordBatch.from_pydict({"document_id": pa.array(range(at, at + 50)), "ordinal": pa.array([0] * 50, pa.int32()), "embedding": pa.array(vectors[at : at + 50].tolist())})
        for at in range(0, 600, 50)
    ]
    rows = [row for out in S._scorer(asked, 4)(iter(batches)) for row in out.to_pylist()]
    norm = lambda m: m / np.where(np.linalg.norm(m, axis=-1) == 0, 1.0, np.linalg.norm(m, axis=-1))[..., None]
    for query in asked:
        scores = np.round(norm(vectors) @ norm(np.array(query["embedding"])), 6)
        best = sorted(range(600), key=lambda i: (-scores[i], i))[: query["k"]]
        assert [r["document_id"] for r in rows if r["query_id"] == query["query_id"]] == best
