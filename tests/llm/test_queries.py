"""The registered queries on the smallest tables; those with SQL against DuckDB."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quirefold.llm import jaccard, quality
from quirefold.llm.queries import ORACLE, REGISTRY
from tests.compare import difference, open_oracle
from tests.llm.helpers import documents, prose

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in REGISTRY) == list(range(1, 14))


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_sql_twin(spark, key):
    assert difference(spark, open_oracle(SF_DIR), REGISTRY[key], ORACLE[key], SF_DIR) is None


@pytest.mark.parametrize("key", sorted(set(REGISTRY) - set(ORACLE)))
def test_whole_table(spark, key):
    rows = REGISTRY[key](spark, SF_DIR)
    ids = rows.select("doc_id").distinct()
    assert ids.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "quality_rules":
            assert {r["doc_id"] for r in docs.collect()} == {r["row"]["doc_id"] for r in quality.judge(before, ["doc_id"]).where("kept").collect()}
        if name == "near_duplicates":
            roots = jaccard.near_duplicates(before).select("component_id").distinct()
            assert docs.count() == roots.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert packed.agg(F.countDistinct("doc_id")).first()[0] == docs.count()


def test_pipeline_keeps_clean_and_drops_copies(spark, tmp_path):
    texts = [(i, prose(i, 120, 2000)) for i in range(60)]
    rows = texts + [(100 + i, texts[i][1]) for i in range(10)] + [(200, "too short"), (201, None)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == {i for i, _ in texts}
