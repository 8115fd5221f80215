"""Every registered query against its SQL twin on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry
from quirefold.catalog.oracle import ORACLE
from quirefold.catalog.queries import REGISTRY
from tests.compare import difference, open_oracle

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    return open_oracle(SF_DIR)


def test_every_query_has_a_twin():
    assert set(REGISTRY) == set(ORACLE)


def test_entry(spark):
    assert entry(spark).count() == 30


@pytest.mark.parametrize("key", list(REGISTRY))
def test_query(spark, oracle, key):
    assert difference(spark, oracle, REGISTRY[key], ORACLE[key], SF_DIR) is None


def test_import_stream_reads_a_table_of_several_files(spark, tmp_path):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    documents.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = REGISTRY["import_files_stream"](spark, str(tmp_path))
    whole = REGISTRY["import_files_stream"](spark, SF_DIR)
    assert found.count() == whole.count() == documents.count()
    assert found.exceptAll(whole).isEmpty()


def test_import_stream_gives_one_row_per_row_of_the_table(spark, tmp_path):
    """A document id that comes twice is two rows, as in SQL."""
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    # Indexed, blank and unsupported ones.
    twice = documents.where("doc_id % 10 = 3 OR doc_id = 5 OR doc_id = 6")
    documents.unionByName(twice).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    database = duckdb.connect()
    database.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    key = "import_files_stream"
    assert difference(spark, database, REGISTRY[key], ORACLE[key], str(tmp_path)) is None
