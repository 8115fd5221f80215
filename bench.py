"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

A given table is one file with one row group, which Spark reads in one task; ``value`` and
``queries`` are for these tables. ``several_files`` has the same for a copy in several files, as
tables on a cluster are; making the copy is not timed.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

from quirefold.catalog.queries import REGISTRY
from quirefold.session import build_session

HEADLINE = [
    "md_chunks", "md_sections", "pack_words", "page_chunks", "document_record", "import_summary", "import_batch",
    "upsert_chunks", "keyword_filter", "keyword_topk", "keyword_topk_sections", "vector_topk", "hybrid_search",
    "chunk_section_asof", "reparse_comparison", "job_snapshot", "admit_reparse", "viewport_join", "mindmap_nodes",
    "skeleton_path", "skeleton_content", "tree_markdown",
]


def timed(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Seconds of each headline query over the tables in ``sf_dir``."""
    # The first job pays for the start of the JVM's compiler, not for a query.
    REGISTRY["md_chunks"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    return seconds


def report(spark: SparkSession, given: str, cpus: int) -> dict:
    """Seconds over the given tables, and over the same ones laid out in ``cpus`` files."""
    spread = tempfile.mkdtemp(prefix="spark-bench-")
    for path in sorted(Path(given).glob("*.parquet")):
        spark.read.parquet(str(path)).repartition(cpus).write.parquet(f"{spread}/{path.name}")
    seconds, of_files = timed(spark, given), timed(spark, spread)
    return {
        "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": given.rsplit("sf", 1)[-1],
        "several_files": {"value": round(sum(of_files.values()), 3), "queries": of_files},
    }


def main() -> None:
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("quirefold-bench", f"local[{cpus}]", cpus)
    print(json.dumps(report(spark, os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), cpus)))
    spark.stop()


if __name__ == "__main__":
    main()
