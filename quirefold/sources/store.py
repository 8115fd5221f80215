"""Chunks, documents and sections as Parquet tables with idempotent upsert.

Layout: ``<root>/<table>/workspace_id=…/bucket=…/``, bucket by hash of the document's
id, so a document's chunks lie together. An
upsert takes the batch's own partitions first, a bounded list, and looks for key
conflicts (key columns only) in those.
Buckets without any get the new rows appended; only buckets with a conflict are
read and rewritten, by dynamic partition overwrite. One writer at a time. With a
table format at hand the same step is a ``MERGE INTO``.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold import schemas
from quirefold.operators.upsert import replace_sections, upsert_chunks, upsert_documents

KEYS = {"chunks": "document_id", "documents": "document_id", "sections": "document_id"}
ROW_IDS = {"chunks": "chunk_id", "documents": "document_id", "sections": "section_id"}
SCHEMAS = {"chunks": schemas.CHUNKS, "documents": schemas.DOCUMENTS, "sections": schemas.SECTIONS}
PARTITION = ["workspace_id", "bucket"]
COMMITS = T.StructType([
    T.StructField("import_batch_id", T.StringType()),
    T.StructField("workspace_id", T.StringType()),
    T.StructField("committed_at", T.TimestampType()),
])


def is_missing(error: AnalysisException) -> bool:
    """Whether a read failed because nothing was written yet; any other failure is one."""
    return (error.getCondition() or "").split(".")[0] == "PATH_NOT_FOUND"


class CorpusStore:
    """Tables below one root folder; ``buckets`` is fixed when the store is made."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root = spark, root
        layout = os.path.join(root, "_layout")
        try:
            self.buckets = spark.read.schema("buckets int").json(layout).first()["buckets"]
        except AnalysisException as error:
            if not is_missing(error):
                raise
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.json(layout)
            self.buckets = buckets

    def _path(self, table: str) -> str:
        return os.path.join(self.root, table)

    def _stored(self, table: str) -> DataFrame:
        schema = T.StructType([*SCHEMAS[table].fields, T.StructField("workspace_id", T.StringType()), T.StructField("bucket", T.IntegerType())])
        try:
            # Files written before a nullable column existed are read with null there.
            rows = self.spark.read.schema(schema).parquet(self._path(table))
            return rows.where(F.col(ROW_IDS[table]).isNotNull())
        except AnalysisException as error:
            if not is_missing(error):
                raise
            return self.spark.createDataFrame([], schema)

    def table(self, name: str, workspace_id: str | None = None) -> DataFrame:
        """A table, of one workspace if named (partitions of others are not listed)."""
        rows = self._stored(name)
        if workspace_id is not None:
            rows = rows.where(F.col("workspace_id") == workspace_id)
        return rows.drop("bucket")

    def _filed(self, df: DataFrame, table: str) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(KEYS[table]), F.lit(self.buckets)).cast("int"))

    def _dealt(self, df: DataFrame, table: str) -> DataFrame:
        """The rows as they are written. Rebalancing splits a crowded partition over several tasks and files."""
        columns = [f.name for f in SCHEMAS[table]] + PARTITION
        dealt = df.select(*(c for c in columns if c != "text_lc")).hint("rebalance", *PARTITION)
        if table == "chunks":
            # Written with every row, so a row of an old file gets it as soon as it is written again. It does not move with the rows.
            dealt = dealt.withColumn("text_lc", F.lower("text"))
        return dealt.select(*columns)

    def _write(self, df: DataFrame, table: str, mode: str) -> None:
        (
            self._dealt(df, table).write.mode(mode)
            .option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION).parquet(self._path(table))
        )

    def _in(self, partitions: DataFrame) -> Column | None:
        """Predicate for the named partitions, None if there are none.

        Collects partition names, at most workspaces of the batch times buckets; the
        file listing holds as many on the driver.
        """
        by_workspace: dict[str, list[int]] = {}
        for row in partitions.select(*PARTITION).distinct().collect():
            by_workspace.setdefault(row["workspace_id"], []).append(row["bucket"])
        tests = [(F.col("workspace_id") == w) & F.col("bucket").isin(b) for w, b in by_workspace.items()]
        return reduce(lambda a, b: a | b, tests) if tests else None

    def stored_near(self, keys: DataFrame, table: str) -> DataFrame | None:
        """Stored rows of the partitions that the keys fall into; None for no keys."""
        own = self._in(keys)
        return None if own is None else self._stored(table).where(own)

    def _conflicts(self, keys: DataFrame, table: str, on: list[str]) -> Column | None:
        """Predicate for the partitions that hold a key of the batch, None if there are none."""
        near = self.stored_near(keys, table)
        return None if near is None else self._in(near.join(keys.select(*on), on, "left_semi"))

    def _chunk_hits(self, filed: DataFrame) -> DataFrame:
        """Partitions that hold a chunk of the batch, or will: a chunk may come with another document than before."""
        names = [row[0] for row in filed.select("workspace_id").distinct().collect()]
        old = self._stored("chunks").where(F.col("workspace_id").isin(names)).select("workspace_id", "chunk_id", "bucket")
        hits = old.join(filed.select("workspace_id", "chunk_id", F.col("bucket").alias("new")), ["workspace_id", "chunk_id"])
        return hits.select("workspace_id", F.explode(F.array("bucket", "new")).alias("bucket"))

    def _overwrite(self, old: DataFrame, new: DataFrame, table: str) -> None:
        """Write ``new`` over the partitions of ``old``.

        A dynamic overwrite leaves a bucket alone that gets no row. One that loses its last
        row gets a row without an id, which readers skip.
        """
        emptied = old.select(*PARTITION).distinct().join(new.select(*PARTITION).distinct(), PARTITION, "left_anti")
        self._write(new.unionByName(emptied, allowMissingColumns=True), table, "overwrite")

    def upsert_chunks(
        self,
        batch: DataFrame,
        position: str = "position",
        now: Column | None = None,
        unique: bool = False,
        documents: DataFrame | None = None,
    ) -> None:
        """``batch``: chunk columns without timestamps, ``workspace_id`` and an order column.

        With ``unique`` the caller vouches for distinct ids in the batch, as an import
        does; new rows are then written without an aggregation. ``documents(workspace_id,
        document_id)`` names the documents of a batch whose chunk ids depend on the
        document; stored ids are then looked up by document, without making the batch.
        """
        now = F.current_timestamp() if now is None else now
        filed = self._filed(batch, "chunks")
        if documents is None:
            conflict = self._in(self._chunk_hits(filed))
        else:
            conflict = self._conflicts(self._filed(documents, "chunks"), "chunks", [*PARTITION, "document_id"])
        fresh = filed if conflict is None else filed.where(~conflict)
        if conflict is not None:
            old = self._stored("chunks").where(conflict).drop("text_lc")
            merged = self._filed(upsert_chunks(old, filed.where(conflict), position, now), "chunks")
            self._overwrite(old, merged, "chunks")
        if unique:
            fresh = fresh.withColumn("created_at", now).withColumn("updated_at", now)
        else:
            fresh = upsert_chunks(self._stored("chunks").limit(0).drop("text_lc"), fresh, position, now)
        self._write(fresh, "chunks", "append")

    def upsert_documents(self, batch: DataFrame, sections: DataFrame, position: str = "position", now: Column | None = None) -> None:
        """Document records and their sections; sections of a batch document are replaced as a whole."""
        now = F.current_timestamp() if now is None else now
        filed = self._filed(batch, "documents")
        conflict = self._conflicts(filed, "documents", [*PARTITION, "document_id"])
        fresh = filed if conflict is None else filed.where(~conflict)
        if conflict is not None:
            merged = upsert_documents(self._stored("documents").where(conflict), filed.where(conflict), position, now)
            self._write(merged, "documents", "overwrite")
        self._write(upsert_documents(self._stored("documents").limit(0), fresh, position, now), "documents", "append")
        self._replace_sections(batch, sections)

    def _replace_sections(self, batch: DataFrame, sections: DataFrame) -> None:
        documents = self._filed(batch.select("document_id", "workspace_id").distinct(), "sections")
        new = self._filed(sections, "sections")
        conflict = self._conflicts(documents, "sections", [*PARTITION, "document_id"])
        if conflict is None:
            self._write(new, "sections", "append")
            return
        old = self._stored("sections").where(conflict)
        kept = replace_sections(old, documents, new.where(conflict))
        self._overwrite(old, kept, "sections")
        self._write(new.where(~conflict), "sections", "append")

    def mark_commit(self, import_batch_id: str, workspace_id: str) -> None:
        row = self.spark.createDataFrame([(import_batch_id, workspace_id)], "import_batch_id string, workspace_id string")
        row.withColumn("committed_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self._path("commits"))

    def commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(COMMITS).parquet(self._path("commits"))
        except AnalysisException as error:
            if not is_missing(error):
                raise
            return self.spark.createDataFrame([], COMMITS)
