"""Tables that a stream keeps up to date: one row per key, folded with every micro-batch.

Rows lie in a fixed number of buckets by their key. A fold reads the buckets that the changes
fall into, merges, and overwrites those buckets, so files are bounded by the buckets and
not by the micro-batches. Merging must give the same rows when the same changes come twice; then a
fold that broke off in between is mended by folding again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.session import cut_lineage, release
from quirefold.sources.store import is_missing

BUCKET = "_bucket"


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table at ``path`` was written to its end."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def written_once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; it is made and written only if it is not there to its end.

    What a micro-batch decides goes through this before it takes effect, so a replay
    of the micro-batch finds the same decisions, whatever they have changed since.
    """
    if not is_written(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class FoldedTable:
    """A table at ``path`` with rows of ``schema``; ``merge`` makes one row per ``key`` of old and new rows."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, merge: Callable[[DataFrame], DataFrame], buckets: int = 16):
        self.spark, self.path, self.key, self.merge, self.buckets = spark, path, key, merge, buckets
        self.schema = T._parse_datatype_string(schema)

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def _stored(self) -> DataFrame:
        full = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        try:
            return self.spark.read.schema(full).parquet(self.path)
        except AnalysisException as error:
            if not is_missing(error):
                raise
            return self.spark.createDataFrame([], full)

    def fold(self, changes: DataFrame) -> None:
        """Merge ``changes`` into the buckets they fall into."""
        names = self.schema.fieldNames()
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        new = cut_lineage(changes.select(*names))
        # At most as many numbers as there are buckets.
        touched = [row[0] for row in new.select(bucket.alias("b")).distinct().collect()]
        if touched:
            old = self._stored().where(F.col(BUCKET).isin(touched)).select(*names)
            # Written aside first, since the buckets are overwritten while they are read.
            merged = cut_lineage(self.merge(old.unionByName(new)).select(*names).withColumn(BUCKET, bucket))
            writer = merged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy(BUCKET).parquet(self.path)
            release(merged)
        release(new)
