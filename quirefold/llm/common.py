"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python task holds at a time, whatever the length of an Arrow batch.
ROWS = 512

#: White space of the word rule: code points 9 to 13 and 32, as ``bytes.split`` has it.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of the value written as text, modulo ``folds``; a null value counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def row_slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most ``rows`` rows, so that outputs of a batch stay small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_slices(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``function`` over slices of the rows, in Arrow tasks, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches):
            yield function(part)

    return df.mapInArrow(run, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where body uses it several times."""
    return F.transform(F.array(value), body)[0]


class Memory:
    """Values by key with two generations: a full young one replaces the old one.

    Keys in use move to the young generation, so frequent ones stay. At most twice
    ``size`` entries are held.
    """

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def found(self, key):
        """The value of a key that ``young`` does not have; None if it is not known."""
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key, value):
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value
        return value
