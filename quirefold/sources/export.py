"""Text exports of outlines and heading trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions.report import outline_line
from quirefold.operators.blocks import top_k

# Fixed value: sections shown in an outline.
OUTLINE_LINES = 10


def outline_export(sections: DataFrame, lines: int = OUTLINE_LINES) -> DataFrame:
    """First sections of each document as indented lines: ``(document_id, outline)``.

    The cut comes before the lines are gathered, so a group holds at most ``lines`` rows.
    """
    first = top_k(
        sections, ["document_id"], [F.asc("chunk_start_ordinal"), F.asc("title")], lines, ["chunk_start_ordinal", "title"], fan=8
    )
    numbered = F.struct("rank", outline_line(F.col("level"), F.col("title")).alias("line"))
    gathered = first.groupBy("document_id").agg(F.array_sort(F.collect_list(numbered)).alias("lines"))
    return gathered.select("document_id", F.array_join("lines.line", "\n").alias("outline"))


def write_text(df: DataFrame, text: str, path: str) -> None:
    """Write one text column as text files."""
    df.select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def write_tree_lines(lines: DataFrame, path: str) -> None:
    """Write tree lines in document order, range-partitioned instead of gathered."""
    ordered = lines.repartitionByRange("document_id", "line_no", "child_no").sortWithinPartitions(
        "document_id", "line_no", "child_no"
    )
    ordered.select("line").write.mode("overwrite").text(path)
