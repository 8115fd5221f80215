"""Documents, their sections, and the section a chunk belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.operators.blocks import global_index, last_before, row_index
from quirefold.operators.search import BROADCAST_HITS

# Fixed value: documents shown by recency.
RECENT_LIMIT = 80


def _newest_first() -> list[Column]:
    return [F.desc("imported_at"), F.asc("document_id")]


def recent_documents(documents: DataFrame, limit: int = RECENT_LIMIT) -> DataFrame:
    """Newest documents first; ties by id."""
    return documents.orderBy(*_newest_first()).limit(max(0, limit))


def recent_with_index(documents: DataFrame, limit: int | None = RECENT_LIMIT) -> DataFrame:
    """Newest documents with their 0-based place as ``recency_index``; all of them without a limit.

    A usual limit is cut first and its few rows are numbered in one window; all
    documents, or a limit beyond what can be broadcast, are numbered over ranges.
    """
    order = _newest_first()
    if limit is None or limit > BROADCAST_HITS:
        numbered = global_index(documents, order, "recency_index")
        return numbered if limit is None else numbered.where(F.col("recency_index") < limit)
    window = Window.partitionBy(F.lit(0)).orderBy(*order)
    return recent_documents(documents, limit).withColumn("recency_index", F.row_number().over(window) - 1)


def few(df: DataFrame, bound: int | None) -> DataFrame:
    """``df`` marked for broadcast if its proven row bound is small; None is no bound."""
    return F.broadcast(df) if bound is not None and bound <= BROADCAST_HITS else df


def sections_of_document(sections: DataFrame, document_id) -> DataFrame:
    return sections.where(F.col("document_id") == F.lit(document_id)).orderBy("chunk_start_ordinal", "title")


def docs_with_sections(documents: DataFrame, sections: DataFrame, limit: int = RECENT_LIMIT) -> DataFrame:
    """Recent documents with their sections; a document without any keeps one row.

    The documents are few by the limit, so they are broadcast against the sections
    and only the sections of these documents go on.
    """
    recent = recent_documents(documents, limit)
    keys = recent.select("document_id")
    wanted = sections.join(few(keys, limit), "document_id", "left_semi")
    return recent.join(wanted, "document_id", "left")


def with_section_index(sections: DataFrame) -> DataFrame:
    """0-based place of a section in its document by start ordinal."""
    return row_index(sections, ["document_id"], "chunk_start_ordinal", "section_index", ties=["title"])


def chunk_section_asof(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Every chunk with the last section that starts at or before it; null if none.

    Sections are merged into the chunk order of their document and the last one seen
    is carried forward, block by block.
    """
    starts = sections.groupBy("document_id", "chunk_start_ordinal").agg(
        F.max(F.struct("title", "level")).alias("_section")
    )
    marks = starts.select(
        "document_id", F.col("chunk_start_ordinal").alias("ordinal"), F.lit(0).alias("_kind"),
        F.struct("_section.title", "_section.level", F.col("chunk_start_ordinal").alias("start")).alias("_section"),
    )
    both = chunks.withColumn("_kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    seen = last_before(both, ["document_id"], "ordinal", F.col("_section"), "_last", ties=["_kind"])
    return seen.where(F.col("_kind") == 1).select(
        *chunks.columns,
        F.col("_last.title").alias("section_title"),
        F.col("_last.level").alias("section_level"),
        F.col("_last.start").alias("section_start"),
    )


def section_of_hits(hits: DataFrame, sections: DataFrame, hit_bound: int) -> DataFrame:
    """Same lookup for a short hit list: hits meet the sections of their documents only.

    The best section per hit is kept by a partial aggregation, so a document with
    very many sections does not gather in one task.
    """
    keys = hits.select("document_id", "ordinal").distinct()
    best = (
        sections.join(few(keys, hit_bound), "document_id")
        .where(F.col("chunk_start_ordinal") <= F.col("ordinal"))
        .groupBy("document_id", "ordinal")
        .agg(F.max(F.struct("chunk_start_ordinal", "title", "level")).alias("_best"))
    )
    found = best.select(
        "document_id",
        "ordinal",
        F.col("_best.title").alias("section_title"),
        F.col("_best.level").alias("section_level"),
        F.col("_best.chunk_start_ordinal").alias("section_start"),
    )
    return hits.join(few(found, hit_bound), ["document_id", "ordinal"], "left")
