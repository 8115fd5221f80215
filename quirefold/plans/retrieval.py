"""Search with the section of every hit and its display columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions import report as R
from quirefold.operators import search as S
from quirefold.operators.sections import section_of_hits


def result_view(results: DataFrame) -> DataFrame:
    """Display columns of search results: score, page, ordinal, text."""
    return (
        results.withColumn("score_label", R.score_label(F.col("score")))
        .withColumn("page_label", R.page_label(F.col("source_page_index")))
        .withColumn("ordinal_label", R.ordinal_label(F.col("ordinal")))
    )


def keyword_search_with_sections(chunks: DataFrame, sections: DataFrame, keyword: str, limit: int = S.DEFAULT_LIMIT) -> DataFrame:
    """Top-k of one keyword with the section each chunk lies in."""
    return section_of_hits(S.keyword_topk(chunks, keyword, limit), sections, limit)


def search_many(
    chunks: DataFrame, sections: DataFrame, vectors: DataFrame, queries: DataFrame, page: int | None = None, **options
) -> DataFrame:
    """Hybrid search of a query table, with chunk text, page filter, section and labels."""
    hits = S.hybrid_search(chunks, vectors, queries, **options)
    bound = S.largest_k(queries) * queries.count()
    texts = S.page_filter(S.with_chunk_text(hits, chunks, bound), page)
    return result_view(section_of_hits(texts, sections, bound))
