"""Column expressions on page texts and page-index arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions.text import let

from quirefold.functions.text import text_length

# Trimmed page length -> quality score, and the routing threshold.
LONG_PAGE, LONG_PAGE_SCORE = 240, 0.92
MEDIUM_PAGE, MEDIUM_PAGE_SCORE = 80, 0.74
SHORT_PAGE_SCORE = 0.45
FALLBACK_THRESHOLD = 0.65


def page_quality(trimmed: Column, unit: str = "grapheme") -> Column:
    """Score by length; a page of few code points is short in any unit."""
    length = text_length(trimmed, unit)
    return (
        F.when(F.char_length(trimmed) <= MEDIUM_PAGE, F.lit(SHORT_PAGE_SCORE))
        .when(length > LONG_PAGE, F.lit(LONG_PAGE_SCORE))
        .when(length > MEDIUM_PAGE, F.lit(MEDIUM_PAGE_SCORE))
        .otherwise(F.lit(SHORT_PAGE_SCORE))
    )


def requires_fallback(score: Column, threshold: float = FALLBACK_THRESHOLD) -> Column:
    return score < F.lit(float(threshold))


def distinct_pages(pages: Column) -> Column:
    return F.array_sort(F.array_distinct(pages))


def pages_except(before: Column, after: Column) -> Column:
    """Sorted distinct pages of ``before`` that are not in ``after``."""
    return F.array_sort(F.array_except(before, after))


def pages_without(pages: Column, drop: Column) -> Column:
    """``pages`` without those in ``drop``; order and duplicates are kept.

    The difference is by hash and keeps the order; only a list with a page named twice
    is tested page by page.
    """
    left = F.array_except(pages, drop)
    named_once = F.size(F.array_distinct(pages)) == F.size(pages)
    return F.when(named_once, left).otherwise(let(left, lambda kept: F.filter(pages, lambda page: F.array_contains(kept, page))))


def page_label_list(pages: Column, empty: str = "none") -> Column:
    """Pages counted from 1, joined by a comma; ``empty`` for an empty list."""
    labels = F.transform(pages, lambda page: (page + 1).cast("string"))
    return F.when(F.size(pages) == 0, F.lit(empty)).otherwise(F.array_join(labels, ", "))


def rate_percent(ratio: Column) -> Column:
    """Whole percent, halves away from zero."""
    return F.round(ratio * 100).cast("int")
