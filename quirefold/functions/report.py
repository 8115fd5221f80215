"""Display columns for result tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def score_label(score: Column) -> Column:
    """Three decimals of the exact binary value, halves to even, as C prints them.

    The formatter of the JVM rounds the shortest decimal form half up and so gives
    0.063 for 1/16. Here the score is taken as a whole number of 2**-60, which is
    exact for the sizes scores have; others go through the formatter.
    """
    size = F.abs(score)
    unit = F.lit(str(2**60)).cast("decimal(19,0)")
    thousandths = (size * F.lit(float(2**60))).cast("bigint").cast("decimal(19,0)") * F.lit(1000).cast("decimal(4,0)")
    rest = thousandths % unit
    whole = ((thousandths - rest) / unit).cast("bigint")
    above = rest * 2
    up = (above > unit) | ((above == unit) & (whole % 2 == 1))
    rounded = whole + up.cast("bigint")
    sign = F.when(score < 0, F.lit("-")).otherwise(F.lit(""))
    exact = F.concat(sign, F.format_string("%d.%03d", F.floor(rounded / 1000), rounded % 1000))
    return F.when((size < 4) & (size >= 2.0**-8), exact).otherwise(F.format_string("%.3f", score))


def page_label(source_page_index: Column) -> Column:
    """``P`` and the page counted from 1; null where there is no page."""
    return F.concat(F.lit("P"), (source_page_index + 1).cast("string"))


def ordinal_label(ordinal: Column) -> Column:
    return F.concat(F.lit("#"), ordinal.cast("string"))


def quality_badge(title: Column, low_page_count: Column) -> Column:
    state = F.when(low_page_count == 0, F.lit("Clean")).otherwise(
        F.concat(F.lit("LQ "), low_page_count.cast("string"))
    )
    return F.concat(title, F.lit(" • "), state)


# The texts of the next two functions are fixed values.
def import_message(chunk_count: Column, fallback_pages: Column) -> Column:
    hint = F.when(
        fallback_pages > 0,
        F.concat(F.lit(" ("), fallback_pages.cast("string"), F.lit(" pages flagged for VLM fallback)")),
    ).otherwise(F.lit(""))
    return F.concat(F.lit("Indexed "), chunk_count.cast("string"), F.lit(" chunks"), hint)


def reparse_message(resolved: Column, remaining: Column) -> Column:
    return F.concat(
        F.lit("Resolved "), resolved.cast("string"), F.lit(", remaining "), remaining.cast("string")
    )


# Texts of jobs that wait or run.
QUEUED = "Queued"
REPARSING = "Re-parsing PDF"


def parsing_message(source_path: Column) -> Column:
    return F.concat(F.lit("Parsing "), F.regexp_extract(source_path, r"([^/]*)$", 1))


def clamp_progress(progress: Column) -> Column:
    return F.least(F.greatest(progress, F.lit(0.0)), F.lit(1.0))


def outline_line(level: Column, title: Column) -> Column:
    return F.concat(F.repeat(F.lit("  "), F.greatest(F.lit(0), level - 1)), F.lit("• "), title)
