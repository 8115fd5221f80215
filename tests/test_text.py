import random
import re

import pytest
from pyspark.sql import functions as F

from quirefold.functions import pages as P
from quirefold.functions import report as R
from quirefold.functions import text as X


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "t string").select(build(F.col("t")).alias("r")).first()["r"]


def test_newlines_and_trim(spark):
    assert one(spark, "a\r\nb\rc\nd", X.normalize_newlines) == "a\nb\nc\nd"
    assert one(spark, " 　\t a b  \x85\r\n", X.trim_unicode) == "a b"
    assert one(spark, " \n ", X.trim_unicode) == ""


@pytest.mark.parametrize(
    ("text", "title"),
    [
        ("intro\n\n  # Title #\nmore", "Title"),
        ("##\n# later", ""),
        ("no heading", "notes.v1"),
        ("x #tag", "tag"),
    ],
)
def test_title(spark, text, title):
    row = spark.createDataFrame([(text, "/in/notes.v1.md")], "t string, p string")
    assert row.select(X.document_title(F.col("t"), F.col("p"))).first()[0] == title


def test_paths(spark):
    assert one(spark, "/a/b.c/Report.PDF", X.file_extension) == "pdf"
    assert one(spark, "/a/b.c/noext", X.file_extension) == ""
    assert one(spark, "/a/.hidden", X.file_extension) == ""
    assert one(spark, "/a/b/Report.final.pdf", X.file_stem) == "Report.final"


@pytest.mark.parametrize(
    ("segment", "level", "title"),
    [
        ("# A #", 1, "A"),
        ("###", None, None),
        ("#tag", 1, "tag"),
        ("####### deep", 7, "deep"),
        ("## Head\nbody line", 2, "Head\nbody line"),
        ("text\n# inside", None, None),
    ],
)
def test_headings(spark, segment, level, title):
    df = spark.createDataFrame([(segment,)], "s string")
    found = df.select(X.heading_title(F.col("s")).alias("t"), X.heading_level(F.col("s")).alias("l")).first()
    assert found["t"] == title
    if title is not None:
        assert found["l"] == level


def test_heading_first_line_only(spark):
    assert one(spark, "## Head\nbody", lambda c: X.heading_title(c, first_line_only=True)) == "Head"


def test_segments(spark):
    # A line of one space does not separate; three LFs leave one at the next segment's start.
    assert one(spark, "a\n \nb\n\n\nc\n\n\n\nd\n\n  ", X.segments) == ["a\n \nb", "c", "d"]


def by_rule(text, limit, length=len):
    """The packing rule, one word at a time."""
    if length(text) <= limit:
        return [text]
    pieces, current = [], ""
    for word in [w for w in text.split(" ") if w]:
        joined = f"{current} {word}" if current else word
        if length(joined) > limit:
            if current:
                pieces.append(current)
            current = word
        else:
            current = joined
    return [*pieces, current] if current else pieces or [text]


def test_packing_follows_the_rule(spark):
    rng = random.Random(5)
    texts = [" " * 500, "x" * 500, "a" * 200, "a" * 201, " " + "w " * 300]
    for _ in range(150):
        words = ["ab\né漢"[: rng.randint(1, 5)] * rng.choice([1, 2, 5, 80]) for _ in range(rng.randint(1, 120))]
        texts.append("".join(w + " " * rng.choice([1, 1, 1, 2, 3]) for w in words))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for limit in (50, 200, 333):  # below 200 the limit is 200
        for unit in ("grapheme", "codepoint"):
            got = dict(df.select("i", X.pack_words(F.col("t"), limit, unit)).collect())
            for i, text in enumerate(texts):
                assert got[i] == by_rule(text, max(200, limit)), (limit, unit, i)


def test_packing_counts_clusters(spark):
    import regex

    def clusters(text):
        return len(regex.findall(r"\X", text))

    accent, family, thai = "é", "👨‍👩‍👧", "กำ"
    rng = random.Random(6)
    texts = [accent * 200, (accent * 9 + " ") * 40, family * 190 + " " + family * 20, thai * 3000]
    for _ in range(40):
        texts.append(" ".join(rng.choice([accent, family, thai, "ab"]) * rng.randint(1, 30) for _ in range(60)))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = dict(df.select("i", X.pack_words(F.col("t"), 200)).collect())
    for i, text in enumerate(texts):
        assert got[i] == by_rule(text, 200, clusters), i
    lengths = dict(df.select("i", X.text_length(F.col("t"))).collect())
    assert lengths == {i: clusters(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("size", "score"), [(0, 0.45), (80, 0.45), (81, 0.74), (240, 0.74), (241, 0.92)])
def test_page_quality_bounds(spark, size, score):
    assert one(spark, "é" * size, P.page_quality) == score
    assert one(spark, "é" * size, P.page_quality) == score


def test_page_arrays(spark):
    df = spark.createDataFrame([([3, 1, 3, 0], [1, 5])], "a array<int>, b array<int>")
    a, b = F.col("a"), F.col("b")
    row = df.select(P.distinct_pages(a), P.pages_except(a, b), P.pages_without(a, b), P.page_label_list(a), P.page_label_list(F.filter(a, lambda x: x > 9))).first()
    assert list(row) == [[0, 1, 3], [0, 3], [3, 3, 0], "4, 2, 4, 1", "none"]


def test_labels(spark):
    values = [1 / 16, 0.6 / 16, 0.5, 1.0, 0.0, 2 / 3, 0.0005, 3.9995, 12.3456]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    got = [r[0] for r in df.select(R.score_label(F.col("s"))).collect()]
    assert got == ["%.3f" % v for v in values[:6]] + got[6:7] + ["%.3f" % v for v in values[7:]]
    labels = spark.range(1).select(
        R.page_label(F.lit(4)), R.page_label(F.lit(None).cast("int")), R.ordinal_label(F.lit(0)),
        R.quality_badge(F.lit("T"), F.lit(0)), R.quality_badge(F.lit("T"), F.lit(2)),
        R.import_message(F.lit(3), F.lit(0)), R.import_message(F.lit(3), F.lit(2)), R.reparse_message(F.lit(2), F.lit(1)),
        R.clamp_progress(F.lit(1.5)), R.clamp_progress(F.lit(-0.1)), R.outline_line(F.lit(3), F.lit("x")),
    ).first()
    assert list(labels) == [
        "P5", None, "#0", "T • Clean", "T • LQ 2", "Indexed 3 chunks", "Indexed 3 chunks (2 pages flagged for VLM fallback)",
        "Resolved 2, remaining 1", 1.0, 0.0, "    • x",
    ]
    rates = spark.createDataFrame([(0.005,), (0.125,), (0.5,), (1.0,)], "r double").select(P.rate_percent(F.col("r")))
    assert [r[0] for r in rates.collect()] == [1, 13, 50, 100]
