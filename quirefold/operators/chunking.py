"""Documents and pages to chunks, sections, page scores and document records.

A Markdown document is parsed inside its own row and exploded, without a shuffle.
Pages of one document are separate rows. They are parsed once into a written table; their
ordinals come from blocked sums over its narrow columns and meet the pieces by row number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import pages as P
from quirefold.functions import text as X
from quirefold.operators.blocks import running_offset
from quirefold.session import cut_lineage

# Reject reasons.
EMPTY_MARKDOWN = "Empty markdown document"
NO_PAGE_TEXT = "PDF has no extractable text"

#: Pages whose first ordinals, two numbers each, are broadcast.
BROADCAST_PAGES = 1 << 18
# Pieces that a task gets at most, about, where pieces move to their numbers.
PIECES_OF_TASK = 1 << 16


def md_segments(docs: DataFrame, text: str = "md") -> DataFrame:
    """One row per paragraph: ``(…, segment_index, segment)``."""
    segments = X.segments(X.normalize_newlines(F.col(text)))
    return docs.select("document_id", F.posexplode(segments).alias("segment_index", "segment"))


def md_headings(docs: DataFrame, text: str = "md", first_line_only: bool = False) -> DataFrame:
    """Heading segments with level and title."""
    segment = F.col("segment")
    return (
        md_segments(docs, text)
        .select(
            "document_id",
            "segment_index",
            X.heading_level(segment).alias("level"),
            X.heading_title(segment, first_line_only).alias("title"),
        )
        .where(F.col("title").isNotNull())
    )


def _pieces(text: Column, limit: int, unit: str, first_line_only: bool) -> Column:
    """All pieces of a document in order; the first piece of a heading carries level and title."""

    def of_segment(segment: Column) -> Column:
        def of_piece(piece: Column, index: Column) -> Column:
            first = index == 0
            return F.struct(
                piece.alias("text"),
                F.when(first, X.heading_title(segment, first_line_only)).alias("title"),
                F.when(first, X.heading_level(segment)).alias("level"),
            )

        return F.transform(X.pack_words(segment, limit, unit), of_piece)

    return F.flatten(F.transform(X.segments(X.normalize_newlines(text)), of_segment))


def md_pieces(
    docs: DataFrame,
    text: str = "md",
    limit: int = X.DEFAULT_CHUNK_LIMIT,
    unit: str = "grapheme",
    first_line_only: bool = False,
) -> DataFrame:
    """One pass over the text: ``(document_id, ordinal, text, title, level)``.

    Chunks are all rows; sections are the rows with a title.
    """
    exploded = docs.select(
        "document_id", F.posexplode(_pieces(F.col(text), limit, unit, first_line_only)).alias("ordinal", "piece")
    )
    return exploded.select("document_id", "ordinal", "piece.text", "piece.title", "piece.level")


def md_outline(
    docs: DataFrame,
    text: str = "md",
    limit: int = X.DEFAULT_CHUNK_LIMIT,
    unit: str = "grapheme",
    first_line_only: bool = False,
    keep: tuple[str, ...] = (),
    texts: bool = False,
) -> DataFrame:
    """Per document: ``chunk_count`` and ``sections`` as an array, without any chunk text.

    ``texts`` adds the chunk texts as an array, from the same parse.
    """
    held = ["texts"] if texts else []

    def summary(pieces: Column) -> Column:
        starts = F.transform(
            pieces,
            lambda piece, no: F.struct(
                piece["level"].alias("level"), piece["title"].alias("title"), no.alias("chunk_start_ordinal")
            ),
        )
        return F.struct(
            F.size(pieces).alias("chunk_count"),
            F.filter(starts, lambda start: start["title"].isNotNull()).alias("sections"),
            *(pieces["text"].alias(name) for name in held),
        )

    return docs.select(
        "document_id", *keep, X.let(_pieces(F.col(text), limit, unit, first_line_only), summary).alias("_o")
    ).select("document_id", *keep, "_o.chunk_count", "_o.sections", *(f"_o.{name}" for name in held))


def outline_chunks(outlines: DataFrame) -> DataFrame:
    """Chunk rows of ``md_outline`` with ``texts``."""
    return chunks_of(outlines.select("document_id", F.posexplode("texts").alias("ordinal", "text")))


def chunks_of(pieces: DataFrame) -> DataFrame:
    return pieces.select("document_id", "ordinal", "text", F.lit(None).cast("int").alias("source_page_index"))


def sections_of(pieces: DataFrame) -> DataFrame:
    return pieces.where(F.col("title").isNotNull()).select(
        "document_id", "level", "title", F.col("ordinal").alias("chunk_start_ordinal")
    )


def md_chunks(docs: DataFrame, text: str = "md", limit: int = X.DEFAULT_CHUNK_LIMIT, unit: str = "grapheme") -> DataFrame:
    return chunks_of(md_pieces(docs, text, limit, unit))


def md_sections(
    docs: DataFrame,
    text: str = "md",
    limit: int = X.DEFAULT_CHUNK_LIMIT,
    unit: str = "grapheme",
    first_line_only: bool = False,
) -> DataFrame:
    return sections_of(md_pieces(docs, text, limit, unit, first_line_only))


def is_blank_markdown(text: Column) -> Column:
    """True for the documents that are rejected as empty."""
    return X.trim_unicode(text) == ""


def page_source(pages: DataFrame) -> DataFrame:
    """Page texts trimmed; empty ones stay, marked, because they are scored."""
    trimmed = X.trim_unicode(F.col("text"))
    return pages.select(
        "document_id", "page_index", trimmed.alias("text"), (trimmed == "").alias("is_empty")
    )


def page_scores(pages: DataFrame, score: Column | None = None, unit: str = "grapheme") -> DataFrame:
    """Quality per page; ``score`` replaces the built-in rule (any Column, also a pandas UDF)."""
    if score is None:
        score = P.page_quality(X.trim_unicode(F.col("text")), unit)
    return pages.select("document_id", "page_index", score.alias("quality_score"))


def route_pages(scores: DataFrame, threshold: float = P.FALLBACK_THRESHOLD) -> DataFrame:
    return scores.withColumn("requires_fallback", P.requires_fallback(F.col("quality_score"), threshold))


def parsed_pages(
    pages: DataFrame,
    limit: int = X.DEFAULT_CHUNK_LIMIT,
    unit: str = "grapheme",
    threshold: float = P.FALLBACK_THRESHOLD,
) -> DataFrame:
    """One parse of all pages: ``(document_id, page_index, requires_fallback, n_pieces, tie, page_no, pieces)``.

    Write the result before using it: ``page_no`` tells the rows of one run apart. An empty page has no piece.
    """
    text = F.col("text")
    pieces = F.when(text == "", F.array().cast("array<string>")).otherwise(X.pack_words(text, limit, unit))
    trimmed = pages.select("document_id", "page_index", X.trim_unicode(text).alias("text"))
    packed = trimmed.select(
        "document_id",
        "page_index",
        P.requires_fallback(P.page_quality(text, unit), threshold).alias("requires_fallback"),
        F.coalesce(pieces, F.array().cast("array<string>")).alias("pieces"),
    )
    # Rows of one page index are ordered by their text, so that a retry numbers them alike.
    return packed.select(
        "document_id", "page_index", "requires_fallback", F.size("pieces").alias("n_pieces"),
        F.xxhash64("pieces").alias("tie"), F.monotonically_increasing_id().alias("page_no"), "pieces",
    )


def numbered_chunks(parsed: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Chunks of a written ``parsed_pages`` table; ordinals run on over the pages of a document.

    Only numbers are sorted. Pieces stay where they were read if there are few pages. If there are many they move once,
    by page, into hash tables of the numbers, in as many tasks as the pieces need. ``documents`` names the
    documents to number; pages of others are left out.
    """
    filled = parsed.where(F.col("n_pieces") > 0)
    sizes = filled.select("document_id", "page_index", "tie", "page_no", "n_pieces")
    if documents is not None:
        sizes = sizes.join(documents.select("document_id"), "document_id", "left_semi")
    placed = running_offset(sizes, ["document_id"], "page_index", F.col("n_pieces"), "first_ordinal", ties=["tie", "page_no"])
    firsts = placed.select("page_no", "first_ordinal")
    held = filled.select("page_no", "document_id", "page_index", "pieces")
    pages, pieces = filled.agg(F.count(F.lit(1)), F.sum("n_pieces")).first()
    if pages <= BROADCAST_PAGES:
        firsts = F.broadcast(firsts)
    else:
        # Fewer tasks than the session's shuffle partitions would be dealt again by the join.
        tasks = max(-(-pieces // PIECES_OF_TASK), int(parsed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        held, firsts = held.repartition(tasks, "page_no"), firsts.repartition(tasks, "page_no").hint("shuffle_hash")
    exploded = held.join(firsts, "page_no").select(
        "document_id", "page_index", "first_ordinal", F.posexplode("pieces").alias("piece_index", "text")
    )
    return exploded.select(
        "document_id",
        (F.col("first_ordinal") + F.col("piece_index")).cast("int").alias("ordinal"),
        "text",
        F.col("page_index").cast("int").alias("source_page_index"),
    )


def page_chunks(pages: DataFrame, limit: int = X.DEFAULT_CHUNK_LIMIT, unit: str = "grapheme") -> DataFrame:
    """Chunks of all non-empty pages, parsed once into a table in the shared folder."""
    return numbered_chunks(cut_lineage(parsed_pages(pages, limit, unit)))


def page_sections(docs: DataFrame, path: str = "source_path") -> DataFrame:
    """One section per paged document: level 1, titled by the file stem, from chunk 0."""
    return docs.select(
        "document_id",
        F.lit(1).alias("level"),
        X.file_stem(F.col(path)).alias("title"),
        F.lit(0).alias("chunk_start_ordinal"),
    )


def page_piece_counts(parsed: DataFrame) -> DataFrame:
    """Chunks per document of ``parsed_pages``; documents without any text give no row."""
    sizes = parsed.where(F.col("n_pieces") > 0)
    return sizes.groupBy("document_id").agg(F.sum("n_pieces").cast("int").alias("chunk_count"))


def low_pages(pages: DataFrame, threshold: float = P.FALLBACK_THRESHOLD) -> DataFrame:
    """Pages routed to the fallback, one row each."""
    routed = route_pages(page_scores(pages), threshold)
    return routed.where(F.col("requires_fallback")).select("document_id", "page_index")


def low_page_lists(low: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Sorted page list per document, as the document record stores it.

    The list is one value of the record and grows with the document's low pages
    only. It is sorted in blocks first, then the blocks are put in order.
    """
    blocks = (
        low.withColumn("_block", F.floor(F.col("page_index") / F.lit(block)))
        .groupBy("document_id", "_block")
        .agg(F.array_sort(F.collect_list(F.col("page_index").cast("int"))).alias("_pages"))
    )
    lists = blocks.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_pages"))).alias("_blocks")
    )
    return lists.select("document_id", F.flatten("_blocks._pages").alias("low_quality_pages"))


def document_record(
    docs: DataFrame, chunks: DataFrame | None, low: DataFrame, imported_at: Column, title: Column | None = None
) -> DataFrame:
    """Document rows ``(document_id, source_path, title, source_type)`` with counts and page lists.

    ``chunks`` are chunk rows, or one row per document with its ``chunk_count``; None if ``docs`` has that column.
    """
    counted = docs
    if chunks is not None:
        if "chunk_count" in chunks.columns:
            counts = chunks.select("document_id", "chunk_count")
        else:
            counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
        counted = docs.join(counts, "document_id", "left")
    no_pages = F.array().cast("array<int>")
    return (
        counted.join(low_page_lists(low), "document_id", "left")
        .select(
            "document_id",
            "source_path",
            (F.col("title") if title is None else title).alias("title"),
            "source_type",
            F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
            F.coalesce("low_quality_pages", no_pages).alias("low_quality_pages"),
            F.coalesce(F.size("low_quality_pages"), F.lit(0)).alias("fallback_page_count"),
            imported_at.alias("imported_at"),
        )
    )


def import_summary(docs: DataFrame, chunks: DataFrame, sections: DataFrame, low: DataFrame) -> DataFrame:
    """Chunks, sections and fallback pages per document.

    The three inputs are tagged and summed in one aggregation; partial sums keep
    the shuffle at one row per document and input partition.
    """

    kinds = ("chunks", "sections", "fallback_pages")

    def tagged(df: DataFrame, kind: str | None) -> DataFrame:
        return df.select("document_id", *[F.lit(int(kind == k)).cast("long").alias(k) for k in kinds])

    parts = tagged(docs, None)
    for df, kind in ((chunks, "chunks"), (sections, "sections"), (low, "fallback_pages")):
        parts = parts.unionByName(tagged(df, kind))
    return parts.groupBy("document_id").agg(*[F.sum(k).alias(k) for k in kinds])
