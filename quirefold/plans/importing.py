"""The import job: files and page texts to the three stored tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import ids
from quirefold.functions import pages as P
from quirefold.functions import text as X
from quirefold.operators import chunking as C
from quirefold.operators.jobs import import_outcomes
from quirefold.session import cut_lineage, release
from quirefold.sources.corpus import route_source_type
from quirefold.sources.store import CorpusStore

FILE_COLUMNS = "source_path string, text string, reject_reason string"


@dataclass
class ParsedBatch:
    """Tables of one parsed batch; every file is in ``documents`` or in ``rejects``.

    They are read from ``written``, which ``release`` deletes when the batch is done with.
    """

    documents: DataFrame
    chunks: DataFrame
    sections: DataFrame
    rejects: DataFrame
    written: list[DataFrame] = field(default_factory=list)

    def outcomes(self) -> DataFrame:
        return import_outcomes(self.documents, self.rejects)

    def release(self) -> None:
        release(*self.written)


def parse_batch(
    files: DataFrame,
    pages: DataFrame,
    workspace_id: str,
    import_batch_id: str,
    imported_at: Column,
    limit: int = X.DEFAULT_CHUNK_LIMIT,
    threshold: float = P.FALLBACK_THRESHOLD,
) -> ParsedBatch:
    """``files(source_path, text, reject_reason)``, ``pages(source_path, page_index, text)``.

    ``files`` lists paged files too, with null text. Each text is parsed once: its verdict, title,
    chunk count, outline and pieces are written out, and records, sections, rejects and chunks
    read the columns that they need.
    """
    listed = (
        route_source_type(files.withColumnRenamed("reject_reason", "_given"))
        .withColumn("reject_reason", F.coalesce("_given", "reject_reason"))
        .drop("_given")
        .withColumn("document_id", ids.document_id(F.lit(workspace_id), F.col("source_path"), F.lit(import_batch_id)))
    )
    open_markdown = (F.col("source_type") == "markdown") & F.col("reject_reason").isNull()
    texts = listed.where(open_markdown)
    parsed = C.md_outline(
        texts.withColumn("title", X.document_title(X.normalize_newlines(F.col("text")), F.col("source_path"))),
        "text", limit, keep=("source_path", "source_type", "title"), texts=True,
    )
    # A text gives no chunk only if it is blank or missing.
    blank = F.when(F.coalesce(F.col("chunk_count"), F.lit(0)) <= 0, F.lit(C.EMPTY_MARKDOWN))
    judged = cut_lineage(parsed.withColumn("reject_reason", blank))
    markdown = judged.where(F.col("reject_reason").isNull())

    paged = listed.where(F.col("reject_reason").isNull() & (F.col("source_type") == "pdf")).select(
        "document_id", "source_path", "source_type", X.file_stem(F.col("source_path")).alias("title")
    )
    # Page texts do not move to the list of files: a short list is sent to them, and of a long one only keys meet, after the parse.
    page_rows = pages.where(F.col("source_path").isNotNull()).withColumn(
        "document_id", ids.document_id(F.lit(workspace_id), F.col("source_path"), F.lit(import_batch_id))
    )
    own = paged.select("document_id")
    if own.count() <= C.BROADCAST_PAGES:
        page_rows = page_rows.join(F.broadcast(own), "document_id", "left_semi")
    parsed_pages = cut_lineage(C.parsed_pages(page_rows.select("document_id", "page_index", "text"), limit, threshold=threshold))
    counts = C.page_piece_counts(parsed_pages).join(own, "document_id", "left_semi")
    readable = paged.join(counts.select("document_id"), "document_id", "left_semi")
    unreadable = paged.join(counts.select("document_id"), "document_id", "left_anti")

    chunks = C.outline_chunks(markdown).unionByName(C.numbered_chunks(parsed_pages, own))
    outlines = markdown.select("document_id", F.inline("sections"))
    sections = outlines.unionByName(C.page_sections(readable))
    # A text keeps the count of its own row: joined by id, a path that arrives twice would give each row the counts of both.
    columns = ["document_id", "source_path", "source_type", "title", "chunk_count"]
    documents = cut_lineage(C.document_record(
        markdown.select(*columns).unionByName(paged.join(counts, "document_id").select(*columns)),
        None,
        parsed_pages.where("requires_fallback").select("document_id", "page_index"),
        imported_at,
    ))
    rejects = (
        listed.where(F.col("reject_reason").isNotNull()).select("source_path", "reject_reason")
        .unionByName(judged.where(F.col("reject_reason").isNotNull()).select("source_path", "reject_reason"))
        .unionByName(unreadable.select("source_path", F.lit(C.NO_PAGE_TEXT).alias("reject_reason")))
    )

    def with_id(df: DataFrame, name: str, kind: str, number: str) -> DataFrame:
        return df.withColumn(name, ids.part_id(F.col("document_id"), kind, F.col(number))).withColumn(
            "workspace_id", F.lit(workspace_id)
        )

    return ParsedBatch(
        documents=documents.withColumn("workspace_id", F.lit(workspace_id)),
        chunks=with_id(chunks, "chunk_id", "chunk", "ordinal"),
        sections=with_id(sections, "section_id", "section", "chunk_start_ordinal"),
        rejects=rejects,
        written=[judged, parsed_pages, documents],
    )


def import_batch(
    store: CorpusStore,
    files: DataFrame,
    pages: DataFrame,
    workspace_id: str,
    import_batch_id: str,
    imported_at: Column | None = None,
    **options,
) -> ParsedBatch:
    """Parse and store a batch: chunks, then documents with sections, then the commit row.

    Ids depend on the batch id, so running a batch again rewrites its own rows. The caller releases
    the batch once its outcomes are read.
    """
    if imported_at is None:
        imported_at = F.current_timestamp()
    batch = parse_batch(files, pages, workspace_id, import_batch_id, imported_at, **options)
    chunks = batch.chunks.withColumn("position", F.col("ordinal").cast("long"))
    store.upsert_chunks(chunks, unique=True, documents=batch.documents.select("workspace_id", "document_id"))
    records = batch.documents.drop("fallback_page_count").withColumn("position", F.lit(0).cast("long"))
    store.upsert_documents(records, batch.sections)
    store.mark_commit(import_batch_id, workspace_id)
    return batch
