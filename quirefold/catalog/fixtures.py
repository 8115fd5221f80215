"""Views derived from the given tables, written once for Spark and once for SQL.

Each Spark function has a SQL twin in ``oracle.py`` under the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import report as R
from quirefold.functions.report import clamp_progress
from quirefold.operators import chunking as C
from quirefold.operators.jobs import REPARSE_PROGRESS, state_progress
from quirefold.session import cut_lineage

EPOCH = 1704067200  # 2024-01-01 in seconds

LITERAL_QUERIES = [(1, " The ", 0, 30), (2, "%", 5, 10), (3, "", 7, 10), (4, "é", 9, 0), (5, "zzzz", 11, 10), (6, "a_e", 3, 12), (7, " the", 13, 45)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def markdown(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Every fifth line of a document becomes a heading; lines are set apart as paragraphs. Columns of ``keep`` stay."""

    def mark(line, index):
        level = (1 + (index / 5).cast("int") % 3).cast("int")
        return F.when(index % 5 == 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), line)).otherwise(line)

    md = F.array_join(F.transform(F.split("text", "\n", -1), mark), "\n\n")
    return documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), md.alias("md"), *keep)


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.md_pieces(markdown(spark, sf_dir))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunks_of(pieces(spark, sf_dir))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sections_of(pieces(spark, sf_dir))


def outline_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chunk keys and sections from one pass over the text, written out without it."""
    narrow = cut_lineage(pieces(spark, sf_dir).select("document_id", "ordinal", "title", "level"))
    return narrow.select("document_id", "ordinal"), C.sections_of(narrow)


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the Markdown documents; the paged ones stay without an outline."""
    _, found = outline_tables(spark, sf_dir)
    return found.where(~is_paged(F.col("document_id")))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small page table: turns of conversations."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("document_id"), F.col("turn").cast("int").alias("page_index"), "text"
    )


def pages(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Large page table: lines of documents. Columns of ``keep`` stay."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("document_id"), *keep, F.posexplode(F.split("text", "\n", -1)).alias("page_index", "text")
    )


def repaired_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages after a repair: the text of every other page is doubled."""
    doubled = F.concat("text", F.lit(" "), "text")
    return pages(spark, sf_dir).withColumn("text", F.when(F.col("page_index") % 2 == 0, doubled).otherwise(F.col("text")))


def is_paged(document: Column) -> Column:
    """The source type in this fixture: every third document is paged, the others are Markdown."""
    return document % 3 == 0


def source_path(document: Column) -> Column:
    """Path of a document, from its id and the column ``source``."""
    extension = F.when(is_paged(document), F.lit(".pdf")).otherwise(F.lit(".md"))
    return F.concat("source", F.lit("/"), document.cast("string"), extension)


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source path and type per document."""
    paged = is_paged(F.col("doc_id"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"),
        source_path(F.col("doc_id")).alias("source_path"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.when(paged, F.lit("pdf")).otherwise(F.lit("markdown")).alias("source_type"),
    )


def imported_at():
    return F.timestamp_seconds(F.lit(EPOCH) + F.col("document_id") * 60)


def paged_pages(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return pages(spark, sf_dir, *keep).where(is_paged(F.col("document_id")))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document records with chunk counts and low pages."""
    md = C.chunks_of(C.md_pieces(markdown(spark, sf_dir).where(~is_paged(F.col("document_id")))))
    paged = C.page_chunks(paged_pages(spark, sf_dir))
    low = C.low_pages(paged_pages(spark, sf_dir))
    return C.document_record(document_rows(spark, sf_dir), md.unionByName(paged), low, imported_at())


def record_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without chunk counts, for queries that do not look at them."""
    low = C.low_page_lists(C.low_pages(paged_pages(spark, sf_dir)))
    none = F.array().cast("array<int>")
    joined = document_rows(spark, sf_dir).join(low, "document_id", "left").select(
        "document_id", "source_path", "title", "source_type",
        F.coalesce("low_quality_pages", none).alias("low_quality_pages"), imported_at().alias("imported_at"),
    )
    return cut_lineage(joined)


def still_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = repaired_pages(spark, sf_dir).where(is_paged(F.col("document_id")))
    return C.low_page_lists(C.low_pages(repaired)).withColumnRenamed("low_quality_pages", "still_low")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as vectors of the first chunk of a document."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("document_id"), F.lit(0).alias("ordinal"), "embedding"
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search queries: a few literal rows and one per benchmark item (its first word)."""
    rows = ", ".join(f"({q}L, '{keyword}', {vec}L, {k})" for q, keyword, vec, k in LITERAL_QUERIES)
    literal = spark.sql(f"SELECT * FROM VALUES {rows} AS t(query_id, keyword, vec_id, k)")
    derived = table(spark, sf_dir, "benchmark").select(
        (F.col("item_id") + 100).alias("query_id"),
        F.concat(F.lit(" "), F.substring_index("text", " ", 1)).alias("keyword"),
        F.col("item_id").alias("vec_id"),
        (F.col("item_id") % 20 + 5).cast("int").alias("k"),
    )
    stored = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    # Both sides are short lists; AQE measures them.
    return literal.unionByName(derived).join(stored, "vec_id", "left").select(
        "query_id", "keyword", F.coalesce("embedding", F.array().cast("array<float>")).alias("embedding"), "k"
    )


JOB_STATUS = {"view": "queued", "signup": "queued", "click": "parsing", "purchase": "indexed", "error": "failed"}
JOB_PROGRESS = {"queued": 0.0, "parsing": 0.2, "indexed": 1.0, "failed": 1.0}


def event_time() -> Column:
    """A time for each event, a minute apart."""
    return F.timestamp_seconds(F.lit(EPOCH) + F.col("event_id") * 60)


def as_job_events(events: DataFrame) -> DataFrame:
    """Events as import-job events with their texts; ``user_id`` is the job."""
    status = F.lit(None).cast("string")
    for kind, name in JOB_STATUS.items():
        status = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(status)
    progress = F.lit(None).cast("double")
    for name, value in JOB_PROGRESS.items():
        progress = F.when(status == name, F.lit(value)).otherwise(progress)
    number = F.col("user_id").cast("string")
    path = F.concat(F.lit("in/"), number, F.lit(".md"))
    message = (
        F.when(status == "queued", F.lit(R.QUEUED))
        .when(status == "parsing", R.parsing_message(path))
        .when(status == "indexed", R.import_message(F.col("event_id") % 40, F.col("event_id") % 3))
        .otherwise(F.lit(C.EMPTY_MARKDOWN))
    )
    return events.select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), status.alias("status"),
        clamp_progress(progress).alias("progress"), message.alias("message"),
        F.concat(F.lit("Document "), number).alias("document_title"), path.alias("source_path"), event_time().alias("created_at"),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_job_events(table(spark, sf_dir, "events"))


def as_admission_log(events: DataFrame) -> DataFrame:
    """Events as re-parse requests and finishes; ``user_id`` is the document, every seventh has no low pages."""
    finish = F.col("event_type").isin("purchase", "error")
    return events.select(
        F.col("user_id").alias("document_id"), F.col("event_id").alias("seq"),
        F.when(finish, F.lit("finish")).otherwise(F.lit("enqueue")).alias("kind"),
        (F.col("user_id") % 7 != 0).alias("has_low_pages"),
    )


def admission_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_admission_log(table(spark, sf_dir, "events"))


def reparse_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as re-parse jobs of the document ``user_id``; each job was given up to three pages, one of them twice."""
    status = (
        F.when(F.col("event_type") == "click", F.lit("running"))
        .when(F.col("event_type") == "purchase", F.lit("completed"))
        .when(F.col("event_type") == "error", F.lit("failed"))
        .otherwise(F.lit("queued"))
    )
    message = (
        F.when(status == "queued", F.lit(R.QUEUED)).when(status == "running", F.lit(R.REPARSING))
        .when(status == "completed", R.reparse_message(F.col("event_id") % 4, F.col("event_id") % 3)).otherwise(F.lit(C.NO_PAGE_TEXT))
    )
    given = F.array(*((F.col("event_id") % n).cast("int") for n in (5, 3, 5)))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("document_id"), F.col("event_id").alias("job_id"), status.alias("status"),
        F.col("ts").alias("created_at"), state_progress(status, REPARSE_PROGRESS).alias("progress"), message.alias("message"),
        given.alias("page_indices"),
    )


def reparse_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events other than purchases and errors as requests to parse the document ``user_id`` again."""
    return table(spark, sf_dir, "events").where(~F.col("event_type").isin("purchase", "error")).select(
        F.col("user_id").cast("string").alias("document_id"), F.col("event_id").alias("seq")
    )


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as rectangles."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("node_id"),
        (F.col("l_partkey") * 7.0).alias("x"),
        (F.col("l_suppkey") * 131.0).alias("y"),
        F.col("l_quantity").cast("double").alias("width"),
        (F.col("l_linenumber") * 10.0).alias("height"),
    )


def viewports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as viewports of different sizes, some far off the map."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("viewport_id"),
        (key * 60.0 - 100.0).alias("x"),
        (key * 131.0 - F.when(key % 5 == 0, F.lit(1e7)).otherwise(F.lit(0.0))).alias("y"),
        F.pow(F.lit(2.0), (key % 12).cast("double")).alias("width"),
        ((key % 4) * 50.0).alias("height"),
    )


def responses(nodes: DataFrame) -> DataFrame:
    """Scorer answers for the heading nodes: a JSON list, or broken JSON for every fourth node."""
    topic = F.regexp_replace("topic", r'["\\]', "")
    good = F.concat(F.lit('[{"topic":"'), topic, F.lit('","details":["one","two"]},{"topic":"more","details":[]}]'))
    bad = F.concat(F.lit('[{"topic":"'), topic)
    return nodes.select(
        "document_id", "node_id", F.when(F.col("node_index") % 4 == 3, bad).otherwise(good).alias("response")
    )


def skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirefold.operators.outline import skeleton as build

    return build(markdown(spark, sf_dir))
