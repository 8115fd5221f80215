"""Registered queries: one per operator, each over the whole given tables.

Every callable takes ``(spark, sf_dir)``. Arrays leave as JSON text and times as
epoch seconds, so that values compare the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.catalog import fixtures as X
from quirefold.functions import pages as P
from quirefold.functions import report as R
from quirefold.functions import text as TX
from quirefold.functions.geometry import Rect, rect_contains
from quirefold.operators import audit, jobs, layout, outline, reparse, search, upsert
from quirefold.operators import chunking as C
from quirefold.operators import sections as S
from quirefold.plans.importing import import_batch
from quirefold.plans.reparsing import reparse_jobs, reparse_step
from quirefold.plans.retrieval import keyword_search_with_sections, result_view, search_many
from quirefold.schemas import SECTIONS
from quirefold.session import scratch_path
from quirefold.sources import corpus, export
from quirefold.sources.store import CorpusStore
from quirefold.streaming import imports as stream_imports
from quirefold.streaming import jobs as stream_jobs

REGISTRY: dict = {}


def query(function):
    # A trailing underscore keeps a query apart from the operator it calls.
    REGISTRY[function.__name__.rstrip("_")] = function
    return function


def longs(df: DataFrame) -> DataFrame:
    """Integer columns widened to BIGINT, since engines differ in result widths."""
    return df.select(*[
        F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.ShortType)) else F.col(f.name)
        for f in df.schema
    ])


def _json(name: str, out: str | None = None):
    return F.to_json(name).alias(out or name)


# --- sources and sinks -------------------------------------------------------


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of six kinds of name, every tenth with a byte that is not UTF-8."""
    names = F.array(*map(F.lit, [".md", ".MD", ".txt", ".pdf", ".docx", ""]))
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.element_at(names, (F.col("doc_id") % 6 + 1).cast("int")))
    content = F.encode("text", "UTF-8")
    broken = F.concat(F.unhex(F.lit("FF")), content)
    return X.documents(spark, sf_dir).select(
        path.alias("source_path"), F.octet_length("text").alias("length"),
        F.when(F.col("doc_id") % 10 == 7, broken).otherwise(content).alias("content"),
    )


@query
def read_corpus(spark, sf_dir):
    rows = corpus.corpus_rows(_files(spark, sf_dir))
    return longs(rows.select("source_path", "source_type", F.md5("text").alias("text_md5"), F.char_length("text").alias("n"), "reject_reason"))


@query
def route_source_type(spark, sf_dir):
    return corpus.route_source_type(_files(spark, sf_dir)).select("source_path", "source_type", "reject_reason")


@query
def page_source(spark, sf_dir):
    return longs(C.page_source(X.turns(spark, sf_dir)))


def _text_files(documents: DataFrame) -> DataFrame:
    """Documents as readable Markdown files; every eleventh is blank."""
    blank = F.col("doc_id") % 11 == 5
    return documents.select(
        F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 13 == 6, F.lit(".docx")).otherwise(F.lit(".md"))).alias("source_path"),
        F.when(blank, F.lit(" \n\n ")).otherwise(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("text"),
        F.lit(None).cast("string").alias("reject_reason"),
    )


@query
def import_files_stream(spark, sf_dir):
    """Documents arriving as a stream, stored, and read back from the store's outcome rows."""
    schema = X.table(spark, sf_dir, "documents").schema
    # A pattern, because a stream takes a plain path for a folder; a table may be one file or a folder of files.
    arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")
    root = scratch_path(spark, "stream")
    store = CorpusStore(spark, f"{root}/store", buckets=8)
    stream = stream_imports.import_stream(_text_files(arriving), store, "w", f"{root}/checkpoint", f"{root}/outcomes")
    stream.awaitTermination()
    return spark.read.parquet(f"{root}/outcomes").select("source_path", "status", "progress", "message")


def _stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.timestamp_seconds(F.lit(X.EPOCH))
    return X.chunks(spark, sf_dir).select(
        F.concat_ws("/", "document_id", "ordinal").alias("chunk_id"), "document_id", "ordinal", "text", "source_page_index",
        start.alias("created_at"), start.alias("updated_at"),
    )


@query
def upsert_chunks(spark, sf_dir):
    stored = _stored_chunks(spark, sf_dir)
    changed = stored.where(F.col("document_id") % 2 == 1).drop("created_at", "updated_at")
    versions = F.explode(F.array(F.lit(0), F.lit(1)))
    repeated = changed.withColumn("position", versions).withColumn("text", F.concat("text", F.lit(" v"), F.col("position").cast("string")))
    fresh = changed.where(F.col("ordinal") == 0).withColumn("chunk_id", F.concat(F.lit("new/"), "chunk_id")).withColumn("position", F.lit(0))
    merged = upsert.upsert_chunks(stored, repeated.unionByName(fresh), "position", F.timestamp_seconds(F.lit(X.EPOCH + 3600)))
    return longs(merged.select(
        "chunk_id", "document_id", "ordinal", F.md5("text").alias("text_md5"),
        F.unix_seconds("created_at").alias("created"), F.unix_seconds("updated_at").alias("updated"),
    ))


@query
def upsert_documents(spark, sf_dir):
    stored = X.record_heads(spark, sf_dir).withColumn("updated_at", F.col("imported_at"))
    changed = stored.where(F.col("document_id") % 2 == 1)
    repeated = changed.withColumn("position", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "title", F.concat("title", F.lit(" v"), F.col("position").cast("string"))
    )
    fresh = changed.withColumn("document_id", F.col("document_id") + 1000000000).withColumn("position", F.lit(0))
    merged = upsert.upsert_documents(stored, repeated.unionByName(fresh), "position", F.timestamp_seconds(F.lit(X.EPOCH + 10**8)))
    return longs(merged.select(
        "document_id", "source_path", "title", "source_type", _json("low_quality_pages", "low_pages"),
        F.unix_seconds("imported_at").alias("imported"), F.unix_seconds("updated_at").alias("updated"),
    ))


@query
def replace_sections(spark, sf_dir):
    ids = X.document_rows(spark, sf_dir).where(F.col("source_type") == "pdf")
    new = ids.where(F.col("document_id") % 2 == 0).select(
        "document_id", F.lit(1).alias("level"), F.lit("Redone").alias("title"), F.lit(0).alias("chunk_start_ordinal")
    )
    return longs(upsert.replace_sections(X.sections(spark, sf_dir), ids, new))


@query
def evolve_schema(spark, sf_dir):
    target = T.StructType([
        T.StructField("document_id", T.LongType(), False), T.StructField("ordinal", T.LongType(), False),
        T.StructField("text", T.StringType(), False), T.StructField("source_page_index", T.LongType(), True),
    ])
    old = X.chunks(spark, sf_dir).drop("source_page_index")
    rows = upsert.evolve_schema(old, target).unionByName(upsert.evolve_schema(C.page_chunks(X.turns(spark, sf_dir)), target))
    return longs(rows.select("document_id", "ordinal", "source_page_index", F.md5("text").alias("text_md5")))


@query
def store_by_workspace(spark, sf_dir):
    """Chunks written by workspace (the document's language) and read back."""
    store = CorpusStore(spark, scratch_path(spark, "store"), buckets=8)
    languages = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("workspace_id"))
    rows = _stored_chunks(spark, sf_dir).drop("created_at", "updated_at").join(languages, "document_id")
    store.upsert_chunks(rows.withColumn("document_id", F.col("document_id").cast("string")).withColumn("position", F.lit(0)))
    stored = store.table("chunks")
    return longs(stored.groupBy("workspace_id", F.col("document_id").cast("bigint").alias("document_id")).agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("ordinal").alias("ordinals"), F.sum(F.char_length("text")).alias("characters")
    ))


@query
def documents_interchange(spark, sf_dir):
    out = corpus.to_interchange(X.record_heads(spark, sf_dir))
    back = corpus.from_interchange(out.withColumn("json", F.col("low_quality_pages_json")))
    total = F.aggregate("low_quality_pages", F.lit(0).cast("bigint"), lambda a, b: a + b)
    return longs(back.select("document_id", "title", F.col("json").alias("low_pages"), F.size("low_quality_pages").alias("pages"), total.alias("page_sum")))


@query
def artifact_audit(spark, sf_dir):
    """Document texts as artifacts; the manifest has upper-case, wrong and missing hashes and repeated ids."""
    docs = X.documents(spark, sf_dir)
    key = F.col("doc_id").cast("string")
    artifacts = docs.select(key.alias("model_id"), F.encode("text", "UTF-8").alias("content"))
    right = F.upper(F.sha2("text", 256))
    wrong = F.sha2(F.lit("other"), 256)
    first = docs.where(F.col("doc_id") % 3 != 2).select(
        key.alias("model_id"), F.when(F.col("doc_id") % 3 == 0, right).otherwise(wrong).alias("sha256"), F.lit(0).alias("position")
    )
    second = docs.where(F.col("doc_id") % 3 == 1).select(key.alias("model_id"), right.alias("sha256"), F.lit(1).alias("position"))
    return audit.artifact_audit(artifacts, first.unionByName(second))


@query
def outline_export(spark, sf_dir):
    return export.outline_export(X.sections(spark, sf_dir))


# --- chunking ----------------------------------------------------------------


@query
def normalize_newlines(spark, sf_dir):
    ending = F.when(F.col("document_id") % 2 == 0, F.lit("\r\n")).otherwise(F.lit("\r"))
    crlf = F.replace("md", F.lit("\n"), ending)
    return X.markdown(spark, sf_dir).select("document_id", F.md5(TX.normalize_newlines(crlf)).alias("md_md5"))


@query
def trim_unicode(spark, sf_dir):
    wrapped = F.concat(F.lit("　 \t\x0b"), "text", F.lit("\x85  \r\n"))
    return longs(X.documents(spark, sf_dir).select(
        "doc_id", F.md5(TX.trim_unicode(wrapped)).alias("text_md5"), F.char_length(TX.trim_unicode(wrapped)).alias("n")
    ))


@query
def document_title(spark, sf_dir):
    """Titles of Markdown; every fourth document has no heading and takes its file name."""
    paths = X.document_rows(spark, sf_dir).select("document_id", "source_path")
    text = F.when(F.col("document_id") % 4 == 0, F.replace("md", F.lit("#"), F.lit(""))).otherwise(F.col("md"))
    text = F.when(F.col("document_id") % 9 == 1, F.concat(F.lit("##\n"), text)).otherwise(text)
    titled = X.markdown(spark, sf_dir).join(paths, "document_id")
    return titled.select("document_id", TX.document_title(text, F.col("source_path")).alias("title"))


@query
def file_stem(spark, sf_dir):
    path = F.col("source_path")
    return X.document_rows(spark, sf_dir).select(
        "document_id", TX.file_stem(path).alias("stem"), TX.file_extension(path).alias("extension")
    )


@query
def md_segments(spark, sf_dir):
    return longs(C.md_segments(X.markdown(spark, sf_dir)))


@query
def md_headings(spark, sf_dir):
    return longs(C.md_headings(X.markdown(spark, sf_dir)))


@query
def pack_words(spark, sf_dir):
    docs = X.documents(spark, sf_dir)
    pieces = docs.select("doc_id", F.posexplode(TX.pack_words(F.col("text"), 200)).alias("piece_index", "piece"))
    return longs(pieces)


@query
def md_chunks(spark, sf_dir):
    return longs(C.md_chunks(X.markdown(spark, sf_dir)).select("document_id", "ordinal", "text"))


@query
def md_sections(spark, sf_dir):
    return longs(C.md_sections(X.markdown(spark, sf_dir)))


@query
def page_quality(spark, sf_dir):
    return longs(C.page_scores(X.pages(spark, sf_dir)))


@query
def route_pages(spark, sf_dir):
    return longs(C.route_pages(C.page_scores(X.pages(spark, sf_dir))))


@query
def page_chunks(spark, sf_dir):
    return longs(C.page_chunks(X.pages(spark, sf_dir)))


@query
def page_sections(spark, sf_dir):
    return longs(C.page_sections(X.document_rows(spark, sf_dir).where(F.col("source_type") == "pdf")))


def _record_view(df: DataFrame) -> DataFrame:
    return longs(df.select(
        "document_id", "source_path", "title", "source_type", "chunk_count", _json("low_quality_pages", "low_pages"),
        "fallback_page_count", F.unix_seconds("imported_at").alias("imported"),
    ))


@query
def document_record(spark, sf_dir):
    return _record_view(X.records(spark, sf_dir))


def _import_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # A path is made in the row of its text, so no text moves to its path.
    document = F.col("document_id")
    paged = X.is_paged(document)
    path = X.source_path(document)
    md = X.markdown(spark, sf_dir, "source").where(document.isNotNull())
    files = md.select(path.alias("source_path"), F.when(~paged, F.col("md")).alias("text"), F.lit(None).cast("string").alias("reject_reason"))
    pages = X.paged_pages(spark, sf_dir, "source").select(path.alias("source_path"), "page_index", "text")
    return files, pages


@query
def import_batch_(spark, sf_dir):
    """The whole import job into a fresh store; its document table joined with stored counts."""
    store = CorpusStore(spark, scratch_path(spark, "import"), buckets=8)
    files, pages = _import_inputs(spark, sf_dir)
    import_batch(store, files, pages, "w1", "b1", F.timestamp_seconds(F.lit(X.EPOCH))).release()
    chunks = store.table("chunks").groupBy("document_id").agg(F.count(F.lit(1)).alias("stored_chunks"))
    sections = store.table("sections").groupBy("document_id").agg(F.count(F.lit(1)).alias("stored_sections"))
    joined = store.table("documents").join(chunks, "document_id", "left").join(sections, "document_id", "left")
    return longs(joined.select(
        "source_path", "title", "source_type", "chunk_count", _json("low_quality_pages", "low_pages"),
        F.coalesce("stored_chunks", F.lit(0)).alias("stored_chunks"), F.coalesce("stored_sections", F.lit(0)).alias("stored_sections"),
    ))


# --- predicates --------------------------------------------------------------


@query
def keyword_filter(spark, sf_dir):
    return longs(search.keyword_filter(X.chunks(spark, sf_dir), " The ").select("document_id", "ordinal"))


@query
def keyword_filter_stored(spark, sf_dir):
    """The same over stored chunks, whose lower-cased text the scan tests."""
    store = CorpusStore(spark, scratch_path(spark, "search"), buckets=8)
    rows = _stored_chunks(spark, sf_dir).drop("created_at", "updated_at").withColumn("workspace_id", F.lit("w"))
    store.upsert_chunks(rows.withColumn("document_id", F.col("document_id").cast("string")).withColumn("position", F.lit(0)), unique=True)
    found = search.keyword_filter(store.table("chunks", "w"), " The ")
    return longs(found.select(F.col("document_id").cast("bigint").alias("document_id"), "ordinal"))


@query
def keyword_like(spark, sf_dir):
    return longs(search.keyword_like(X.chunks(spark, sf_dir), "A_e%The").select("document_id", "ordinal"))


@query
def page_filter(spark, sf_dir):
    chunks = C.page_chunks(X.pages(spark, sf_dir))
    hits = search.keyword_topk_many(chunks, X.queries(spark, sf_dir))
    shown = search.page_filter(search.with_chunk_text(hits, chunks, _hit_bound(spark, sf_dir)), 0)
    return longs(shown.select("query_id", "rank", "document_id", "ordinal", "source_page_index"))


@query
def valid_rows(spark, sf_dir):
    number = F.col("doc_id").cast("string")
    digest = F.md5(number)
    uuid = F.upper(F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    shape = F.col("doc_id") % 5
    identity = (
        F.when(shape == 0, F.sha2(number, 256)).when(shape == 1, uuid).when(shape == 2, number).when(shape == 3, F.sha2(number, 256))
    )
    kind = F.when(shape == 3, F.lit("epub")).otherwise(F.lit("markdown"))
    rows = X.table(spark, sf_dir, "documents").select("doc_id", identity.alias("document_id"), kind.alias("source_type"))
    good = audit.valid_rows(rows, ["document_id"], "source_type").withColumn("reject_reason", F.lit(None).cast("string"))
    return good.unionByName(audit.invalid_rows(rows, ["document_id"], "source_type"))


@query
def rect_contains_(spark, sf_dir):
    points = X.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 1.0).alias("px"), F.col("value").alias("py"))
    inside = rect_contains(Rect.literal(10, 10, 40, 20), F.col("px"), F.col("py"))
    return points.select("event_id", F.coalesce(inside, F.lit(False)).alias("inside"))


# --- joins -------------------------------------------------------------------


@query
def chunk_section_asof(spark, sf_dir):
    return longs(S.chunk_section_asof(*X.outline_tables(spark, sf_dir)))


@query
def docs_with_sections(spark, sf_dir):
    joined = S.docs_with_sections(X.record_heads(spark, sf_dir), X.markdown_sections(spark, sf_dir))
    return longs(joined.select("document_id", F.col("source_path"), "level", "chunk_start_ordinal"))


def _hit_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked = X.queries(spark, sf_dir)
    keyword = search.keyword_topk_many(X.chunks(spark, sf_dir), asked)
    return keyword, search.vector_topk_many(X.vectors(spark, sf_dir), asked)


@query
def hybrid_fuse(spark, sf_dir):
    fused = search.hybrid_fuse(*_hit_lists(spark, sf_dir))
    return longs(fused.withColumn("score", F.round("score", 6)))


@query
def doc_latest_job(spark, sf_dir):
    latest = jobs.doc_latest_job(X.document_rows(spark, sf_dir), X.reparse_jobs(spark, sf_dir))
    return latest.select("document_id", F.col("job.job_id").alias("job_id"), F.col("job.status").alias("status"))


@query
def active_job_semi(spark, sf_dir):
    """Documents by whether their newest job is still active."""
    docs = X.document_rows(spark, sf_dir)
    newest = jobs.doc_latest_job(docs, X.reparse_jobs(spark, sf_dir)).where(F.col("job").isNotNull()).select("document_id", "job.*")
    busy = jobs.active_job_semi(docs, newest).select("document_id", F.lit(True).alias("busy"))
    idle = jobs.active_job_semi(docs, newest, active=False).select("document_id", F.lit(False).alias("busy"))
    return busy.unionByName(idle)


@query
def viewport_join(spark, sf_dir):
    return layout.viewport_join(X.rectangles(spark, sf_dir), X.viewports(spark, sf_dir)).select("viewport_id", "node_id")


# --- aggregations and re-parse -----------------------------------------------


@query
def import_summary(spark, sf_dir):
    chunks, sections = X.outline_tables(spark, sf_dir)
    low = C.low_pages(X.paged_pages(spark, sf_dir))
    return longs(C.import_summary(X.document_rows(spark, sf_dir), chunks, sections, low))


def _resolved(spark: SparkSession, sf_dir: str, records: DataFrame | None = None) -> DataFrame:
    records = X.record_heads(spark, sf_dir) if records is None else records
    return reparse.resolved_pages(records, X.still_low(spark, sf_dir))


@query
def resolved_pages(spark, sf_dir):
    found = _resolved(spark, sf_dir)
    return longs(found.select("document_id", "source_type", _json("low_quality_pages", "requested"), _json("resolved_pages", "resolved")))


def _applied(spark: SparkSession, sf_dir: str, records: DataFrame) -> DataFrame:
    ran = _resolved(spark, sf_dir, records).where(F.size("low_quality_pages") > 0)
    return reparse.reparse_apply(records, ran, F.timestamp_seconds(F.lit(X.EPOCH + 10**8)))


@query
def reparse_apply(spark, sf_dir):
    return longs(_applied(spark, sf_dir, X.record_heads(spark, sf_dir)).select(
        "document_id", "title", _json("low_quality_pages", "low_pages"), F.unix_seconds("imported_at").alias("imported")
    ))


def _comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = X.record_heads(spark, sf_dir)
    before = records.select("document_id", F.col("low_quality_pages").alias("page_indices"))
    return reparse.reparse_comparison(_applied(spark, sf_dir, records).join(before, "document_id"))


@query
def reparse_comparison(spark, sf_dir):
    compared = _comparison(spark, sf_dir)
    return longs(compared.select(
        "document_id", "before_count", "after_count", "resolved_count", F.round("resolved_ratio", 6).alias("resolved_ratio"),
        *[_json(name) for name in ("before_pages", "after_pages", "resolved_pages", "remaining_pages")],
    ))


@query
def reparse_scope(spark, sf_dir):
    return longs(reparse.reparse_scope(_comparison(spark, sf_dir)))


@query
def rate_percent(spark, sf_dir):
    compared = _comparison(spark, sf_dir)
    return longs(compared.select("document_id", P.rate_percent(F.col("resolved_ratio")).alias("rate")))


# --- windows -----------------------------------------------------------------


@query
def reciprocal_rank(spark, sf_dir):
    hits = search.keyword_topk_many(X.chunks(spark, sf_dir), X.queries(spark, sf_dir))
    return longs(hits.select("query_id", "document_id", "ordinal", F.round(search.reciprocal_rank(F.col("rank")), 6).alias("score")))


@query
def recency_index(spark, sf_dir):
    recent = S.recent_with_index(X.record_heads(spark, sf_dir))
    return longs(recent.select("document_id", "recency_index"))


@query
def section_index(spark, sf_dir):
    _, sections = X.outline_tables(spark, sf_dir)
    return longs(S.with_section_index(sections).select("document_id", "chunk_start_ordinal", "section_index"))


# --- top-k -------------------------------------------------------------------


@query
def keyword_topk(spark, sf_dir):
    return longs(search.keyword_topk_many(X.chunks(spark, sf_dir), X.queries(spark, sf_dir)))


@query
def keyword_topk_like(spark, sf_dir):
    return longs(search.keyword_topk_many(X.chunks(spark, sf_dir), X.queries(spark, sf_dir), mode="like"))


@query
def keyword_topk_sections(spark, sf_dir):
    """One keyword with the section of every hit."""
    pieces = X.pieces(spark, sf_dir)
    found = keyword_search_with_sections(C.chunks_of(pieces), C.sections_of(pieces), "The")
    return longs(found.select("document_id", "ordinal", F.md5("text").alias("text_md5"), "section_title", "section_level"))


@query
def vector_topk_stub(spark, sf_dir):
    return longs(search.first_chunks_many(X.chunks(spark, sf_dir), X.queries(spark, sf_dir)))


@query
def vector_topk(spark, sf_dir):
    return longs(search.vector_topk_many(X.vectors(spark, sf_dir), X.queries(spark, sf_dir)))


def _hit_bound(spark: SparkSession, sf_dir: str) -> int:
    """No more hits than queries times the largest k."""
    asked = X.queries(spark, sf_dir)
    return search.largest_k(asked) * asked.count()


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid_search(X.chunks(spark, sf_dir), X.vectors(spark, sf_dir), X.queries(spark, sf_dir))


@query
def hybrid_search(spark, sf_dir):
    return longs(_hybrid(spark, sf_dir).withColumn("score", F.round("score", 6)))


@query
def recent_documents(spark, sf_dir):
    recent = S.recent_documents(X.record_heads(spark, sf_dir))
    return recent.select("document_id", "title", F.unix_seconds("imported_at").alias("imported"))


@query
def sections_of_document(spark, sf_dir):
    return longs(S.sections_of_document(X.sections(spark, sf_dir), 7))


# --- sets and report columns -------------------------------------------------


@query
def distinct_pages(spark, sf_dir):
    doubled = F.concat(F.reverse("low_quality_pages"), F.col("low_quality_pages"))
    return X.record_heads(spark, sf_dir).select("document_id", F.to_json(P.distinct_pages(doubled)).alias("pages"))


@query
def pages_except(spark, sf_dir):
    both = X.record_heads(spark, sf_dir).join(X.still_low(spark, sf_dir), "document_id")
    gone = P.pages_except(F.col("low_quality_pages"), F.col("still_low"))
    return both.select("document_id", F.to_json(gone).alias("pages"))


@query
def result_view_(spark, sf_dir):
    hits = _hybrid(spark, sf_dir)
    bound = _hit_bound(spark, sf_dir)
    shown = result_view(search.with_chunk_text(hits, X.chunks(spark, sf_dir), bound))
    return longs(shown.select("query_id", "rank", "score_label", "page_label", "ordinal_label", F.md5("text").alias("text_md5")))


@query
def search_with_sections(spark, sf_dir):
    """The whole search: hybrid hits with text, labels and the section of each."""
    pieces = X.pieces(spark, sf_dir)
    found = search_many(C.chunks_of(pieces), C.sections_of(pieces), X.vectors(spark, sf_dir), X.queries(spark, sf_dir))
    columns = ["query_id", "rank", "document_id", "ordinal", "score_label", "ordinal_label", "section_title", "section_level"]
    return longs(found.select(*columns, F.md5("text").alias("text_md5")))


@query
def page_label_list(spark, sf_dir):
    return X.record_heads(spark, sf_dir).select("document_id", P.page_label_list(F.col("low_quality_pages")).alias("pages"))


@query
def quality_badge(spark, sf_dir):
    return X.record_heads(spark, sf_dir).select("document_id", R.quality_badge(F.col("title"), F.size("low_quality_pages")).alias("badge"))


@query
def job_message(spark, sf_dir):
    imported = X.records(spark, sf_dir).select(
        "document_id", R.import_message(F.col("chunk_count"), F.col("fallback_page_count")).alias("import_message")
    )
    applied = _comparison(spark, sf_dir).select(
        "document_id", R.reparse_message(F.size("resolved_pages"), F.size("remaining_pages")).alias("reparse_message")
    )
    return imported.join(applied, "document_id")


# --- jobs and streams --------------------------------------------------------


def _job_view(states: DataFrame) -> DataFrame:
    return states.withColumn("created", F.unix_seconds("created_at")).drop("created_at")


@query
def job_snapshot(spark, sf_dir):
    return _job_view(jobs.job_snapshot(X.job_events(spark, sf_dir)))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = X.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query
def job_snapshot_stream(spark, sf_dir):
    root = scratch_path(spark, "snapshot")
    stream_jobs.snapshot_stream(X.as_job_events(_event_stream(spark, sf_dir)), f"{root}/jobs", f"{root}/checkpoint").awaitTermination()
    return _job_view(stream_jobs.job_table(spark, f"{root}/jobs").read())


@query
def admit_reparse(spark, sf_dir):
    return jobs.admit_reparse(X.admission_log(spark, sf_dir))


@query
def admit_reparse_stream(spark, sf_dir):
    root = scratch_path(spark, "admit")
    stream_jobs.admit_stream(X.as_admission_log(_event_stream(spark, sf_dir)), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return stream_jobs.read_decisions(spark, f"{root}/out")


@query
def reparse_job(spark, sf_dir):
    """Two micro-batches of requests run against stored records; every job with its document's record."""
    root = scratch_path(spark, "reparse")
    store = CorpusStore(spark, f"{root}/store", buckets=2)
    records = X.record_heads(spark, sf_dir).select(
        F.col("document_id").cast("string").alias("document_id"), "source_path", "title", "source_type", F.lit(0).alias("chunk_count"),
        "low_quality_pages", "imported_at", F.lit("w").alias("workspace_id"), F.lit(0).alias("position"),
    )
    store.upsert_documents(records, spark.createDataFrame([], SECTIONS).withColumn("workspace_id", F.lit("w")))
    pages = X.repaired_pages(spark, sf_dir).withColumn("document_id", F.col("document_id").cast("string"))
    requests = X.reparse_requests(spark, sf_dir)
    for epoch in (0, 1):
        own = requests.where(F.col("seq") % 2 == epoch)
        reparse_step(store, "w", own, pages, f"{root}/jobs", epoch, F.timestamp_seconds(F.lit(X.EPOCH + 10**8 + epoch)))
    stored = store.table("documents", "w").select(
        "document_id", F.to_json("low_quality_pages").alias("low_pages"), F.unix_seconds("imported_at").alias("imported")
    )
    ran = reparse_jobs(store, f"{root}/jobs").read().join(stored, "document_id")
    return ran.select(
        "job_id", "document_id", "document_title", "source_path", _json("page_indices", "pages"), "status", "progress", "message",
        F.unix_seconds("created_at").alias("created"), "low_pages", "imported",
    )


@query
def job_comparison(spark, sf_dir):
    """Documents with their newest job: pages it was given against the pages that are low now."""
    compared = reparse.job_comparison(X.record_heads(spark, sf_dir), X.reparse_jobs(spark, sf_dir))
    return longs(compared.select(
        "document_id", "status", "progress", "message", "before_count", "after_count", "resolved_count",
        F.round("resolved_ratio", 6).alias("resolved_ratio"), *[_json(name) for name in ("before_pages", "after_pages", "resolved_pages")],
    ))


@query
def import_outcomes(spark, sf_dir):
    rows = corpus.corpus_rows(_files(spark, sf_dir))
    # No page table here: a paged file has no text.
    reason = F.coalesce("reject_reason", F.when(F.col("source_type") == "pdf", F.lit(C.NO_PAGE_TEXT)))
    rows = rows.withColumn("reject_reason", reason)
    good = rows.where(F.col("reject_reason").isNull()).select(
        "source_path", F.size(TX.pack_words(F.col("text"))).alias("chunk_count"), F.lit(0).alias("fallback_page_count")
    )
    bad = rows.where(F.col("reject_reason").isNotNull()).select("source_path", "reject_reason")
    return jobs.import_outcomes(good, bad)


# --- layout ------------------------------------------------------------------


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.mindmap_nodes(X.record_heads(spark, sf_dir), X.markdown_sections(spark, sf_dir))


@query
def mindmap_nodes(spark, sf_dir):
    return _nodes(spark, sf_dir)


@query
def viewport_nodes(spark, sf_dir):
    return layout.viewport_nodes(_nodes(spark, sf_dir), 330, 400, 300, 5000)


@query
def nodes_out_of_bounds(spark, sf_dir):
    return layout.nodes_out_of_bounds(_nodes(spark, sf_dir)).select("node_id", "x", "y", "kept")


# --- heading tree ------------------------------------------------------------


@query
def skeleton_nodes(spark, sf_dir):
    return longs(outline.skeleton_nodes(X.markdown(spark, sf_dir)))


@query
def skeleton_parent(spark, sf_dir):
    return longs(X.skeleton(spark, sf_dir).select("document_id", "node_index", "level", "parent_index"))


@query
def skeleton_path(spark, sf_dir):
    return longs(X.skeleton(spark, sf_dir).select("document_id", "node_index", "node_id", "parent_id"))


@query
def skeleton_content(spark, sf_dir):
    return longs(outline.skeleton_content(X.markdown(spark, sf_dir), max_level=2).select("document_id", "node_index", "level", "content"))


@query
def skeleton_subchunks(spark, sf_dir):
    nodes = outline.skeleton_content(X.markdown(spark, sf_dir))
    return longs(outline.skeleton_subchunks(nodes))


@query
def refine_prompts(spark, sf_dir):
    nodes = X.skeleton(spark, sf_dir)
    return outline.refine_prompts(nodes)


@query
def refine_prompts_cut(spark, sf_dir):
    """Long content as several requests of at most 300 characters each."""
    return longs(outline.refine_prompts(X.skeleton(spark, sf_dir), limit=300))


@query
def attach_children(spark, sf_dir):
    nodes = X.skeleton(spark, sf_dir)
    attached = outline.attach_children(nodes, X.responses(nodes))
    return longs(attached.select("document_id", "node_id", "parent_id", "level", "topic", _json("details")))


@query
def rejected_responses(spark, sf_dir):
    return outline.rejected_responses(X.responses(X.skeleton(spark, sf_dir))).select("document_id", "node_id")


@query
def tree_markdown(spark, sf_dir):
    nodes = X.skeleton(spark, sf_dir)
    children = outline.attach_children(nodes, X.responses(nodes))
    return outline.tree_markdown(outline.tree_lines(nodes, children))
