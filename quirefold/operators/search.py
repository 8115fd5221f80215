"""Keyword, vector and hybrid top-k search for one query or a table of queries.

Tables: ``chunks(document_id, ordinal, text, …)``, ``vectors(document_id, ordinal,
embedding)``, ``queries(query_id, keyword, embedding, k)``. Order is total: keyword
hits by ``ordinal, document_id``; scored hits by ``score desc, document_id, ordinal``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import trim_unicode
from quirefold.operators.blocks import top_k
from quirefold.operators.grams import gram_code, gram_counts, rarest_gram, with_grams
from quirefold.operators.queries import for_each_slice

# Default weights of the two hit lists, and the app's candidates per list.
KEYWORD_WEIGHT = 0.4
VECTOR_WEIGHT = 0.6
DEFAULT_LIMIT = 30

CHUNK_KEY = ["document_id", "ordinal"]
# Name of the stored lower-cased text of a chunk.
SEARCH_TEXT = "text_lc"
KEYWORD_ORDER = ["ordinal", "document_id"]

# Most keyword rows looked up in one pass, and most query vectors held by a task.
INLINE_KEYWORDS = 1 << 18
INLINE_VECTORS = 4096
# Hit lists up to this many rows are broadcast; longer ones are shuffled.
BROADCAST_HITS = 200_000

# Letters folded by the stored-table variant of the keyword test.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"

ASKED = "array<struct<query_id:bigint,k:int>>"


def normalize_keyword(keyword: Column) -> Column:
    return F.lower(trim_unicode(keyword))


def fold_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def like_pattern(keyword: Column) -> Column:
    """``%keyword%`` with ``%`` and ``_`` left as wildcards and backslash as itself."""
    return F.concat(F.lit("%"), F.replace(fold_ascii(keyword), F.lit("\\"), F.lit("\\\\")), F.lit("%"))


def _match(text: Column, keyword: Column, mode: str) -> Column:
    """Test of a normalized keyword against text prepared by ``_prepared``."""
    if mode != "like":
        return F.contains(text, keyword)
    # Without wildcards the pattern is a plain substring, which needs no regular expression.
    wild = F.contains(keyword, F.lit("%")) | F.contains(keyword, F.lit("_"))
    return F.when(wild, F.like(text, like_pattern(keyword))).otherwise(F.contains(text, fold_ascii(keyword)))


def _prepared(text: Column, mode: str) -> Column:
    return fold_ascii(text) if mode == "like" else F.lower(text)


def _search_text(chunks: DataFrame, mode: str = "contains") -> Column:
    """The text that keywords are looked up in: the stored one where a row has it."""
    folded = _prepared(F.col("text"), mode)
    return F.coalesce(SEARCH_TEXT, folded) if mode != "like" and SEARCH_TEXT in chunks.columns else folded


def keyword_filter(chunks: DataFrame, keyword: str) -> DataFrame:
    """Chunks whose lower-cased text holds the keyword; a blank keyword finds nothing.

    Over a table with the stored lower-cased text the test reaches the scan. Rows of files from
    before that column have null there; they pass the scan and are tested by their text.
    """
    wanted = normalize_keyword(F.lit(keyword))
    holds = F.contains(_search_text(chunks), wanted)
    if SEARCH_TEXT in chunks.columns:
        # Names the stored column only, and so can be pushed down.
        holds = (F.contains(F.col(SEARCH_TEXT), wanted) | F.col(SEARCH_TEXT).isNull()) & holds
    return chunks.where((wanted != "") & holds)


def keyword_like(chunks: DataFrame, keyword: str) -> DataFrame:
    """Wildcard variant: ``%`` and ``_`` in the keyword are wildcards, ASCII letters fold."""
    wanted = normalize_keyword(F.lit(keyword))
    return chunks.where((wanted != "") & _match(_prepared(F.col("text"), "like"), wanted, "like"))


def keyword_topk(chunks: DataFrame, keyword: str, limit: int = DEFAULT_LIMIT, mode: str = "contains") -> DataFrame:
    """First ``limit`` hits of one keyword, ordered by chunk ordinal."""
    hits = keyword_like(chunks, keyword) if mode == "like" else keyword_filter(chunks, keyword)
    return hits.orderBy(*KEYWORD_ORDER).limit(max(0, limit))


def _wildcard_matches(folded: DataFrame, terms: list[dict], mode: str) -> DataFrame:
    """Hits of keywords that hold wildcards only, tested inside each row."""
    listed = F.from_json(F.lit(json.dumps(terms)), f"array<struct<keyword:string,queries:{ASKED}>>")
    hits = F.filter(listed, lambda term: _match(F.col("_text"), term["keyword"], mode))
    return folded.select(*CHUNK_KEY, F.explode(F.flatten(F.transform(hits, lambda term: term["queries"]))).alias("_query"))


def keyword_matches(
    chunks: DataFrame, queries: DataFrame, mode: str = "contains", bound: int = INLINE_KEYWORDS
) -> DataFrame:
    """All (query, chunk) hits of a query table: ``(query_id, k, document_id, ordinal)``.

    Every keyword is looked up by one of its n-grams. The n-grams of a chunk meet the keywords'
    in a broadcast equi-join, and what meets is tested by the exact rule inside the same row,
    unless the n-gram is the keyword itself. So the text is read once for all keywords of a
    slice and never shuffled, and the work grows with the text and the candidates, not with
    chunks times keywords. Which n-gram stands for a keyword is a matter of speed only
    (``rarest_gram``). Keywords of wildcards alone are tested in a pass of their own.
    """
    keyword = normalize_keyword(F.col("keyword"))
    wanted = queries.select(
        F.col("query_id").cast("long"), keyword.alias("keyword"), F.col("k").cast("int"),
        (fold_ascii(keyword) if mode == "like" else keyword).alias("folded"),
    ).where(F.col("keyword") != "")
    folded = chunks.select(*CHUNK_KEY, _search_text(chunks, mode).alias("_text"))

    def run(rows) -> DataFrame:
        counts = gram_counts(folded, "_text") if rows else None
        asked: dict[str, tuple] = {}
        for row in rows:
            if row["keyword"] not in asked:
                gram = rarest_gram(literal_runs(row["folded"], mode), counts)
                asked[row["keyword"]] = (gram, gram is not None and gram.decode("utf-8", "replace") == row["folded"], [])
            asked[row["keyword"]][2].append({"query_id": row["query_id"], "k": row["k"]})
        terms = [(gram_code(gram), word, whole, members) for word, (gram, whole, members) in asked.items() if gram]
        known = F.broadcast(chunks.sparkSession.createDataFrame(terms, f"_gram int, keyword string, whole boolean, queries {ASKED}"))
        held = with_grams(folded, "_text", (gram for gram, _, _ in asked.values() if gram))
        met = held.select(*CHUNK_KEY, "_text", F.explode("_grams").alias("_gram")).join(known, "_gram")
        found = met.where(F.when(F.col("whole"), True).otherwise(_match(F.col("_text"), F.col("keyword"), mode)))
        hits = found.select(*CHUNK_KEY, F.explode("queries").alias("_query"))
        bare = [{"keyword": word, "queries": members} for word, (gram, _, members) in asked.items() if gram is None]
        if bare:
            hits = hits.unionByName(_wildcard_matches(folded, bare, mode))
        return hits.select("_query.query_id", "_query.k", *CHUNK_KEY)

    return for_each_slice(wanted, bound, run, 2 * F.octet_length("keyword"))


def literal_runs(keyword: str, mode: str) -> list[str]:
    """The parts of a keyword that a matching text must hold as they are."""
    return [run for run in re.split("[%_]", keyword) if run] if mode == "like" else [keyword]


def largest_k(queries: DataFrame) -> int:
    """The largest ``k`` of a query table: the constant that lets Spark cut before a shuffle."""
    return max(0, queries.agg(F.max("k")).first()[0] or 0)


def keyword_topk_many(
    chunks: DataFrame, queries: DataFrame, mode: str = "contains", bound: int = INLINE_KEYWORDS
) -> DataFrame:
    """Top-k of every keyword of a query table: ``(query_id, rank, document_id, ordinal)``."""
    ranked = top_k(
        keyword_matches(chunks, queries, mode, bound),
        ["query_id"],
        [F.col(name) for name in KEYWORD_ORDER],
        largest_k(queries),
        CHUNK_KEY,
        k=F.col("k"),
    )
    return ranked.select("query_id", "rank", *CHUNK_KEY)


def first_chunks(chunks: DataFrame, embedding: list[float], limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Placeholder vector search: first chunks by ordinal, none for an empty vector."""
    return chunks.orderBy(*KEYWORD_ORDER).limit(max(0, limit) if embedding else 0)


def first_chunks_many(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Placeholder vector search of a query table; an equi-join on the rank hands out the rows."""
    first = top_k(chunks.select(*CHUNK_KEY), [], [F.col(name) for name in KEYWORD_ORDER], largest_k(queries), CHUNK_KEY)
    asked = queries.where((F.size("embedding") > 0) & (F.col("k") > 0)).select(
        "query_id", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("rank")
    )
    return asked.join(first, "rank").select("query_id", "rank", *CHUNK_KEY)


def is_finite_vector(vector: Column) -> Column:
    """Whether a vector has components and all are finite numbers."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & sound, F.lit(False))


def rejected_vectors(vectors: DataFrame) -> DataFrame:
    """Rows whose vector cannot be compared: null, empty, or with a component that is no finite number."""
    return vectors.where(~is_finite_vector(F.col("embedding")))


def _best_of_batch(scores: np.ndarray, k: int) -> np.ndarray:
    """Mask of the ``k`` best rows per column; equal scores go to the earlier row."""
    if scores.shape[0] <= k:
        return np.ones(scores.shape, dtype=bool)
    cut = -np.partition(-scores, k - 1, axis=0)[k - 1]
    above = scores > cut
    tied = scores == cut
    return above | (tied & (np.cumsum(tied, axis=0) <= k - above.sum(axis=0)))


def _best_by_limit(scores: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """``_best_of_batch`` with a ``k`` of its own for every column."""
    mask = np.zeros(scores.shape, dtype=bool)
    for k in np.unique(limits[limits > 0]):
        same = limits == k
        mask[:, same] = _best_of_batch(scores[:, same], int(k))
    return mask


def vector_matches(vectors: DataFrame, queries: DataFrame, bound: int = INLINE_VECTORS) -> DataFrame:
    """Candidates for the top-k by cosine: ``(query_id, k, document_id, ordinal, score)``.

    Every Arrow batch of vectors is multiplied with the query vectors of a slice. A task
    keeps the best rows of each query over all its batches and gives them out once, so what
    leaves it is at most k rows per query, by the query's own k. Vectors of another length than the query's
    are not comparable and never match, nor do vectors with a component that is no
    finite number. Scores are rounded to 6 places, before ranking.
    """
    wanted = queries.where(is_finite_vector(F.col("embedding"))).select(
        F.col("query_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("k").cast("int")
    )
    keys = vectors.select(*CHUNK_KEY).schema
    schema = "query_id bigint, k int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys) + ", score double"
    narrow = vectors.where(is_finite_vector(F.col("embedding"))).select(*CHUNK_KEY, "embedding")

    def run(rows) -> DataFrame:
        groups: dict[int, list] = {}
        for row in rows:
            groups.setdefault(len(row["embedding"]), []).append(row)
        result = None
        for size, members in sorted(groups.items()) or [(0, [])]:
            part = narrow.where(F.size("embedding") == size).mapInArrow(_scorer(members, size), schema)
            result = part if result is None else result.unionByName(part)
        return result

    return for_each_slice(wanted, bound, run, F.size("embedding") * 8)


def _scorer(rows: list, size: int):
    ids = np.array([row["query_id"] for row in rows], dtype=np.int64)
    limits = np.array([row["k"] for row in rows], dtype=np.int32)
    wanted = int(np.maximum(limits, 0).sum())
    matrix = np.array([row["embedding"] for row in rows], dtype=np.float64).reshape(len(rows), size)
    lengths = np.linalg.norm(matrix, axis=1)
    matrix = matrix / np.where(lengths == 0, 1.0, lengths)[:, None]
    names = ["_query", *CHUNK_KEY, "score"]

    def best(hits: pa.Table) -> pa.Table:
        """The first rows of each query, as many as it asks for."""
        order = [("_query", "ascending"), ("score", "descending"), *((name, "ascending") for name in CHUNK_KEY)]
        ordered = hits.sort_by(order).combine_chunks()
        query = ordered["_query"].to_numpy()
        first = np.searchsorted(query, query)
        return ordered.filter(pa.array(np.arange(len(query)) - first < limits[query]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept = [], 0
        for batch in batches:
            if batch.num_rows == 0 or wanted == 0:
                continue
            table = pa.Table.from_batches([batch]).sort_by([(name, "ascending") for name in CHUNK_KEY]).combine_chunks()
            values = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            norms = np.linalg.norm(values, axis=1)
            unit = values / np.where(norms == 0, 1.0, norms)[:, None]
            keys = table.select(CHUNK_KEY)
            for start in range(0, len(ids), 128):
                scores = np.round(unit @ matrix[start : start + 128].T, 6)
                row_no, query_no = np.nonzero(_best_by_limit(scores, limits[start : start + 128]))
                hits = keys.take(pa.array(row_no))
                held.append(pa.table([start + query_no, *hits.columns, scores[row_no, query_no]], names=names))
                kept += len(row_no)
            if kept > 4 * wanted:
                held = [best(pa.concat_tables(held))]
                kept = len(held[0])
        if held:
            found = best(pa.concat_tables(held))
            query = found["_query"].to_numpy()
            columns = [ids[query], limits[query], *(found[name] for name in CHUNK_KEY), found["score"]]
            yield from pa.table(columns, names=["query_id", "k", *CHUNK_KEY, "score"]).combine_chunks().to_batches()

    return score


SCORE_ORDER = ("score", "document_id", "ordinal")


def _by_score() -> list[Column]:
    return [F.desc("score"), F.asc("document_id"), F.asc("ordinal")]


def vector_topk_many(vectors: DataFrame, queries: DataFrame, bound: int = INLINE_VECTORS) -> DataFrame:
    """Top-k by cosine for every query vector: ``(query_id, rank, document_id, ordinal, score)``."""
    ranked = top_k(
        vector_matches(vectors, queries, bound), ["query_id"], _by_score(), largest_k(queries), CHUNK_KEY, k=F.col("k")
    )
    return ranked.select("query_id", "rank", *CHUNK_KEY, "score")


def reciprocal_rank(rank: Column) -> Column:
    """1 for the first hit, 1/2 for the second, and so on."""
    return F.lit(1.0).cast("double") / rank


def hybrid_fuse(
    keyword_hits: DataFrame,
    vector_hits: DataFrame,
    keyword_weight: float = KEYWORD_WEIGHT,
    vector_weight: float = VECTOR_WEIGHT,
) -> DataFrame:
    """Weighted sum of reciprocal ranks over both hit lists; a missing side counts 0.

    Both lists go through one aggregation on (query, chunk), which is the full outer
    join with a single shuffle.
    """

    def weighted(hits: DataFrame, weight: float) -> DataFrame:
        score = F.lit(float(weight)) * reciprocal_rank(F.col("rank"))
        return hits.select("query_id", *CHUNK_KEY, score.alias("score"))

    both = weighted(keyword_hits, keyword_weight).unionByName(weighted(vector_hits, vector_weight))
    return both.groupBy("query_id", *CHUNK_KEY).agg(F.sum("score").alias("score"))


def hybrid_search(
    chunks: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    keyword_weight: float = KEYWORD_WEIGHT,
    vector_weight: float = VECTOR_WEIGHT,
    mode: str = "contains",
    vector_hits: DataFrame | None = None,
) -> DataFrame:
    """Both lists cut to k, fused, sorted by score and cut to k again, per query."""
    keyword_hits = keyword_topk_many(chunks, queries, mode)
    if vector_hits is None:
        vector_hits = vector_topk_many(vectors, queries)
    fused = hybrid_fuse(keyword_hits, vector_hits, keyword_weight, vector_weight)
    limits = queries.select(F.col("query_id").cast("long"), F.col("k").cast("int").alias("_k"))
    ranked = top_k(
        fused.join(limits, "query_id"), ["query_id"], _by_score(), largest_k(queries), CHUNK_KEY, k=F.col("_k")
    )
    return ranked.select("query_id", "rank", *CHUNK_KEY, "score")


def with_chunk_text(hits: DataFrame, chunks: DataFrame, hit_bound: int) -> DataFrame:
    """Add the chunk columns to hits; hits are broadcast while ``hit_bound`` rows are few.

    ``hit_bound`` is a proven bound such as queries times k.
    """
    few = F.broadcast(hits) if hit_bound <= BROADCAST_HITS else hits
    return chunks.join(few, CHUNK_KEY)


def page_filter(results: DataFrame, page: int | None) -> DataFrame:
    """Keep the results of one page; applied to a finished top-k, so fewer than k may stay."""
    return results if page is None else results.where(F.col("source_page_index") == page)
