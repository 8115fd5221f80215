"""The registered queries: each operator over its whole table, with the digests that are compared.

``ORACLE`` holds DuckDB SQL for the queries that SQL can state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import bpe, chat, filters, impacts, interpolation, jaccard, licenses, packing, pieces, quality, repeats, spelling, toxicity
from quirefold.llm.common import crc_fold, table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    REGISTRY[function.__name__] = function
    return function


def sha256(text) -> Column:
    return F.sha2(text.cast("binary"), 256)


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op6_bpe_rank_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_texts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op1_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    added = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(tricky).alias("text"),
    )
    messages = said.unionByName(added).withColumn("parts", chat.text_parts(F.col("text")))
    formatted = chat.format_chat(messages)
    turns = chat.read_chat(F.col("formatted"))
    loss = F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss_mask")), "")
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss")).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        sha256(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        sha256(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


ORACLE["op1_chat_parts"] = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))
    + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + 15 AS chars
  FROM said
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query
def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("row.doc_id", *quality.MEASURES, "base_failed", "kept")


ORACLE["op4_host_rules"] = r"""
WITH texts AS (
  SELECT doc_id, lower(coalesce(source, '')) AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM texts WHERE len(w) > 5
), grams AS (SELECT doc_id, i, w[i:i + 4] AS g FROM windows
), twice AS (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) > 1
), covered AS (
  SELECT doc_id, count(*) AS n FROM (
    SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS place FROM grams JOIN twice USING (doc_id, g)) GROUP BY doc_id
), measured AS (
  SELECT doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
  FROM texts LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 3 * n_words OR word_chars > 10 * n_words AS soft_failed,
    100 * n_symbols > 30 * n_words AS heavy FROM measured
), hosts AS (
  SELECT host, count(*) AS n, avg((base_failed OR soft_failed)::INT) AS f, avg(soft_failed::INT) AS s FROM judged GROUP BY host
), moments AS (
  SELECT least(greatest(avg(f), 1e-6), 1 - 1e-6) AS fm, var_pop(f) AS fv,
    least(greatest(avg(s), 1e-6), 1 - 1e-6) AS sm, var_pop(s) AS sv, (SELECT avg(soft_failed::INT) FROM judged) AS corpus_rate FROM hosts
), prior AS (
  SELECT *, CASE WHEN fv > 0 THEN least(greatest(fm * (1 - fm) / fv - 1, 1), 1e6) ELSE 1e6 END AS ft,
    CASE WHEN sv > 0 THEN least(greatest(sm * (1 - sm) / sv - 1, 1), 1e6) ELSE 1e6 END AS st FROM moments
), posteriors AS (
  SELECT host, (f * n + fm * ft) / (n + ft) AS failed_rate, (s * n + sm * st) / (n + st) AS soft_rate, n + st AS weight, corpus_rate FROM hosts, prior
), verdicts AS (
  SELECT host, failed_rate > 0.8 AS rejected, soft_rate - corpus_rate > 0.5 * sqrt(soft_rate * (1 - soft_rate) / (weight + 1)) AS strict FROM posteriors
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT rejected AND NOT heavy AND NOT (strict AND soft_failed) AS kept
FROM judged JOIN verdicts USING (host)
"""


@query
def op8_toxic_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc_fold("doc_id", 3) != 1)
    scored = toxicity.score_documents(documents, toxicity.train(documents, labels), ["doc_id"])
    return scored.select(
        "row.doc_id",
        (crc_fold("row.doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "offending",
    )


@query
def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc_fold("doc_id", 10)
    role = F.when(fold == 0, interpolation.TEST).when(fold == 1, interpolation.HELD).otherwise(interpolation.TRAIN)
    scored = interpolation.score_documents(table(spark, sf_dir, "documents"), role)
    return scored.select(
        "doc_id", (F.col("tag") == interpolation.TEST).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query
def op5_prefix_free_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["start"])
    return repeats.report(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256"
    )


@query
def op10_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=90)


@query
def op7_impact_ordered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return impacts.top_products(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


ORACLE["op7_impact_ordered_search"] = """
WITH coded AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM coded q JOIN coded c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op9_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents")).select(*licenses.first_license("doc_id"), "licenses")


@query
def op11_piece_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_texts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(table(spark, sf_dir, "documents"), drop_every=199)
    return spelling.group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


ORACLE["op12_spelling_variants"] = r"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents
), counted AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS said, run, count(*) AS n FROM runs WHERE length(run) > 5 GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(list_reduce(list_transform(range(strlen(said)), lambda i: ('0x' || substr(hex(encode(said)), 2 * i + 1, 2))::BIGINT),
    lambda h, b: xor(h >> 8, tab[(xor(h, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM counted, crc
), typed AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), words AS (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) > 5 GROUP BY word HAVING sum(n) >= 5
), cut AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, unnest(range(length(word))) u(i)
), pairs AS (
  SELECT x.word AS word, y.word AS near FROM cut x JOIN cut y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT x.word, w.word FROM cut x JOIN words w ON x.rest = w.word
  UNION SELECT w.word, x.word FROM cut x JOIN words w ON x.rest = w.word
), ranked AS (
  SELECT p.word, p.near, w.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near,
    row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.near) AS k FROM pairs p JOIN words w ON p.near = w.word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form,
    CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN ranked r ON w.word = r.word AND k = 1
), steps AS (
  WITH RECURSIVE chain(word, spot, next) AS (
    SELECT word, word, form FROM formed UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON c.next = f.word
  ) SELECT word, spot AS root FROM chain WHERE next IS NULL
)
SELECT f.word, n, n_near, form, form_n, root FROM formed f JOIN steps s ON f.word = s.word
"""


@query
def op13_survival_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE["op13_survival_words"] = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (SELECT t, min(doc_id) AS earliest FROM texts GROUP BY t
), failed AS (
  SELECT part, doc_id, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > earliest, false)::INT AS f
  FROM texts JOIN firsts USING (t)
), marks AS (SELECT doc_id, max((quality = 1)::INT) AS quality, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), counts AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS bad
  FROM failed LEFT JOIN marks USING (doc_id) GROUP BY part, f
), letters(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), steps AS (
  SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS gone FROM orders, range(1, 6) r(step)
), stepped AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (f & (gone | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (f & gone = 0 AND f & bit <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (f & gone <> 0 AND f & bit <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (f = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (f & gone = 0 AND f & bit <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(bad) FILTER (f & gone = 0 AND f & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM stepped
"""
