"""Language-model scores by deleted interpolation of a bigram, a unigram and a uniform estimate.

A text is its words in lower case and an end token; the context of the first word is a
start mark. The probability of a token is a mixture of the maximum-likelihood estimates
c(context, token) / c(context) and c(token) / N and of 1 / (V + 1). Mixture weights depend
on the context's frequency, in buckets of powers of two, and are learned by expectation
maximisation on counts that were held out: one tenth of the training documents, against
estimates from the others. Final estimates use all training documents.

Counts cover every document. Texts are coded in chunks once; words and pairs are counted
inside a chunk, added up over all chunks by their hash (``pair_mask``), and sent back to each
chunk (see ``exchange``). Nothing that grows with the corpus goes through the driver:
it sees the weights, three numbers a bucket.

Defined cases: a null or empty text is the end token alone; without training documents
every count is 0, N and V are 0 and the uniform estimate is 1; repeated rows are counted
as often as they occur; null ids are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import row_slices
from quirefold.llm.exchange import Chunk, add_up, bucket_bits, code_chunks, drop_chunks, mix, pack, send_keys, totals_of, unpack, with_totals, write_chunks
from quirefold.session import cut_lineage

TEST, HELD, TRAIN = 0, 1, 2
START, STOP = np.uint64(1), np.uint64(2)
SMOOTHING = 0.1
ROUNDS = 12
CLOSE_ENOUGH = 1e-3
CHUNK_WORDS = 1 << 20
CONTEXTS = 48  # frequency buckets: 0 and powers of two


def tokens_of(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and context hash of every token of the chunk, and the document's place for each."""
    ends = chunk.ends + np.arange(1, len(chunk.ends) + 1)
    at_end = ends - 1
    token = np.empty(len(chunk.codes) + len(ends), np.uint64)
    words = np.ones(len(token), bool)
    words[at_end] = False
    token[words] = chunk.words[chunk.codes]
    token[at_end] = STOP
    context = np.roll(token, 1)
    context[ends - (chunk.lengths + 1)] = START
    return token, context, np.repeat(np.arange(len(ends)), chunk.lengths + 1)


def pair_mask(words: int) -> np.uint64:
    """The leading bits of a pair's hash that are kept.

    They grow with twice the logarithm of the corpus, so that at any size no more than some
    tens of all pairs are expected to share a key with another one; that spares a quarter of the shuffle.
    """
    bits = min(64, max(32, 2 * int(words).bit_length() - 6))
    return np.uint64((1 << 64) - (1 << (64 - bits)))


def _keys(chunk: Chunk, mask: np.uint64) -> tuple[np.ndarray, ...]:
    """Sorted unique keys of the chunk, the place of each token and each pair among them, the tokens' documents.

    Keys of tokens are even, those of pairs are odd.
    """
    token, context, document = tokens_of(chunk)
    pair = (mix(context, token) & mask) | np.uint64(1)
    single = mix(token) & ~np.uint64(1)
    keys, place = np.unique(np.concatenate([single, pair]), return_inverse=True)
    return keys, place[: len(token)], place[len(token) :], document


def _sent(chunk: Chunk, mask: np.uint64) -> tuple[np.ndarray, list[np.ndarray]]:
    """Counts in training documents, and in the held-out tenth of them."""
    keys, single, pair, document = _keys(chunk, mask)
    tag = chunk.tags[document]
    columns = []
    for chosen in (tag != TEST, tag == HELD):
        columns.append(np.bincount(single[chosen], minlength=len(keys)) + np.bincount(pair[chosen], minlength=len(keys)))
    return keys, columns


def _distinct_tokens(keys: np.ndarray, sums: list[np.ndarray]) -> int:
    """Distinct tokens of training documents in a bucket."""
    return int(((keys & np.uint64(1) == 0) & (sums[0] > 0)).sum())


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the power of two at or below its count."""
    return np.where(count > 0, np.frexp(count.astype(float))[1], 0).clip(0, CONTEXTS - 1)


def mixed(weights: np.ndarray, bucket: np.ndarray, estimates: np.ndarray) -> np.ndarray:
    """Each estimate's part of the probability; the sum over them is the probability."""
    return weights[bucket] * estimates


def estimates_of(pair: np.ndarray, context: np.ndarray, token: np.ndarray, total: int, words: int) -> np.ndarray:
    return np.stack(
        [pair / np.maximum(context, 1), token / max(total, 1), np.full(len(pair), 1.0 / (words + 1))], axis=1
    )


COUNTED = "distinct bigint, rows array<struct<doc_id:bigint,tag:bigint,n:bigint>>, single binary, pair binary, held_bucket binary, held_pair binary, held_single binary"


def _counted(chunks: DataFrame, mask: np.uint64, held_documents: int, documents: int) -> DataFrame:
    """Per chunk: training counts of each token and pair; of held-out tokens, bucket and the two retained estimates' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, 1):
            row = part.to_pylist()[0]
            chunk = Chunk(row)
            _, single, pair, document = _keys(chunk, mask)
            train, held = totals_of(row, 2)
            kept = train - held
            chosen = chunk.tags[document] == HELD
            context = np.roll(kept[single], 1)
            firsts = chunk.starts + np.arange(len(chunk.starts))
            context[firsts] = documents - held_documents
            ratio = kept[pair][chosen] / np.maximum(context[chosen], 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([sum(b["tally"] or 0 for b in row["blocks"] or [])], pa.int64()),
                    part.column("rows"),
                    *(
                        pa.array([pack(a)], pa.binary())
                        for a in (
                            train[single].astype("<i8"),
                            train[pair].astype("<i8"),
                            context_bucket(context[chosen]).astype("<i4"),
                            ratio.astype("<f4"),
                            kept[single][chosen].astype("<i8"),
                        )
                    ),
                ],
                names=["distinct", "rows", "single", "pair", "held_bucket", "held_pair", "held_single"],
            )

    return chunks.mapInArrow(run, COUNTED)


def learn_weights(counted: DataFrame, total: int, words: int) -> np.ndarray:
    """Mixture weights by bucket: expectation over all held-out tokens in Arrow tasks, maximisation here."""
    weights = np.full((CONTEXTS, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)  # an unseen context has no pair estimate
    events = counted.select("held_bucket", "held_pair", "held_single")
    before = -np.inf
    for _ in range(ROUNDS):
        at = weights.copy()

        def expect(batches: Iterator[pa.RecordBatch], at: np.ndarray = at) -> Iterator[pa.RecordBatch]:
            sums, gain = np.zeros((CONTEXTS, 3)), 0.0
            for part in row_slices(batches, 1):
                row = part.to_pylist()[0]
                bucket, ratio, single = (unpack(row[c], k)[0] for c, k in (("held_bucket", "<i4"), ("held_pair", "<f4"), ("held_single", "<i8")))
                estimates = np.stack([ratio.astype(float), single / max(total, 1), np.full(len(ratio), 1.0 / (words + 1))], axis=1)
                parts = mixed(at, bucket, estimates)
                probability = parts.sum(axis=1)
                gain += float(np.log(probability).sum())
                for i in range(3):
                    sums[:, i] += np.bincount(bucket, parts[:, i] / probability, CONTEXTS)
            yield pa.RecordBatch.from_pydict(
                {"bucket": pa.array(range(CONTEXTS), pa.int32()), **{f"w{i}": pa.array(sums[:, i]) for i in range(3)}, "gain": pa.array([gain] + [0.0] * (CONTEXTS - 1))}
            )

        sums = events.mapInArrow(expect, "bucket int, w0 double, w1 double, w2 double, gain double").groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("w0", "w1", "w2", "gain")))
        gain = 0.0
        for row in sums.collect():  # one row per bucket
            found = np.array([row["w0"], row["w1"], row["w2"]])
            gain += row["gain"]
            if found.sum() > 0:
                weights[row["bucket"]] = (found + 1e-3 * np.array([row["bucket"] > 0, 1, 1])) / (found + 1e-3 * np.array([row["bucket"] > 0, 1, 1])).sum()
        if gain == 0 or gain - before < CLOSE_ENOUGH * abs(gain):
            break
        before = gain
    return weights


SCORED = "doc_id bigint, tag bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score_documents(df: DataFrame, role: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: token counts, the unigram base score and the model's score.

    ``role`` is 0 for documents that the model must not learn from, 1 for those whose
    counts are held out to learn the weights, 2 for all others.
    """
    chunks = write_chunks(code_chunks(df, key, text, role, CHUNK_WORDS))
    size = chunks.agg(F.sum("n_words").alias("words")).first()["words"] or 0
    rows = chunks.select(F.explode("rows").alias("r")).select("r.*")
    seen = {r["tag"]: (r["docs"], r["words"]) for r in rows.groupBy("tag").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words")).collect()}
    documents, words = (sum(seen[t][i] for t in seen if t != TEST) for i in (0, 1))
    held_documents, held_words = seen.get(HELD, (0, 0))
    tokens, held_tokens = documents + words, held_documents + held_words
    mask = pair_mask(size)
    blocks = send_keys(chunks, lambda chunk: _sent(chunk, mask), bucket_bits(2 * size))
    totals = with_totals(chunks, add_up(blocks, 2, _distinct_tokens))
    counted = cut_lineage(_counted(totals, mask, held_documents, documents))
    drop_chunks(chunks)
    distinct = counted.agg(F.sum("distinct")).first()[0] or 0
    weights = learn_weights(counted, tokens - held_tokens, distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, 1):
            row = part.to_pylist()[0]
            single, pair = unpack(row["single"], "<i8")[0], unpack(row["pair"], "<i8")[0]
            lengths = np.array([r["n"] for r in row["rows"]], np.int64) + 1
            first = np.cumsum(lengths) - lengths
            context = np.roll(single, 1)
            context[first] = documents
            probability = mixed(weights, context_bucket(context), estimates_of(pair, context, single, tokens, distinct)).sum(axis=1)
            base = np.log10((single + SMOOTHING) / (tokens + SMOOTHING * (distinct + 1)))
            add = lambda values: np.add.reduceat(values, first)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([r["doc_id"] for r in row["rows"]], pa.int64()),
                    "tag": pa.array([r["tag"] for r in row["rows"]], pa.int64()),
                    "n_tokens": pa.array(lengths),
                    "n_known": pa.array(add((single > 0).astype(np.int64))),
                    "train_tokens": pa.array([tokens] * len(lengths), pa.int64()),
                    "base_score": pa.array(add(base)),
                    "score": pa.array(add(np.log10(probability))),
                }
            )

    return counted.select("rows", "single", "pair").mapInArrow(run, SCORED)

