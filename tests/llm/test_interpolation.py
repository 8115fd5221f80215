import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quirefold.llm import exchange, interpolation
from tests.llm.helpers import documents, odd_texts, prose


def words_of(text):
    return [*(text or "").encode().lower().split(), b"</s>"]


def estimates(rows):
    """Unigram and pair counts and the number of documents."""
    single, pair = Counter(), Counter()
    for text in rows:
        tokens = words_of(text)
        single.update(tokens)
        pair.update(zip(["<s>", *tokens], tokens))
    return single, pair, len(rows)


def by_hand(rows, roles):
    """Plain expectation maximisation and scores over dictionaries."""
    train = estimates([t for (_, t), r in zip(rows, roles) if r != 0])
    kept = estimates([t for (_, t), r in zip(rows, roles) if r == 2])
    total, distinct, kept_total = sum(train[0].values()), len(train[0]), sum(kept[0].values())

    def parts(counts, n, before, token):
        context = counts[2] if before == "<s>" else counts[0][before]
        bucket = min(int(math.log2(context)) + 1, 47) if context else 0
        return bucket, np.array([counts[1][before, token] / max(context, 1), counts[0][token] / max(n, 1), 1 / (distinct + 1)])

    events = [parts(kept, kept_total, b, t) for (_, text), r in zip(rows, roles) if r == 1 for b, t in zip(["<s>", *words_of(text)], words_of(text))]
    weights = np.full((48, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)
    before = -np.inf
    for _ in range(interpolation.ROUNDS):
        sums, gain = np.zeros((48, 3)), 0.0
        for bucket, p in events:
            part = weights[bucket] * p
            gain += math.log(part.sum())
            sums[bucket] += part / part.sum()
        for b in range(48):
            if sums[b].sum() > 0:
                s = sums[b] + 1e-3 * np.array([b > 0, 1, 1])
                weights[b] = s / s.sum()
        if gain == 0 or gain - before < interpolation.CLOSE_ENOUGH * abs(gain):
            break
        before = gain
    result = {}
    for i, text in rows:
        tokens, score, base = words_of(text), 0.0, 0.0
        for b, t in zip(["<s>", *tokens], tokens):
            bucket, p = parts(train, total, b, t)
            score += math.log10((weights[bucket] * p).sum())
            base += math.log10((train[0][t] + 0.1) / (total + 0.1 * (distinct + 1)))
        result[i] = (len(tokens), sum(t in train[0] for t in tokens), total, base, score)
    return result


def test_equals_plain_estimates(spark):
    chosen = random.Random(5)
    rows = [(i, prose(i % 17, chosen.randint(0, 60), 40) + (" Rare%d" % i if i % 5 == 0 else "")) for i in range(120)]
    rows += [(500 + n, t) for n, (_, t) in enumerate(odd_texts()) if t is None or len(t) < 1000]
    df = documents(spark, rows, clashing=True).repartition(3)
    found = {r["doc_id"]: r for r in interpolation.score_documents(df, (F.col("doc_id") % 10).cast("int").isin(1).cast("int") + F.when(F.col("doc_id") % 10 > 1, 2).otherwise(0)).collect()}
    expected = by_hand(rows, [0 if i % 10 == 0 else 1 if i % 10 == 1 else 2 for i, _ in rows])
    for i, (n, known, total, base, score) in expected.items():
        r = found[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-3, abs_tol=1e-3)
    test = [i for i in expected if i % 10 == 0]
    assert sum(found[i]["score"] for i in test) > sum(found[i]["base_score"] for i in test)


def test_no_training_documents(spark):
    rows = interpolation.score_documents(documents(spark, [(1, "a b"), (None, None)]), F.lit(0)).collect()
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in rows} == {(1, 3, 0, 0), (None, 1, 0, 0)}
    assert all(math.isfinite(r["score"]) for r in rows)
    assert interpolation.score_documents(documents(spark, []), F.lit(2)).count() == 0


def test_blocks_lose_nothing():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 1000, np.uint64))
    assert (exchange.unpack_sorted(exchange.pack_sorted(keys)) == keys).all()
    assert len(exchange.unpack_sorted(exchange.pack_sorted(keys[:0]))) == 0


def test_chunks_are_cut_and_counted_alike(spark):
    rows = [(i, prose(i, 30, 20)) for i in range(50)]
    small = exchange.code_chunks(documents(spark, rows).coalesce(1), "doc_id", "text", F.lit(0), 100).collect()
    assert len(small) > 10 and sum(r["n_words"] for r in small) == 1500
    chunk = exchange.Chunk(small[0].asDict(recursive=True))
    assert len(chunk.codes) == chunk.lengths.sum()
