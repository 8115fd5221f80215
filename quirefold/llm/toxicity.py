"""Toxicity by multiple-instance learning: sentences are the instances, documents the bags.

A sentence has the logit bias + sum of its words' weights; a document is toxic with the
noisy-or of its sentences, 1 - prod(1 - p). Only documents have labels; the weights of
words and word starts are fitted through the noisy-or, and the sentences with a high
probability are the places to look at.

The classifier is fitted on at most ``SAMPLE`` labelled rows, those with the smallest
hash of their id. That bound makes the label side small enough to broadcast, so texts
are not shuffled. Features of the sample are counted in Arrow tasks and combined by a
shuffle; the ``FEATURES`` most telling ones with a log likelihood ratio of ``MIN_GAIN`` or more are kept, so a fitted document is a few
numbers. Scoring is a map over all whole texts and needs the weights only.

Defined cases: a null or empty text has no sentence and the score 0; without labels of
both kinds every score is 0; a document labelled more than once counts as toxic if any
label is; repeated rows are scored each; null labels are not used.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import Memory, row_slices, text_of
from quirefold.session import cut_lineage, release

SAMPLE = 40_000
FEATURES = 8_192
MIN_GAIN = 10.0
STEPS = 300
RATE = 0.1
DECAY = 1e-4
CACHED = 300_000
TOLD = 0.5
PREFIXES = (4, 5)

_SENTENCE = re.compile(r"[^.!?\n]+")
_EDGES = re.compile(r"^[\W_\d]+|[\W_\d]+$")


def word_features(word: str) -> list[str]:
    """The word without marks at its ends, and its starts, which inflected forms share."""
    core = _EDGES.sub("", word).lower()
    return [core, *(f"{core[:n]}-" for n in PREFIXES if len(core) > n)] if core else []


@dataclass(frozen=True)
class Model:
    """Weights of features, and the bias of a sentence; None if there was nothing to learn from."""

    weights: dict[str, float]
    bias: float | None


def sample_labels(labels: DataFrame, documents: DataFrame, key: str, rows: int) -> DataFrame:
    """Text and label of at most ``rows`` labelled documents."""
    bags = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max("toxic").alias("toxic"))
    chosen = cut_lineage(bags.orderBy(F.xxhash64(key), key).limit(rows))
    return documents.join(F.broadcast(chosen), key)  # at most ``rows`` rows of two numbers


def choose_features(bags: DataFrame, limit: int) -> list[str]:
    """The features whose document counts tell most about the label, by likelihood ratio."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        memory = {}
        for part in row_slices(batches):
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found = set()
                for word in set(text.split()):
                    if word not in memory:
                        memory[word] = word_features(word)
                    found.update(memory[word])
                seen.update((f, toxic) for f in found)
            if len(seen) > CACHED:
                yield counted(seen)
                seen, memory = Counter(), {}
        yield counted(seen)

    def counted(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {
                "feature": pa.array([f for f, _ in seen], pa.string()),
                "toxic": pa.array([t for _, t in seen], pa.int32()),
                "n": pa.array(list(seen.values()), pa.int64()),
            }
        )

    counts = bags.select("_text", "_toxic").mapInArrow(count, "feature string, toxic int, n bigint")
    table = counts.groupBy("feature").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("good"),
    )
    totals = {row["_toxic"]: row["n"] for row in bags.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return []
    share = totals[1] / sum(totals.values())
    seen = F.col("bad") + F.col("good")
    log_ratio = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(F.lit(0.0))
    gain = log_ratio(F.col("bad"), seen * share) + log_ratio(F.col("good"), seen * (1 - share))
    best = table.withColumn("gain", gain).where(F.col("gain") >= MIN_GAIN).orderBy(F.desc("gain"), "feature").limit(limit)
    return [row["feature"] for row in best.select("feature").collect()]


def sentence_lists(bags: DataFrame, features: list[str]) -> tuple[np.ndarray, ...]:
    """Of the sample: label and featureless sentences by document; document by sentence; sentence and feature by entry."""
    index = {f: i for i, f in enumerate(features)}

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, list[int]] = {}
        for part in row_slices(batches):
            plain, held = [], []
            for text in part.column(0).to_pylist():
                n, lists = 0, []
                for sentence in _SENTENCE.findall(text):
                    words = sentence.split()
                    entries = []
                    for word in words:
                        known = memory.get(word)
                        if known is None:
                            known = memory[word] = [index[f] for f in word_features(word) if f in index]
                        entries += known
                    if entries:
                        lists.append(entries)
                    else:
                        n += bool(words)
                plain.append(n)
                held.append(lists)
            if len(memory) > CACHED:
                memory.clear()
            yield pa.RecordBatch.from_arrays(
                [part.column(1), pa.array(plain, pa.int64()), pa.array(held, pa.list_(pa.list_(pa.int32())))], names=["toxic", "plain", "held"]
            )

    rows = bags.select("_text", "_toxic").mapInArrow(look_up, "toxic int, plain bigint, held array<array<int>>").collect()
    sentences = [(d, s) for d, row in enumerate(rows) for s in row["held"]]
    return (
        np.array([row["toxic"] for row in rows], float),
        np.array([row["plain"] for row in rows], float),
        np.array([d for d, _ in sentences], np.int64),
        np.repeat(np.arange(len(sentences)), [len(s) for _, s in sentences]),
        np.array([i for _, s in sentences for i in s], np.int64),
    )


def fit(y: np.ndarray, plain: np.ndarray, bag: np.ndarray, sentence: np.ndarray, entry: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the noisy-or's log loss, by Adam over all bags."""
    theta = np.zeros(size + 1)
    theta[-1] = -6.0
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        logit = theta[-1] + np.bincount(sentence, theta[entry], len(bag))
        plain_p = 1 / (1 + np.exp(-theta[-1]))
        p = 1 / (1 + np.exp(-logit))
        # hazard: minus the log of the probability that no sentence is toxic
        hazard = np.bincount(bag, np.logaddexp(0, logit), len(y)) + plain * np.logaddexp(0, theta[-1])
        none = np.exp(-np.maximum(hazard, 1e-9))
        slope = np.where(y > 0, -none / (1 - none), 1.0) / len(y)
        by_sentence = slope[bag] * p
        gradient = np.append(np.bincount(entry, by_sentence[sentence], size), by_sentence.sum() + (slope * plain).sum() * plain_p)
        gradient[:-1] += DECAY * theta[:-1] / size
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        theta -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-12)
    return theta[:-1], float(theta[-1])


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """A model from ``labels`` (``key``, ``toxic``) and the texts of ``documents``."""
    narrow = documents.select(F.col(key).alias("_key"), text_of(text).alias("_text"))
    renamed = labels.select(F.col(key).alias("_key"), F.col("toxic").cast("int").alias("toxic"))
    bags = cut_lineage(sample_labels(renamed, narrow, "_key", sample).select("_text", (F.col("toxic") > 0).cast("int").alias("_toxic")))
    features = choose_features(bags, FEATURES)
    lists = sentence_lists(bags, features) if features else None
    release(bags)
    if lists is None:
        return Model({}, None)
    weights, bias = fit(*lists, len(features))
    return Model({f: float(w) for f, w in zip(features, weights) if w}, bias)


class Scorer:
    """Scores of texts; remembers words."""

    def __init__(self, model: Model):
        self.model, self.memory = model, Memory(CACHED)

    def learn(self, word: str) -> float:
        weight = self.memory.found(word)
        if weight is None:
            weight = self.memory.put(word, float(sum(self.model.weights.get(f, 0.0) for f in word_features(word))))
        return weight

    def score(self, text: str) -> tuple[float, list[dict]]:
        """The noisy-or, and the sentences that are likely toxic: start, length, probability."""
        if self.model.bias is None:
            return 0.0, []
        logits, spans, known = [], [], self.memory.young.get
        for found in _SENTENCE.finditer(text):
            words = found[0].split()
            if words:
                weights = [known(w) for w in words]
                if None in weights:
                    weights = [self.learn(w) if v is None else v for w, v in zip(words, weights)]
                logits.append(sum(weights))
                spans.append(found.span())
        z = self.model.bias + np.array(logits)
        hazard = np.logaddexp(0, z).sum()
        told = [{"start": spans[i][0], "length": spans[i][1] - spans[i][0], "score": float(1 / (1 + np.exp(-z[i])))} for i in np.flatnonzero(z >= np.log(TOLD / (1 - TOLD)))]
        return float(-np.expm1(-hazard)), told


SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())])


def score_documents(df: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``row`` (struct of ``keep``), ``score``, ``offending`` (array of start, length, score of sentences)."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for part in row_slices(batches):
            found = [scorer.score(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([told for _, told in found], pa.list_(SPAN))],
                names=["row", "score", "offending"],
            )

    rows = df.select(F.struct(*keep).alias("row"), text_of(text).alias("_text"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, score double, offending array<struct<start:bigint,length:bigint,score:double>>"
    return rows.mapInArrow(run, schema)
