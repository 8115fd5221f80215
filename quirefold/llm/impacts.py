"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors of whole numbers are dealt to shards by a hash. A shard's index has, for every
dimension, the vectors in the order of their quantised component; equal components form
a posting segment. For a query, a segment's impact is the most that a vector in it can
gain in that dimension over the dimension's least. Segments of all dimensions are
processed by descending impact, in phases. After a phase, the next segment's impact
bounds what any vector can still gain in each dimension that has not reached it. The
processing stops only when that bound proves that the vectors which could still be
among the first k are few; these are scored exactly from their components.

Queries are a stated set: they are packed in blocks and every block meets every shard
once, by an equality join on the shard number. A task holds one shard and one group of
blocks. Each pair gives at most k rows a query, which a window cuts to the first k.

Defined cases: a null or empty vector, a vector with a null or non-finite component and
a row without id take no part; only vectors of equal length meet; rows with a query's id are its own
and no candidates for it; of several query rows with one id the smallest vector is used;
repeated candidate rows count as often as they occur; products must fit 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quirefold.session import cut_lineage

SCALE = 256
SHARD = 8192
BLOCK = 256
GROUP = 64  # blocks that a task holds beside a shard
LEVELS = 16
PHASES = (0.5, 0.7, 0.8, 0.9, 1.0)  # of all postings, after which the proof is tried
FEW = 0.04
PROBED = 16


def whole_numbers(vector: str) -> Column:
    """floor(256 * x) of every component; null where the vector takes no part."""
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    sound = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when((F.size(values) > 0) & sound, F.transform(values, lambda x: F.floor(x * SCALE).cast("bigint")))


def _smallest(codes: np.ndarray) -> np.ndarray:
    for kind in ("<i2", "<i4"):
        if not codes.size or (codes.min() >= np.iinfo(kind).min and codes.max() <= np.iinfo(kind).max):
            return codes.astype(kind)
    return codes


def _codes(table: pa.Table, size: int) -> np.ndarray:
    return table["codes"].combine_chunks().flatten().to_numpy().reshape(-1, size)


INDEX = "size int, shard bigint, ids binary, copies binary, codes binary, kind string, order binary, edges binary, low bigint, step bigint"


def build_index(group: pa.Table) -> pa.Table:
    """One row: the shard's vectors, and their order and segment edges in every dimension."""
    group = group.sort_by("vec_id")
    size = group["size"][0].as_py()
    codes = _codes(group, size)
    low, high = int(codes.min()), int(codes.max())
    step = (high - low) // LEVELS + 1
    level = (codes - low) // step
    order = np.argsort(-level, axis=0, kind="stable").T.astype("<i4")
    # edges[d, l]: how many vectors have a level above l in dimension d
    edges = np.stack([np.append(0, np.cumsum(np.bincount(level[:, d], minlength=LEVELS)[::-1])) for d in range(size)]).astype("<i4")
    held = _smallest(codes)
    return pa.table(
        {
            "size": group["size"][:1],
            "shard": group["shard"][:1],
            "ids": pa.array([group["vec_id"].to_numpy().astype("<i8").tobytes()], pa.binary()),
            "copies": pa.array([group["copies"].to_numpy().astype("<i8").tobytes()], pa.binary()),
            "codes": pa.array([held.tobytes()], pa.binary()),
            "kind": pa.array([held.dtype.str]),
            "order": pa.array([order.tobytes()], pa.binary()),
            "edges": pa.array([edges.tobytes()], pa.binary()),
            "low": pa.array([low], pa.int64()),
            "step": pa.array([step], pa.int64()),
        }
    )


class Shard:
    """A shard's index as arrays, searched by one query after another."""

    def __init__(self, row: dict):
        size = row["size"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.copies = np.frombuffer(row["copies"], "<i8")
        self.codes = np.frombuffer(row["codes"], row["kind"]).reshape(-1, size).astype(np.int64)
        self.order = np.frombuffer(row["order"], "<i4").reshape(size, -1)
        self.edges = np.frombuffer(row["edges"], "<i4").reshape(size, LEVELS + 1)
        levels = np.arange(LEVELS - 1, -1, -1)  # in the order of the edges
        self.least = row["low"] + levels * row["step"]
        self.most = self.least + row["step"] - 1

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the first k, by score and then id; a row stands as often as it was given."""
        count, size = len(self.ids), len(query)
        one, two = query[:, None] * self.least, query[:, None] * self.most
        base = np.minimum(one, two).min(axis=1)
        impact = (np.maximum(one, two) - base[:, None]).ravel()
        lengths = np.diff(self.edges, axis=1).ravel()
        used = np.flatnonzero(lengths)
        used = used[np.argsort(-impact[used], kind="stable")]
        reached = np.cumsum(lengths[used])
        gained, seen = np.zeros(count), np.zeros(count, np.int64)
        open_ = self.ids != own
        done, bar, best = 0, None, np.empty(0, np.int64)
        for share in PHASES:
            upto = len(used) if share == 1.0 else int(np.searchsorted(reached, share * reached[-1], "right"))
            if upto > done:
                now = used[done:upto]
                dims, at = now // LEVELS, now % LEVELS
                docs = np.concatenate([self.order[d, a:b] for d, a, b in zip(dims.tolist(), self.edges[dims, at].tolist(), self.edges[dims, at + 1].tolist())])
                gained += np.bincount(docs, np.repeat(impact[now].astype(float), lengths[now]), count)
                seen += np.bincount(docs, minlength=count)
                done = upto
            left = float(impact[used[done]]) if done < len(used) else 0.0
            bound = np.where(open_, gained + left * (size - seen), -np.inf)
            probed = np.argpartition(-bound, min(PROBED, count - 1))[: max(PROBED, k)]
            best = np.union1d(best, probed[open_[probed]]).astype(np.int64)
            exact = np.sort(self.codes[best] @ query)[::-1]
            if len(exact) >= k:
                bar = exact[k - 1]
            # A score is what is gained over the least of every dimension.
            able = np.flatnonzero(bound + float(base.sum()) >= bar) if bar is not None else np.flatnonzero(open_)
            if len(able) <= max(PROBED, FEW * count) or done == len(used):
                break
        members = np.union1d(able, best).astype(np.int64)
        scores = self.codes[members] @ query
        order = np.lexsort((self.ids[members], -scores))[:k]
        times = np.minimum(self.copies[members[order]], k)
        return np.repeat(self.ids[members[order]], times)[:k], np.repeat(scores[order], times)[:k]


HITS = "query_id bigint, vec_id bigint, score bigint"


def _pack_queries(group: pa.Table) -> pa.Table:
    size = group["size"][0].as_py()
    held = _codes(group, size)
    return pa.table(
        {
            "size": group["size"][:1], "block": group["block"][:1],
            "ids": pa.array([group["vec_id"].to_numpy().astype("<i8").tobytes()], pa.binary()),
            "queries": pa.array([held.astype("<i8").tobytes()], pa.binary()),
        }
    )


def top_products(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The first ``k`` candidates of every query: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``."""

    def sound(df: DataFrame) -> DataFrame:
        coded = df.select(F.col(key).cast("bigint").alias("vec_id"), whole_numbers(vector).alias("codes"))
        return coded.where(F.col("codes").isNotNull() & F.col("vec_id").isNotNull()).withColumn("size", F.size("codes"))

    rows = cut_lineage(sound(vectors).groupBy("size", "vec_id", "codes").agg(F.count(F.lit(1)).alias("copies")))
    asked = cut_lineage(sound(queries).groupBy("size", "vec_id").agg(F.min("codes").alias("codes")))
    shards = math.ceil(rows.count() / SHARD) or 1
    blocks = math.ceil(asked.count() / BLOCK) or 1
    groups = math.ceil(blocks / GROUP)
    index = cut_lineage(
        rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(shards))).groupBy("size", "shard").applyInArrow(build_index, INDEX)
    )
    packed = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("size", "block")
    packed = packed.applyInArrow(_pack_queries, "size int, block bigint, ids binary, queries binary")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = packed.select("*", every(shards).alias("shard"), F.pmod("block", F.lit(groups)).alias("part"))
    right = index.select("*", every(groups).alias("part"))

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for row in held.to_pylist():
            shard = Shard(row)
            for block in asked.to_pylist():
                for own, query in zip(np.frombuffer(block["ids"], "<i8"), np.frombuffer(block["queries"], "<i8").reshape(-1, row["size"])):
                    ids, scores = shard.top(int(own), query, k)
                    found.append((np.full(len(ids), own), ids, scores))
        parts = [np.concatenate(c) if found else np.empty(0, np.int64) for c in (zip(*found) if found else ((), (), ()))]
        return pa.table({n: pa.array(p, pa.int64()) for n, p in zip(("query_id", "vec_id", "score"), parts)})

    keys = ("size", "shard", "part")
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
