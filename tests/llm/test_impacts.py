import math
import random

import pytest

from quirefold.llm import impacts

VECTORS = "vec_id bigint, embedding array<float>, rank string, score string, size string, shard string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], VECTORS)


def brute(rows, asked, k):
    coded = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and i is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in coded:
        if i in asked:
            queries[i] = min(queries.get(i, v), v)
    result = []
    for q, v in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in coded if i != q and len(w) == len(v))
        result += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(result)


def found(vectors, k):
    return sorted(tuple(r) for r in impacts.top_products(vectors, vectors.where("vec_id % 50 = 0"), k).collect())


def single(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


@pytest.mark.parametrize("shard, block", [(8192, 256), (40, 3)])
def test_equals_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(impacts, "SHARD", shard)
    monkeypatch.setattr(impacts, "BLOCK", block)
    chosen = random.Random(shard)
    rows = [(i, [single(chosen.gauss(0, 0.2)) for _ in range(16)]) for i in range(500)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # many equal vectors: ties by id
    rows += [(2000 + i, [single(1e6 * (i + 1))] * 16) for i in range(3)]
    assert found(table(spark, rows).repartition(3), 5) == brute(rows, set(range(0, 3000, 50)), 5)


def test_defined_cases(spark):
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 3.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [1.0, None]),
        (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [9.0, 9.0]), (7, [9.0, 9.0, 9.0]), (8, [-1.0, 0.001]), (50, [1.0]), (100, None),
    ]
    assert found(table(spark, rows), 5) == brute(rows, {0, 50, 100}, 5)
    assert found(table(spark, []), 5) == []


def test_fewer_candidates_than_asked(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0])]
    assert found(table(spark, rows), 5) == [(0, 1, 1, 0)]
