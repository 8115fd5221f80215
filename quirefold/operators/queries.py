"""Query tables: read to the driver in slices of checked size.

A table of search queries is small next to the corpus, but its size is not taken on
trust: it is counted, cut into hash slices, and every slice is checked again. One
slice is one pass over the corpus; the passes are united, so a large query table
costs more passes, never a larger broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

MAX_SLICES = 1 << 20
MAX_BYTES = 32 << 20


def for_each_slice(
    queries: DataFrame,
    bound: int,
    run: Callable[[list[Row]], DataFrame],
    size: Column,
    max_bytes: int = MAX_BYTES,
    slices: int | None = None,
) -> DataFrame:
    """Union of ``run(rows)`` over slices of at most ``bound`` rows and ``max_bytes`` bytes.

    ``size`` gives the bytes of a row. A single row over ``max_bytes`` is a slice of its own.
    """
    if slices is None:
        total = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
        if total["n"] <= bound and total["bytes"] <= max_bytes:
            return run(queries.collect())
        slices = 2 * max(math.ceil(total["n"] / bound), math.ceil(total["bytes"] / max_bytes))
    elif slices > MAX_SLICES:
        raise ValueError("query_id must be unique in the query table")
    result = None
    for number in range(slices):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == number)
        total = part.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
        if total["n"] > 1 and (total["n"] > bound or total["bytes"] > max_bytes):
            # Uneven hashing: start again with finer slices.
            return for_each_slice(queries, bound, run, size, max_bytes, slices * 2)
        if total["n"]:
            passed = run(part.collect())
            result = passed if result is None else result.unionByName(passed)
    return run([]) if result is None else result
