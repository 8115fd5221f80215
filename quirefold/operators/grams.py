"""Byte n-grams of texts, for looking up many keywords in one pass over the text.

An n-gram is a run of n bytes of UTF-8, n at most ``GRAM``. A text that holds a keyword holds every
n-gram of it, so one n-gram, looked up by an equi-join, gives all candidates; an exact test
follows. An n-gram is written as one number, its size above its bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 3
BITS = 8 * GRAM
# Texts, and letters of each, whose n-grams are counted to tell frequent ones from rare ones.
COUNTED_TEXTS = 500
COUNTED_LETTERS = 2000
# Rows whose text a task takes apart at a time.
ROWS = 1024


def gram_code(gram: bytes) -> int:
    return len(gram) << BITS | int.from_bytes(gram, "big")


def _grams_of(held: bytes, size: int) -> set[bytes]:
    return {held[i : i + size] for i in range(len(held) - size + 1)}


def gram_counts(texts: DataFrame, text: str) -> Counter:
    """In how many of the first texts an n-gram stands.

    A bounded look at the table. The counts only choose between n-grams of a keyword, all of
    which lead to the same hits.
    """
    seen: Counter = Counter()
    for row in texts.select(F.substring(text, 1, COUNTED_LETTERS).alias("t")).limit(COUNTED_TEXTS).collect():
        seen.update(_grams_of((row["t"] or "").encode(), GRAM))
    return seen


def rarest_gram(runs: Iterable[str], counts: Counter) -> bytes | None:
    """The n-gram of the runs that is looked up: of the largest size there is the rarest; None without a letter."""
    held = [run.encode() for run in runs if run]
    size = min(GRAM, max(map(len, held), default=0))
    grams = set().union(*(_grams_of(run, size) for run in held)) if size else ()
    return min(grams, key=lambda gram: (counts[gram], gram), default=None)


def with_grams(df: DataFrame, text: str, wanted: Iterable[bytes], out: str = "_grams") -> DataFrame:
    """Add ``out``: which of the wanted n-grams the text holds, each once, as an array of their numbers.

    One pass over the text in Arrow tasks; a null text holds none.
    """
    codes = np.array(sorted({gram_code(gram) for gram in wanted}), np.int64)
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for size in np.unique(codes >> BITS).tolist():
            known[size] = np.zeros(1 << 8 * size, bool)
            known[size][codes[codes >> BITS == size] & ((1 << BITS) - 1)] = True
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                found = _found(part.column(place).cast(pa.large_string()), known)
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, `{out}` array<int>")


def _found(texts: pa.Array, known: dict[int, np.ndarray]) -> pa.ListArray:
    """For each text the numbers of its known n-grams, ascending."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    ends = ends - ends[0]
    code, pairs = np.zeros(len(held), np.int32), []
    for size in range(1, max(known, default=0) + 1):
        # The code of the size before, a byte longer.
        code = (code[: max(0, len(held) - size + 1)] << 8) | held[size - 1 :]
        if size not in known:
            continue
        at = np.flatnonzero(known[size][code])
        row = np.searchsorted(ends, at, side="right") - 1
        inside = at + size <= ends[row + 1]
        pairs.append(row[inside].astype(np.int64) << 32 | size << BITS | code[at[inside]])
    found = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
    counts = np.bincount(found >> 32, minlength=len(texts))
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array((found & 0xFFFFFFFF).astype(np.int32))
    )
