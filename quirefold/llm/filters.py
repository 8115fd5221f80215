"""Interaction of filters by truth-table survival words.

A document that fails the filters F survives a set S of filters if S and F have nothing in
common. With five filters there are 32 sets; the document's survival word has bit S set if it
survives S. How many documents survive each set is the positional popcount of all words: for
each bit, how many words have it. It is taken for each part, and in each part for all
documents and for those of a label, by carry-save adders: sixteen words are added bit by
bit into planes of weight 1, 2, 4, 8 and 16 with a fixed number of logical operations, and only
the planes of weight 16 and the last remainders are unpacked to be counted. Counts of tasks
are added up by part.

These 32 counts answer every order of the filters. After the filters P the survivors are those
of P; a filter f behind them removes survivors(P) - survivors(P + f), and fails
survivors({}) - survivors({f}). So orders are made from counts, not from documents.

Measuring is row-local. A copy of an earlier text (``E``) is found from two 64-bit hashes
and the length of the text: the smallest id of each text that stands twice or more goes back
to the narrow rows. Texts that make up more than one in ``HOT`` rows number fewer than
``HOT``, so these are broadcast; the others are joined. No text moves.

Defined cases: a null text is empty; a null part is the empty string; a null id is no earlier one
and has none, and no label; repeated rows count each, and do not make each other copies; of
repeated labels one is enough; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import WORD, let, text_of
from quirefold.session import cut_lineage, release

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
COPY = 1 << FILTERS.index("E")
HOT = 1024
#: Words that a task holds before it adds them up.
HELD = 1 << 16

MIN_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3
SYMBOLS = r"[#$%&*|]"


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""

    def bits(words: Column) -> Column:
        failed = [
            F.size(words) < MIN_WORDS,
            100 * F.size(F.array_distinct(words)).cast("bigint") < DISTINCT_PERCENT * F.size(words).cast("bigint"),
            100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("bigint") > CAPITAL_PERCENT * F.length(text).cast("bigint"),
            F.rlike(text, F.lit(SYMBOLS)),
        ]
        return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed[1:], 1)), F.when(failed[0], 1).otherwise(0))

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), bits)


def measure(df: DataFrame, labels: DataFrame, part: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Narrow rows: ``part``, ``failed`` (bits of all five filters), ``good`` and ``toxic`` (by label)."""
    content = text_of(text)
    narrow = cut_lineage(
        df.select(
            F.col(key).cast("bigint").alias("id"),
            F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
            F.xxhash64(content).alias("h1"),
            F.xxhash64(F.lit(1), content).alias("h2"),
            F.length(content).alias("size"),
            failures(content).alias("failed"),
        )
    )
    sign = ["h1", "h2", "size"]
    grouped = narrow.groupBy(*sign).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    firsts = cut_lineage(grouped.where((F.col("n") > 1) & F.col("first").isNotNull()))
    share = narrow.count() / HOT
    # Fewer than HOT texts can have more than this share of the rows each.
    hot = F.broadcast(firsts.where(F.col("n") > share).select(*sign, F.col("first").alias("hot_first")))
    marked = narrow.join(hot, sign, "left")
    often, seldom = marked.where(F.col("hot_first").isNotNull()), marked.where(F.col("hot_first").isNull())
    cold = firsts.where(F.col("n") <= share).select(*sign, "first")
    both = often.withColumn("first", F.col("hot_first")).unionByName(seldom.join(cold, sign, "left"))
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    flagged = both.select("id", "part", "h1", (F.col("failed") + F.when(copy, COPY).otherwise(0)).alias("failed"))
    of_label = lambda name: F.max((F.coalesce(F.col(name), F.lit(0)) == 1).cast("int")).alias(name)
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(of_label("quality"), of_label("toxic"))
    has = lambda name: F.coalesce(F.col(name) == 1, F.lit(False))
    named = flagged.where(F.col("id").isNotNull()).join(known, "id", "left").select("part", "failed", has("quality").alias("good"), has("toxic").alias("toxic"))
    nameless = flagged.where(F.col("id").isNull()).select("part", "failed", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    found = named.unionByName(nameless)
    found._written = (narrow, firsts)
    return found


def survival_words() -> np.ndarray:
    """By failed filters: the word whose bit S is set where S has none of them."""
    sets = np.arange(SETS, dtype=np.uint32)
    alive = (sets[:, None] & sets[None, :]) == 0
    return (alive.astype(np.uint32) << sets[None, :]).sum(axis=1, dtype=np.uint32)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save addition of three planes: the plane of the sum and that of the carry."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _count(plane: np.ndarray) -> np.ndarray:
    """How many words of a plane have each bit."""
    bits = np.unpackbits(plane.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """For each of 32 bits the number of words that have it."""
    rows = len(words) // 16
    lanes = words[: rows * 16].reshape(16, rows)
    ones = twos = fours = eights = np.zeros(rows, np.uint32)
    total = _count(words[rows * 16 :])
    if not rows:
        return total
    carried = {2: [], 4: [], 8: []}
    for i in range(0, 16, 2):
        ones, carry = _add(ones, lanes[i], lanes[i + 1])
        carried[2].append(carry)
    for i in range(0, 8, 2):
        twos, carry = _add(twos, *carried[2][i : i + 2])
        carried[4].append(carry)
    for i in range(0, 4, 2):
        fours, carry = _add(fours, *carried[4][i : i + 2])
        carried[8].append(carry)
    eights, sixteens = _add(eights, *carried[8])
    return total + sum(weight * _count(plane) for weight, plane in ((1, ones), (2, twos), (4, fours), (8, eights), (16, sixteens)))


def survivors(measured: DataFrame) -> DataFrame:
    """Columns ``part``, ``label`` (all, good, toxic), ``survivors``: 32 counts by set of filters."""
    words = survival_words()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[np.ndarray]] = {}
        totals: dict[tuple[str, str], np.ndarray] = {}
        n_held = 0

        def add_up() -> None:
            for at, arrays in held.items():
                totals[at] = totals.get(at, 0) + positional_popcount(np.concatenate(arrays))
            held.clear()

        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            codes, parts = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            of_row = words[batch.column(1).to_numpy()]
            label = {"all": np.ones(len(codes), bool), "good": batch.column(2).to_numpy(False), "toxic": batch.column(3).to_numpy(False)}
            order = np.argsort(codes, kind="stable")
            edges = np.searchsorted(codes[order], np.arange(len(parts) + 1))
            for i, name in enumerate(parts):
                rows = order[edges[i] : edges[i + 1]]
                for kind, chosen in label.items():
                    held.setdefault((name, kind), []).append(of_row[rows[chosen[rows]]])
            n_held += len(codes)
            if n_held >= HELD:
                add_up()
                n_held = 0
        add_up()
        if totals:
            names, kinds = zip(*totals)
            counts = [c.tolist() for c in totals.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(kinds, pa.string()), pa.array(counts, pa.list_(pa.int64()))], names=["part", "label", "counts"]
            )

    added = measured.select("part", "failed", "good", "toxic").mapInArrow(run, "part string, label string, counts array<bigint>")
    sums = [F.sum(F.col("counts")[i]).alias(f"s{i}") for i in range(SETS)]
    return added.groupBy("part", "label").agg(*sums).select("part", "label", F.array(*(f"s{i}" for i in range(SETS))).alias("survivors"))


def orders(df: DataFrame) -> DataFrame:
    """Rows of ``df`` for all orders of the filters: ``filter_order``, ``step``, ``before`` (set), ``bit`` of the step's filter."""
    listed = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            listed.append(F.struct(F.lit(order).alias("filter_order"), F.lit(step).alias("step"), F.lit(before).alias("before"), F.lit(bit).alias("bit")))
            before |= bit
    return df.select("*", F.explode(F.array(*listed)).alias("o")).select(*df.columns, "o.*")


def audit(df: DataFrame, labels: DataFrame, part: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per part, order of the filters and step, with what the step's filter does there."""
    measured = measure(df, labels, part, key, text)
    counts = cut_lineage(survivors(measured))
    release(*measured._written)
    of_label = lambda kind: F.first(F.when(F.col("label") == kind, F.col("survivors")), ignorenulls=True).alias(kind)
    parts = counts.groupBy("part").agg(of_label("all"), of_label("good"), of_label("toxic"))
    rows = orders(parts)
    after = F.col("before").bitwiseOR(F.col("bit"))
    of = lambda kind, index: F.coalesce(F.get(F.col(kind), index), F.lit(0))
    removed = of("all", F.col("before")) - of("all", after)
    fails = of("all", F.lit(0)) - of("all", F.col("bit"))
    stepped = rows.select(
        "part",
        "filter_order",
        "step",
        "bit",
        of("all", after).alias("kept"),
        removed.alias("removed"),
        (fails - removed).alias("redundant"),
        (of("all", F.lit(SETS - 1) - F.col("bit")) - of("all", F.lit(SETS - 1))).alias("unique_fails"),
        (of("good", F.col("before")) - of("good", after)).alias("good_lost"),
        (of("toxic", F.col("before")) - of("toxic", after)).alias("toxic_lost"),
    )
    shares = stepped.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return stepped.join(shares, ["part", "bit"]).drop("bit")
