"""Host-level quality rules with rates shrunk by an empirical beta prior.

Every text is measured inside its row. Rule failures are counted for each host, and
each host's failure rates are drawn towards the corpus by a beta prior whose two
parameters are fitted to all hosts' rates by moments, so that a host with few documents
is not judged by them alone. The host verdict goes back to the documents:

* ``rejected``: the shrunk rate of documents that fail any rule is above ``REJECT``; all
  documents of the host go;
* ``strict``: the host's posterior rate of soft failures is above the corpus rate by more than
  ``MARGIN`` posterior deviations; documents with any soft failure go;
* ``lenient``: else; only documents with heavy symbol use go.

Soft failures are symbols, duplicate lines and a mean word length out of range. A base rule failure (few
words, repeated windows) always rejects the document. A host on its own has the corpus rate and is lenient.

For a report, measures are written, so texts are measured once. To keep whole documents they
are measured twice instead, which spares a copy of all texts. Host counts combine before
the shuffle. Host verdicts are a written table and joined by plain equality:
Spark broadcasts it below its size threshold and splits skewed hosts above.

Defined cases: a null text has no words and fails; a null host is the host with the
empty name; repeated rows are judged each; an empty table gives an empty table; extra
columns go through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import WORD, let, text_of
from quirefold.session import cut_lineage

WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
SYMBOL_PERCENT = 10
HEAVY_PERCENT = 30
LINE_PERCENT = 30
WORD_LENGTH = (3, 10)
REJECT = 0.8
MARGIN = 0.5
MAX_STRENGTH = 1e6
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("base_failed", "symbols_failed", "lines_failed", "length_failed", "heavy")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the array.

    Windows are compared by a 64-bit hash. Only a text with a repeated window is sorted.
    """

    def covered(places: Column) -> Column:
        reach = F.transform(places, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(places, i + 1) - p, F.lit(window))))
        return F.aggregate(reach, F.lit(0).cast("bigint"), lambda total, n: total + n)

    def in_order(pairs: Column) -> Column:
        same = lambda a, i: F.coalesce(a["hash"] == F.get(pairs, i)["hash"], F.lit(False))
        twice = F.transform(pairs, lambda a, i: F.when(same(a, i - 1) | same(a, i + 1), a["at"]))
        return let(F.array_sort(F.filter(twice, lambda at: at.isNotNull())), covered)

    def repeats(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(let(pairs, in_order))

    starts = F.sequence(F.lit(1), F.size(words) - (window - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) <= window, F.lit(0).cast("bigint")).otherwise(let(hashes, repeats))


def line_counts(text: Column) -> Column:
    """Struct of the lines with a word, and of those that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.rlike(line, F.lit(WORD)))
    return let(
        lines,
        lambda kept: F.struct(
            F.size(kept).cast("bigint").alias("n"), (F.size(kept) - F.size(F.array_distinct(kept))).cast("bigint").alias("dup")
        ),
    )


def measures(text: Column) -> Column:
    """Struct of the measures of a text."""
    return let(
        F.struct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"), line_counts(text).alias("lines")),
        lambda parts: _measured(text, parts["words"], parts["lines"]),
    )


def _measured(text: Column, words: Column, lines: Column) -> Column:
    return F.struct(
        F.size(words).cast("bigint").alias("n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        lines["dup"].alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
        lines["n"].alias("n_lines"),
    )


def rules() -> list[Column]:
    """Columns ``RULES`` over the measures."""
    words, least, most = F.col("n_words"), *WORD_LENGTH
    symbols = 100 * F.col("n_symbols")
    conditions = (
        (words < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * words),
        symbols > SYMBOL_PERCENT * words,
        100 * F.col("n_dup_lines") > LINE_PERCENT * F.col("n_lines"),
        (F.col("word_chars") < least * words) | (F.col("word_chars") > most * words),
        symbols > HEAVY_PERCENT * words,
    )
    return [condition.alias(name) for name, condition in zip(RULES, conditions)]


def host_of(url: Column) -> Column:
    """Host of an address in lower case; a value that is no address is its own host."""
    named = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#]*)", 1)
    return F.lower(named)


def strength(mean: float | None, variance: float | None) -> tuple[float, float]:
    """Alpha and beta of the prior with this mean and variance of host rates."""
    mean = min(max(mean or 0.0, 1e-6), 1 - 1e-6)
    total = MAX_STRENGTH if not variance else min(max(mean * (1 - mean) / variance - 1, 1.0), MAX_STRENGTH)
    return mean * total, (1 - mean) * total


def host_verdicts(judged: DataFrame) -> DataFrame:
    """One row per host with its counts, shrunk rates and verdict."""
    hosts = cut_lineage(
        judged.groupBy("host").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("failed").cast("bigint")).alias("n_failed"),
            F.sum(F.col("soft_failed").cast("bigint")).alias("n_soft_failed"),
        )
    )
    counts = {"failed_rate": "n_failed", "soft_rate": "n_soft_failed"}
    # One row: mean and variance over all hosts, and the rate over all documents.
    moments = (f(F.col(count) / F.col("n")).alias(f"{f.__name__}_{name}") for name, count in counts.items() for f in (F.avg, F.var_pop))
    found = hosts.agg(*moments, (F.sum("n_soft_failed") / F.sum("n")).alias("corpus_rate")).first()
    for name, count in counts.items():
        alpha, beta = strength(found[f"avg_{name}"], found[f"var_pop_{name}"])
        hosts = hosts.withColumn(name, (F.col(count) + alpha) / (F.col("n") + alpha + beta))
    rate, weight = F.col("soft_rate"), F.col("n") + alpha + beta
    # Deviation of the posterior, a beta distribution.
    deviation = F.sqrt(rate * (1 - rate) / (weight + 1))
    above = rate - F.lit(found["corpus_rate"]) > MARGIN * deviation
    return hosts.withColumn("verdict", F.when(F.col("failed_rate") > REJECT, "rejected").when(above, "strict").otherwise("lenient"))


def judge(df: DataFrame, keep: list[str], host: str = "source", text: str = "text", written: bool = True) -> DataFrame:
    """Columns ``row`` (struct of ``keep``), the measures, ``base_failed``, ``verdict`` of the host, ``kept``.

    ``written`` writes the measures with ``keep`` to the shared folder; else they are made twice.
    """
    measured = df.select(
        F.struct(*keep).alias("row"), host_of(F.col(host)).alias("host"), measures(text_of(text)).alias("m")
    ).select("row", "host", "m.*")
    soft = F.col("symbols_failed") | F.col("lines_failed") | F.col("length_failed")
    judged = (cut_lineage(measured) if written else measured).select("*", *rules()).withColumn("soft_failed", soft)
    judged = judged.withColumn("failed", F.col("base_failed") | F.col("soft_failed"))
    verdicts = cut_lineage(host_verdicts(judged).select("host", "verdict"))
    strict = F.col("verdict") == "strict"
    kept = ~F.col("base_failed") & (F.col("verdict") != "rejected") & ~F.col("heavy") & ~(strict & F.col("soft_failed"))
    return judged.join(verdicts, "host").select("row", *MEASURES, *RULES, "verdict", kept.alias("kept"))


def keep_documents(df: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The rows that are kept, with their columns as they came."""
    return judge(df, df.columns, host, text, written=False).where("kept").select("row.*")
