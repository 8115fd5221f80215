"""Small tables for the operators' tests: plain, odd and empty ones."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns of the operators' results, as strangers in the input.
CLASHING = "row string, bytes string, id string, hash string, score string, kept string, tag string, chunk string, n string, host string"


def documents(spark, rows, clashing=False):
    """A documents table of (id, text) pairs."""
    full = [(i, t, "en", "src1", None if t is None else len(t)) for i, t in rows]
    if not clashing:
        return spark.createDataFrame(full, SCHEMA)
    return spark.createDataFrame([(*r, *["x"] * 10) for r in full], f"{SCHEMA}, {CLASHING}")


def odd_texts():
    """Nulls, empty and blank texts, ties, repeated rows, odd characters and one long text."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "no id"), (None, None),
        (6, "a b 　 c\x1cd"), (7, "\U0001f600 café é <|endoftext|> don't  stop"), (8, long), (9, long), (10, "x" * 5000),
    ]


def prose(seed, n, vocabulary=400):
    chosen = random.Random(seed)
    words = [f"word{i}" for i in range(vocabulary)]
    return " ".join(chosen.choice(words) for _ in range(n))
