import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirefold.llm import spelling
from tests.llm.helpers import documents, odd_texts


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts, ratio=5):
    """Rows (word, n, n_near, form, form_n, root) by comparing all words."""
    forms, rows = {}, {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
        rows[w] = [n, len(others), forms[w], counts.get(forms[w])]
    for w, row in rows.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        row.append(root)
    return {(w, *row) for w, row in rows.items()}


def vocabulary(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n bigint")


def some_words(seed, n, letters="abé", most=7):
    chosen = random.Random(seed)
    made = ("".join(chosen.choice(letters) for _ in range(chosen.randint(1, most))) for _ in range(n))
    return {w: chosen.choice([1, 2, 5, 9, 30, 200]) for w in made}


def as_rows(df):
    return {tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_are_those_of_all_pairs(spark, seed):
    counts = some_words(seed, 300)
    assert as_rows(spelling.group_variants(vocabulary(spark, counts))) == grouped(counts)


@pytest.mark.parametrize("cell, bucket_rows", [(2, 10), (7, 50), (10_000, 1)])
def test_cut_cells_find_the_same_pairs(spark, cell, bucket_rows):
    """Cells are cut down to single places; every pair still comes out once."""
    counts = some_words(3, 250, "ab", 8)
    rows = spelling.near_words(spelling.cell_tables(vocabulary(spark, counts), cell), cell, bucket_rows).collect()
    expected = sorted((a, b, counts[b]) for a in counts for b in counts if near(a, b))
    assert sorted(tuple(r) for r in rows) == expected


def test_a_hot_cell_is_cut(spark):
    """Half of all words share their first half: no task may get them all."""
    same = [f"preamble{a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"]
    counts = {w: 5 for w in [*same, *(f"{i * 7919:08d}" for i in range(500))]}
    tables = spelling.cell_tables(vocabulary(spark, counts), 100)
    rows = spelling.near_words(tables, 100, 400).collect()
    assert sorted((r["word"], r["near"]) for r in rows) == sorted((a, b) for a in counts for b in counts if near(a, b))
    assert len(tables) > 1 and max(r[1] for r in tables[-1].groupBy("cell").count().collect()) <= 100


def test_acceptor_is_minimal_and_accepts_its_words():
    acceptor = spelling.Acceptor()
    words = sorted({"cats", "cuts", "bats", "bits", "buts"})
    start = acceptor.start(words)
    assert sorted(acceptor.common(start, start)) == words
    assert acceptor.start(words) == start
    # The end, s, ts, and the states behind c, b and the start: the suffixes are shared.
    assert len(acceptor.states) == 6
    assert acceptor.start([]) is None


def test_very_long_words(spark):
    long = "ab" * 3000
    counts = {long: 100, long[:-1]: 5, long[:2000] + "x" + long[2001:]: 6, "y" + long: 7, long + "z": 8, long[1:]: 9}
    assert as_rows(spelling.group_variants(vocabulary(spark, counts))) == grouped(counts)


def test_chains_of_forms_end_at_the_root(spark):
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625}
    rows = {r["word"]: r for r in spelling.group_variants(vocabulary(spark, counts)).collect()}
    assert {r["root"] for r in rows.values()} == {"abbbbb"} and rows["aaaaaa"]["form"] == "aaaaab" and rows["abbbbb"]["form"] is None


def counted(rows, every):
    import re

    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 6
    return {w: n for w, n in counts.items() if n >= 5}


@pytest.mark.parametrize("every", [None, 3, 199])
def test_counted_words(spark, every):
    chosen = random.Random(8)
    words = ["garden", "Gärten", "garDEN", "ÉCLAIRS", "éclairs", "short", "letters2letters", "straße×÷ÿ", "x" * 3000]
    rows = [(i if i else None, " ".join(chosen.choice(words) for _ in range(30))) for i in range(200)] + odd_texts() * 5
    found = spelling.count_words(documents(spark, rows, clashing=True), drop_every=every)
    assert {r["word"]: r["n"] for r in found.collect()} == counted(rows, every)


def test_empty_tables(spark):
    assert spelling.count_words(documents(spark, [])).count() == 0
    assert spelling.count_words(documents(spark, [(1, None), (2, "")])).count() == 0
    assert spelling.group_variants(vocabulary(spark, {"x": 1}).where("false")).count() == 0
    clashing = vocabulary(spark, {"ab": 1, "abc": 9}).selectExpr("word", "n", "'x' AS near", "'x' AS cell", "'x' AS form", "1 AS m").union(
        spark.createDataFrame([(None, 3, "x", "x", "x", 1)], "word string, n bigint, near string, cell string, form string, m int")
    )
    assert as_rows(spelling.group_variants(clashing)) == grouped({"ab": 1, "abc": 9})


def test_frequent_words_are_added_up_before_the_shuffle(spark):
    plan = spelling.count_words(documents(spark, [(i, "garden " * 50) for i in range(20)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(word") < plan.rindex("partial_count") and "Python" not in plan
    assert spelling.count_words(documents(spark, [(1, "garden " * 50)])).select(F.sum("n")).first()[0] == 50
