import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirefold.llm import quality
from tests.llm.helpers import documents, odd_texts, prose


def brute(text):
    words = (text or "").encode().split()
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [line for line in (text or "").split("\n") if line.encode().split()]
    return (
        len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)), len(covered),
    )


def test_measures(spark):
    chosen = random.Random(4)
    texts = odd_texts()
    texts += [(100 + i, "".join(chosen.choice(["a", "b", "a b c d e ", "#", "\n", " ", "é", "\x0b", "\x1c"]) for _ in range(chosen.randint(0, 80)))) for i in range(200)]
    df = documents(spark, texts).select("doc_id", "text", quality.measures(F.coalesce("text", F.lit(""))).alias("m"))
    for row in df.collect():
        assert tuple(row["m"])[:5] == brute(row["text"]), row["doc_id"]
        assert row["m"]["n_lines"] == sum(1 for line in (row["text"] or "").split("\n") if line.encode().split())


def test_host_verdicts(spark):
    clean, junk, bad = prose(1, 60), " ".join(f"{w}###" for w in prose(2, 60).split()), "a b c"
    rows = [(i, clean, "http://User@Good.example/x?y") for i in range(200)]
    rows += [(1000 + i, clean if i < 2 else bad, "bad.example") for i in range(60)]
    rows += [(2000 + i, clean if i % 2 else junk, "ftp://mixed.example") for i in range(60)]
    rows += [(3000, bad, "tiny.example"), (3001, clean, None), (3002, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = {r["row"]["doc_id"]: (r["kept"], r["verdict"]) for r in quality.judge(df, ["doc_id"]).collect()}
    assert all(kept[i] == (True, "lenient") for i in range(200))
    assert all(not kept[1000 + i][0] and kept[1000 + i][1] == "rejected" for i in range(60))
    assert all(kept[2000 + i] == (bool(i % 2), "strict") for i in range(60))
    assert not kept[3000][0] and kept[3001][0] and not kept[3002][0]
    # One failure of one document is drawn towards the corpus, so its host isn't rejected.
    assert kept[3000][1] != "rejected"


def test_the_host_decides_on_soft_failures(spark):
    """The same borderline document stays at a lenient host and goes at a strict one, by production thresholds."""
    clean = prose(1, 60)
    lines = "\n".join([prose(n, 12) for n in range(8)] + ["so it is"] * 5)
    symbols = f"{prose(5, 50)} {'# ' * 9}"
    long_words = " ".join("x" * 14 + str(i) for i in range(40))
    soft = [lines, symbols, long_words]
    rows = [(i, clean if i >= 3 else soft[i], "good.example") for i in range(300)]
    rows += [(1000 + i, clean if i >= 90 else soft[i % 3], "poor.example") for i in range(300)]
    rows += [(2000 + i, "a b c", "bad.example") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {r["row"]["doc_id"]: r for r in quality.judge(df, ["doc_id"]).collect()}
    assert {found[i]["verdict"] for i in (0, 1000, 2000)} == {"lenient", "strict", "rejected"}
    assert all(found[i]["kept"] for i in range(300))
    assert all(found[1000 + i]["kept"] == (i >= 90) for i in range(300))
    assert [found[i]["lines_failed"] for i in range(3)] == [True, False, False]
    assert [found[i]["symbols_failed"] for i in range(3)] == [False, True, False]
    assert [found[i]["length_failed"] for i in range(3)] == [False, False, True]


def test_columns_and_empty_tables(spark):
    df = documents(spark, [(1, prose(3, 30)), (1, prose(3, 30)), (2, "short")], clashing=True)
    kept = quality.keep_documents(df)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [1, 1]
    assert quality.keep_documents(documents(spark, [])).count() == 0


@pytest.mark.parametrize("mean, variance", [(None, None), (0.0, 0.0), (1.0, 0.0), (0.2, 0.01), (0.5, 0.25)])
def test_prior_is_proper(mean, variance):
    alpha, beta = quality.strength(mean, variance)
    assert alpha > 0 and beta > 0


def test_no_python_in_the_plan(spark):
    plan = quality.judge(documents(spark, [(1, "a b")]), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
