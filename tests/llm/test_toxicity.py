import random

import numpy as np

from quirefold.llm import toxicity
from tests.llm.helpers import documents, odd_texts

BAD = ["vileword", "nastyword", "uglyending", "uglyendings"]


def corpus(n, seed=1):
    """Documents of clean sentences; every fourth has one sentence with a bad word."""
    chosen = random.Random(seed)
    rows, places = [], {}
    for i in range(n):
        sentences = [" ".join(f"w{chosen.randint(0, 300)}" for _ in range(8)) for _ in range(chosen.randint(2, 12))]
        if i % 4 == 0:
            at = chosen.randrange(len(sentences))
            sentences[at] += " " + chosen.choice(BAD)
            places[i] = at
        rows.append((i, ". ".join(sentences) + "."))
    return rows, places


def test_held_out_documents(spark):
    rows, places = corpus(900)
    labels = spark.createDataFrame([(i, int(i in places)) for i, _ in rows if i % 3], "doc_id bigint, toxic int")
    df = documents(spark, rows)
    model = toxicity.train(df, labels)
    found = {r["row"]["doc_id"]: r for r in toxicity.score_documents(df, model, ["doc_id"]).collect()}
    held = [i for i, _ in rows if i % 3 == 0]
    assert all((found[i]["score"] >= 0.7) == (i in places) for i in held)
    texts = dict(rows)
    for i in held:
        if i in places:
            (told,) = found[i]["offending"]
            assert any(w in texts[i][told["start"] : told["start"] + told["length"]] for w in BAD)
    # Labels of held-out documents change nothing.
    assert toxicity.train(df, labels.unionByName(spark.createDataFrame([(10**6, 1)], "doc_id bigint, toxic int"))) == model


def test_noisy_or_is_the_product_over_sentences():
    scorer = toxicity.Scorer(toxicity.Model({"bad": 4.0, "good": -1.0}, -3.0))
    score, told = scorer.score("Bad good! fine? bad, bad\nnothing")
    p = 1 / (1 + np.exp(-(np.array([4 - 1, 0, 8, 0]) - 3.0)))
    assert np.isclose(score, 1 - np.prod(1 - p)) and [t["start"] for t in told] == [0, 15]


def test_odd_texts_and_missing_labels(spark):
    df = documents(spark, odd_texts(), clashing=True)
    empty = spark.createDataFrame([], "doc_id bigint, toxic int")
    one_kind = spark.createDataFrame([(1, 1), (4, 1), (4, None), (None, 1)], "doc_id bigint, toxic int")
    for labels in (empty, one_kind):
        model = toxicity.train(df, labels)
        rows = toxicity.score_documents(df, model, df.columns).select("row.*", "offending").collect()
        assert model.bias is None and len(rows) == len(odd_texts()) and all(r["offending"] == [] for r in rows)
    scored = toxicity.score_documents(df, toxicity.Model({"one": 9.0}, -4.0), ["doc_id"]).collect()
    assert {r["row"]["doc_id"]: r["score"] > 0.7 for r in scored if r["row"]["doc_id"] in (1, 2, 3, 4, 5)} == {1: False, 2: False, 3: False, 4: True, 5: True}
    assert toxicity.score_documents(documents(spark, []), toxicity.Model({}, None), ["doc_id"]).count() == 0


def test_the_sample_is_bounded(spark):
    rows, places = corpus(40)
    labels = spark.createDataFrame([(i, int(i in places)) for i, _ in rows], "doc_id bigint, toxic int")
    assert toxicity.sample_labels(labels, documents(spark, rows), "doc_id", 7).count() == 7
