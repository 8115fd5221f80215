import itertools
import random
import re

import numpy as np
import pytest

from quirefold.llm import filters
from tests.llm.helpers import documents, odd_texts, prose

LABELS = "doc_id bigint, quality int, toxic int"


def fails(text, doc_id, rows):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = set()
    if len(words) < 200:
        out.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
        out.add("C")
    if re.search(r"[#$%&*|]", text):
        out.add("D")
    if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows):
        out.add("E")
    return out


def audited(rows, labels):
    """The audit by running every order over the documents; ``rows`` are (id, text, part)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failed = [(i, part or "", fails(text or "", i, rows)) for i, text, part in rows]
    out = {}
    for part in {p for _, p, _ in failed}:
        total = dict.fromkeys(filters.FILTERS, 0)
        mine = [(i, f) for i, p, f in failed if p == part]
        for order in map("".join, itertools.permutations(filters.FILTERS)):
            alive = mine
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in alive if name in f]
                earlier = [f for _, f in mine if name in f and f & set(order[: step - 1])]
                alive = [(i, f) for i, f in alive if name not in f]
                total[name] += len(gone)
                out[part, order, step] = [
                    len(alive), len(gone), len(earlier), sum(f == {name} for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def as_dict(df):
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = df.collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in rows}) == len(rows)
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in columns] for r in rows}


def texts(seed, n):
    chosen = random.Random(seed)
    made = []
    for i in range(n):
        text = prose(chosen.randint(0, n // 2), chosen.choice([5, 150, 199, 200, 201, 400]), chosen.choice([40, 400]))
        text = chosen.choice([text, text.upper(), text + " #", text.title(), "", None]) if chosen.random() < 0.5 else text
        made.append((i if chosen.random() < 0.95 else None, text, chosen.choice(["en", "de", None, ""])))
    return made + chosen.sample(made, n // 5)


@pytest.mark.parametrize("seed, hot", [(1, 1024), (2, 4), (3, 2)])
def test_against_running_every_order(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(filters, "HOT", hot)
    rows = texts(seed, 120)
    chosen = random.Random(seed)
    labels = [(i, chosen.choice([0, 1, None]), chosen.choice([0, 1])) for i in range(0, 120, 2)] + [(4, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, lang string, part string, failed int")
    found = as_dict(filters.audit(df, spark.createDataFrame(labels, LABELS)))
    assert found == audited(rows, labels)


def test_odd_texts(spark):
    rows = [(i, t, "en") for i, t in odd_texts()]
    df = documents(spark, odd_texts(), clashing=True)
    assert as_dict(filters.audit(df, spark.createDataFrame([], LABELS))) == audited(rows, [])


def test_empty_table(spark):
    assert filters.audit(documents(spark, []), spark.createDataFrame([(1, 1, 1)], LABELS)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 31, 32, 1000, 4096])
def test_popcount_by_carry_save(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    expected = [int(((words >> np.uint32(i)) & 1).sum()) for i in range(32)]
    assert filters.positional_popcount(words).tolist() == expected


def test_full_words_do_not_overflow():
    assert filters.positional_popcount(np.full(1 << 20, 0xFFFFFFFF, np.uint32)).tolist() == [1 << 20] * 32


def test_survival_words():
    words = filters.survival_words().tolist()
    assert words[0] == 0xFFFFFFFF and words[31] == 1
    assert all((words[f] >> s & 1) == (f & s == 0) for f in range(32) for s in range(32))


def test_hot_texts_do_not_meet_in_one_task(spark):
    """A text in a third of all rows is sent to the rows, not the rows to it."""
    rows = [(i, "the same" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    measured = filters.measure(documents(spark, rows), spark.createDataFrame([], LABELS))
    plan = measured._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan
    assert {(r["failed"] >= filters.COPY, r["count"]) for r in measured.groupBy("failed").count().collect()} == {(True, 999), (False, 2001)}
