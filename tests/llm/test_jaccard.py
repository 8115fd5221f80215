import random

import numpy as np
import pytest

from quirefold.llm import jaccard
from quirefold.llm.components import components
from tests.llm.helpers import documents, odd_texts


def sets_of(rows, size=3):
    result = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        result.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()})
    return result


def brute(rows, size=3, percent=90):
    sets = sets_of(rows, size)
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and common and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((key, len(s), least.get(find(i))) for i, ((key, _), s) in enumerate(zip(rows, sets))), key=repr)


def found(df, size=3, percent=90):
    return sorted((tuple(r) for r in jaccard.near_duplicates(df, size=size, percent=percent).collect()), key=repr)


def copies(seed, n):
    chosen = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    bases = [[chosen.choice(words) for _ in range(chosen.choice([1, 2, 3, 5, 12, 40, 100, 300]))] for _ in range(20)]
    rows = []
    for i in range(n):
        text = list(chosen.choice(bases))
        for _ in range(chosen.choice([0, 0, 1, 2, 3, len(text) // 50, len(text) // 30])):
            text[chosen.randrange(len(text))] = chosen.choice(words)
        rows.append((3 * i, " ".join(text)))
    return rows


def test_equals_brute_force(spark):
    rows = copies(1, 250) + [(5000, "A"), (5001, "a"), (5002, "a b"), (5003, "A\tb")]
    assert found(documents(spark, rows, clashing=True).repartition(3)) == brute(rows)


def test_five_words_and_a_lower_bound(spark):
    rows = copies(4, 200)
    assert found(documents(spark, rows), 5, 80) == brute(rows, 5, 80)


def test_large_clusters_are_searched_in_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("UNIT_BYTES", 4000)):
        monkeypatch.setattr(jaccard, name, value)
    rows = copies(2, 250)
    assert found(documents(spark, rows).repartition(3)) == brute(rows)


def test_odd_texts(spark):
    rows = [(i, t) for i, t in odd_texts() if i is not None]
    rows += [(None, odd_texts()[10][1] + " w1"), (None, "lonely words here")]
    assert found(documents(spark, rows)) == brute(rows)
    assert found(documents(spark, [])) == []


def test_one_of_each_component_stays(spark):
    text = " ".join(f"w{i}" for i in range(100))
    df = documents(spark, [(4, text), (2, text + " x"), (9, text), (7, "other words here"), (8, None), (None, text)], clashing=True)
    kept = jaccard.keep_one(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 7, 8] and kept.columns == df.columns


def test_rows_are_kept_by_id_and_text(spark):
    some = lambda word: " ".join(f"{word}{i}" for i in range(100))
    rows = [
        (1, some("a")), (5, some("a") + " x"), (5, some("b")),  # two texts under id 5, one of which links
        (None, some("a") + " y"), (None, some("c")),  # two null ids, one of which links with a named document
        (None, some("d")), (None, some("d") + " z"), (None, some("d")),  # null ids near each other
        (6, some("e")), (6, some("e")), (7, some("e") + " x"), (8, some("f")), (8, some("f") + " x"),  # repeated rows, near texts of one id
        (9, None), (9, ""), (None, None),
    ]
    df = documents(spark, rows, clashing=True).repartition(3)
    kept = [(r["doc_id"], (r["text"] or "")[:2]) for r in jaccard.keep_one(df).collect()]
    assert sorted(kept, key=repr) == sorted([(1, "a0"), (5, "b0"), (None, "c0"), (None, "d0"), (6, "e0"), (8, "f0"), (9, ""), (9, ""), (None, "")], key=repr)
    assert jaccard.keep_one(df).columns == df.columns


@pytest.mark.parametrize("bound", [1 << 21, 0])
def test_texts_stay_where_they_are_while_few_rows_are_dropped(spark, monkeypatch, bound):
    monkeypatch.setattr(jaccard, "BROADCAST_GONE", bound)
    some = lambda word: " ".join(f"{word}{i}" for i in range(100))
    df = documents(spark, [(1, some("a")), (2, some("a") + " x"), (3, some("b")), (4, some("c")), (4, some("c")), (5, None)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard.keep_one(df)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert ("SortMergeJoin" in plan) == (bound == 0) and ("BroadcastHashJoin" in plan) == (bound > 0)


@pytest.mark.parametrize("bits, fan", [(1 << 15, 32), (64, 2), (128, 3)])
def test_tree_search_finds_the_components(monkeypatch, bits, fan):
    monkeypatch.setattr(jaccard, "MAX_BITS", bits)
    monkeypatch.setattr(jaccard, "FAN", fan)
    chosen = random.Random(bits)
    base = [chosen.sample(range(2000), 80) for _ in range(8)]
    sets = []
    for _ in range(90):
        own = set(chosen.choice(base))
        for _ in range(chosen.randint(0, 6)):
            own.discard(chosen.choice(sorted(own)))
            own.add(chosen.randrange(2000))
        sets.append(own)
    sets.sort(key=len)
    label = jaccard.link([([np.array(sorted(s), np.uint64) for s in sets], np.array([len(s) for s in sets]))], 90)
    one = list(range(90))
    for i in range(90):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 100 * common >= 90 * (len(sets[i]) + len(sets[j]) - common):
                old, new = one[i], one[j]
                one = [new if x == old else x for x in one]
    assert len(set(zip(one, label.tolist()))) == len(set(one)) == len(set(label.tolist()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (100, 101)]
    found_ = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found_ == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
