import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quirefold.llm import repeats
from tests.llm.helpers import documents, odd_texts, prose


def brute(rows, width):
    """Kept bytes and spans by a set of all strings of ``width`` bytes, in the order of the rows."""
    seen, result = set(), []
    for text in rows:
        data = (text or "").encode()
        covered, own = bytearray(len(data)), []
        for p in range(len(data) - width + 1):
            part = data[p : p + width]
            if part in seen:
                covered[p : p + width] = b"\1" * width
            own.append(part)
            seen.add(part)
        kept = bytes(c for c, f in zip(data, covered) if not f)
        spans = sum(f and not (i and covered[i - 1]) for i, f in enumerate(covered))
        result.append((len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return result


def found(df, width):
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    rows = repeats.report(df, width=width).select("doc_id", "n_bytes", removed, F.size("spans"), "kept_sha256").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def repetitive(seed, n):
    chosen = random.Random(seed)
    some = lambda size, letters: "".join(chosen.choice(letters) for _ in range(size))
    bases = [some(chosen.randint(0, 400), letters) for letters in ("ab", "abcdefgh \n", "é漢a", "a") for _ in range(5)]
    texts = []
    for _ in range(n):
        text, kind = chosen.choice(bases), chosen.random()
        if 0.3 < kind < 0.6:
            for _ in range(chosen.randint(1, 3)):
                at = chosen.randint(0, len(text))
                text = text[:at] + chosen.choice("xyz") + text[at:]
        elif 0.6 < kind < 0.8:
            at = chosen.randint(0, len(text))
            text = some(chosen.randint(0, 120), "mnopq") + text[at:] + some(50, "uvw") + text[: at + 150]
        elif kind > 0.8:
            text = some(chosen.randint(0, 500), "ab")
        texts.append(text)
    return [*texts, "abc" * 300, "\0" * 350, "\0" * 360 + "z"]


@pytest.mark.parametrize("width, seed", [(100, 1), (40, 2)])
def test_equals_brute_force(spark, width, seed):
    texts = repetitive(seed, 120)
    rows = list(enumerate(texts))
    expected = sorted(((i, *r) for i, r in zip(range(len(texts)), brute(texts, width))), key=repr)
    assert found(documents(spark, rows, clashing=True).repartition(4), width) == expected


def test_small_batches_and_buckets(spark, monkeypatch):
    # Segments end inside documents, batches hold few of them, buckets are many.
    monkeypatch.setattr(repeats, "SEGMENT", 64)
    texts = repetitive(3, 40)
    data = [t.encode() for t in texts]
    batch = repeats.Batch([(i, 0, d) for i, d in enumerate(data)])
    place, first, last, hashed = repeats.triggers(batch.data, batch.ends)
    monkeypatch.setattr(repeats, "SEGMENT", 1 << 24)
    whole = repeats.triggers(batch.data, batch.ends)
    owned = lambda p, a, b: [x for x, low, high in zip(p, a, b) for _ in range(low, high + 1)]
    assert owned(place, first, last) == owned(*whole[:3])
    assert set(zip(place.tolist(), hashed.tolist())) == set(zip(whole[0].tolist(), whole[3].tolist()))


def test_defined_cases(spark):
    long = "".join(random.Random(6).choice("abcdefgh") for _ in range(300))
    rows = [(2, long), (2, long), (None, long[:150]), (3, long), (4, None), (5, ""), (6, long[:99])]
    # The null id is first; repeated rows of id 2 do not repeat each other.
    null_first = brute([long[:150], long, long, None, "", long[:99]], 100)
    expected = [(None, *null_first[0]), (2, *null_first[1]), (2, *null_first[1]), (3, *null_first[2]), (4, *null_first[3]), (5, *null_first[4]), (6, *null_first[5])]
    assert found(documents(spark, rows), 100) == sorted(expected, key=repr)
    assert found(documents(spark, []), 100) == []


def test_texts_are_cut(spark):
    long = "é" * 90 + "abcdefghij" * 3
    df = documents(spark, [(1, long), (2, "z" + long), (3, long), (4, None)], clashing=True)
    cut = {r["doc_id"]: r["text"] for r in repeats.remove_repeats(df).collect()}
    assert cut[2] == "z" and cut[3] == "" and cut[4] is None and repeats.remove_repeats(df).columns == df.columns
    # Strings of equal bytes overlap inside the first text too.
    assert cut[1] == long.encode()[: 100 + 0].decode("utf-8", "ignore")[: len(cut[1])] or cut[1].startswith("é")


def test_odd_texts(spark):
    rows = [(i, t) for i, t in odd_texts() if i is not None and i != 5]
    expected = sorted(((i, *r) for (i, _), r in zip(rows, brute([t for _, t in rows], 100))), key=repr)
    assert found(documents(spark, rows), 100) == expected


def test_copies_go_as_a_whole(spark):
    """Sizes whose bytes are above 127, zero and 255; other columns stay as they are."""
    texts = [prose(n, n, 5000)[:n] for n in (128, 150, 255, 256, 400, 40_000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10 + i, t) for i, t in enumerate(texts)] + [(None, "no id"), (30, None)]
    found = repeats.remove_repeats(documents(spark, rows, clashing=True))
    kept = {r["doc_id"]: (r["text"], r["row"], r["hash"]) for r in found.collect()}
    assert found.columns == documents(spark, rows, clashing=True).columns
    assert kept == {i: ("" if i is not None and 10 <= i < 20 else t, "x", "x") for i, t in rows}
