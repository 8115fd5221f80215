import zlib

import numpy as np
import pytest

from quirefold.llm import packing
from tests.llm.helpers import documents, odd_texts, prose

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public.path("word_bpe_49k.json")


def check(rows, texts, capacity=packing.CAPACITY):
    """Every id in exactly one piece, sequences gapless and within capacity; returns the share of padding."""
    library = tokenizers.Tokenizer.from_file(PATH)
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in texts}
    by_document, by_sequence = {}, {}
    for r in rows:
        by_document.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_document) == set(ids)
    for key, pieces in by_document.items():
        own = ids[key]
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(own)
            assert r["ids_crc32"] == zlib.crc32(own[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(own)
    padded = used = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        used += at
        padded += 0 if at & (at - 1) == 0 else capacity - at
    return padded / max(used, 1)


def test_documents(spark):
    texts = [(i, prose(i, 20 + i * 37 % 900)) for i in range(300)]
    rows = packing.pack_documents(documents(spark, texts).repartition(3), PATH).collect()
    assert check(rows, texts) < 0.02
    assert len({r["sequence_id"] for r in rows}) < len(rows)


def test_odd_texts(spark):
    texts = [(i, t) for n, (i, t) in enumerate(odd_texts()) if i is not None and (i, t) not in odd_texts()[:n] and i < 8]
    rows = packing.pack_documents(documents(spark, texts, clashing=True), PATH).collect()
    check(rows, texts)
    assert packing.pack_documents(documents(spark, []), PATH).count() == 0
    twice = packing.pack_documents(documents(spark, [(1, "a b"), (1, "a b"), (None, None)]), PATH).collect()
    assert sum(r["length"] for r in twice if r["doc_id"] == 1) == 6
    assert [r["length"] for r in twice if r["doc_id"] is None] == [1]


@pytest.mark.parametrize("length", [1, 7, 8, 585, 1000, 2047, 2048, 2049, 4095, 4096, 4097, 100_001])
def test_cuts_cover_a_document(length):
    pieces = packing.cut_lengths(length)
    assert sum(pieces) == length and all(0 < p <= packing.CAPACITY for p in pieces)
    count = packing.class_sizes(packing.CAPACITY)
    for p in pieces:
        place = packing.CAPACITY // count[p]
        assert p * count[p] <= packing.CAPACITY and (place - p <= packing.SLACK * place or p < 8)


def test_open_bins_are_cut_at_powers_of_two():
    packer = packing.Packer(3, 4096)
    packer.add((1, 0, np.arange(1300, dtype="<u4"), 1300))
    packer.add((2, 0, np.arange(1260, dtype="<u4"), 1260))
    packer.finish()
    sizes = {}
    for row in packer.out:
        sizes[row[5]] = sizes.get(row[5], 0) + row[2]
    assert sorted(sizes.values()) == [512, 2048] and min(sizes) == 3 << 40
