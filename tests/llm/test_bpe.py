import hashlib
import random

import numpy as np
import pytest

from quirefold.llm import bpe
from tests.llm.helpers import documents, odd_texts

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Codec(file.read())


def test_random_texts(codec, library):
    chosen = random.Random(2)
    letters = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x1680, 0x3000, 0xFEFF, 0x1F600, 0x4E00, 0x10FFFF]]
    for _ in range(3000):
        text = "".join(chosen.choice([*" \nab1!\x1c", "'s", chosen.choice(letters)]) for _ in range(chosen.randint(0, 30)))
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert codec.decode(codec.encode(text)) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 500 + "!" * 300, "\n" * 500, "über" * 200, "<|endoftext|>" * 3, " <|endoftext|>x"])
def test_long_pieces_and_special_strings(codec, library, text):
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_both_ways_of_merging_agree(codec):
    chosen = random.Random(3)
    for _ in range(300):
        piece = bytes(chosen.choice(b"abcdefgh the") for _ in range(chosen.randint(1, bpe.SHORT)))
        assert codec.merge(piece) == codec._merge_long(piece)


def test_memory_stays_bounded(codec):
    from quirefold.llm.common import Memory

    memory = Memory(10)
    for i in range(100):
        memory.put(i, i)
        memory.young.get(0) or memory.found(0)
    assert len(memory.young) + len(memory.old) <= 20 and (memory.young.get(0) is not None or memory.found(0) is not None)


def test_tables(spark, library):
    df = documents(spark, odd_texts(), clashing=True)
    rows = bpe.encode_texts(df, PATH).collect()
    assert sorted(map(repr, (r["doc_id"] for r in rows))) == sorted(map(repr, (i for i, _ in odd_texts())))
    expected = sorted((repr(i), hashlib.sha256(np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest(), t or "") for i, t in odd_texts())
    assert sorted((repr(r["doc_id"]), hashlib.sha256(r["ids"]).hexdigest(), r["decoded"]) for r in rows) == expected
    assert bpe.encode_texts(documents(spark, []), PATH).count() == 0


def test_decoding_other_ids(spark):
    ids = np.array([50256, 40, 99_999_999], "<u4").tobytes()
    df = spark.createDataFrame([(1, ids), (2, None)], "doc_id bigint, ids binary")
    assert {r["doc_id"]: r["text"] for r in bpe.decode_ids(df, PATH).collect()} == {1: "<|endoftext|>I", 2: ""}
