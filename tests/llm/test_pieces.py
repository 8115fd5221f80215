import random

import numpy as np
import pytest

from quirefold.llm import pieces
from tests.llm.helpers import documents, odd_texts

public = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return pieces.Pieces(pieces.read_model(PATH))


def numbers(held):
    return np.frombuffer(held, "<i4").tolist()


def agree(codec, library, texts):
    for text, held in zip(texts, codec.encode_all(texts)):
        expected = library.encode(text)
        assert numbers(held) == expected, text[:80]
        assert codec.decode(expected) == library.decode(expected), text[:80]


def test_random_texts(codec, library):
    chosen = random.Random(4)
    letters = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x2581, 0x3000, 0x4E00, 0x4EBA, 0x7F8E, 0x1F600, 0x10FFFF]]
    bits = [*" \n\tabth", "the", "ing", "  ", "ation", "▁"]
    agree(codec, library, ["".join(chosen.choice([*bits, chosen.choice(letters)]) for _ in range(chosen.randint(0, 40))) for _ in range(4000)])


def test_long_words(codec, library):
    chosen = random.Random(5)
    long = ["".join(chosen.choice("etaoinshrdlu") for _ in range(n)) for n in (100, 400, pieces.LONG - 1, pieces.LONG, pieces.LONG + 1, 5000)]
    agree(codec, library, [*long, "x" * 5000, "ab" * 500, " " * 3000, "the" * 400, "\n" * 900, "人美" * 700, "\U0001f600" * 900, "a\0b \0", " \n \n"])


def test_rounds_and_heap_agree(codec, monkeypatch):
    chosen = random.Random(6)
    words = ["▁" + "".join(chosen.choice(["th", "e", "in", "o", "io", "n", "a", "t"]) for _ in range(chosen.randint(0, 60))) for _ in range(500)]
    by_rounds = codec.merge_words(words)
    monkeypatch.setattr(pieces, "LONG", 1)
    assert codec.merge_words(words) == by_rounds


def test_rounds_merge_many_at_once(codec, monkeypatch):
    """Occurrences in all words merge together: the rounds number far fewer than the merges."""
    rounds = []
    lookup = codec._rank
    monkeypatch.setattr(codec, "_rank", lambda *pair: rounds.append(len(pair[0])) or lookup(*pair))
    words = [f"▁{a}nation{b}able" for a in "abcdefgh" for b in ("al", "ing", "ed", "ist")]
    merged = sum(len(w) for w in words) - sum(len(i) // 4 for i in codec.merge_words(words))
    assert merged > 10 * len(rounds)


def test_decoding_any_ids(codec, library):
    chosen = random.Random(7)
    for _ in range(3000):
        ids = [chosen.choice([chosen.randrange(32000), chosen.randrange(3, 259), chosen.randrange(3)]) for _ in range(chosen.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids), ids
    assert codec.decode([99_999, -1, 264]) == library.decode([264])


def test_tables(spark, library):
    df = documents(spark, odd_texts(), clashing=True)
    rows = pieces.encode_texts(df, PATH).collect()
    expected = sorted(repr((i, library.encode(t or "", add_eos=True), library.decode(library.encode(t or "", add_eos=True)))) for i, t in odd_texts())
    assert sorted(repr((r["doc_id"], r["ids"], r["decoded"])) for r in rows) == expected
    assert pieces.encode_texts(documents(spark, []), PATH).count() == 0
    bare = pieces.encode_texts(documents(spark, [(1, "one two")]), PATH, end=False, decode=False).first()
    assert bare["ids"] == library.encode("one two") and bare["decoded"] is None


def test_decoding_tables(spark, library):
    df = spark.createDataFrame([(1, library.encode("The end")), (2, None), (3, [264, None])], "doc_id bigint, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in pieces.decode_ids(df, PATH).collect()} == {1: "The end", 2: "", 3: "a"}


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as file:
        model.ParseFromString(file.read())
    model.pieces[300].type = model.pieces[300].USER_DEFINED
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.read_model(str(tmp_path / "other.model"))
