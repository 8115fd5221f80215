"""Byte-level BPE encoding and decoding by a contiguous rank array.

A text is cut at strings of special tokens, then into pieces by the public pattern of
byte-level vocabularies. Inside a piece the merge state is two flat lists: the part
boundaries and the rank of every adjacent pair. The lowest rank is found by a scan,
its boundary is deleted, and the ranks of the two neighbours are refreshed. Pieces
over ``SHORT`` bytes reach the same merges through a heap over linked parts, because a
scan for every merge would be quadratic there.

Texts are independent of each other, so encoding is a map without a shuffle. A worker
remembers short words that it has encoded, a bounded number of them (``Memory``).

Defined cases: a null text is empty and gives no ids; ids outside the vocabulary decode
to nothing; bytes that are not UTF-8 decode to U+FFFD; repeated rows give repeated rows.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import Memory, row_slices, text_of

SHORT = 96
CACHED = 400_000

# The piece pattern of byte-level vocabularies and Unicode's white space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\t-\r \x85\xa0  -     　"

NEVER = 1 << 60


@lru_cache(maxsize=1)
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file.

    Printable bytes stand for themselves, all others for the code points from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """Merges and tokens of one vocabulary file of the byte-level kind."""

    def __init__(self, source: str):
        parsed = json.loads(source)
        letters = byte_letters()
        spelled = lambda token: bytes(letters[c] for c in token)
        self.ids = {spelled(token): i for token, i in parsed["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.first = [self.ids.get(bytes([b]), 0) for b in range(256)]
        self.ranks: dict[int, int] = {}  # by left id and right id
        self.made: list[int] = []  # by rank: the id of the merged part
        for rank, pair in enumerate(parsed["model"]["merges"]):
            left, right = map(spelled, pair.split(" ") if isinstance(pair, str) else pair)
            self.ranks[self.ids[left] << 32 | self.ids[right]] = rank
            self.made.append(self.ids[left + right])
        tokens = {i: token for token, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.bytes_of = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        longest_first = sorted(self.special, key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self._runs = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self._uneven = re.compile(f"[{WHITE}] |[{WHITE}]$")
        self._pieces = regex.compile(PIECES)
        self._words = Memory(CACHED)
        self._of_pieces = Memory(CACHED // 2)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of the parts of a piece when no adjacent pair can be merged any more."""
        if len(piece) > SHORT:
            return self._merge_long(piece)
        rank_of = self.ranks.get
        parts = [self.first[b] for b in piece]
        bounds = list(range(len(piece) + 1))
        ranks = [rank_of(a << 32 | b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks:
            lowest = min(ranks)
            if lowest == NEVER:
                break
            at = ranks.index(lowest)
            parts[at] = made = self.made[lowest]
            del bounds[at + 1], parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] << 32 | made, NEVER)
            if at < len(ranks):
                ranks[at] = rank_of(made << 32 | parts[at + 1], NEVER)
        return parts

    def _merge_long(self, piece: bytes) -> list[int]:
        n, rank_of = len(piece), self.ranks.get
        part = [self.first[b] for b in piece]  # by the start of a part
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # after 0: merged into an earlier part
        queue = []

        def offer(start: int) -> None:
            right = after[start]
            if right < n:
                rank = rank_of(part[start] << 32 | part[right])
                if rank is not None:
                    heapq.heappush(queue, (rank, start, right, after[right]))

        for start in range(n - 1):
            offer(start)
        while queue:
            rank, start, right, stop = heapq.heappop(queue)
            if after[start] != right or after[right] != stop:
                continue  # a part of the pair has changed meanwhile
            part[start] = self.made[rank]
            after[start], after[right] = stop, 0
            if stop < n:
                before[stop] = start
            offer(start)
            if before[start] >= 0:
                offer(before[start])
        parts, start = [], 0
        while start < n:
            parts.append(part[start])
            start = after[start]
        return parts

    def _encode_run(self, run: str) -> bytes:
        """Ids of white space with the text up to the next white space: no piece crosses its ends."""
        memory, found = self._of_pieces, []
        for piece in self._pieces.findall(run):
            ids = memory.young.get(piece) or memory.found(piece)
            if ids is None:
                ids = np.array(self.merge(piece.encode()), "<u4").tobytes()
                if len(piece) <= SHORT:
                    memory.put(piece, ids)
            found.append(ids)
        return b"".join(found)

    def _learn(self, word: str) -> bytes:
        """Ids of a space and the word after it."""
        ids = self._words.found(word)
        if ids is None:
            ids = self._encode_run(" " + word)
            if len(word) <= SHORT:
                self._words.put(word, ids)
        return ids

    def _encode_plain(self, text: str) -> bytes:
        if self._uneven.search(text):
            return b"".join(map(self._encode_run, self._runs.findall(text)))
        # Every space has text before it, so each one starts a run of its own.
        first, *words = text.split(" ")
        known, learn = self._words.young.get, self._learn
        return self._encode_run(first) + b"".join([known(w) or learn(w) for w in words])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self._special is None or not any(t in text for t in self.special):
            return self._encode_plain(text)
        parts = self._special.split(text)
        return b"".join(
            int(self.special[part]).to_bytes(4, "little") if i % 2 else self._encode_plain(part) for i, part in enumerate(parts)
        )

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4")
        if len(numbers) and numbers.max() >= len(self.bytes_of):
            numbers = numbers[numbers < len(self.bytes_of)]
        return b"".join(map(self.bytes_of.__getitem__, numbers.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec_of(source: str) -> Codec:
    return Codec(source)


def encode_texts(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", decode: bool = True) -> DataFrame:
    """Columns ``key``, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` (null unless asked for).

    ``vocabulary`` is the path of a byte-level vocabulary file on the driver. Its content
    is sent to the executors; it is as large as the vocabulary, whatever the input.
    """
    spark = df.sparkSession
    with open(vocabulary, encoding="utf-8") as file:
        sent = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(sent.value)
        for part in row_slices(batches):
            ids = [codec.encode(t) for t in part.column(1).to_pylist()]
            decoded = [codec.decode(i) for i in ids] if decode else [None] * len(ids)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=[key, "ids", "decoded"]
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), text_of(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, ids binary, decoded string")


def decode_ids(df: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Columns ``key`` and ``text``: the text of little-endian 32-bit ids; null ids give empty text."""
    with open(vocabulary, encoding="utf-8") as file:
        sent = df.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(sent.value)
        for part in row_slices(batches):
            texts: Iterable[str] = [codec.decode(i or b"") for i in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(ids).alias("_ids")).mapInArrow(run, f"`{key}` {kind}, text string")
