"""Harmonic packing of token ids into sequences of a fixed capacity.

Class k holds pieces of about capacity / k ids, and a bin of class k is full with k
pieces. A document is cut so that its pieces fit their class: a piece stays whole if
it wastes at most ``SLACK`` of its place, else the longest class size below it is cut
off and the rest is classed again. Every worker keeps one open bin for each class and
closes it when the k-th piece arrives, so workers need nothing from each other and no
row is shuffled.

Bins still open at the end of a worker's input are cut at powers of two, which need no
padding: a bin with 2,560 ids becomes sequences of 2,048 and 512. Memory of a worker is
bounded by one open bin for each class; a class size is a distinct value of
floor(capacity / k), about 2 * sqrt(capacity) of them.

Defined cases: a null or empty text is the end id alone; repeated rows are packed as
often as they occur; a null doc_id is kept as null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import Memory, row_slices, text_of

CAPACITY = 4096
END_ID = 2
END = END_ID.to_bytes(4, "little")
SLACK = 1 / 128
CACHED = 600_000
LONGEST = 96
GROUP = 192
MARK = b"\x01"

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class WordIds:
    """Ids of whole texts by a tokenizer that drops white space, with a memory of words.

    White space separates pieces in this kind of vocabulary, so the ids of a text are
    those of its words one after another.
    """

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memory = Memory(CACHED)
        mark = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def encoded(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word. The library is given many words at a time with a mark between them that has one id."""
        groups = [words[i : i + GROUP] for i in range(0, len(words), GROUP)]
        if self.mark is None or any(MARK in w for w in words):
            found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
            return [np.array(e.ids, "<u4").tobytes() for e in found]
        between = b" " + MARK + b" "
        result = []
        for encoding in self.tokenizer.encode_batch_fast([between.join(g).decode() for g in groups], add_special_tokens=False):
            ids = np.array(encoding.ids, "<u4")
            cuts = [-1, *np.flatnonzero(ids == self.mark).tolist(), len(ids)]
            held = ids.tobytes()
            result += [held[4 * a + 4 : 4 * b] for a, b in zip(cuts, cuts[1:])]
        return result

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that the young memory does not have."""
        found = {w: self.memory.found(w) for w in words}
        new = [w for w, ids in found.items() if ids is None]
        for word, ids in zip(new, self.encoded(new)):
            found[word] = ids
            if len(word) <= LONGEST:
                self.memory.put(word, ids)
        return found

    def of(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.encode().split() for t in texts]
        known = self.memory.young.get
        values = [list(map(known, words)) for words in split]
        missing = [i for i, found in enumerate(values) if None in found]
        learned = self.learn(list({w for i in missing for w, v in zip(split[i], values[i]) if v is None}))
        for i in missing:
            values[i] = [learned[w] if v is None else v for w, v in zip(split[i], values[i])]
        return [np.frombuffer(b"".join(found) + END, "<u4") for found in values]


@lru_cache(maxsize=1)
def words_of(source: str) -> WordIds:
    return WordIds(source)


@lru_cache(maxsize=4)
def class_sizes(capacity: int) -> list[int]:
    """By length from 0 to the capacity: k of the class whose place is the smallest that holds it."""
    return [0, *(capacity // length for length in range(1, capacity + 1))]


def cut_lengths(length: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Lengths of the pieces of a document, each with its place in a class."""
    pieces = [capacity] * (length // capacity)
    rest = length % capacity
    count = class_sizes(capacity)
    while rest:
        place = capacity // count[rest]  # a bin of the class holds count[rest] pieces of this size
        if place - rest <= slack * place or rest < 8:
            pieces.append(rest)
            break
        whole = capacity // (count[rest] + 1)  # the next smaller place is filled exactly
        pieces.append(whole)
        rest -= whole
    return pieces


class Packer:
    """Open bins of one worker; ``out`` collects finished piece rows."""

    def __init__(self, worker: int, capacity: int):
        self.capacity, self.next_id = capacity, worker << 40
        self.open: dict[int, list[tuple]] = {}
        self.out: list[tuple] = []

    def add(self, piece: tuple) -> None:
        kind = class_sizes(self.capacity)[len(piece[2])]
        held = self.open.setdefault(kind, [])
        held.append(piece)
        if len(held) == kind:
            self.close(self.open.pop(kind))

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def finish(self) -> None:
        """Cut what is open at powers of two."""
        for _, pieces in sorted(self.open.items()):
            total = sum(len(p[2]) for p in pieces)
            left = list(reversed(pieces))
            for bit in range(self.capacity.bit_length(), -1, -1):
                room, held = total & (1 << bit), []
                while room:
                    doc_id, start, ids, tokens = left.pop()
                    held.append((doc_id, start, ids[:room], tokens))
                    if len(ids) > room:
                        left.append((doc_id, start + room, ids[room:], tokens))
                    room -= min(room, len(ids))
                if held:
                    self.close(held)
        self.open = {}

    def taken(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        names = [field.split()[0] for field in PIECE.split(", ")]
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def pack_documents(
    df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, slack: float = SLACK
) -> DataFrame:
    """One row per piece: its document, place in the document, and place in a sequence.

    Sequence ids are unique: the number of the worker in the high bits. A piece's ids are
    those of its document from ``start`` on; ``ids_crc32`` lets a reader check them.
    """
    spark = df.sparkSession
    with open(vocabulary, encoding="utf-8") as file:
        sent = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = words_of(sent.value), Packer(TaskContext.get().partitionId(), capacity)
        for part in row_slices(batches):
            for doc_id, ids in zip(part.column(0).to_pylist(), words.of(part.column(1).to_pylist())):
                start = 0
                for length in cut_lengths(len(ids), capacity, slack):
                    packer.add((doc_id, start, ids[start : start + length], len(ids)))
                    start += length
            yield packer.taken()
        packer.finish()
        yield packer.taken()

    return df.select(F.col(key).cast("bigint"), text_of(text)).mapInArrow(run, PIECE)
