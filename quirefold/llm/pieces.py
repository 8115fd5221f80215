"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A model's text is its words joined by a mark for the space; no piece of a model with
``split_by_whitespace`` has the mark behind another letter, so words are independent. The
distinct words of a slice of rows become one flat numpy array of symbols. It is cut where two
letters stand side by side that do so in no piece. Each round takes the lowest rank of a
pair in every word (``minimum.reduceat``), merges its occurrences from the left, and looks up
only the ranks beside a merge. Words without a pair left are taken out, and the arrays are
compacted. This goes on until no pair remains.

Merging all occurrences in one round is right only if no merge makes a pair that comes before
the rest of them. That is known from the vocabulary: a rank is *late* if one of its pieces
begins or ends a piece of an equal or lower rank. Of a late rank only the first occurrence
in a word is merged in a round. Words over ``LONG`` symbols reach the same merges through a
heap over linked symbols, because their rounds could be as many as their symbols.

Texts are independent of each other, so encoding is a map without a shuffle. A worker
remembers words that it has encoded, a bounded number of them (``Memory``).

Defined cases: a null text is empty and has only the end id; symbols outside the vocabulary
become byte ids; repeated rows give repeated rows; an empty table gives an empty table; control
ids decode to nothing, unknown ones to the model's surface, ids outside the vocabulary to
nothing; bytes that are not UTF-8 decode to U+FFFD each.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import Memory, row_slices, text_of

LONG = 512
CACHED = 200_000
CACHED_CHARS = 48

NEVER = np.int64(1 << 40)
SPACE = "▁"  # fixed value: the mark of a space in pieces

# Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def read_model(path: str) -> dict:
    """Pieces, scores, kinds and settings of a model file; ValueError for a model of another kind."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    kinds = [p.type for p in model.pieces]
    trainer, normalizer = model.trainer_spec, model.normalizer_spec
    plain = not normalizer.precompiled_charsmap and not normalizer.remove_extra_whitespaces and not trainer.treat_whitespace_as_suffix
    if trainer.model_type != trainer.BPE or not trainer.byte_fallback or not plain or not normalizer.escape_whitespaces:
        raise ValueError("not a byte-fallback BPE model with identity normalisation")
    if set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("user-defined and unused pieces are not supported")
    return {
        "pieces": [p.piece for p in model.pieces],
        "scores": [p.score for p in model.pieces],
        "kinds": kinds,
        "end": trainer.eos_id,
        "unknown": trainer.unk_surface,
        "prefix": normalizer.add_dummy_prefix,
    }


def _each(error: UnicodeError):
    return "�" * (error.end - error.start), error.end


codecs.register_error("quirefold-each", _each)


class Pieces:
    """Merges and pieces of one model."""

    def __init__(self, model: dict):
        pieces, kinds = model["pieces"], model["kinds"]
        self.end, self.prefix = model["end"], model["prefix"]
        normal = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == NORMAL}
        self.byte = np.zeros(256, np.int32)
        for i, (p, kind) in enumerate(zip(pieces, kinds)):
            if kind == BYTE:
                self.byte[int(p[1:-1], 16)] = i
        # A letter is its piece, or minus its code point minus one where it is none.
        self.letter = -np.arange(0x110000, dtype=np.int32) - 1
        for p, i in normal.items():
            if len(p) == 1:
                self.letter[ord(p)] = i
        symbol = lambda p: normal.get(p, -ord(p) - 1 if len(p) == 1 else None)
        scores = np.array([model["scores"][i] for i in normal.values()])
        ranks = dict(zip(normal, np.unique(-scores, return_inverse=True)[1].tolist()))
        found, beside, late = {}, set(), set()
        for p, made in normal.items():
            beside.update(ord(a) << 21 | ord(b) for a, b in zip(p, p[1:]))
            for cut in range(1, len(p)):
                left, right = p[:cut], p[cut:]
                late.update(ranks[part] for part in (left, right) if len(part) > 1 and part in normal and ranks[p] <= ranks[part])
                if symbol(left) is not None and symbol(right) is not None:
                    found[symbol(left) << 32 | symbol(right) & 0xFFFFFFFF] = (ranks[p], made)
        self.found = found
        self.keys = np.array(sorted(found), np.int64)
        self.ranks = np.array([found[k][0] for k in self.keys.tolist()] + [NEVER], np.int64)
        self.made = np.array([found[k][1] for k in self.keys.tolist()] + [0], np.int32)
        self.late = np.zeros(len(normal) + 1, bool)
        self.late[list(late)] = True
        self.beside = np.array(sorted(beside), np.int64)
        inner = {c for p in normal if len(p) > 1 for c in p}
        self.by_words = not any(SPACE in p.lstrip(SPACE) for p in normal)
        self.by_lines = "\n" not in inner
        surfaces = {NORMAL: lambda p: p.replace(SPACE, " ").encode(), CONTROL: lambda p: b"", UNKNOWN: lambda p: model["unknown"].encode()}
        self.surface = [bytes([int(p[1:-1], 16)]) if k == BYTE else surfaces[k](p) for p, k in zip(pieces, kinds)]
        self.marked = [k == NORMAL and p.startswith(SPACE) for p, k in zip(pieces, kinds)]
        self.control = [k == CONTROL for k in kinds]
        self.controls = frozenset(i for i, c in enumerate(self.control) if c)
        self._plain = self.prefix and self.by_words
        self._words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self._memory = Memory(CACHED)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair; ``NEVER`` where the pair is no piece."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        at[self.keys[at] != keys] = len(self.keys)
        return self.ranks[at], self.made[at]

    def merge_words(self, words: list[str]) -> list[bytes]:
        """The ids of every word, as little-endian 32-bit integers."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out, stays = self.letter[points], np.ones(len(points), bool)
        first = np.zeros(len(points), bool)
        first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        pairs = points[:-1] << 21 | points[1:]
        at = np.minimum(np.searchsorted(self.beside, pairs), len(self.beside) - 1)
        first[1:] |= self.beside[at] != pairs
        starts = np.flatnonzero(first)
        sizes = np.diff(starts, append=len(points))
        for start, size in zip(starts[sizes > LONG].tolist(), sizes[sizes > LONG].tolist()):
            self._merge_long(out, stays, start, start + size)
        chosen = (sizes > 1) & (sizes <= LONG)
        places = np.flatnonzero(np.repeat(chosen, sizes))
        self._rounds(out, stays, places, np.repeat(np.arange(len(sizes)), sizes)[places])
        return self._in_words(out, stays, points, lengths)

    def _rounds(self, out: np.ndarray, stays: np.ndarray, places: np.ndarray, words: np.ndarray) -> None:
        """Merge in ``out``; ``places`` are the symbols' indexes and ``words`` their words' numbers, both ascending."""
        symbols = out[places]
        rank, made = self._rank(symbols, np.append(symbols[1:], 0))
        last = np.append(words[1:] != words[:-1], True)[: len(words)]
        rank[last] = NEVER
        while len(symbols):
            starts = np.flatnonzero(np.append(True, last[:-1]))
            sizes = np.diff(starts, append=len(symbols))
            lowest = np.minimum.reduceat(rank, starts)
            open_ = lowest < NEVER
            if not open_.all():
                keep = np.repeat(open_, sizes)
                out[places[~keep]] = symbols[~keep]
                symbols, places, words, rank, made, last = (a[keep] for a in (symbols, places, words, rank, made, last))
                lowest, sizes = lowest[open_], sizes[open_]
                if not len(symbols):
                    return
            hits = np.flatnonzero(rank == np.repeat(lowest, sizes))
            # Of hits in a row every second one counts, from the left; of a late rank the first in its word.
            new = np.append(True, np.diff(hits) > 1)
            order = np.arange(len(hits))
            hits_first = np.append(True, words[hits[1:]] != words[hits[:-1]])
            taken = hits[((order - np.maximum.accumulate(np.where(new, order, 0))) % 2 == 0) & (hits_first | ~self.late[rank[hits]])]
            symbols[taken] = made[taken]
            last[taken] = last[taken + 1]
            gone = np.zeros(len(symbols), bool)
            gone[taken + 1] = True
            stays[places[gone]] = False
            now = taken - np.arange(len(taken))  # indexes once the merged symbols are gone
            symbols, places, words, rank, made, last = (a[~gone] for a in (symbols, places, words, rank, made, last))
            beside = np.zeros(len(symbols), bool)
            beside[now] = beside[now[now > 0] - 1] = True
            changed = np.flatnonzero(beside)
            changed_last = last[changed]
            rank[changed[changed_last]] = NEVER
            changed = changed[~changed_last]
            rank[changed], made[changed] = self._rank(symbols[changed], symbols[changed + 1])

    def _merge_long(self, out: np.ndarray, stays: np.ndarray, begin: int, end: int) -> None:
        """The same merges in a long word: a heap by rank, then place, over linked symbols."""
        part = out[begin:end].tolist()
        n, found = len(part), self.found
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []

        def offer(left: int) -> None:
            right = after[left]
            if right < n:
                pair = found.get(part[left] << 32 | part[right] & 0xFFFFFFFF)
                if pair is not None:
                    heapq.heappush(queue, (pair[0], left, right, part[left], part[right], pair[1]))

        for left in range(n - 1):
            offer(left)
        while queue:
            _, left, right, was_left, was_right, made = heapq.heappop(queue)
            if after[left] != right or part[left] != was_left or part[right] != was_right:
                continue  # one of the pair has changed meanwhile
            part[left], after[left], after[right] = made, after[right], 0
            stays[begin + right] = False
            if after[left] < n:
                before[after[left]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        out[begin:end] = part

    def _in_words(self, out: np.ndarray, stays: np.ndarray, points: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The remaining symbols as ids, letters outside the vocabulary as byte ids, cut into words."""
        places = np.flatnonzero(stays)
        symbols = out[places]
        counts = np.ones(len(places), np.int64)
        strange = np.flatnonzero(symbols < 0)
        if len(strange):
            spelled = [chr(p).encode() for p in points[places[strange]].tolist()]
            counts[strange] = [len(s) for s in spelled]
            symbols = np.repeat(symbols, counts)
            symbols[symbols < 0] = self.byte[np.frombuffer(b"".join(spelled), np.uint8)]
        of_place = np.zeros(len(points) + 1, np.int64)
        of_place[places + 1] = counts
        ends = np.cumsum(of_place)[np.cumsum(lengths)].tolist()
        held = symbols.astype("<i4").tobytes()
        return [held[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]

    def _cut(self, text: str) -> list[str]:
        """Keys of the words of a text. A key without the mark and a line's end in front has the mark before it."""
        if not text:
            return []
        if self._plain and "  " not in text and text[0] != " " and text[-1] != " " and SPACE not in text and "\0" not in text:
            return (text.replace("\n", " \n") if self.by_lines else text).split(" ")
        marked = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        # A nought in front says that nothing is to be put before the word.
        return ["\0" + w for w in (self._words.findall(marked) if self.by_words else [marked])]

    def _word(self, key: str) -> str:
        if key[:1] == "\0":
            return key[1:]
        return key if self.by_lines and key[:1] == "\n" else SPACE + key

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of every text without an end id, as little-endian 32-bit integers."""
        cut = [self._cut(t) for t in texts]
        memory, known, fresh = self._memory, {}, []
        for key in set().union(*cut):
            ids = memory.young.get(key) or memory.found(key)
            if ids is None:
                fresh.append(key)
            else:
                known[key] = ids
        if fresh:
            for key, ids in zip(fresh, self.merge_words([self._word(k) for k in fresh])):
                known[key] = ids
                if len(key) <= CACHED_CHARS and ids:
                    memory.put(key, ids)
        return [b"".join(map(known.__getitem__, keys)) for keys in cut]

    def decode(self, ids: list[int]) -> str:
        known = len(self.surface)
        if ids and (min(ids) < 0 or max(ids) >= known):
            ids = [i for i in ids if 0 <= i < known]
        control = [at for at, i in enumerate(ids) if self.control[i]] if not self.controls.isdisjoint(ids) else []
        runs = [ids[a + 1 : b] for a, b in zip([-1, *control], [*control, len(ids)])]
        # Byte ids on both sides of a control id spell no letter together.
        texts = [b"".join(map(self.surface.__getitem__, run)).decode("utf-8", "quirefold-each") for run in runs]
        if self.prefix:
            lead = next((at for at, run in enumerate(runs) if run), None)
            if lead is not None and self.marked[runs[lead][0]]:
                texts[lead] = texts[lead][1:]
        return "".join(texts)


@lru_cache(maxsize=2)
def _cached(_: int, held) -> Pieces:
    return Pieces(held.value)


def _pieces_of(sent) -> Pieces:
    return _cached(sent.id if hasattr(sent, "id") else id(sent), sent)


def encode_texts(df: DataFrame, model: str, key: str = "doc_id", text: str = "text", end: bool = True, decode: bool = True) -> DataFrame:
    """Columns ``key``, ``ids`` (array of int, with the end id last where ``end``) and ``decoded`` (null unless asked for).

    ``model`` is the path of a model file on the driver. Its pieces are sent to the executors;
    they are as large as the vocabulary, whatever the input.
    """
    sent = df.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces_of(sent)
        last = np.array([pieces.end] if end else [], "<i4").tobytes()
        for part in row_slices(batches):
            ids = [found + last for found in pieces.encode_all(part.column(1).to_pylist())]
            flat = np.frombuffer(b"".join(ids), "<i4")
            offsets = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
            numbers = flat.tolist() if decode else None
            decoded = [pieces.decode(numbers[a:b]) if decode else None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(decoded, pa.string())],
                names=[key, "ids", "decoded"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), text_of(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")


def decode_ids(df: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Columns ``key`` and ``text``: the text of an array of ids; null ids give empty text."""
    sent = df.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces_of(sent)
        for part in row_slices(batches):
            texts = [pieces.decode([i for i in row or [] if i is not None]) for row in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(ids).cast("array<int>").alias("_ids")).mapInArrow(run, f"`{key}` {kind}, text string")
