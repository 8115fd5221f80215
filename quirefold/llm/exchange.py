"""Texts coded in chunks, and totals of 64-bit keys over all chunks.

A chunk is one row with the words of some documents as codes and the hash of each
distinct word. Keys made from a chunk (words, word pairs, shingles) are unique and
counted inside it before anything moves, so a frequent key is sent once per chunk. They
go out as sorted blocks, one for each bucket of the key range; a bucket adds up its
blocks and sends every block's totals back in the block's own order. Buckets are as many
as the keys need to fit a task (``BUCKET_KEYS``), so a task is bounded at any size.

Blocks hold differences of sorted keys, bytes of equal weight together and compressed;
nothing is lost.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import row_slices, text_of
from quirefold.session import release, scratch_path

CHUNK_WORDS = 1 << 19
BUCKET_KEYS = 1 << 20

CHUNK = "chunk bigint, rows array<struct<doc_id:bigint,tag:bigint,n:bigint>>, n_words bigint, codes binary, words binary"
ROW = pa.list_(pa.struct([("doc_id", pa.int64()), ("tag", pa.int64()), ("n", pa.int64())]))


def planes(numbers: np.ndarray) -> bytes:
    """The bytes of the numbers, those of equal weight together."""
    width = numbers.dtype.itemsize
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, width).T).tobytes()


def from_planes(held: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(held, np.uint8).reshape(width, -1).T).view(kind).ravel()


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(map(planes, columns)))


def unpack(held: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(held)
    widths = [np.dtype(kind).itemsize for kind in kinds]
    length = len(data) // sum(widths)
    ends = np.cumsum(widths) * length
    return [from_planes(data[e - w * length : e], kind) for e, w, kind in zip(ends.tolist(), widths, kinds)]


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(held: bytes) -> np.ndarray:
    return np.cumsum(unpack(held, "<u8")[0], dtype=np.uint64)


def mix(*parts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of several columns of 64-bit numbers, in their order."""
    seed = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for part in parts:
            seed = (seed ^ part) * np.uint64(0xBF58476D1CE4E5B9)
            seed = (seed ^ (seed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            seed ^= seed >> np.uint64(32)
    return seed


def lower_words(text: str) -> list[bytes]:
    """The words of a text with A-Z in lower case."""
    return text.encode().lower().split()


def code_chunks(df: DataFrame, key: str, text: str, tag: Column, size: int = CHUNK_WORDS) -> DataFrame:
    """Rows of ``CHUNK``: whole documents, about ``size`` words in each chunk; ``write_chunks`` before use.

    ``tag`` is a number that stays with the document. Chunk ids are unique in the written table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        index: dict[bytes, int] = defaultdict()
        index.default_factory = index.__len__
        rows, codes, held = [], [], 0

        def flush() -> pa.RecordBatch:
            words = np.fromiter(map(xxhash.xxh3_64_intdigest, index), np.uint64, len(index))
            joined = np.concatenate(codes) if codes else np.empty(0, np.int32)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([base + made], pa.int64()),
                    pa.array([rows], ROW),
                    pa.array([held], pa.int64()),
                    pa.array([pack(joined)], pa.binary()),
                    pa.array([words.tobytes()], pa.binary()),
                ],
                names=["chunk", "rows", "n_words", "codes", "words"],
            )

        for part in row_slices(batches):
            for doc_id, kept, content in zip(*(c.to_pylist() for c in part.columns)):
                words = lower_words(content)
                codes.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
                rows.append({"doc_id": doc_id, "tag": kept, "n": len(words)})
                held += len(words)
                if held >= size or len(rows) >= size:
                    yield flush()
                    index.clear()
                    rows, codes, held, made = [], [], 0, made + 1
        if rows:
            yield flush()

    return df.select(F.col(key).cast("bigint"), tag.cast("bigint"), text_of(text)).mapInArrow(run, CHUNK)


def write_chunks(chunks: DataFrame) -> DataFrame:
    """The chunks as a written table bucketed by chunk, so that a join by chunk does not move them."""
    spark = chunks.sparkSession
    name, path = f"chunks_{uuid.uuid4().hex}", scratch_path(spark, "chunks")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks.write.option("path", path).format("parquet").bucketBy(buckets, "chunk").saveAsTable(name)
    written = spark.table(name)
    written._scratch, written._table = path, name
    return written


def drop_chunks(chunks: DataFrame) -> None:
    """Delete a table of ``write_chunks`` once all that was built on it is written."""
    chunks.sparkSession.sql(f"DROP TABLE IF EXISTS {chunks._table}")
    release(chunks)


class Chunk:
    """A row of ``CHUNK`` with its parts as arrays."""

    def __init__(self, row: dict):
        self.doc_ids = [r["doc_id"] for r in row["rows"]]
        self.tags = np.array([r["tag"] for r in row["rows"]], np.int64)
        self.lengths = np.array([r["n"] for r in row["rows"]], np.int64)
        (self.codes,) = unpack(row["codes"], "<i4")
        self.words = np.frombuffer(row["words"], "<u8")
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths


def bucket_bits(keys: int, per_bucket: int = BUCKET_KEYS) -> int:
    return max(4, int(max(keys, 1) // per_bucket).bit_length())


def send_keys(chunks: DataFrame, keys_of: Callable[[Chunk], tuple[np.ndarray, list[np.ndarray]]], bits: int) -> DataFrame:
    """Blocks (chunk, bucket, keys, counts) of every chunk's sorted unique keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, 1):
            row = part.to_pylist()[0]
            keys, counts = keys_of(Chunk(row))
            edges = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            edges = np.append(edges, len(keys))
            full = np.flatnonzero(np.diff(edges))
            cut = [slice(edges[b], edges[b + 1]) for b in full]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["chunk"]] * len(full), pa.int64()),
                    pa.array(full, pa.int64()),
                    pa.array([pack_sorted(keys[c]) for c in cut], pa.binary()),
                    pa.array([pack(*(n[c].astype("<i4") for n in counts)) for c in cut], pa.binary()),
                ],
                names=["chunk", "bucket", "keys", "counts"],
            )

    return chunks.mapInArrow(run, "chunk bigint, bucket bigint, keys binary, counts binary")


def add_up(blocks: DataFrame, columns: int, tally: Callable[[np.ndarray, list[np.ndarray]], int] | None = None) -> DataFrame:
    """Blocks (chunk, bucket, totals, tally): for each key of a block the sums over all chunks, 64 bits a column.

    ``tally`` makes a number of a bucket's distinct keys and their sums; one row of the bucket has it.
    """

    def total(group: pa.Table) -> pa.Table:
        keys = [unpack_sorted(k) for k in group["keys"].to_pylist()]
        sizes = [len(k) for k in keys]
        counts = [unpack(c, *["<i4"] * columns) for c in group["counts"].to_pylist()]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum(sizes)
        sums = [np.bincount(place, np.concatenate([c[i] for c in counts])).astype("<i8") for i in range(columns)]
        found = [tally(distinct, sums) if tally else None] + [None] * (len(sizes) - 1)
        sums = [s[place] for s in sums]
        held = [pack(*(s[e - n : e] for s in sums)) for e, n in zip(ends, sizes)]
        return pa.table({"chunk": group["chunk"], "bucket": group["bucket"], "totals": pa.array(held, pa.binary()), "tally": pa.array(found, pa.int64())})

    return blocks.groupBy("bucket").applyInArrow(total, "chunk bigint, bucket bigint, totals binary, tally bigint")


def with_totals(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """The chunks with their blocks of totals, ordered by bucket."""
    gathered = blocks.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "totals", "tally"))).alias("blocks"))
    return chunks.join(gathered, "chunk", "left")


def totals_of(row: dict, columns: int) -> list[np.ndarray]:
    """Totals of a row of ``with_totals`` in the order of the chunk's sorted keys."""
    blocks = [unpack(block["totals"], *["<i8"] * columns) for block in row["blocks"] or []]
    return [np.concatenate([np.empty(0, "<i8"), *(b[i] for b in blocks)]) for i in range(columns)]
