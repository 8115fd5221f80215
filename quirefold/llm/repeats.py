"""Repeated byte strings removed by prefix-free parsing.

A rolling hash of ``GRAM`` bytes is taken at every byte. Of each run of ``width - 36``
neighbouring hashes the smallest one, the last among equals, is a trigger; so every string
of ``width`` bytes (a window) owns exactly one trigger, at a place that its own bytes
decide, and equal windows own equal triggers. The parse of a document is its triggers;
a dictionary entry is a trigger with the bytes of the windows that own it.

1. Triggers are hashed with the 37 bytes that every owning window has behind them. Each task sends
   the hashes to buckets of the hash range; a bucket returns, for each document, the
   hashes that also stand elsewhere. Only these triggers go on; most text ends here.
2. For these, entries with their bytes and earliest place go to buckets. A task sends an
   entry once: its later places in the same task repeat an earlier one for sure. In a
   bucket the suffixes of the entries that are windows are sorted (the suffix array of
   the dictionary); neighbours with a common prefix of ``width`` bytes are one string,
   and the places of their entries (the parse) tell which is first in corpus order.
3. All other places of a string are covered; their union is removed from the document.

Corpus order is document id, then the text's hash where an id has several texts, then
place. Exact copies of a text are found by SHA-256 beforehand and take no part, so large
groups of copies cost nothing; groups are joined salted.

Memory of a task follows the size of its batch of documents or its bucket, both bounded;
a single document must fit a task.

Defined cases: a null text is empty; texts shorter than ``width`` keep all bytes; a null
id orders first; repeated rows are the same document and get the same result, they do
not repeat each other; several texts under one id order by their hash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.llm.common import row_slices, text_of
from quirefold.llm.exchange import mix, pack, unpack
from quirefold.session import cut_lineage, release

WIDTH = 100
GRAM = 16
BEHIND = 37
SEGMENT = 1 << 20
BATCH_BYTES = 1 << 23
BUCKET_TRIGGERS = 1 << 19
BUCKET_ENTRIES = 1 << 16
SORTED_AT_ONCE = 1 << 17
SALTS = 32
NO_ID = -(1 << 63)


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as a number; the last seven places are filled with zero bytes."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(len(data), np.uint64)
    for shift in range(8):
        part = out[shift::8]
        part[:] = padded[shift : shift + 8 * len(part)].view("<u8")
    return out


def triggers(data: np.ndarray, ends: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Triggers of the windows of documents that lie one after another in ``data``.

    Returns place, first and last start of the windows that own it, and hash, in order of place.
    """
    found = []
    reach = width - BEHIND + 1
    start_of_last = ends - width
    for low in range(0, len(data), SEGMENT):
        part = data[low : low + SEGMENT + width - 1]
        count = len(part) - width + 1
        if count <= 0:
            break
        eight = loads(part)
        rolled = mix(eight[: len(part) - GRAM + 1], eight[GRAM - 8 : len(part) - 7])
        hidden = np.uint64((1 << 24) - 1)
        place = np.arange(len(rolled), dtype=np.uint64)
        least = (rolled & ~hidden) | (hidden - place)
        span = 1
        while 2 * span <= reach:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < reach:
            least = np.minimum(least[: span - reach], least[reach - span :])
        owned = (hidden - (least[:count] & hidden)).astype(np.int64)
        starts = np.arange(low, low + count)
        inside = starts <= start_of_last[np.searchsorted(ends, starts, "right")]
        kept = np.flatnonzero(inside)
        if not len(kept):
            continue
        at = owned[kept]
        # A run: neighbouring starts that own the same trigger.
        new = np.flatnonzero(np.append(True, (np.diff(at) != 0) | (np.diff(kept) != 1)))
        last = np.append(new[1:], len(kept)) - 1
        where = at[new]
        found.append((where + low, kept[new] + low, kept[last] + low, mix(*(eight[where + s] for s in (0, 8, 16, 24, BEHIND - 8)))))
    if not found:
        return tuple(np.empty(0, k) for k in (np.int64, np.int64, np.int64, np.uint64))  # type: ignore[return-value]
    return tuple(np.concatenate(c) for c in zip(*found))  # type: ignore[return-value]


class Batch:
    """Documents one after another in one array."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        self.data = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
        self.ends = np.cumsum([len(r[2]) for r in rows])
        self.starts = self.ends - [len(r[2]) for r in rows]

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, "right")


def _in_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (id, hash, bytes, more) in lists of about ``BATCH_BYTES``."""
    rows, held = [], 0
    for part in row_slices(batches):
        for row in zip(*(c.to_pylist() for c in part.columns)):
            rows.append(row)
            held += len(row[2])
            if held >= BATCH_BYTES:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def _bits(count: int, per_bucket: int) -> int:
    return max(4, int(max(count, 1) // per_bucket).bit_length())


SENT = "bucket bigint, ids array<bigint>, hashes array<bigint>, document binary, trigger binary, twice binary"
SHARED = "id bigint, hash bigint, trigger binary"


def shared_triggers(texts: DataFrame, bits: int, width: int) -> DataFrame:
    """For each document the triggers (``bits + 32`` leading bits of the hash) that stand in another text too, or twice in this one."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _in_batches(batches):
            batch = Batch(rows)
            place, first, _, hashed = triggers(batch.data, batch.ends, width)
            short = hashed >> np.uint64(32 - bits)
            document = batch.document(first)
            if not len(short):
                continue
            order = np.lexsort((document, short))
            short, document, place = short[order], document[order], place[order]
            # A run that a segment's end has cut is one trigger, not two.
            again = np.append(False, (np.diff(short.view(np.int64)) == 0) & (np.diff(document) == 0))
            repeated = again & np.append(False, np.diff(place) != 0)
            heads = np.flatnonzero(~again)
            twice = np.maximum.reduceat(repeated, heads)
            short, document = short[heads], document[heads]
            edges = np.searchsorted(short, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
            for b in np.flatnonzero(np.diff(edges)):
                c = slice(edges[b], edges[b + 1])
                used, local = np.unique(document[c], return_inverse=True)
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array([b], pa.int64()),
                        "ids": pa.array([[rows[d][0] for d in used]], pa.list_(pa.int64())),
                        "hashes": pa.array([[rows[d][1] for d in used]], pa.list_(pa.int64())),
                        "document": pa.array([pack(local.astype("<i4"))], pa.binary()),
                        "trigger": pa.array([pack(np.diff((short[c] & np.uint64(0xFFFFFFFF)).astype("<u4"), prepend=np.uint32(0)))], pa.binary()),
                        "twice": pa.array([np.packbits(twice[c]).tobytes()], pa.binary()),
                    }
                )

    def reduce(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        bucket = np.uint64(rows[0]["bucket"]) << np.uint64(32)
        trigger = [np.cumsum(unpack(r["trigger"], "<u4")[0], dtype=np.uint32) for r in rows]
        sizes = [len(t) for t in trigger]
        twice = np.concatenate([np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=n).astype(bool) for r, n in zip(rows, sizes)])
        ids, hashes = (np.array([v for r in rows for v in r[c]], np.int64) for c in ("ids", "hashes"))
        shift = np.cumsum([0] + [len(r["ids"]) for r in rows])
        owner = np.concatenate([unpack(r["document"], "<i4")[0].astype(np.int64) + s for r, s in zip(rows, shift)])
        joined = np.concatenate(trigger)
        order = np.lexsort((hashes[owner], joined))
        joined, owner, twice = joined[order], owner[order], twice[order]
        heads = np.flatnonzero(np.append(True, np.diff(joined.astype(np.int64)) != 0))
        text = hashes[owner]
        apart = np.append(False, (np.diff(text) != 0) & (np.diff(joined.astype(np.int64)) == 0))
        group_of = np.cumsum(np.isin(np.arange(len(joined)), heads)) - 1
        shared = (np.add.reduceat(apart | twice, heads) > 0)[group_of]
        owner, joined = owner[shared], joined[shared].astype(np.uint64) | bucket
        order = np.argsort(owner, kind="stable")
        owner, joined = owner[order], joined[order]
        cut = np.append(np.flatnonzero(np.append(len(owner) > 0, np.diff(owner) != 0)), len(owner)) if len(owner) else np.array([0])
        held = [joined[a:b].tobytes() for a, b in zip(cut, cut[1:])]
        who = owner[cut[:-1]]
        return pa.table({"id": pa.array(ids[who], pa.int64()), "hash": pa.array(hashes[who], pa.int64()), "trigger": pa.array(held, pa.binary())})

    return texts.mapInArrow(send, SENT).groupBy("bucket").applyInArrow(reduce, SHARED)


ENTRY = "bucket bigint, trigger bigint, id bigint, hash bigint, low bigint, count int, bytes binary, spans binary"
SPANS = "id bigint, hash bigint, spans binary"


def repeated_spans(candidates: DataFrame, bits: int, bucket_bits: int, width: int) -> DataFrame:
    """Per document, byte ranges (start, end as pairs of 64-bit numbers) of windows that also stand earlier.

    ``candidates`` has id, hash, bytes and the document's shared triggers.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _in_batches(batches):
            rows.sort(key=lambda r: r[:2])
            batch = Batch(rows)
            _, first, last, hashed = triggers(batch.data, batch.ends, width)
            document = batch.document(first)
            keep = np.zeros(len(first), bool)
            cut = np.searchsorted(document, np.arange(len(rows) + 1))
            for d, row in enumerate(rows):
                part = slice(cut[d], cut[d + 1])
                keep[part] = np.isin(hashed[part] >> np.uint64(32 - bits), np.frombuffer(row[3], "<u8"))
            first, last, hashed, document = first[keep], last[keep], hashed[keep], document[keep]
            seen: dict[tuple, int] = {}
            covered: dict[int, list[int]] = defaultdict(list)
            sent = []
            raw = batch.data.tobytes()
            # Documents are in corpus order, so the first place of an entry is its earliest in the batch.
            for i, (a, b, h, d) in enumerate(zip(first.tolist(), last.tolist(), hashed.tolist(), document.tolist())):
                entry = (h, raw[a : b + width])
                place = (rows[d][0], rows[d][1], a - int(batch.starts[d]))
                if entry not in seen:
                    seen[entry] = place
                    sent.append((h, *place, b - a + 1, entry[1]))
                elif seen[entry] != place:
                    start = a - int(batch.starts[d])
                    covered[d] += (start, start + b - a + width)
            del seen
            for low in range(0, len(sent), 4096):
                h, ids, hashes, lows, counts, held = zip(*sent[low : low + 4096])
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array([x >> (64 - bucket_bits) for x in h], pa.int64()),
                        "trigger": pa.array(np.array(h, np.uint64).view(np.int64)),
                        "id": pa.array(ids, pa.int64()),
                        "hash": pa.array(hashes, pa.int64()),
                        "low": pa.array(lows, pa.int64()),
                        "count": pa.array(counts, pa.int32()),
                        "bytes": pa.array(held, pa.binary()),
                        "spans": pa.nulls(len(h), pa.binary()),
                    }
                )
            if covered:
                ids, hashes = zip(*(rows[d][:2] for d in covered))
                none = pa.nulls(len(ids), pa.int64())
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array([hash(x) & ((1 << bucket_bits) - 1) for x in hashes], pa.int64()),
                        "trigger": none, "id": pa.array(ids, pa.int64()), "hash": pa.array(hashes, pa.int64()), "low": none,
                        "count": pa.nulls(len(ids), pa.int32()), "bytes": pa.nulls(len(ids), pa.binary()),
                        "spans": pa.array([np.array(s, "<i8").tobytes() for s in covered.values()], pa.binary()),
                    }
                )

    def reduce(group: pa.Table) -> pa.Table:
        spans: dict[tuple[int, int], list[bytes]] = defaultdict(list)
        known = group.column("spans").is_valid()
        for row in group.filter(known).select(["id", "hash", "spans"]).to_pylist():
            spans[row["id"], row["hash"]].append(row["spans"])
        entries = group.filter(group.column("trigger").is_valid()).drop_columns(["bucket", "spans"]).sort_by(
            [("trigger", "ascending"), ("id", "ascending"), ("hash", "ascending"), ("low", "ascending")]
        )
        trigger, ids, hashes, lows, counts = (entries[c].to_numpy() for c in ("trigger", "id", "hash", "low", "count"))
        heads = np.flatnonzero(np.append(True, np.diff(trigger) != 0)) if len(trigger) else np.empty(0, np.int64)
        sizes = np.diff(np.append(heads, len(trigger)))
        held = entries["bytes"]
        take, windows = [], 0
        for head, size in [*zip(heads[sizes > 1].tolist(), sizes[sizes > 1].tolist()), (None, 0)]:
            if take and (head is None or windows >= SORTED_AT_ONCE):
                chosen = np.array(take)
                for i, start, end in _covered(held.take(pa.array(chosen)).to_pylist(), counts[chosen], ids[chosen], hashes[chosen], lows[chosen], width):
                    spans[int(ids[chosen[i]]), int(hashes[chosen[i]])].append(np.array([start, end], "<i8").tobytes())
                take, windows = [], 0
            if head is not None:
                take.extend(range(head, head + size))
                windows += int(counts[head : head + size].sum())
        keys = list(spans)
        return pa.table(
            {
                "id": pa.array([k[0] for k in keys], pa.int64()),
                "hash": pa.array([k[1] for k in keys], pa.int64()),
                "spans": pa.array([b"".join(spans[k]) for k in keys], pa.binary()),
            }
        )

    return candidates.mapInArrow(send, ENTRY).groupBy("bucket").applyInArrow(reduce, SPANS)


def _covered(held: list[bytes], counts: np.ndarray, ids: np.ndarray, hashes: np.ndarray, lows: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
    """Entry, start and end in its document of the windows that an earlier entry has too."""
    data = np.frombuffer(b"".join(held), np.uint8)
    begin = np.cumsum([0] + [len(h) for h in held[:-1]])
    entry = np.repeat(np.arange(len(held)), counts)
    inner = np.arange(len(entry)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begin[entry] + inner
    eight = loads(data).byteswap()
    columns = [eight[at + s] for s in (*range(0, width - 8, 8), width - 8)]
    place = lows[entry] + inner
    # The suffix array of the entries' windows; equal ones in corpus order.
    order = np.lexsort((place, hashes[entry], ids[entry], *reversed(columns)))
    same = np.ones(len(order) - 1, bool)
    for column in columns:
        same &= np.diff(column[order].view(np.int64)) == 0
    later = np.zeros(len(order), bool)
    later[order[1:]] = same
    # The same place may come from two tasks if a row is repeated: it doesn't repeat itself.
    first = np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(len(order)), 0))
    head = order[first]
    itself = (ids[entry[order]] == ids[entry[head]]) & (hashes[entry[order]] == hashes[entry[head]]) & (place[order] == place[head])
    later[order[itself]] = False
    runs = np.flatnonzero(later)
    if len(runs):
        new = np.flatnonzero(np.append(True, (np.diff(runs) != 1) | (np.diff(entry[runs]) != 0)))
        for a, b in zip(runs[new], runs[np.append(new[1:], len(runs)) - 1]):
            yield int(entry[a]), int(place[a]), int(place[b]) + width


KEPT = "id bigint, hash bigint, kept binary, text string, spans array<struct<start:bigint,end:bigint>>"


def _union(parts: list[bytes]) -> list[tuple[int, int]]:
    pairs = np.sort(np.frombuffer(b"".join(parts), "<i8").reshape(-1, 2).copy().view([("a", "<i8"), ("b", "<i8")]).ravel(), order=("a", "b"))
    if not len(pairs):
        return []
    reach = np.maximum.accumulate(pairs["b"])
    new = np.flatnonzero(np.append(True, pairs["a"][1:] > reach[:-1]))
    return list(zip(pairs["a"][new].tolist(), reach[np.append(new[1:], len(pairs)) - 1].tolist()))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in row_slices(batches):
        kept, told = [], []
        for text, parts in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
            spans = _union(parts)
            edges = [0, *(e for span in spans for e in span), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            told.append([{"start": a, "end": b} for a, b in spans])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(kept, pa.binary()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()), pa.array(told, kind)], names=["id", "hash", "kept", "text", "spans"])


def find_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: every row without its text (``id``, ``hash``, ``n_bytes``, ``sha256``, ``copied``), spans, and texts.

    ``copied`` says that an earlier document has exactly this text. The second table
    (``id``, ``hash``, ``spans``: pairs of 64-bit numbers, to be united by ``_union``) has each document with removed bytes once; those
    absent keep all bytes. The third has their ``bytes``, and those of others. ``id`` is the key with null as the smallest
    number, ``hash`` the text's hash. The first and the third are written tables, for ``release``.
    """
    source = df.select(F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_of(text)).alias("hash"), text_of(text).cast("binary").alias("bytes"))
    rows = cut_lineage(source.select("id", "hash", F.octet_length("bytes").cast("bigint").alias("n_bytes"), F.sha2("bytes", 256).alias("sha256")))
    groups = rows.groupBy("sha256").agg(F.min("id").alias("first"), F.max("id").alias("last")).where(F.col("first") < F.col("last"))
    salted = groups.select("sha256", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    told = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    measured, rows = rows, cut_lineage(
        told.join(salted, ["sha256", "salt"], "left").select("id", "hash", "n_bytes", "sha256", F.coalesce(F.col("first") < F.col("id"), F.lit(False)).alias("copied"))
    )
    release(measured)
    size = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bits = _bits(size * 2 // (width - BEHIND + 2), BUCKET_TRIGGERS)
    shared = shared_triggers(source, bits, width).groupBy("id", "hash").agg(F.collect_list("trigger").alias("parts"))
    shared = shared.select("id", "hash", F.expr("aggregate(parts, cast('' as binary), (a, b) -> concat(a, b))").alias("trigger"))
    originals = rows.where(~F.col("copied") & (F.col("n_bytes") >= width)).select("id", "hash").distinct()
    candidates = cut_lineage(source.join(shared.join(originals, ["id", "hash"]), ["id", "hash"]).select("id", "hash", "bytes", "trigger"))
    entries = candidates.agg(F.sum(F.octet_length("trigger") / 8)).first()[0] or 0
    spans = repeated_spans(candidates, bits, _bits(int(entries), BUCKET_ENTRIES), width)
    spans = spans.groupBy("id", "hash").agg(F.collect_list("spans").alias("spans"))
    return rows, spans, candidates


def report(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per input row: ``key``, sizes, removed spans and the SHA-256 of the kept bytes."""
    rows, found, texts = find_repeats(df, key, text, width)
    changed = texts.select("id", "hash", "bytes").dropDuplicates(["id", "hash"]).join(found, ["id", "hash"]).mapInArrow(_cut, KEPT)
    spans = F.coalesce(F.col("spans"), F.array().cast("array<struct<start:bigint,end:bigint>>"))
    whole = F.col("copied") & (F.col("n_bytes") >= width)
    spans = F.when(whole, F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end")))).otherwise(spans)
    found = rows.join(changed.select("id", "hash", "spans", F.sha2("kept", 256).alias("kept_sha256")), ["id", "hash"], "left")
    sha = F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce(F.col("kept_sha256"), F.col("sha256")))
    return found.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias(key), "n_bytes", spans.alias("spans"), sha.alias("kept_sha256")
    )


def _cut_rows(text: str):
    """Rows (``row``, ``spans``) with the spans cut out of the row's text; rows without spans go through as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches):
            rows, spans = part.column(0), part.column(1).to_pylist()
            if any(spans):
                fields = [f.name for f in rows.type]
                texts = rows.field(text).to_pylist()
                for i, parts in enumerate(spans):
                    if parts:
                        held = texts[i].encode()
                        edges = [0, *(e for span in _union(parts) for e in span), len(held)]
                        texts[i] = b"".join(held[a:b] for a, b in zip(edges[::2], edges[1::2])).decode("utf-8", "ignore")
                columns = [pa.array(texts, rows.type.field(name).type) if name == text else rows.field(name) for name in fields]
                rows = pa.StructArray.from_arrays(columns, fields=list(rows.type))
            yield pa.RecordBatch.from_arrays([rows], names=["row"])

    return run


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows of ``df`` with repeated bytes cut out of ``text``; bytes of a character that is cut in two go as well.

    The spans, which are narrow, are written and joined to the rows; each text is cut where it is met. The texts
    of the search are deleted before that join moves the rows.
    """
    rows, found, texts = find_repeats(df, key, text, width)
    # A copy of an earlier text goes as a whole: one span, in the form of the others.
    digits = lambda value: F.lpad(F.hex(value), 16, "0")
    number = lambda value: F.unhex(F.concat(*(F.substring(digits(value), at, 2) for at in range(15, 0, -2))))
    copies = rows.where(F.col("copied") & (F.col("n_bytes") >= width)).select("id", "hash", F.array(F.concat(number(F.lit(0)), number(F.col("n_bytes")))).alias("spans"))
    cuts = cut_lineage(found.unionByName(copies.dropDuplicates(["id", "hash"])))
    release(rows, texts)
    own_id, own_hash = F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID)), F.xxhash64(text_of(text))
    held = df.select(F.struct(*df.columns).alias("row"), own_id.alias("id"), own_hash.alias("hash")).join(cuts, ["id", "hash"], "left")
    return held.select("row", "spans").mapInArrow(_cut_rows(text), T.StructType([T.StructField("row", df.schema)])).select("row.*")
