"""Near-duplicate documents by an exact n-gram Jaccard join over signature trees.

A document is the set of its distinct word shingles, by 64-bit hash. Two documents link
when the intersection is at least ``percent`` of the union. The result is each document's
component of links.

1. Shingles are counted over all documents (``exchange``, by leading bits of the hash, which
   can only overstate a count). A shingle that stands in one document cannot be
   shared, so a document with too few others links with nothing and ends here. Equal sets
   are one class from here on.
2. Of a class, the rarest shingles that decide (the prefix: any linked pair shares one)
   go to buckets with a signature, the number of shingles in each of 128 parts of the
   hash range. Classes that share such a shingle, are of similar size, and whose
   signatures allow enough overlap are put into one cluster.
3. A cluster is searched by a signature tree: nodes hold OR-combined token bitmaps and size
   ranges, and a traversal of the tree against itself leaves out pairs of nodes whose
   largest possible overlap is too small, whose sizes do not fit, or whose documents are
   in one component already. What reaches the leaves is counted exactly. A cluster too
   large for a task is cut into blocks; pairs of blocks of fitting sizes are searched by
   two trees.

No pair is written out: tasks return stars of components. No link between different sets is
lost, because step 2 only joins and step 3 leaves out proven non-links and known ones.
A cluster of many thousand different sets that are near each other without linking is
searched block by block, in time quadratic in such a cluster; the size ranges and the bitmaps
are what limits it.

Defined cases: a null or empty text has no shingle and is its own component; a text with
fewer words than a shingle is one shingle of all its words; repeated rows link with each
other; a null id takes the smallest other id of its component, or null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import row_slices, text_of
from quirefold.llm.components import components
from quirefold.llm.exchange import Chunk, add_up, bucket_bits, code_chunks, drop_chunks, mix, send_keys, totals_of, with_totals, write_chunks
from quirefold.session import cut_lineage, release

SHINGLE = 5
PERCENT = 80
PARTS = 128
FAN = 32
MAX_BITS = 1 << 15
UNIT_BYTES = 1 << 24
BLOCK = 2048
#: Keys of rows to drop that are broadcast at most, so that the texts of the others need not move; more are joined by a shuffle.
BROADCAST_GONE = 1 << 21
HOT_CLASSES = 1024
FINGERPRINT = 32


def shingles(chunk: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the document and hash of each distinct shingle, ordered by both."""
    words = chunk.words[chunk.codes]
    document = np.repeat(np.arange(len(chunk.lengths)), chunk.lengths)
    starts = np.arange(len(words) - size + 1) if len(words) >= size else np.empty(0, np.int64)
    starts = starts[document[starts] == document[starts + size - 1]] if len(starts) else starts
    hashes, owner = [mix(*(words[starts + k] for k in range(size)))] if len(starts) else [np.empty(0, np.uint64)], [document[starts]]
    for length in range(1, size):  # shorter texts: all words as one
        short = np.flatnonzero(chunk.lengths == length)
        first = chunk.starts[short]
        if len(short):
            hashes.append(mix(*(words[first + k] for k in range(length))))
            owner.append(short)
    hashed, owned = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((hashed, owned))
    hashed, owned = hashed[order], owned[order]
    new = np.append(True, (np.diff(owned) != 0) | (hashed[1:] != hashed[:-1])) if len(hashed) else np.empty(0, bool)
    return owned[new], hashed[new]


def needed(size: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The smallest overlap that a set of this size needs for any link."""
    return -(-size * percent // 100)


SETS = "doc_id bigint, tag bigint, uid bigint, n bigint, low bigint, high bigint, tokens binary, prefix int"


def shared_sets(chunks: DataFrame, words: int, size: int, percent: int) -> DataFrame:
    """One row per document. ``tokens``: its shared shingles, rarest first; null where it cannot link.

    ``low`` and ``high`` are a 128-bit hash of the set, ``prefix`` the number of leading tokens that decide.
    """
    bits = bucket_bits(words)
    leading = np.uint64((1 << 64) - (1 << (64 - min(64, FINGERPRINT + bits))))

    def sent(chunk: Chunk) -> tuple[np.ndarray, list[np.ndarray]]:
        keys, counts = np.unique(shingles(chunk, size)[1] & leading, return_counts=True)
        return keys, [counts]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, 1):
            row = part.to_pylist()[0]
            chunk = Chunk(row)
            owner, hashed = shingles(chunk, size)
            _, place = np.unique(hashed & leading, return_inverse=True)
            (totals,) = totals_of(row, 1)
            often = totals[place]
            documents = len(chunk.lengths)
            n = np.bincount(owner, minlength=documents)
            low, high = np.zeros(documents, np.uint64), np.zeros(documents, np.uint64)
            np.bitwise_xor.at(low, owner, mix(hashed))
            with np.errstate(over="ignore"):
                np.add.at(high, owner, mix(hashed, hashed))
            shared = np.bincount(owner[often > 1], minlength=documents)
            links = (n > 0) & (shared >= needed(n, percent))
            kept = (often > 1) & links[owner]
            owner, hashed, often = owner[kept], hashed[kept], often[kept]
            order = np.lexsort((hashed, often, owner))
            hashed = hashed[order]
            cut = np.searchsorted(owner, np.arange(documents + 1))
            tokens = [hashed[a:b].tobytes() if b > a else None for a, b in zip(cut, cut[1:])]
            base = (row["chunk"] >> 32 << 42) + ((row["chunk"] & 0xFFFFFFFF) << 20)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(chunk.doc_ids, pa.int64()),
                    "tag": pa.array(chunk.tags),
                    "uid": pa.array(base + np.arange(documents)),
                    "n": pa.array(n.astype(np.int64)),
                    "low": pa.array(low.view(np.int64)),
                    "high": pa.array(high.view(np.int64)),
                    "tokens": pa.array(tokens, pa.binary()),
                    "prefix": pa.array(np.where(links, shared - needed(n, percent) + 1, 0).astype(np.int32)),
                }
            )

    return with_totals(chunks, add_up(send_keys(chunks, sent, bits), 1)).mapInArrow(gather, SETS)


def signature(tokens: np.ndarray) -> np.ndarray:
    """Shingles in each part of the hash range."""
    counts = np.bincount((tokens >> np.uint64(57)).astype(np.int64), minlength=PARTS)
    return np.minimum(counts, np.iinfo(np.int16).max).astype("<i2")


class Groups:
    """Components of 0 .. n - 1 with their labels kept up to date."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: int, b: int) -> None:
        a, b = self.label[a], self.label[b]
        if a != b:
            self.label[self.label == max(a, b)] = min(a, b)


class Forest:
    """Components of 0 .. n - 1 by parent pointers, for many small joins."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, a: int) -> int:
        parent = self.parent
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _may_link(n: np.ndarray, sketch: np.ndarray, a: np.ndarray | int, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sizes and signatures of two classes allow a link: the overlap is at most the sum of the smaller part counts."""
    small = np.minimum(sketch[a], sketch[b])
    # A count at the limit of its type may stand for more.
    overlap = np.where((small == np.iinfo(np.int16).max).any(axis=-1), np.minimum(n[a], n[b]), small.sum(axis=-1, dtype=np.int64))
    return 100 * overlap >= percent * (n[a] + n[b] - overlap)


EDGE = "a bigint, b bigint"
PREFIXES = "bucket bigint, uid binary, n binary, sketch binary, token binary, owner binary"


def possible_edges(classes: DataFrame, bits: int, percent: int) -> DataFrame:
    """Edges that put classes which may link into one component."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, 4096):
            uid, n = (part.column(c).to_numpy() for c in ("uid", "n"))
            tokens = [np.frombuffer(t, "<u8") for t in part.column("tokens").to_pylist()]
            sketch = np.array([signature(t) for t in tokens])
            prefix = part.column("prefix").to_numpy()
            token = np.concatenate([t[:p] for t, p in zip(tokens, prefix)])
            owner = np.repeat(np.arange(len(uid)), prefix)
            bucket = token >> np.uint64(64 - bits)
            order = np.argsort(bucket, kind="stable")
            token, owner = token[order], owner[order]
            edges = np.searchsorted(bucket[order], np.arange((1 << bits) + 1, dtype=np.uint64))
            for b in np.flatnonzero(np.diff(edges)):
                c = slice(edges[b], edges[b + 1])
                used, local = np.unique(owner[c], return_inverse=True)
                held = (uid[used], n[used], sketch[used], token[c], local.astype("<i4"))
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in held)], names=["bucket", "uid", "n", "sketch", "token", "owner"])

    def reduce(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        read = lambda c, kind: [np.frombuffer(r[c], kind) for r in rows]
        uids = read("uid", "<i8")
        shift = np.cumsum([0] + [len(u) for u in uids])
        uid, n, token = np.concatenate(uids), np.concatenate(read("n", "<i8")), np.concatenate(read("token", "<u8"))
        sketch = np.concatenate(read("sketch", "<i2")).reshape(-1, PARTS)
        owner = np.concatenate([o.astype(np.int64) + s for o, s in zip(read("owner", "<i4"), shift)])
        order = np.lexsort((owner, n[owner], token))
        token, owner = token[order], owner[order]
        # A cell: one token, sizes without a gap that no link can cross.
        size = n[owner]
        new = np.append(True, (token[1:] != token[:-1]) | (100 * size[:-1] < percent * size[1:]))
        heads = np.flatnonzero(new)
        lengths = np.diff(np.append(heads, len(owner)))
        joined = Forest(len(uid))
        for head, length in zip(heads[lengths > 1].tolist(), lengths[lengths > 1].tolist()):
            cell = owner[head : head + length]
            roots = np.array([joined.find(i) for i in cell.tolist()])
            if (roots == roots[0]).all():
                continue
            for i in np.flatnonzero(_may_link(n, sketch, cell[:-1], cell[1:], percent)):
                joined.join(int(cell[i]), int(cell[i + 1]))
            for i in range(length - 1):
                rest = cell[i + 1 :]
                # Later ones of other components whose size still fits
                rest = rest[: np.searchsorted(n[rest], 100 * n[cell[i]] // percent, "right")]
                root = joined.find(int(cell[i]))
                rest = rest[[joined.find(j) != root for j in rest.tolist()]] if len(rest) else rest
                if len(rest):
                    for j in rest[_may_link(n, sketch, cell[i], rest, percent)].tolist():
                        joined.join(int(cell[i]), j)
        root = np.array([joined.find(i) for i in range(len(uid))], np.int64)
        # The same class came from one task only; its rows in a bucket are one.
        moved = np.flatnonzero(root != np.arange(len(uid)))
        return pa.table({"a": pa.array(uid[moved]), "b": pa.array(uid[root[moved]])})

    return classes.mapInArrow(send, PREFIXES).groupBy("bucket").applyInArrow(reduce, EDGE)


class SignatureTree:
    """Sets with OR-combined bitmaps and size ranges, level by level.

    Bits are the cluster's own tokens where they fit ``MAX_BITS``, else tokens modulo that
    number; then ``excess`` is the most tokens of a set that fell on a taken bit.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, bit_of: list[np.ndarray], bits: int):
        self.sets, self.sizes = sets, sizes
        flags = np.zeros((len(sets), bits), bool)
        for i, own in enumerate(bit_of):
            flags[i, own] = True
        packed = np.packbits(flags, axis=1)
        packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)
        self.excess = max((len(s) - int(f) for s, f in zip(sets, flags.sum(axis=1))), default=0)
        self.levels = [(packed, sizes, sizes)]
        while len(self.levels[-1][0]) > 1:
            bitmap, least, most = self.levels[-1]
            at = np.arange(0, len(bitmap), FAN)
            self.levels.append((np.bitwise_or.reduceat(bitmap, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))

    def below(self, level: int, node: int) -> slice:
        return slice(node * FAN, min((node + 1) * FAN, len(self.levels[level - 1][0])))

    def documents(self, level: int, node: int) -> slice:
        return slice(node * FAN**level, min((node + 1) * FAN**level, len(self.sets)))


def search(left: SignatureTree, right: SignatureTree, groups: Groups, shift: int, percent: int) -> None:
    """Join the components of all linked pairs between two trees; ``shift`` is the place of the right tree's first set in ``groups``.

    With ``left is right`` the tree is searched against itself.
    """
    excess = min(left.excess, right.excess)
    stack = [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)]
    while stack:
        up, i, vp, j = stack.pop()
        if up == 0 and left is right:
            continue  # one set alone
        if up > 1 or vp > 1:
            pairs = [(up - 1 if up > 1 else up, x, vp - 1 if vp > 1 else vp, y) for x in (range(*left.below(up, i).indices(1 << 62)) if up > 1 else (i,)) for y in (range(*right.below(vp, j).indices(1 << 62)) if vp > 1 else (j,))]
            for pair in pairs:
                if (left is not right or pair[1] <= pair[3] or pair[0] != pair[2]) and _open(left, right, groups, shift, pair, excess, percent):
                    stack.append(pair)
            continue
        _leaves(left, right, groups, shift, left.documents(up, i), right.documents(vp, j), excess, percent)


def _open(left: SignatureTree, right: SignatureTree, groups: Groups, shift: int, pair: tuple[int, int, int, int], excess: int, percent: int) -> bool:
    """Whether a pair of nodes can hold a link that is not known yet."""
    up, i, vp, j = pair
    (a, a_least, a_most), (b, b_least, b_most) = left.levels[up], right.levels[vp]
    if 100 * a_most[i] < percent * b_least[j] or 100 * b_most[j] < percent * a_least[i]:
        return False
    largest = int(np.bitwise_count(a[i] & b[j]).sum()) + excess
    if largest < needed(int(max(a_least[i], b_least[j])), percent):
        return False
    one, two = left.documents(up, i), right.documents(vp, j)
    label = groups.label
    first = label[one.start]
    return not ((label[one] == first).all() and (label[two.start + shift : two.stop + shift] == first).all())


def _leaves(left: SignatureTree, right: SignatureTree, groups: Groups, shift: int, one: slice, two: slice, excess: int, percent: int) -> None:
    x, y = left.levels[0][0][one], right.levels[0][0][two]
    n, m = left.sizes[one][:, None], right.sizes[two][None, :]
    overlap = np.bitwise_count(x[:, None, :] & y[None, :, :]).sum(axis=2, dtype=np.int64) + excess
    linked = 100 * overlap >= percent * (n + m - overlap)
    for i, j in zip(*np.nonzero(linked)):
        a, b = one.start + int(i), two.start + int(j)
        if left is right and a >= b or groups.label[a] == groups.label[b + shift]:
            continue
        if excess:
            exact = len(np.intersect1d(left.sets[a], right.sets[b], assume_unique=True))
            if 100 * exact < percent * (int(left.sizes[a]) + int(right.sizes[b]) - exact):
                continue
        groups.join(a, b + shift)


def link(sides: list[tuple[list[np.ndarray], np.ndarray]], percent: int) -> np.ndarray:
    """Component labels of the sets of one side, or of both sides one after another; only links between the two are sought then."""
    every = np.concatenate([t for sets, _ in sides for t in sets])
    tokens, code = np.unique(every, return_inverse=True)
    bits = min(max(64, len(tokens)), MAX_BITS)
    cut = np.cumsum([len(t) for sets, _ in sides for t in sets])[:-1]
    codes = np.split(code % bits, cut)
    groups, trees, at = Groups(sum(len(sets) for sets, _ in sides)), [], 0
    for sets, sizes in sides:
        trees.append(SignatureTree(sets, sizes, codes[at : at + len(sets)], bits))
        at += len(sets)
    search(trees[0], trees[-1], groups, len(sides[0][0]) if len(sides) > 1 else 0, percent)
    return groups.label


def unit_edges(units: DataFrame, percent: int) -> DataFrame:
    """Stars of linked classes of every unit: rows (unit, cluster, side, uid, n, tokens)."""

    def run(group: pa.Table) -> pa.Table:
        table = group.sort_by([("cluster", "ascending"), ("n", "ascending"), ("low", "ascending"), ("uid", "ascending")])
        cluster, side, uid, n = (table[c].to_numpy() for c in ("cluster", "side", "uid", "n"))
        held = table["tokens"]
        a, b = [], []
        edges = np.append(np.flatnonzero(np.append(True, np.diff(cluster) != 0)), len(cluster))
        for low, high in zip(edges, edges[1:]):
            sets = [np.frombuffer(t, "<u8") for t in held.slice(low, high - low).to_pylist()]
            part = side[low:high]
            sides = [[low + i for i in range(high - low) if part[i] == s] for s in np.unique(part)]
            label = link([([sets[i - low] for i in rows], n[rows]) for rows in sides], percent)
            order = np.concatenate([np.array(rows, np.int64) for rows in sides])
            moved = np.flatnonzero(label != np.arange(len(label)))
            a.append(uid[order[moved]])
            b.append(uid[order[label[moved]]])
        return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    return units.groupBy("unit").applyInArrow(run, EDGE)


def _units(member: DataFrame, percent: int) -> DataFrame:
    """The members of every cluster, dealt to tasks: whole clusters together, larger ones as pairs of blocks."""
    sizes = cut_lineage(
        member.groupBy("cluster").agg(F.sum(F.octet_length("tokens").cast("bigint")).alias("bytes"), F.count(F.lit(1)).alias("members"))
    )
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    columns = ("unit", "cluster", "side", "uid", "n", "low", "tokens")
    large = (F.col("bytes") > UNIT_BYTES) | (F.col("members") > 2 * BLOCK)
    small = member.join(sizes.where(~large), "cluster").select(
        F.concat(F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(total // UNIT_BYTES * 2 + 8))).alias("unit"), "cluster", F.lit(0).alias("side"), "uid", "n", "low", "tokens"
    )
    # Blocks of a large cluster: sizes in steps that a link can cross once, then by hash.
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent)) * 1.001))
    banded = member.join(sizes.where(large), "cluster").withColumn("band", band)
    counts = banded.groupBy("cluster", "band").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.octet_length("tokens")) * 2 / UNIT_BYTES)).cast("bigint").alias("blocks")
    )
    counts = cut_lineage(counts)
    placed = banded.join(counts, ["cluster", "band"]).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")))
    next_band = counts.select("cluster", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    last_band = counts.select("cluster", (F.col("band") + 1).alias("band"), F.col("blocks").alias("under"))
    placed = placed.join(next_band, ["cluster", "band"], "left").join(last_band, ["cluster", "band"], "left")
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    meet = lambda band, other, low, high, side: F.struct(band.cast("bigint").alias("band"), other.cast("bigint").alias("other"), low.alias("first"), high.alias("second"), F.lit(side).alias("side"))
    here, block, blocks = F.col("band"), F.col("block"), F.col("blocks")
    pairs = F.concat(
        F.transform(F.filter(up_to(blocks), lambda o: o >= block), lambda o: meet(here, here, block, o, 0)),
        F.transform(F.filter(up_to(blocks), lambda o: o < block), lambda o: meet(here, here, o, block, 1)),
        F.transform(up_to(F.coalesce("above", F.lit(0))), lambda o: meet(here, here + 1, block, o, 0)),
        F.transform(up_to(F.coalesce("under", F.lit(0))), lambda o: meet(here - 1, here, o, block, 1)),
    )
    dealt = placed.select("*", F.explode(pairs).alias("p")).select(
        F.concat_ws("-", F.lit("l"), "cluster", "p.band", "p.other", "p.first", "p.second").alias("unit"), "cluster", F.col("p.side").alias("side"), "uid", "n", "low", "tokens"
    )
    return small.select(*columns).unionByName(dealt.select(*columns))


def _members(df: DataFrame, key: str, text: str, tag: Column, size: int, percent: int) -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``tag``, ``n``, ``component`` (its smallest id) and ``root``, a number of the component.

    ``root`` is null for a row that surely links with nothing.
    """
    chunks = write_chunks(code_chunks(df, key, text, tag))
    words = chunks.agg(F.sum("n_words")).first()[0] or 0
    sets = cut_lineage(shared_sets(chunks, words, size, percent))
    drop_chunks(chunks)
    same_set = ["low", "high", "n"]
    linking = sets.where(F.col("tokens").isNotNull())
    groups = cut_lineage(linking.groupBy(*same_set).agg(F.min("uid").alias("uid"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")))
    classes = cut_lineage(linking.join(groups.select("uid"), "uid", "left_semi").select("uid", "n", "low", "tokens", "prefix"))
    keys = classes.agg(F.sum("prefix")).first()[0] or 0
    clusters = components(possible_edges(classes, bucket_bits(keys), percent))
    member = cut_lineage(classes.join(clusters.withColumnsRenamed({"node": "uid", "root": "cluster"}), "uid"))
    release(classes)
    linked = components(unit_edges(_units(member, percent), percent))
    release(member)
    of_class = groups.join(linked.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    least = of_class.groupBy("root").agg(F.min("least").alias("component"))
    named = cut_lineage(of_class.join(least, "root").select(*same_set, "component", "root", "rows"))
    # Fewer than HOT_CLASSES classes can have more than this share of the rows each: these are broadcast.
    share = (groups.agg(F.sum("rows")).first()[0] or 0) / HOT_CLASSES
    release(groups)
    rows = sets.select("doc_id", "tag", *same_set, F.col("tokens").isNotNull().alias("links"))
    hot = named.where(F.col("rows") > share).drop("rows")
    seldom = rows.where("links").join(F.broadcast(hot.select(*same_set)), same_set, "left_anti")
    columns = ["doc_id", "tag", "n", "component", "root"]
    found = rows.where("links").join(F.broadcast(hot), same_set).select(*columns).unionByName(
        seldom.join(named.where(F.col("rows") <= share).drop("rows"), same_set).select(*columns)
    )
    alone = rows.where(~F.col("links")).select("doc_id", "tag", "n", F.col("doc_id").alias("component"), F.lit(None).cast("bigint").alias("root"))
    return found.unionByName(alone)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links."""
    found = _members(df, key, text, F.lit(0), size, percent)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Exactly one row of ``df`` of each component: of the rows with its smallest id, null last, the one with the smallest hash of its text.

    A row is known by id and hash of the text, so other texts under its id, or without an
    id, are judged on their own. Repeated rows are in one component. Texts without a word all stay.
    Rows stay where they are read if few are dropped: their keys are counted and then broadcast.
    """
    own_hash = F.xxhash64(text_of(text))
    found = _members(df, key, text, own_hash, SHINGLE, PERCENT).where(F.col("root").isNotNull())
    texts = cut_lineage(found.groupBy("doc_id", "tag", "component", "root").agg(F.count(F.lit(1)).alias("rows")))
    first = F.col("doc_id").eqNullSafe(F.col("component"))
    heads = texts.where(first)
    least = heads.groupBy("root").agg(F.min("tag").alias("tag"))
    repeated = cut_lineage(heads.join(least, ["root", "tag"], "left_semi").where(F.col("rows") > 1).select("doc_id", "tag"))
    gone = texts.where(~first).select("doc_id", "tag").unionByName(heads.join(least, ["root", "tag"], "left_anti").select("doc_id", "tag"))
    gone = cut_lineage(gone.unionByName(repeated))
    release(texts)
    held = df.select(F.struct(*df.columns).alias("row"), F.col(key).cast("bigint").alias("id"), own_hash.alias("hash"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("tag"))
    few = F.broadcast if gone.count() <= BROADCAST_GONE else lambda keys: keys
    kept = held.join(few(gone), same, "left_anti").select("row")
    if not repeated.isEmpty():
        kept = kept.unionByName(held.join(few(repeated), same, "left_semi").dropDuplicates(["id", "hash"]).select("row"))
    return kept.select("row.*")
