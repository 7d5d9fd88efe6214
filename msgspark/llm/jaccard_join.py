"""N-gram Jaccard join: documents whose shingle sets agree, linked by a prefix tree over globally ordered sets.

1. Equal sets form a class; one row of each class goes on.
2. All shingles get one global order, common ones last: by their documents, counted over all documents in 2^26 buckets of their
   hashes (four bits for each go to the tasks, so they stay small at any size), then by hash. Any order gives the same links; this
   one keeps shingles that many documents share out of the prefixes. With few counters, all of them are full when the corpus is
   large, common shingles do not stand out any more, and unrelated sets grow into one group.
3. Two sets that agree enough share some of their first n - ceil(t n) + 1 shingles; pairs that share too few are
   dropped (``candidates``). What remains forms groups (connected components, found by contraction).
4. The sets of a group go into a trie in global order. A set walks the trie, sharing the overlap counted along a path
   among all sets below it; subtrees are cut where the lengths that remain can't reach the threshold any more, and
   where all sets are in the walking set's component already. Only links that join components are kept.
5. A group of more than ``GROUP_TOKENS`` is dealt into blocks, each joined with itself and with some shared sets; then
   every set outside the group's largest component meets every block. Nothing is left out.

``link_pairs`` and ``link_counts`` give all links, not only those that join components: in place of 4 and 5, every block meets
every block of its group, and the walk is cut by the remaining lengths alone.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. A null, empty or blank text has an empty set
and stands alone. Texts with fewer words than a shingle have one shingle. A null doc_id is the smallest id; rows with the same
doc_id count as linked. Repeated rows are returned each. Other columns are not read. Empty in, empty out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import anchors
from .anchors import LOWEST, mix
from .batches import slices, spans, utf8
from .components import components
from .storage import written

SKETCH_BITS = 20
NEXT_BITS = 6
BLOCK_BITS = 16
HELD = 1 << 22
KEY_BITS = 24
GROUP_TOKENS = 1 << 21
SMALL_GROUP = 32
SHARED_SETS = 64
PAIR_SETS = 2048
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(text: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, text after text in hash order, and their offsets."""
    data, offsets = utf8(text)
    a = int(offsets[0])
    values, words = anchors.word_values(LOWER[data[a: int(offsets[-1])]], offsets - a)
    n = np.diff(words)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    first = spans(words[:-1], count)
    length = np.repeat(np.minimum(n, size), count)
    h = np.empty(len(first), np.uint64)
    for i in range(0, len(first), anchors.PIECE):  # hashes of word runs, in pieces of bounded powers
        f, k = first[i: i + anchors.PIECE], length[i: i + anchors.PIECE]
        if len(f):
            p = anchors.prefix_sums(values[f[0]: f[-1] + k[-1]])
            f = f - f[0]
            h[i: i + len(f)] = mix((p[f + k] - p[f]) * anchors.powers(len(p))[1][f])
    owner = np.repeat(np.arange(len(n)), count)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.zeros(0, bool)
    return h[new], np.r_[0, np.cumsum(np.bincount(owner[new], minlength=len(n)))]


def prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<i8").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<i8")


class Order(NamedTuple):
    """How common shingles are: ``counts`` the documents of 2^SKETCH_BITS runs of buckets, ``levels`` four bits for each bucket, compressed."""
    counts: np.ndarray
    levels: bytes

    def of_buckets(self) -> np.ndarray:
        return np.frombuffer(zlib.decompress(self.levels), np.uint8)


def levels(total: np.ndarray) -> np.ndarray:
    """Two buckets a byte; a level is half a deviation of what chance puts into a bucket, and a doubling from three deviations on."""
    mean = total.mean()
    step = max(1.0, mean ** 0.5)
    bounds = mean + step * np.array([-1, -0.5, 0, 0.5, 1, 1.5, 2, 3])
    level = np.searchsorted(np.r_[bounds, bounds[-1] * 2.0 ** np.arange(1, 8)], total).astype(np.uint8)
    return level[::2] | level[1::2] << 4


def buckets(h: np.ndarray) -> np.ndarray:
    low = (h & np.uint64((1 << SKETCH_BITS) - 1)) << np.uint64(NEXT_BITS)
    return (low | (h >> np.uint64(SKETCH_BITS)) & np.uint64((1 << NEXT_BITS) - 1)).astype(np.uint32)


def gaps(at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers as bytes, each as the distance from the one before (from 0 at ``starts``) with 255 for as many; where each ends."""
    step = np.diff(at, prepend=at[:1])
    step[starts] = at[starts]
    ends = np.cumsum(step // 255 + 1)
    out = np.full(int(ends[-1]), 255, np.uint8)
    out[ends - 1] = step % 255
    return out, ends


def from_gaps(data: np.ndarray) -> np.ndarray:
    return np.cumsum(data, dtype=np.int64)[data != 255]


def sketch(texts: DataFrame, size: int) -> Order:
    """How many documents have a shingle, per bucket of its hash: 2^26 buckets, as in fewer a common shingle does not stand out of
    those that only share its bucket. A task sends a byte or so for each of its shingles, to the task that counts a block of buckets."""
    per_block = 1 << BLOCK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def rows() -> pa.RecordBatch:
            at = np.sort(np.concatenate(held)).astype(np.int64)
            block, first = np.unique(at >> BLOCK_BITS, return_index=True)
            data, ends = gaps(at & (per_block - 1), first)
            edges = np.r_[0, ends[first[1:] - 1], ends[-1]].astype(np.int32)
            return pa.RecordBatch.from_arrays([
                pa.array(block.astype(np.int32)), pa.Array.from_buffers(
                    pa.binary(), len(block), [None, pa.py_buffer(edges), pa.py_buffer(data)])], ["block", "at"])

        for batch in batches:
            for part in slices(batch, limit=anchors.PIECE):
                h, _ = shingle_sets(part.column("text"), size)
                held.append(buckets(h))
                n += len(h)
                if n > HELD:
                    yield rows()
                    held, n = [], 0
        if n:
            yield rows()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(per_block, np.int64)

        def row() -> pa.RecordBatch:
            runs = total.reshape(-1, 1 << NEXT_BITS).sum(axis=1)
            return pa.RecordBatch.from_arrays([
                pa.array([now], pa.int32()), pa.array([zlib.compress(levels(total).tobytes(), 1)], pa.binary()),
                pa.array([packed(runs)], pa.binary())], ["block", "levels", "counts"])

        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("at"), strict=True):
                if block != now:
                    if now is not None:
                        yield row()
                    now, total = block, np.zeros(per_block, np.int64)
                total += np.bincount(from_gaps(np.frombuffer(data.as_buffer(), np.uint8)), minlength=per_block)
        if now is not None:
            yield row()

    parts = texts.select("text").mapInArrow(count, "block int, at binary").repartition("block").sortWithinPartitions("block")
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    found = np.zeros((1 << SKETCH_BITS + NEXT_BITS) // 2, np.uint8)
    runs, size_ = per_block >> NEXT_BITS, per_block // 2
    for r in parts.mapInArrow(add, "block int, levels binary, counts binary").collect():  # one per block
        counts[r.block * runs: (r.block + 1) * runs] = unpacked(r.counts)
        found[r.block * size_: (r.block + 1) * size_] = np.frombuffer(zlib.decompress(r.levels), np.uint8)
    return Order(counts, zlib.compress(found.tobytes(), 1))


def ordered(h: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of the shingles owner by owner in global order."""
    return np.lexsort((h, counts[(h & np.uint64(len(counts) - 1)).astype(np.int64)], owner))


def by_level(h: np.ndarray, owner: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Positions of the shingles owner by owner, those of buckets with few documents first."""
    at = buckets(h)
    return np.lexsort((h, found[at >> 1] >> ((at & 1) << 2).astype(np.uint8) & 15, owner))


def digests(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digest of each set; the order of its shingles doesn't matter."""
    sums = [np.r_[np.uint64(0), np.cumsum(v, dtype=np.uint64)] for v in (mix(h), mix(h ^ anchors.M3))]
    return tuple((s[offsets[1:]] - s[offsets[:-1]]).view(np.int64) for s in sums)


def prefixes(texts: DataFrame, size: int, percent: int, order: Order) -> DataFrame:
    """(doc_id, key, n, one, two, prefix): set size, 128-bit digest of the set, its first shingles in global order.

    Of equal sets in a slice only the one with the smallest key gives a prefix, so a hot group of copies arrives at the next
    exchange as one row for each slice; the smallest key of all is always among them.
    """
    small = order._replace(counts=order.counts[:0])  # tasks need the levels only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = small.of_buckets()
        for batch in batches:
            for part in slices(batch, limit=anchors.PIECE):
                h, offsets = shingle_sets(part.column("text"), size)
                n = np.diff(offsets)
                h = h[by_level(h, np.repeat(np.arange(len(n)), n), found)]
                one, two = digests(h, offsets)
                keys = part.column("key").to_numpy(zero_copy_only=False)
                order = np.lexsort((keys, two, one))
                copy = np.zeros(len(n), bool)
                copy[order[1:]] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
                keep = np.where((n > 0) & ~copy, prefix_length(n, percent), 0)
                prefix = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(keep)].astype(np.int32)),
                                                  pa.array(h[spans(offsets[:-1], keep)].view(np.int64)))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("key"), pa.array(n.astype(np.int64)), pa.array(one),
                    pa.array(two), prefix], ["doc_id", "key", "n", "one", "two", "prefix"])

    return texts.mapInArrow(run, "doc_id long, key long, n long, one long, two long, prefix array<long>")


def candidates(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) edges that connect all sets that agree, and few others.

    Sets that agree share at least ``need`` prefix shingles: the prefix that ends first in global order holds all that
    its set shares up to there, so what it doesn't share counts against the overlap. Shingles of up to SMALL_GROUP
    sets are counted for each pair of fitting sizes; a set is paired with at most SMALL_GROUP - 1 others for a shingle. The sets
    of a more frequent shingle are tied to the smallest one, uncounted. So no pair that agrees is missed.
    """
    token = Window.partitionBy("token")
    rows = sets.select("key", "n", F.explode("prefix").alias("token")).select(
        "*", F.count(F.lit(1)).over(token).alias("g"), F.min("key").over(token).alias("least")).filter("g > 1")
    # n is asked for in both, so that one exchange serves both
    large = rows.filter((F.col("g") > SMALL_GROUP) & (F.col("n") > 0)).select(F.col("least").alias("a"), F.col("key").alias("b"))
    before = token.orderBy("n", "key").rowsBetween(-(SMALL_GROUP - 1), -1)
    pairs = rows.filter(F.col("g") <= SMALL_GROUP).select(
        "key", "n", F.collect_list(F.struct("n", "key")).over(before).alias("others")).select(
        "key", "n", F.explode(F.filter("others", lambda o: 100 * o.n >= percent * F.col("n"))).alias("o")).select(
        F.least("key", "o.key").alias("a"), F.greatest("key", "o.key").alias("b"), F.col("o.n").alias("x"), F.col("n").alias("y"))
    up = lambda over, by: F.floor((over + (by - 1)) / by)
    prefix = lambda c: F.col(c) - up(F.col(c) * percent, 100) + 1
    overlap = up((F.col("x") + F.col("y")) * percent, 100 + percent)
    need = F.least(overlap - F.col("x") + prefix("x"), overlap - F.col("y") + prefix("y"))
    counted = pairs.groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= need)
    return counted.select("a", "b").unionByName(large)


class Trie:
    """Sets in global order as a compressed prefix tree; sets[i] are sorted ranks below ``width``."""

    def __init__(self, sets: list[np.ndarray], width: int, percent: int):
        by_bytes = [s.astype(">u4").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=by_bytes.__getitem__)
        self.sets, self.percent, self.width = sets, percent, width
        self.parent = list(range(len(sets)))
        self.links: list[tuple[int, int]] = []
        self._build()

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((i, j))

    def _build(self) -> None:
        """Nodes from the common prefixes of neighbours in sorted order; a node is [depth, first leaf, end, children]."""
        leaves = [self.sets[i] for i in self.order]
        self.nodes, stack = [[0, 0, len(leaves), []]], [0]
        for i, s in enumerate(leaves):
            shared = 0
            if i:
                m = min(len(s), len(leaves[i - 1]))
                differ = np.flatnonzero(s[:m] != leaves[i - 1][:m])
                shared = int(differ[0]) if len(differ) else m
            while self.nodes[stack[-1]][0] > shared:
                last = stack.pop()
                self.nodes[last][2] = i
                if self.nodes[stack[-1]][0] < shared:  # split the edge at the shared depth
                    top = self.nodes[stack[-1]]
                    self.nodes.append([shared, self.nodes[last][1], len(leaves), [last]])
                    top[3][-1] = len(self.nodes) - 1
                    stack.append(len(self.nodes) - 1)
            if len(s) > self.nodes[stack[-1]][0] or not i or len(s) == shared:
                self.nodes.append([len(s), i, len(leaves), []])
                self.nodes[stack[-1]][3].append(len(self.nodes) - 1)
                stack.append(len(self.nodes) - 1)
        while stack:
            last = stack.pop()
            self.nodes[last][2] = len(leaves)
        self.short, self.long = [0] * len(self.nodes), [0] * len(self.nodes)
        sizes = [len(s) for s in leaves]
        for k, (_, a, b, _) in enumerate(self.nodes):
            self.short[k], self.long[k] = min(sizes[a:b]), max(sizes[a:b])

    def agree(self, overlap: int, n: int, m: int) -> bool:
        return 100 * overlap >= self.percent * (n + m - overlap)

    def near(self, order: list[int]) -> None:
        """Try neighbours of an order first: most copies join here."""
        for i, j in zip(order, order[1:], strict=False):
            if self.find(i) != self.find(j) and self.agree(
                    len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)), len(self.sets[i]), len(self.sets[j])):
                self.join(i, j)

    def walk_all(self) -> None:
        """Link every set with every component it agrees with."""
        roots = [self.find(i) for i in self.order]
        change = np.r_[0, np.cumsum(np.array(roots[1:]) != np.array(roots[:-1]))]  # equal at both ends: one component
        uniform = [roots[a] if change[a] == change[b - 1] else -1 for _, a, b, _ in self.nodes]
        mark = np.zeros(self.width, bool)
        for q in self.order:
            s, n = self.sets[q], len(self.sets[q])
            mark[s] = True
            stack = [(0, 0, 0)]
            while stack:
                node, above, overlap = stack.pop()
                if uniform[node] >= 0 and self.find(uniform[node]) == self.find(q):
                    continue
                depth, leaf, _, below = self.nodes[node]
                rest = n
                if depth:
                    path = self.sets[self.order[leaf]][above:depth]
                    overlap += int(np.count_nonzero(mark[path]))
                    rest = n - int(np.searchsorted(s, path[-1], side="right"))
                best = overlap + min(rest, self.long[node] - depth)
                if (100 + self.percent) * best < self.percent * (n + self.short[node]):
                    continue
                other = self.order[leaf]  # ends here, also above longer sets, if it is as long as the path
                if len(self.sets[other]) == depth and other != q and self.agree(overlap, n, depth):
                    self.join(q, other)
                stack.extend((child, depth, overlap) for child in below)
            mark[s] = False

    def pairs(self, side: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(i, those that agree with i) so that each pair comes once; sides 0 and 1 are only paired with each other.

        A level of the tree at a time; nothing is left out but what the remaining lengths rule out.
        """
        depth, first, end = (np.array([x[i] for x in self.nodes]) for i in range(3))
        width = np.array([len(x[3]) for x in self.nodes])
        below = np.array([c for x in self.nodes for c in x[3]], np.int64)
        start = np.cumsum(width) - width
        above = np.zeros(len(depth), np.int64)
        above[below] = np.repeat(depth, width)
        length, order = depth - above, np.array(self.order)
        ranks = np.concatenate([self.sets[order[f]][a:d] for f, a, d in zip(first, above, depth, strict=True)])
        at = np.cumsum(length) - length
        last = ranks[np.maximum(at + length - 1, 0)]
        sizes = np.array([len(self.sets[i]) for i in self.order])
        ends, short, long = sizes[first] == depth, np.array(self.short), np.array(self.long)
        mark = np.zeros(self.width, np.uint8)
        for place, q in enumerate(self.order):
            s, n = self.sets[q], len(self.sets[q])
            mark[s] = 1
            level, overlap, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
            while len(level):
                overlap = np.repeat(overlap, width[level])
                level = below[spans(start[level], width[level])]
                later = end[level] > place + 1
                level, overlap = level[later], overlap[later]
                if not len(level):
                    break
                k = length[level]
                overlap = overlap + np.add.reduceat(mark[ranks[spans(at[level], k)]], np.cumsum(k) - k, dtype=np.int64)
                rest = n - np.searchsorted(s, last[level], side="right")
                best = overlap + np.minimum(rest, long[level] - depth[level])
                keep = (100 + self.percent) * best >= self.percent * (n + short[level])
                level, overlap = level[keep], overlap[keep]
                hit = ends[level] & (first[level] > place) & self.agree_all(overlap, n, depth[level])
                found.append(order[first[level[hit]]])
            mark[s] = 0
            others = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield q, others[(side[others] != side[q]) | (side[q] < 0)]

    def agree_all(self, overlap: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
        return 100 * overlap >= self.percent * (n + m - overlap)


def trie_of(sets: list[np.ndarray], counts: np.ndarray, percent: int) -> Trie:
    everything = np.unique(np.concatenate(sets))
    order = ordered(everything, np.zeros(len(everything), np.int8), counts)
    rank = np.empty(len(everything), np.int64)
    rank[order] = np.arange(len(everything))
    return Trie([np.sort(rank[np.searchsorted(everything, s)]) for s in sets], len(everything), percent)


def link_sets(sets: list[np.ndarray], counts: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between different sets (of shingle hashes) that connect all that agree by ``percent``."""
    trie = trie_of(sets, counts, percent)
    trie.near(trie.order)
    for seed in (1, 3, 5):
        least = [int(mix(s * np.uint64(2 * seed + 1)).min()) for s in sets]
        trie.near(sorted(range(len(sets)), key=lambda i: (least[i], i)))
    trie.walk_all()
    return trie.links


def link_units(rows: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """(a, b) links inside each unit of ``rows`` (unit, key, one, two, set); a unit has bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}  # a key may come with several sets
        unit, out = None, []

        def flush() -> None:
            if len(held) > 1:
                keys = list(held)
                out.extend((keys[i][0], keys[j][0]) for i, j in link_sets(list(held.values()), counts, percent))
            held.clear()

        for batch in batches:
            for u, *key, s in zip(*(batch.column(c).to_pylist() for c in ("unit", "key", "one", "two", "set")), strict=True):
                if u != unit:
                    flush()
                    unit = u
                held[tuple(key)] = np.frombuffer(s, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
            out.clear()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.repartition("unit").sortWithinPartitions("unit", "key").mapInArrow(run, "a long, b long")


def with_keys(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``texts`` without most rows whose key is not in ``wanted``, so that they are not exchanged; 2^KEY_BITS bits of hashed keys tell."""
    at = F.pmod(F.xxhash64("key"), F.lit(1 << KEY_BITS))
    bits = np.zeros((1 << KEY_BITS) // 8, np.uint8)
    per = 1 << 12  # bytes of a bitmap of Spark's
    for r in wanted.select((at + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect():  # one for 2^15 bits
        bits[(r.bucket - 1) * per: r.bucket * per] = np.frombuffer(r.bits, np.uint8)
    packed = zlib.compress(bits.tobytes(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(zlib.decompress(packed), np.uint8)
        for batch in batches:
            at = batch.column("at").to_numpy(zero_copy_only=False)
            yield batch.select(["key", "text"]).filter(pa.array((own[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

    return texts.select("key", "text", at.alias("at")).mapInArrow(run, texts.select("key", "text").schema)


def sets_of(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The rows of ``wanted`` (key, one, two, unit) with the shingle set that has the digest one, two among the key's texts."""
    kind = wanted.schema["unit"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=anchors.PIECE):
                h, offsets = shingle_sets(part.column("text"), size)
                same = np.ones(len(offsets) - 1, bool)
                for name, digest in zip(("one", "two"), digests(h, offsets), strict=True):
                    same &= part.column(name).to_numpy(zero_copy_only=False) == digest
                sets = pa.array([h[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("units", "key", "one", "two")), sets],
                    ["units", "key", "one", "two", "set"]).filter(pa.array(same))

    units = written(wanted.groupBy("key", "one", "two").agg(F.collect_list("unit").alias("units")), "units")
    # the same plan at all sizes: a small side would be broadcast on small inputs only
    found = with_keys(texts.select("key", "text"), units).join(units.hint("merge"), "key").select(
        "units", "key", "one", "two", "text")
    return found.mapInArrow(run, f"units array<{kind}>, key long, one long, two long, set binary").select(
        F.explode("units").alias("unit"), "key", "one", "two", "set")


def grouped(texts: DataFrame, size: int, percent: int, order: Order) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, key, n, one, two, rep) and the classes (key, n, one, two, copies, top, total, k) that may have links.

    top is the candidate group, total and k its shingles and its classes.
    """
    sets = written(prefixes(texts, size, percent, order), "prefixes")
    digest = ["n", "one", "two"]
    classes = written(sets.filter("n > 0").groupBy(*digest).agg(
        F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    members = written(sets.select("doc_id", "key", *digest).join(classes.drop("copies"), digest, "left").select(
        "doc_id", "key", *digest, F.coalesce("rep", "key").alias("rep")), "members")
    groups = components(candidates(sets, percent))
    # classes that share a rep are different texts of one doc_id
    sized = classes.join(groups, classes.rep == groups.node, "left").select(
        F.col("rep").alias("key"), *digest, "copies", F.coalesce("component", "rep").alias("top"))
    totals = sized.groupBy("top").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    return members, written(sized.join(totals, "top").select("key", *digest, "copies", "top", "total", "k"), "groups")


def link_components(docs: DataFrame, size: int = 4, percent: int = 85, text_col: str = "text", id_col: str = "doc_id",
                    group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of every document; links join sets that agree by ``percent``.

    class_id is the smallest doc_id with the same set, component_id the smallest one reachable by links.
    """
    texts = anchors.texts_of(docs, text_col, id_col)
    order = sketch(texts, size)
    counts = order.counts
    members, sized = grouped(texts, size, percent, order)
    sized = sized.drop("k").withColumn("blocks", F.ceil(F.col("total") / F.lit(group_tokens)).cast("long"))
    # one unit for a group, or one for each of its blocks; the sets of least hash are in all blocks
    row = ("key", "one", "two")
    one = sized.filter("blocks = 1").select(*row, F.col("top").alias("unit"))
    many = sized.filter("blocks > 1").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    unit_of = lambda *c: F.xxhash64("top", *c)
    shares = many.select("*", F.row_number().over(Window.partitionBy("top").orderBy(F.xxhash64("key", F.lit(1)))).alias("k")
                         ).filter(F.col("k") <= SHARED_SETS)
    own = many.select(*row, unit_of("block").alias("unit"))
    others = shares.select(*row, "top", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block")).select(
        *row, unit_of("block").alias("unit"))
    wanted = one.unionByName(own).unionByName(others).distinct()
    links = written(link_units(sets_of(texts, wanted, size), counts, percent), "links")
    if not many.isEmpty():
        links = links.unionByName(written(link_units(sets_of(texts, _rest(many, links), size), counts, percent), "links"))
    # rows of one doc_id count as linked, whatever classes they are in
    several = members.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a <> z").drop("z")
    links = links.unionByName(members.join(several, "key").select("a", F.col("rep").alias("b")).distinct())
    found = components(links)
    out = members.join(found, members.rep == found.node, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("c"), "rep")
    back = lambda c: F.when(F.col(c) != LOWEST, F.col(c))
    return out.select("doc_id", "n_shingles", back("c").alias("component_id"), back("rep").alias("class_id"))


def _rest(many: DataFrame, links: DataFrame) -> DataFrame:
    """(key, unit): in each large group, blocks of the sets outside its largest component with every block."""
    found = components(links)
    now = many.join(found, many.key == found.node, "left").select(
        "key", "one", "two", "top", "blocks", "block", F.coalesce("component", "key").alias("now"))
    sizes = now.groupBy("top", "now").agg(F.count(F.lit(1)).alias("k"))
    largest = sizes.groupBy("top").agg(F.max_by("now", F.struct("k", "now")).alias("largest"))
    now = written(now.join(largest, "top"), "rest")
    rest = now.filter("now <> largest")
    pairs = rest.select("top", F.col("block").alias("i")).distinct()
    unit = F.xxhash64("top", "i", "j")
    row = ("key", "one", "two")
    left = rest.select(*row, "top", F.col("block").alias("i"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("j"))
    right = now.join(pairs, "top").select(*row, "top", "i", F.col("block").alias("j"))
    return left.select(*row, unit.alias("unit")).unionByName(right.select(*row, unit.alias("unit"))).distinct()


def pair_units(texts: DataFrame, sized: DataFrame, size: int, group_tokens: int, pair_sets: int) -> DataFrame:
    """(unit, key, one, two, set): every two classes of a group meet in one unit (top, i, j) of two blocks, or of one (i = j)."""
    dealt = sized.withColumn("blocks", F.greatest(F.ceil(F.col("total") / F.lit(group_tokens)), F.ceil(
        F.col("k") / F.lit(pair_sets))).cast("long")).withColumn("block", F.pmod(F.xxhash64("one", "two"), F.col("blocks")))
    every = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    side = F.when(F.col("block") == F.col("other"), -1).otherwise((F.col("block") > F.col("other")).cast("long")).cast("long")
    unit = F.struct("top", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                    side.alias("side"), "copies")
    return sets_of(texts, every.select("key", "one", "two", unit.alias("unit")), size).select(
        "unit.*", "key", "one", "two", "set")


def walk_pairs(rows: DataFrame, counts: np.ndarray, percent: int, each: bool) -> DataFrame:
    """Links inside each unit of ``rows``: with ``each`` one row a pair of classes, else (key, one, two, n) the documents that
    a class is linked with in a unit."""
    names = ["a", "a_one", "a_two", "b", "b_one", "b_two"] if each else ["key", "one", "two", "n"]

    def links(held: dict) -> Iterator[pa.RecordBatch]:
        keys, values = list(held), list(held.values())
        size, side = (np.array([v[i] for v in values], np.int64) for i in (1, 2))
        columns = np.array(keys, np.int64).reshape(-1, 3)
        total = np.zeros(len(keys), np.int64)
        for i, others in trie_of([v[0] for v in values], counts, percent).pairs(side):
            if each and len(others):
                a = np.repeat(columns[i: i + 1], len(others), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*a.T.copy(), *columns[others].T.copy())], names)
            total[i] += size[others].sum()
            total[others] += size[i]
        if not each:
            some = total > 0
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns[some].T.copy(), total[some])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        unit = None
        for batch in batches:
            for *now, side, copies, key, one, two, s in zip(*(batch.column(c).to_pylist() for c in (
                    "top", "i", "j", "side", "copies", "key", "one", "two", "set")), strict=True):
                if now != unit:
                    if len(held) > 1:
                        yield from links(held)
                    held, unit = {}, now
                held[key, one, two] = (np.frombuffer(s, np.uint64), copies, side)
        if len(held) > 1:
            yield from links(held)

    return rows.repartition("top", "i", "j").sortWithinPartitions("top", "i", "j", "key", "one", "two").mapInArrow(
        run, ", ".join(f"{c} long" for c in names))


def link_pairs(docs: DataFrame, size: int = 4, percent: int = 85, text_col: str = "text", id_col: str = "doc_id",
               group_tokens: int = GROUP_TOKENS, pair_sets: int = PAIR_SETS) -> DataFrame:
    """(a, b) with a < b: the class_ids of every two classes whose sets agree; ``link_components`` has the members.

    The rows grow with the square of a group's classes. Classes of one doc_id (it came with several texts) give no pair.
    """
    texts = anchors.texts_of(docs, text_col, id_col)
    order = sketch(texts, size)
    counts = order.counts
    _, sized = grouped(texts, size, percent, order)
    found = walk_pairs(pair_units(texts, sized, size, group_tokens, pair_sets), counts, percent, True)
    back = lambda c: F.when(c != LOWEST, c)
    return found.filter("a <> b").select(back(F.least("a", "b")).alias("a"), back(F.greatest("a", "b")).alias("b")).distinct()


def link_counts(docs: DataFrame, size: int = 4, percent: int = 85, text_col: str = "text", id_col: str = "doc_id",
                group_tokens: int = GROUP_TOKENS, pair_sets: int = PAIR_SETS) -> DataFrame:
    """(doc_id, n_shingles, class_id, n_links) of every row; n_links is the number of other rows whose sets agree with its own.

    Counts are added up where the pairs are found, so no row a pair is made.
    """
    texts = anchors.texts_of(docs, text_col, id_col)
    order = sketch(texts, size)
    counts = order.counts
    members, sized = grouped(texts, size, percent, order)
    found = walk_pairs(pair_units(texts, sized, size, group_tokens, pair_sets), counts, percent, False)
    found = found.groupBy("one", "two").agg(F.sum("n").alias("more"))
    copies = members.filter("n > 0").groupBy("one", "two").agg((F.count(F.lit(1)) - 1).alias("same"))
    per_class = copies.join(found, ["one", "two"], "left").select(
        "one", "two", (F.col("same") + F.coalesce("more", F.lit(0))).alias("n_links"))
    return members.join(per_class, ["one", "two"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("rep") != LOWEST, F.col("rep")).alias("class_id"),
        F.when(F.col("n") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, size: int = 4, percent: int = 85, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The first document (smallest doc_id) of each component, with the columns it came with."""
    found = link_components(docs, size, percent, text_col, id_col)
    keep = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(keep, docs[id_col].eqNullSafe(keep._keep), "left_semi")
