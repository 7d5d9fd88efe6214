"""Anchors: content-chosen places that bring repeated windows of symbols together.

Each run of ``window`` symbols takes its smallest k-gram (leftmost on ties) as anchor. Equal windows
choose the same anchor at the same offset, so two documents that share a window meet under
their anchor's hash, wherever the window stands. An anchor's context is everything that windows around it
can cover. Contexts that are equal as a whole are settled by comparing places; only those
that differ although their anchors agree need their symbols compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .batches import slices, spans, utf8
from .storage import written

LOWEST = -(1 << 63)
PIECE = 1 << 19
PLACE_BITS = 10  # a window has fewer than 2^10 symbols
ROW_BITS = np.uint64((1 << 20) - 1)
BASE = 0x9E3779B97F4A7C15 | 1
M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


@dataclass(frozen=True)
class Scheme:
    """``same_doc``: an earlier start in the same document counts as a repeat too."""
    window: int
    k: int
    same_doc: bool

    @property
    def before(self) -> int:
        return self.window - self.k


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, PIECE + 4096)
        _powers[:] = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """p with hash of values[a:b] = (p[b] - p[a]) * BASE^-a."""
    p = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=p[1:])
    return p


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def _hashed(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte string, eight bytes after eight: what a step takes in is mixed before the next one, so
    no sum over places can cancel out."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, np.uint64, padded, strides=(1,))  # the eight bytes from each place on
    h, live, at = length.astype(np.uint64) * M3, np.arange(len(first)), 0
    while len(live):
        left = length[live] - at
        h[live] = mix((h[live] ^ (eight[first[live] + at] & LOW_BYTES[np.minimum(left, 8)])) * M1 + M2)
        live, at = live[left > 8], at + 8
    return h


def word_values(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the offsets of the texts among the words.

    Worked in pieces that end after white space, so a long text needs no more memory than its words.
    """
    values, counts, a, end = [], np.zeros(len(offsets), np.int64), int(offsets[0]), int(offsets[-1])
    while a < end:
        b = min(end, a + PIECE)
        while b < end and not SPACE[data[b - 1]]:
            gap = np.flatnonzero(SPACE[data[max(a, b - 4096): b]])
            if len(gap) and max(a, b - 4096) + gap[-1] + 1 > a:
                b = max(a, b - 4096) + int(gap[-1]) + 1
            else:
                b = min(end, b + PIECE)
        word = ~SPACE[data[a:b]]
        cut = offsets[(offsets > a) & (offsets < b)] - a
        starts = word.copy()
        starts[1:] &= ~word[:-1]
        starts[cut] = word[cut]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        ends[cut - 1] = word[cut - 1]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        values.append(_hashed(data[a:b], s, e - s))
        counts += np.searchsorted(s + a, offsets, side="left")
        a = b
    return (np.concatenate(values) if values else np.zeros(0, np.uint64)), counts


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size:]) if size < w else x


def find(values: Callable[[int, int], np.ndarray], offsets: np.ndarray, scheme: Scheme) -> Iterator[tuple]:
    """(text, position, right, hash, context) arrays of the anchors of texts laid end to end.

    ``values(a, b)`` gives symbols a to b as 64-bit numbers; ``right``: symbols from the anchor to the
    end of its context. Long inputs are worked in overlapping pieces, so an anchor may come twice.
    """
    k, window, w, n = scheme.k, scheme.window, scheme.window - scheme.k + 1, int(offsets[-1])
    for s0 in range(0, n, PIECE):
        s1 = min(n, s0 + PIECE)
        lo, hi = max(0, s0 - window), min(n, s1 + 2 * window)
        if hi - lo < window:
            continue
        p, inverse = prefix_sums(values(lo, hi)), powers(hi - lo + 1)[1]
        h = mix((p[k:] - p[:-k]) * inverse[: len(p) - k])
        best = sliding_min((h & ~ROW_BITS) | np.arange(len(h), dtype=np.uint64), w)
        ok = np.zeros(len(best), bool)
        ok[s0 - lo: s1 - lo] = True
        ends = offsets[1:][(offsets[1:] > lo) & (offsets[1:] < hi)] - lo
        first = np.maximum(ends - window + 1, 0)
        over = spans(first, ends - first)
        ok[over[over < len(ok)]] = False
        a = (best[ok] & ROW_BITS).astype(np.int64)
        if not len(a):
            continue
        a = a[np.r_[True, a[1:] != a[:-1]]]
        text = np.searchsorted(offsets, a + lo, side="right") - 1
        pos = a + lo - offsets[text]
        left = np.minimum(scheme.before, pos)
        right = np.minimum(window, offsets[text + 1] - a - lo)
        context = mix((p[a + right] - p[a - left]) * inverse[a - left]
                      + left.astype(np.uint64) * M2 + right.astype(np.uint64) * M3)
        yield text, pos, right, h[a], context


Symbols = Callable[[np.ndarray, np.ndarray], tuple[Callable[[int, int], np.ndarray], np.ndarray]]


def byte_symbols(data: np.ndarray, offsets: np.ndarray):
    at = int(offsets[0])
    return (lambda a, b: BYTE_VALUES[data[at + a: at + b]]), offsets - at


def word_symbols(data: np.ndarray, offsets: np.ndarray):
    values, words = word_values(data, offsets)
    return (lambda a, b: values[a:b]), words


def texts_of(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(doc_id, key, text): key is doc_id with null as the lowest number, text null as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit(LOWEST)).alias("key"), "text")


def tagged(texts: DataFrame) -> DataFrame:
    """``texts`` with ``tag``, which tells different texts under one key apart: 0 where a key has one text, else its hash."""
    digest = F.xxhash64("text")
    shared = written(texts.groupBy("key").agg(F.min(digest).alias("a"), F.max(digest).alias("b")).filter("a <> b").select("key"), "shared")
    if shared.isEmpty():
        return texts.withColumn("tag", F.lit(0).cast("long"))
    known = texts.join(shared.withColumn("_shared", F.lit(True)), "key", "left")
    return known.withColumn("tag", F.when(F.col("_shared"), digest).otherwise(F.lit(0))).drop("_shared")


def anchor_rows(texts: DataFrame, scheme: Scheme, symbols: Symbols) -> DataFrame:
    """(h, context, key, tag, at) of each anchor; at = position * 2^10 + right.

    Copies that meet in one slice of a batch are settled on the spot: the later ones get at < 0 and a
    key of their own instead of their anchor's, so a hot group arrives as one row for each slice.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=PIECE):
                values, offsets = symbols(*utf8(part.column("text")))
                keys, tags = (part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "tag"))
                for text, pos, right, h, context in find(values, offsets, scheme):
                    key, tag, at = keys[text], tags[text], (pos << PLACE_BITS) | right
                    order = np.lexsort((at, key, context, h))
                    key, tag, at, h, context = key[order], tag[order], at[order], h[order], context[order]
                    new = np.r_[True, (h[1:] != h[:-1]) | (context[1:] != context[:-1])]
                    first = np.flatnonzero(new)[np.cumsum(new) - 1]
                    later = key > key[first]
                    if scheme.same_doc:
                        later |= (key == key[first]) & (at > at[first])
                    salt = mix(key.astype(np.uint64) * M1 + at.astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.where(later, salt, h).view(np.int64)), pa.array(context.view(np.int64)), pa.array(key),
                        pa.array(tag), pa.array(np.where(later, -at - 1, at))], ["h", "context", "key", "tag", "at"])

    return texts.select("key", "tag", "text").mapInArrow(run, "h long, context long, key long, tag long, at long")


def spots(texts: DataFrame, scheme: Scheme, symbols: Symbols, hot: int) -> DataFrame:
    """(key, tag, at, h, kind): where repeats are (kind "span") and which contexts must be compared ("ask").

    Written once. Rows meet by anchor hash; a context with an earlier equal one is a span, any other context
    whose anchor is met with another context is asked for ("hot" if over ``hot`` contexts differ).
    """
    same, anchor = Window.partitionBy("h", "context").orderBy("key", "at"), Window.partitionBy("h")
    rows = anchor_rows(texts, scheme, symbols).repartition("h").withColumn("top", F.first(F.struct("key", "at")).over(same))
    later = F.col("key") > F.col("top.key")
    if scheme.same_doc:
        later = later | (F.col("at") > F.col("top.at"))
    leads = (F.col("key") == F.col("top.key")) & (F.col("at") == F.col("top.at"))
    kind = F.when(F.col("at") < 0, "span").when(later, "span").when(F.col("n") > hot, "hot").when(F.col("n") > 1, "ask")
    found = rows.withColumn("n", F.sum(leads.cast("long")).over(anchor)).select(
        "key", "tag", F.when(F.col("at") < 0, -F.col("at") - 1).otherwise(F.col("at")).alias("at"), "h", kind.alias("kind"))
    return written(found.filter("kind is not null"), "spots")


def first_of(at: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """First symbol and number of symbols of the contexts."""
    pos, right = at >> PLACE_BITS, at & ((1 << PLACE_BITS) - 1)
    left = np.minimum(scheme.before, pos)
    return pos - left, left + right


def context_spans(found: DataFrame, scheme: Scheme) -> DataFrame:
    """(key, tag, span) of the settled contexts; span = first symbol * 2^10 + length."""
    pos, right = F.shiftright("at", PLACE_BITS), F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    left = F.least(F.lit(scheme.before).cast("long"), pos)
    return found.filter("kind = 'span'").select(
        "key", "tag", (F.shiftleft(pos - left, PLACE_BITS) + left + right).alias("span"))


def asked(texts: DataFrame, found: DataFrame, kind: str) -> DataFrame:
    """(key, tag, text, asks): each text that has contexts of ``kind`` with their (at, h)."""
    asks = found.filter(F.col("kind") == kind).groupBy("key", "tag").agg(F.collect_list(F.struct("at", "h")).alias("asks"))
    return texts.join(asks, ["key", "tag"]).select("key", "tag", "text", "asks")


def merged(starts: np.ndarray, run: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans (first row of ``starts``, length) of runs of consecutive window starts; ``run`` tells contexts apart."""
    cut = np.flatnonzero(np.r_[True, (starts[1:] != starts[:-1] + 1) | (run[1:] != run[:-1])])
    last = np.r_[cut[1:], len(starts)] - 1
    return cut, starts[last] - starts[cut] + window


def compared(texts: DataFrame, found: DataFrame, scheme: Scheme, symbols_of: Callable, kernel: Callable) -> DataFrame:
    """(key, tag, span) of the repeats inside contexts that differ although their anchors agree.

    ``symbols_of(text)`` gives a text's symbols as an array; ``kernel(symbols, offsets, keys, firsts)`` gets whole
    anchor groups of about a megabyte together and returns (context, window start) of the repeats.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                symbols, asks = symbols_of(batch.column("text")[i].as_py()), batch.column("asks")[i].values
                at, h = (asks.field(c).to_numpy(zero_copy_only=False) for c in ("at", "h"))
                first, length = first_of(at, scheme)
                yield pa.RecordBatch.from_arrays([
                    pa.array(h), *(pa.array(np.full(len(h), batch.column(c)[i].as_py(), np.int64)) for c in ("key", "tag")), pa.array(first),
                    pa.array([symbols[a: a + n].tobytes() for a, n in zip(first, length, strict=True)], pa.binary())],
                    ["h", "key", "tag", "first", "data"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def flush(table: pa.Table) -> pa.RecordBatch:
            data = table.column("data").to_pylist()
            keys, tags, firsts = (table.column(c).to_numpy() for c in ("key", "tag", "first"))
            lengths = np.array([len(x) for x in data], np.int64) // symbol_size
            symbols = np.frombuffer(b"".join(data), symbol_type)
            context, start = kernel(symbols, np.r_[0, np.cumsum(lengths)], keys, firsts)
            if not len(start):
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, ["key", "tag", "span"])
            row, length = merged(start, context, scheme.window)
            return pa.RecordBatch.from_arrays([pa.array(keys[context[row]]), pa.array(tags[context[row]]), pa.array(
                (start[row] << PLACE_BITS) | length)], ["key", "tag", "span"])

        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                held.append(pa.Table.from_batches([part]))
                size += part.nbytes
                if size < PIECE:
                    continue
                table = pa.concat_tables(held)
                h = table.column("h").to_numpy()
                whole = int(np.searchsorted(h, h[-1]))  # the last group may go on
                if whole:
                    yield flush(table.slice(0, whole).combine_chunks())
                held = [table.slice(whole).combine_chunks()]
                size = held[0].nbytes
        if held and sum(t.num_rows for t in held):
            yield flush(pa.concat_tables(held).combine_chunks())

    symbol_type = np.asarray(symbols_of("")).dtype
    symbol_size = symbol_type.itemsize
    contexts = asked(texts, found, "ask").mapInArrow(cut, "h long, key long, tag long, first long, data binary")
    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(search, "key long, tag long, span long")


def hot_spans(texts: DataFrame, found: DataFrame, scheme: Scheme, symbols_of: Callable) -> DataFrame:
    """(key, tag, span) of repeats among the contexts of hot anchors, window by window.

    Each window goes under its own 128-bit hash and the earliest place of a hash is found with partial sums, so
    an anchor that a third of all documents share is spread over as many keys as it has different windows.
    """
    window = scheme.window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                symbols, asks = symbols_of(batch.column("text")[i].as_py()), batch.column("asks")[i].values
                first, length = first_of(asks.field("at").to_numpy(zero_copy_only=False), scheme)
                start = np.unique(spans(first, length - window + 1))
                wide = BYTE_VALUES[symbols] if symbols.dtype == np.uint8 else symbols
                one, two = (np.zeros(len(start), np.uint64) for _ in range(2))
                for j in range(window):
                    one = mix(one + wide[start + j])
                    two = (two ^ wide[start + j]) * M3 + (two >> np.uint64(17))
                yield pa.RecordBatch.from_arrays([
                    pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                    *(pa.array(np.full(len(start), batch.column(c)[i].as_py(), np.int64)) for c in ("key", "tag")), pa.array(start)],
                    ["one", "two", "key", "tag", "start"])

    rows = asked(texts, found, "hot").mapInArrow(cut, "one long, two long, key long, tag long, start long")
    tops = rows.groupBy("one", "two").agg(F.min(F.struct("key", "start")).alias("top"), F.count(F.lit(1)).alias("n"))
    later = F.col("key") > F.col("top.key")
    if scheme.same_doc:
        later = later | (F.col("start") > F.col("top.start"))
    return rows.join(tops.filter("n > 1"), ["one", "two"]).filter(later).select(
        "key", "tag", (F.shiftleft("start", PLACE_BITS) + F.lit(window)).alias("span"))


def repeats(texts: DataFrame, scheme: Scheme, symbols: Symbols, symbols_of: Callable, kernel: Callable,
            hot: int) -> DataFrame:
    """``texts`` with ``spans``: all (first * 2^10 + length) spans of a text covered by repeated windows, or null.

    Different texts under one key have the same age and each its own spans.
    """
    texts = tagged(texts)
    found = spots(texts, scheme, symbols, hot)
    all_spans = context_spans(found, scheme).unionByName(
        compared(texts, found, scheme, symbols_of, kernel)).unionByName(hot_spans(texts, found, scheme, symbols_of))
    return texts.join(all_spans.groupBy("key", "tag").agg(F.collect_list("span").alias("spans")), ["key", "tag"], "left")


def covered(spans_of: pa.Scalar, n: int) -> np.ndarray:
    """Which of n symbols the spans cover."""
    span = spans_of.values.to_numpy(zero_copy_only=False)
    first, length = span >> PLACE_BITS, span & ((1 << PLACE_BITS) - 1)
    edge = np.bincount(np.minimum(first, n), minlength=n + 1) - np.bincount(np.minimum(first + length, n), minlength=n + 1)
    return np.cumsum(edge)[:n] > 0
