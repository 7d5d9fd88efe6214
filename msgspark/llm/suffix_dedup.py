"""Suffix-array de-duplication: bytes of long strings that also start earlier are removed, the first stays.

Anchors bring the contexts that may share a long string into one task. There a suffix array over the contexts is
sorted by prefix doubling, and each suffix's longest previous factor is read from its previous
and next smaller place in suffix order: if one of the two agrees with it for ``length`` bytes, the
string starts earlier too. Contexts that are equal as a whole need no array (see ``anchors``).

Defined results: a null text is empty; texts shorter than ``length`` lose nothing. Among equal strings the smallest
(doc_id, start) stays; a null doc_id is the smallest. Rows that repeat a doc_id with its text get equal results; if
a doc_id has several texts, the spans of all apply to each. Other columns are not read. Empty in, empty out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import anchors
from .anchors import Scheme

K = 32
HOT_CONTEXTS = 8192  # about 1.4 MB of symbols, the most that one task holds of one anchor


def ranks(codes: np.ndarray) -> np.ndarray:
    order = np.argsort(codes)
    ordered = codes[order]
    out = np.empty(len(codes), np.int32)
    out[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
    return out


def paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first.astype(np.int64) * (int(second.max(initial=0)) + 1) + second


def prefix_ranks(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Rank of the ``depth`` symbols from each position on; the last depth - 1 positions have none."""
    rank, size = ranks(symbols), 1
    while size < depth:
        step = min(size, depth - size)
        rank, size = ranks(paired(rank[: len(rank) - step], rank[step:])), size + step
    return rank


def smaller_before(age: np.ndarray) -> np.ndarray:
    """Index of the nearest earlier entry with a smaller age, or -1: jumps over entries known to be no smaller."""
    to = np.arange(-1, len(age) - 1)
    while True:
        open_ = np.flatnonzero((to >= 0) & (age[np.maximum(to, 0)] >= age))
        if not len(open_):
            return to
        to[open_] = to[to[open_]]


def common_prefix(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Symbols on which positions a and b agree, up to ``limit``; levels: (size, ranks), largest first."""
    same = np.zeros(len(a), np.int64)
    for size, rank in levels:
        room = same + size <= limit
        ok = np.zeros(len(a), bool)
        ok[room] = rank[a[room] + same[room]] == rank[b[room] + same[room]]
        same += size * ok
    return same


def longest_previous(symbols: np.ndarray, starts: np.ndarray, age: np.ndarray, limit: int) -> np.ndarray:
    """Longest previous factor, up to ``limit``, at each of ``starts``: the longest string from there on that
    also starts at one of ``starts`` with a smaller age. Each start has ``limit`` symbols after it."""
    levels, rank, size = [], ranks(symbols), 1
    while True:
        levels.insert(0, (size, rank))
        if 2 * size > limit:
            break
        rank, size = ranks(paired(rank[: len(rank) - size], rank[size:])), 2 * size
    tail = rank[starts + limit - size]
    suffix = np.lexsort((tail, rank[starts]))  # the order of the suffixes by their first ``limit`` symbols
    at, old = starts[suffix], age[suffix]
    best = np.zeros(len(starts), np.int64)
    back = smaller_before(old)
    ahead = len(old) - 1 - smaller_before(old[::-1])[::-1]
    for other in (back, np.where(ahead < len(old), ahead, -1)):
        has = np.flatnonzero(other >= 0)
        best[has] = np.maximum(best[has], common_prefix(levels, at[has], at[other[has]], limit))
    out = np.empty(len(starts), np.int64)
    out[suffix] = best
    return out


def kernel_for(length: int):
    def kernel(symbols: np.ndarray, offsets: np.ndarray, keys: np.ndarray, firsts: np.ndarray):
        room = np.diff(offsets) - length + 1
        starts = anchors.spans(offsets[:-1], room)
        context = np.repeat(np.arange(len(room)), room)
        place = firsts[context] + starts - offsets[context]
        order = np.lexsort((place, keys[context]))
        new = np.r_[False, (keys[context[order]][1:] != keys[context[order]][:-1]) | (place[order][1:] != place[order][:-1])]
        age = np.empty(len(order), np.int64)
        age[order] = np.cumsum(new)
        hit = longest_previous(symbols, starts, age, length) >= length
        return context[hit], place[hit]

    return kernel


def bytes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def find_repeats(docs: DataFrame, length: int = 100, text_col: str = "text", id_col: str = "doc_id",
                 hot: int = HOT_CONTEXTS) -> DataFrame:
    """(doc_id, key, text, spans) of every document; see ``anchors.repeats``."""
    scheme = Scheme(length, min(K, length), same_doc=True)
    texts = anchors.texts_of(docs, text_col, id_col)
    return anchors.repeats(texts, scheme, anchors.byte_symbols, bytes_of, kernel_for(length), hot)


def remove_repeats(docs: DataFrame, length: int = 100, text_col: str = "text", id_col: str = "doc_id",
                   hot: int = HOT_CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): ``kept`` has the remaining bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                data, spans = batch.column("text")[i].as_py().encode(), batch.column("spans")[i]
                kept, runs = data, 0
                if spans.is_valid and data:
                    gone = anchors.covered(spans, len(data))
                    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                rows.append((len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(
                columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return find_repeats(docs, length, text_col, id_col, hot).select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
