"""Substring de-duplication with an FM-index: word windows that also start in an earlier document are removed.

Anchors send the contexts that may share a window to shards of about a megabyte. A shard is indexed once: its words
as ranks, the Burrows-Wheeler transform of the contexts laid end to end, and a wavelet matrix over it
with packed bits and block counts. The contexts are then streamed against the index: backward search
extends a match word by word to the left, and where it reaches the window length, the smallest
document among the matched suffixes tells whether an earlier document holds the window.
Contexts that are equal as a whole are settled without an index (see ``anchors``).

Defined results: a null text has no words; texts with fewer words than a window lose nothing. A window found again in
its own document alone stays. A null doc_id is the smallest. Rows that repeat a doc_id with its text get equal results;
if a doc_id has several texts, the spans of all apply to each. Empty in, empty out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import anchors
from .anchors import Scheme
from .suffix_dedup import prefix_ranks

K = 6
HOT_CONTEXTS = 8192


class WaveletMatrix:
    """rank(c, i): how often symbol c occurs among the first i; one packed bit row for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.rows, current, n = [], symbols, len(symbols)
        for b in range(self.bits - 1, -1, -1):
            bit = ((current >> b) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(n // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            counts = np.r_[0, np.cumsum(np.bitwise_count(words))[:-1]].astype(np.int64)
            zeros = n - int(bit.sum())
            self.rows.append((b, words, counts, zeros))
            current = np.concatenate([current[~bit], current[bit]])
        self.start = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, words, counts, zeros in self.rows:
            block = i >> 6
            below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[block] + np.bitwise_count(words[block] & below)
            i = np.where((c >> b) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._walk(c, i) - self.start[c]


class FMIndex:
    """Texts of word symbols laid end to end; finds patterns of up to ``depth`` words.

    Suffixes are sorted by their first depth + 1 words, which is all that a search of that length can tell apart.
    """

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray, owners: np.ndarray, depth: int):
        self.words, coded = np.unique(symbols, return_inverse=True)
        ends = offsets[1:] + np.arange(len(offsets) - 1)
        text = np.zeros(len(symbols) + len(ends), np.int64)  # 0 ends a text
        inner = np.ones(len(text), bool)
        inner[ends] = False
        text[inner] = coded + 1
        n, sigma = len(text), len(self.words) + 1
        rank = prefix_ranks(np.concatenate([text, np.zeros(depth + 1, np.int64)]), depth + 1)[:n]
        suffix = np.argsort(rank, kind="stable")
        self.n, self.depth = n, depth
        self.below = np.searchsorted(text[suffix], np.arange(sigma))  # suffixes that start with a smaller symbol
        self.bwt = WaveletMatrix(text[suffix - 1], sigma)
        owner = np.repeat(owners, np.diff(offsets) + 1)[suffix]
        self.least = [owner]  # least[j][i]: smallest owner among suffixes i .. i + 2^j - 1
        while 2 << len(self.least) - 1 <= n:
            a, half = self.least[-1], 1 << len(self.least) - 1
            self.least.append(np.minimum(a[:-half], a[half:]))

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Ranks of words in the index; 0 for a word it doesn't hold."""
        at = np.minimum(np.searchsorted(self.words, words), max(0, len(self.words) - 1))
        return np.where(self.words[at] == words, at + 1, 0) if len(self.words) else np.zeros(len(words), np.int64)

    def match(self, stream: np.ndarray, ends: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics: for each end position in ``stream`` the length of the longest match that ends
        before it, at most ``limit`` and the depth, with its suffix interval."""
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        length, live = np.zeros(len(ends), np.int64), np.arange(len(ends))
        for step in range(1, self.depth + 1):
            live = live[limit[live] >= step]
            c = stream[ends[live] - step]
            live, c = live[c > 0], c[c > 0]
            a = self.below[c] + self.bwt.rank(c, low[live])
            b = self.below[c] + self.bwt.rank(c, high[live])
            live, a, b = live[a < b], a[a < b], b[a < b]
            if not len(live):
                break
            low[live], high[live], length[live] = a, b, step
        return length, low, high

    def first_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest owner among the suffixes of each interval."""
        out, level = np.empty(len(low), np.int64), np.frexp(high - low)[1] - 1
        for j, least in enumerate(self.least):
            own = level == j
            out[own] = np.minimum(least[low[own]], least[high[own] - (1 << j)])
        return out


def kernel_for(window: int):
    def kernel(symbols: np.ndarray, offsets: np.ndarray, keys: np.ndarray, firsts: np.ndarray):
        index = FMIndex(symbols, offsets, keys, window)
        room = np.maximum(0, np.diff(offsets) - window + 1)
        starts = anchors.spans(offsets[:-1], room)
        context = np.repeat(np.arange(len(room)), room)
        length, low, high = index.match(index.symbols(symbols), starts + window, np.full(len(starts), window))
        hit = length == window
        hit[hit] = index.first_owner(low[hit], high[hit]) < keys[context[hit]]
        return context[hit], (firsts[context] + starts - offsets[context])[hit]

    return kernel


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return anchors.word_values(data, np.array([0, len(data)]))[0]


def find_repeats(docs: DataFrame, window: int = 13, text_col: str = "text", id_col: str = "doc_id",
                 hot: int = HOT_CONTEXTS) -> DataFrame:
    """(doc_id, key, text, spans) of every document; see ``anchors.repeats``."""
    scheme = Scheme(window, min(K, window), same_doc=False)
    texts = anchors.texts_of(docs, text_col, id_col)
    return anchors.repeats(texts, scheme, anchors.word_symbols, word_hashes, kernel_for(window), hot)


def remove_repeats(docs: DataFrame, window: int = 13, text_col: str = "text", id_col: str = "doc_id",
                   hot: int = HOT_CONTEXTS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text): ``kept_text`` has the kept words joined by a space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                words, spans = batch.column("text")[i].as_py().encode().split(), batch.column("spans")[i]
                n = len(words)
                if spans.is_valid and n:
                    gone = anchors.covered(spans, n)
                    words = [words[j] for j in np.flatnonzero(~gone)]
                kept = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(
                columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return find_repeats(docs, window, text_col, id_col, hot).select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def cut_repeats(docs: DataFrame, window: int = 13, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents with repeated windows taken out of their texts, other columns as they came.

    A text that loses nothing stays as it is, white space included; one that loses words has the rest joined by a space.
    Rows that repeat a doc_id keep their own texts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for i in range(batch.num_rows):
                text, spans = batch.column("text")[i].as_py(), batch.column("spans")[i]
                if spans.is_valid and text:
                    words = text.encode().split()
                    gone = anchors.covered(spans, len(words))
                    if gone.any():
                        text = b" ".join([words[j] for j in np.flatnonzero(~gone)]).decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], batch_names)

    batch_names = ["row", "text"]
    found = find_repeats_with_rows(docs, window, text_col, id_col)
    schema = f"row struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in docs.schema)}>, text string"
    done = found.select("row", "text", "spans").mapInArrow(run, schema)
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def find_repeats_with_rows(docs: DataFrame, window: int, text_col: str, id_col: str) -> DataFrame:
    """``find_repeats`` with the input row as a struct, for documents whose other columns go on."""
    scheme = Scheme(window, min(K, window), same_doc=False)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(anchors.LOWEST)).alias("key"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct("*").alias("row"))
    return anchors.repeats(texts, scheme, anchors.word_symbols, word_hashes, kernel_for(window), HOT_CONTEXTS)
