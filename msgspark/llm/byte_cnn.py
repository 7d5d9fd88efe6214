"""Quality classifier: a convolutional network over bytes, in numpy.

Each byte has fixed features (its kind, and a random code). Filters of WIDTH bytes run over the whole text every STRIDE bytes;
their rectified outputs are max-pooled over overlapping chunks of 2 * HALF bytes, half a chunk apart. Over the chunks of a
document the largest, smallest and mean pooled value of each filter go into one logistic unit: the smallest
tells of chunks without variety, which repeated text leaves behind. Filters and unit are trained together.

Training takes at most SAMPLE labelled documents, half of each class, those of least hash; the unit's bias is then shifted to
the classes' shares among all labelled rows. Scoring reads every byte of every text, in Arrow batches.

Defined results: a null or empty text is scored as one chunk of padding. Labels other than 0 and 1, and labels without a
document, are left out; repeated labels count once (the smaller one). Without labels of both classes the score is the share
of label 1, or 0.5. Repeated rows get equal scores. Other columns are never read. Empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .batches import slices, spans, utf8

WIDTH, STRIDE, HALF, FILTERS = 8, 4, 128, 32
SAMPLE, EPOCHS, BATCH, RATE = 2400, 6, 24, 3e-3
PIECE = 1 << 20
PAD = 256
DIGITS = 5  # of a score: sums of 32-bit numbers differ beyond them with the rows beside a text


def byte_features(seed: int = 5) -> np.ndarray:
    """Features of the 256 bytes; the last row is padding."""
    b, kinds = np.arange(256), []
    for low, high in ((65, 90), (97, 122), (48, 57), (32, 32), (9, 10), (33, 47), (58, 64), (123, 126), (128, 191), (192, 255)):
        kinds.append((b >= low) & (b <= high))
    kinds.append(np.isin(b, list(b"#*$%&|<>")))
    code = np.random.default_rng(seed).standard_normal((256, 16 - len(kinds))) * 0.5
    return np.vstack([np.column_stack([np.array(kinds, float).T, code]), np.zeros(16)]).astype(np.float32)


class Network:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.features = byte_features()
        n_in = WIDTH * self.features.shape[1]
        self.filters = (rng.standard_normal((n_in, FILTERS)) * np.sqrt(2 / n_in)).astype(np.float32)
        self.offset = np.zeros(FILTERS, np.float32)
        self.unit = (rng.standard_normal(3 * FILTERS) * 0.05).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def laid_out(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts padded to whole half chunks, and the half chunks of each. Each begins with as much padding as the last window
        before it reaches over, so no window of a text sees bytes of the next one."""
        n = np.diff(offsets)
        halves = -(-(n + WIDTH - STRIDE) // HALF)
        out = np.full(int(halves.sum()) * HALF + WIDTH, PAD, np.int16)
        out[spans((np.cumsum(halves) - halves) * HALF + WIDTH - STRIDE, n)] = data[offsets[0]: offsets[-1]]
        return out, halves

    def inputs(self, symbols: np.ndarray) -> np.ndarray:
        x = self.features[symbols]
        windows = np.lib.stride_tricks.sliding_window_view(x.reshape(-1), WIDTH * x.shape[1])[:: STRIDE * x.shape[1]]
        return windows[: (len(symbols) - WIDTH) // STRIDE]

    def halves(self, symbols: np.ndarray) -> np.ndarray:
        """Largest output of each filter in each half chunk, piece by piece."""
        out, per = [], HALF // STRIDE
        for a in range(0, len(symbols) - WIDTH, PIECE):
            z = np.ascontiguousarray(self.inputs(symbols[a: a + PIECE + WIDTH])) @ self.filters
            out.append(z.reshape(-1, per, FILTERS).max(1))
        return np.maximum(np.concatenate(out) + self.offset, 0)

    def pooled(self, h: np.ndarray, n: np.ndarray):
        """Document vectors; and what training needs: chunk values, chunks of each document, halves of each chunk."""
        chunks = np.maximum(1, n - 1)
        first = spans(np.cumsum(n) - n, chunks)
        second = np.where(np.repeat(n > 1, chunks), first + 1, first)
        c = np.maximum(h[first], h[second])
        at = np.cumsum(chunks) - chunks
        high, low = np.maximum.reduceat(c, at), np.minimum.reduceat(c, at)
        mean = np.add.reduceat(c, at) / chunks[:, None]
        return np.hstack([high, low, mean]).astype(np.float32), c, chunks, first, second

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        symbols, n = self.laid_out(data, offsets)
        vector = self.pooled(self.halves(symbols), n)[0]
        return 1 / (1 + np.exp(-np.clip(vector.astype(np.float64) @ self.unit + self.bias, -40, 40)))

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
        data = np.frombuffer(b"".join(texts), np.uint8)
        symbols, n = self.laid_out(data, np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64))
        x, per = np.ascontiguousarray(self.inputs(symbols)), HALF // STRIDE
        z = (x @ self.filters + self.offset).reshape(-1, per, FILTERS)
        best = z.argmax(1)
        h = np.maximum(z.max(1), 0)
        vector, c, chunks, first, second = self.pooled(h, n)
        p = 1 / (1 + np.exp(-np.clip(vector @ self.unit + self.bias, -40, 40)))
        error = ((p - labels) / len(labels)).astype(np.float32)
        to = error[:, None] * self.unit
        doc = np.repeat(np.arange(len(n)), chunks)
        dc = (to[doc, 2 * FILTERS:] / chunks[doc, None]).astype(np.float32)
        for part, k in ((vector[:, :FILTERS], 0), (vector[:, FILTERS: 2 * FILTERS], 1)):  # to the chunks that gave the extreme
            hit = (c == part[doc]).astype(np.float32)
            ties = np.add.reduceat(hit, np.cumsum(chunks) - chunks)
            dc += hit * (to[:, k * FILTERS: (k + 1) * FILTERS] / ties)[doc]
        dh = np.zeros_like(h)
        take = h[first] >= h[second]
        np.add.at(dh, first, dc * take)
        np.add.at(dh, second, dc * ~take)
        dh *= h > 0
        rows = np.arange(len(h))[:, None] * per + best
        d_filters = np.column_stack([x[rows[:, f]].T @ dh[:, f] for f in range(FILTERS)])
        return [d_filters, dh.sum(0), vector.T @ error, error.sum(keepdims=True)]

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        params = [self.filters, self.offset, self.unit, self.bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), BATCH):
                own, t = order[a: a + BATCH], t + 1
                for k, g in enumerate(self.gradients([texts[i] for i in own], labels[own])):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    params[k] -= (RATE * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.99 ** t)) + 1e-7)).astype(np.float32)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id, as text, leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text",
          id_col: str = "doc_id") -> Network:
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(
        F.min(label_col).alias("label"))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = [r for y in (0, 1) for r in known.filter(F.col("label") == y).orderBy(
        F.xxhash64(id_col), id_col).limit(SAMPLE // 2).collect()]  # bounded by SAMPLE
    net = Network()
    texts = {}
    if chosen:
        ids = F.broadcast(docs.sparkSession.createDataFrame([(r[id_col],) for r in chosen], "_id long"))
        texts = {r[id_col]: (r.t or "").encode() for r in docs.join(ids, F.col(id_col) == F.col("_id")).select(
            id_col, F.col(text_col).alias("t")).toLocalIterator()}
    rows = [(texts[r[id_col]], r.label) for r in chosen if r[id_col] in texts]
    y = np.array([label for _, label in rows], np.float32)
    ones, zeros = int((y == 1).sum()), int((y == 0).sum())
    total = sum(counts.values())
    if ones and zeros:
        net.fit([t for t, _ in rows], y)
        net.bias += np.float32(np.log(counts[1] / counts[0]) - np.log(ones / zeros))
    else:
        share = (counts.get(1, 0) + 1) / (total + 2)
        net.unit[:] = 0
        net.bias[:] = np.log(share / (1 - share))
    return net


def score(docs: DataFrame, net: Network, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=PIECE):
                scores = np.round(model.value.score(*utf8(part.column("text"))), DIGITS)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(scores),
                                                  pa.array((scores >= 0.5).astype(np.int32))],
                                                 ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")
