"""Nearest neighbours by largest inner product: a forest of random-projection trees, searched through one queue.

The trees are fitted to a bounded sample (``SAMPLE`` rows of least hash): each node halves its sample at the median of
one random direction. Inner products become angles by one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, so longer
vectors sort right. Every row is indexed: it carries its leaf in each tree. A query walks all trees
through a shared priority queue of branches, nearest hyperplanes first, until the leaves it took hold ``share`` of the sample.
Rows and queries are dealt into blocks; a unit joins one block of each, takes the rows of the query's leaves as candidates
and ranks them exactly, in double precision on the original vectors.

``share`` fixes the recall. Vectors without structure need about half of all rows for 0.95 at rank k, and more where the k nearest
are a larger part of all n; the default is 0.5 + 1.5 sqrt(k / n), measured on such vectors. Clustered vectors need far less.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part, nor do vectors of another
length than most of the sample. Fewer candidates than asked for are all returned. Equal scores go by the smaller vec_id;
repeated ids are candidates each, and a query's own id is none of its candidates. Empty in, empty out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .storage import written

SAMPLE = 16_384
TREES = 16
DEPTH = 8
LEAST_LEAF = 4
SHARE, SPREAD = 0.5, 1.5
ROW_BLOCK = 8192
QUERY_BLOCK = 2048
SLACK = 1e-9


class Forest:
    def __init__(self, sample: np.ndarray, top: float, trees: int = TREES, depth: int = DEPTH, seed: int = 7):
        self.top = top
        points = self.lifted(sample)
        rng = np.random.default_rng(seed)
        self.depth = max(0, min(depth, int(np.log2(max(1, len(points) / LEAST_LEAF)))))
        inner = (1 << self.depth) - 1
        self.normals = rng.standard_normal((trees, max(1, inner), points.shape[1])).astype(np.float32)
        self.normals /= np.linalg.norm(self.normals, axis=2, keepdims=True)
        self.cuts = np.zeros((trees, max(1, inner)), np.float32)
        for t in range(trees):
            at = np.zeros(len(points), np.int64)
            for node in range(inner):
                own = np.flatnonzero(at == node)
                side = points[own] @ self.normals[t, node]
                self.cuts[t, node] = np.median(side) if len(own) else 0
                at[own] = 2 * node + 1 + (side >= self.cuts[t, node])
        leaves = self.leaves(points)
        self.members = [[np.flatnonzero(leaves[:, t] == k) for k in range(1 << self.depth)] for t in range(trees)]
        self.size = len(points)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.top
        rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", x, x)))
        return np.column_stack([x, rest]).astype(np.float32)

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """Leaf of each lifted point in each tree."""
        out = np.zeros((len(points), len(self.normals)), np.int64)
        for t, normals in enumerate(self.normals):
            at = np.zeros(len(points), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", points, normals[at])
                at = 2 * at + 1 + (side >= self.cuts[t, at])
            out[:, t] = at - ((1 << self.depth) - 1)
        return out

    def visit(self, queries: np.ndarray, share: float) -> np.ndarray:
        """Which leaf of which tree each query takes: (queries, trees, leaves) flags."""
        trees, leaves = len(self.normals), 1 << self.depth
        norm = np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-300)
        points = np.column_stack([queries / norm, np.zeros(len(queries))]).astype(np.float32)
        taken = np.zeros((len(queries), trees, leaves), bool)
        for q, point in enumerate(points):
            margin = (self.normals @ point - self.cuts).tolist()
            seen, found = np.zeros(self.size, bool), 0
            queue = [(0.0, t, 0) for t in range(trees)]
            while queue and found < share * self.size:
                far, t, node = heapq.heappop(queue)
                while node < leaves - 1:
                    m = margin[t][node]
                    near = 2 * node + 1 + (m >= 0)
                    heapq.heappush(queue, (far + m * m, t, 4 * node + 3 - near))
                    node = near
                leaf = node - leaves + 1
                taken[q, t, leaf] = True
                own = self.members[t][leaf]
                found += len(own) - int(np.count_nonzero(seen[own]))
                seen[own] = True
        return taken


def usable(vectors: DataFrame, vector_col: str, id_col: str) -> DataFrame:
    """(id, v): rows with a finite vector that isn't zero, as doubles."""
    v = F.col(vector_col).cast("array<double>")
    good = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull()).filter(good)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of row pairs, summed in the order of the components whatever the batch."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def rank_unit(rows: np.ndarray, ids: np.ndarray, leaves: np.ndarray, queries: np.ndarray, query_ids: np.ndarray,
              taken: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query among the rows: (query id, id, score)."""
    score = queries @ rows.T
    candidate = np.zeros(score.shape, bool)
    for t in range(leaves.shape[1]):
        candidate |= taken[:, t][:, leaves[:, t]]
    candidate &= query_ids[:, None] != ids[None, :]
    score[~candidate] = -np.inf
    cut = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), -np.inf)
    cut = np.where(np.isfinite(cut), cut - SLACK * (1 + np.abs(cut)), -np.finfo(float).max)
    q, r = np.nonzero(score >= cut[:, None])
    exact = exact_scores(queries[q], rows[r])
    order = np.lexsort((ids[r], -exact, q))
    q, r, exact = q[order], r[order], exact[order]
    first = np.searchsorted(q, np.arange(len(queries)))
    keep = np.arange(len(q)) - first[q] < k
    return query_ids[q[keep]], ids[r[keep]], exact[keep]


def nearest(vectors: DataFrame, is_query, k: int = 20, share: float | None = None, vector_col: str = "embedding",
            id_col: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row that ``is_query`` (a column of ``id``) marks."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    good = usable(vectors, vector_col, id_col)
    sample = good.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    if not len(sample):
        return spark.createDataFrame([], out)
    lengths = np.diff(sample.offsets.to_numpy())
    width = int(np.bincount(lengths).argmax())
    points = matrix(sample.filter(pa.array(lengths == width)))
    good = good.filter(F.size("v") == width)
    # an exact bound isn't needed for the lift, only one that no norm passes
    top, n, n_queries = good.agg(
        F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))), F.count(F.lit(1)),
        F.count(F.when(is_query, 1))).first()
    share = min(1.0, SHARE + SPREAD * (k / max(1, n)) ** 0.5) if share is None else share
    forest = spark.sparkContext.broadcast(Forest(points, top))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for batch in batches:
            leaves = f.leaves(f.lifted(matrix(batch.column("v")))).astype(np.int16)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in leaves], pa.binary())],
                                             [*batch.schema.names, "leaves"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for batch in batches:
            taken = f.visit(matrix(batch.column("v")), share)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(
                [np.packbits(x).tobytes() for x in taken], pa.binary())], [*batch.schema.names, "leaves"])

    def unit(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("q", pa.int64()), ("id", pa.int64()), ("score", pa.float64()))})
        f = forest.value
        rows, queries = rows.combine_chunks(), queries.combine_chunks()
        shape = (-1, len(f.normals), 1 << f.depth)
        leaves = np.frombuffer(b"".join(rows["leaves"].to_pylist()), np.int16).reshape(rows.num_rows, -1).astype(np.int64)
        bits = np.frombuffer(b"".join(queries["leaves"].to_pylist()), np.uint8).reshape(queries.num_rows, -1)
        taken = np.unpackbits(bits, axis=1)[:, : shape[1] * shape[2]].astype(bool).reshape(shape)
        q, i, s = rank_unit(matrix(rows["v"].chunk(0)), rows["id"].to_numpy(), leaves, matrix(queries["v"].chunk(0)),
                            queries["id"].to_numpy(), taken, k)
        return pa.table({"q": q, "id": i, "score": s})

    n_rows, n_asks = -(-n // ROW_BLOCK), max(1, -(-n_queries // QUERY_BLOCK))
    schema = "id long, v array<double>, leaves binary"
    block = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    indexed = written(good.mapInArrow(index, schema), "indexed")
    asked = written(good.filter(is_query).repartition(max(n_asks, spark.sparkContext.defaultParallelism), "id").mapInArrow(
        search, schema), "asked")
    left = indexed.select("*", block(n_rows, 1).alias("i")).select("*", all_of(n_asks).alias("j"))
    right = asked.select("*", block(n_asks, 2).alias("j")).select("*", all_of(n_rows).alias("i"))
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(unit, "q long, id long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        F.col("q").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
