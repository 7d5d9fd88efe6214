"""Sharding by sampled splitters: key ranges of nearly equal bytes, dealt to shards.

A record's key is (hash of its text, doc_id), so equal texts are neighbours in key order. A size-weighted
sample of keys gives quantile boundaries; the exact bytes of each range are then summed, ranges
that came out overfull are sampled and cut again, and the ranges go to the shards, largest first, each to the
shard with the fewest bytes. Boundaries lie between texts; the copies of a hot text are cut by doc_id into
several ranges, which stay together in one shard unless they hold more than a whole shard's share.

Defined results: a null text has no bytes (size 1, checksum 0). Empty texts likewise. Repeated rows are kept,
each with its own slot. A null doc_id sorts first. An empty table gives an empty table. The input's
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .storage import written

LOWEST = -(1 << 63)
ROWS_PER_RANGE = 2_000_000
SAMPLE_PER_RANGE = 64
ROUNDS = 6


class Splitters:
    """Sorted (hash, doc_id) boundaries; range k holds the keys from boundary k - 1 up to boundary k."""

    def __init__(self, keys: set[tuple[int, int]]):
        self.keys = sorted(keys)
        self.hashes = np.array([k[0] for k in self.keys], dtype=np.int64)
        ids: dict[int, list[int]] = {}
        for h, d in self.keys:
            if d != LOWEST:
                ids.setdefault(h, []).append(d)
        self.cut = {h: np.array(v, dtype=np.int64) for h, v in ids.items()}

    def range_of(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, h, side="right")
        for hot, ids in self.cut.items():
            own = h == hot
            if own.any():
                at[own] += np.searchsorted(ids, d[own], side="right") - len(ids)
        return at


def _with_range(slim: DataFrame, splitters: Splitters) -> DataFrame:
    @F.pandas_udf("int")
    def range_of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for h, d in parts:
            yield pd.Series(splitters.range_of(h.to_numpy(np.int64), d.to_numpy(np.int64)).astype(np.int32))

    return slim.withColumn("range", range_of("h", F.coalesce("doc_id", F.lit(LOWEST))))


def _sample(rows: DataFrame, n: int) -> list:
    """``n`` keys drawn without replacement with chances in proportion to size, the same on each run."""
    u = (F.pmod(F.xxhash64("doc_id", "h", F.lit("sample")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return rows.select("h", F.coalesce("doc_id", F.lit(LOWEST)).alias("d"), *[c for c in ("range",) if c in rows.columns],
                       (-F.log(u) / F.col("size")).alias("p")).orderBy("p", "h", "d").limit(n).collect()


def _quantiles(points: list, n: int, by_id: bool) -> set[tuple[int, int]]:
    """Boundaries at the n-quantiles of sorted (h, d) points; a text met twice gets a range of its own."""
    points = sorted(points)
    drawn = [points[i * len(points) // n] for i in range(1, n)] if points else []
    if by_id:
        return set(drawn)
    found, last = set(), None
    for h, _ in drawn:
        found.add((h, LOWEST))
        if h == last and h < (1 << 63) - 1:
            found.add((h + 1, LOWEST))
        last = h
    return found


def shard_by_bytes(docs: DataFrame, n_shards: int, text_col: str = "text", id_col: str = "doc_id",
                   ranges_per_shard: int = 32) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every record in one shard, slots without gaps from 0.

    The driver holds the splitters and one total per range. There are ``ranges_per_shard`` ranges a
    shard or one for each ROWS_PER_RANGE records, whichever is more; that is tuning only.
    """
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    slim = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t")).select(
        "doc_id", (F.octet_length("t") + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode("t", "utf-8")).alias("text_crc32"), F.xxhash64("t").alias("h")), "sizes")
    rows, total = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_ranges = max(n_shards * ranges_per_shard, -(-rows // ROWS_PER_RANGE))
    share, full = total / n_shards, 2 * total / n_ranges
    keys = _quantiles([(r.h, r.d) for r in _sample(slim, SAMPLE_PER_RANGE * n_ranges)], n_ranges, by_id=False)
    for _ in range(ROUNDS):
        splitters = Splitters(keys)
        placed = _with_range(slim, splitters)
        sums = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"),
                                           F.min("h").alias("low"), F.max("h").alias("high")).collect()
        by_text = {s.range: s for s in sums if s.bytes > full and s.low < s.high}
        by_id = {s.range: s for s in sums if s.bytes > full and s.low == s.high}
        more: set[tuple[int, int]] = set()
        for some, cut_ids in ((by_text, False), (by_id, True)):
            if not some:
                continue
            points = _sample(placed.filter(F.col("range").isin(list(some))), SAMPLE_PER_RANGE * n_ranges)
            for k, s in some.items():
                n = min(n_ranges, int(s.bytes / full) + 2)
                more |= _quantiles([(r.h, r.d) for r in points if r.range == k], n, cut_ids)
                if not cut_ids:  # a range of two texts has no inner quantile that must differ from its start
                    more.add((s.high, LOWEST))
        if not more - keys:
            break
        keys |= more
    loads, shard_of, at = [0] * n_shards, {}, [0] * n_shards
    copies: dict[int, list] = {}
    for s in sums:
        if s.low == s.high:
            copies.setdefault(s.low, []).append(s)
    together = [c for c in copies.values() if sum(s.bytes for s in c) <= share]
    whole = {s.range for c in together for s in c}
    bundles = together + [[s] for s in sums if s.range not in whole]
    for size, _, bundle in sorted((-sum(s.bytes for s in b), b[0].range, b) for b in bundles):
        k = loads.index(min(loads))
        loads[k] -= size
        shard_of |= {s.range: k for s in bundle}
    units = []
    for s in sorted(sums, key=lambda s: s.range):
        k = shard_of[s.range]
        units.append((s.range, k, at[k]))
        at[k] += s.rows
    plan = F.broadcast(spark.createDataFrame(units, "range int, shard int, first long"))
    order = Window.partitionBy("range").orderBy("h", "doc_id")
    return placed.withColumn("row", F.row_number().over(order)).join(plan, "range").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("row") - 1).alias("slot"))
