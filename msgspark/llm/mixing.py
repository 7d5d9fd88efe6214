"""Mixing sources: temperature weights found by bisection, realised as budgeted block permutations.

Weights are source token shares to the power of an exponent, normalised. Bisection finds the largest exponent whose
weights reach the target entropy (a share of the entropy of equal weights), then, if some source would be repeated more than
``max_repeats`` times within the budget, the smallest exponent above that keeps the limit.

A source's quota of tokens is its weight times the budget: whole epochs, and a part of one more. A source's documents lie in
blocks by a hash of their id; each epoch permutes the blocks, and the documents in them. The part epoch takes blocks in
its order while they fit, and documents of the next block while they fit, so it misses its quota by less than a document. Only
that one block of a source is ever sorted by document; blocks hold BLOCK_TOKENS tokens or 1/MAX_BLOCKS of their source.

Defined results: a null source is a source of its own. Null, empty and blank texts have no tokens; they go with their block and
cost nothing. A source without any token has no share and is kept once. Repeated rows count each. An id decides
place and block, so rows that share an id share them. Empty in, empty out. All other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_TOKENS = 1 << 17
MAX_BLOCKS = 1 << 14
SEED = 17


@dataclass(frozen=True)
class Mix:
    exponent: float
    budget: float
    weights: np.ndarray
    quotas: np.ndarray


def n_words(text_col: str) -> Column:
    return F.size(F.expr(f"array_remove(split(coalesce(`{text_col}`, ''), '[\\\\x20\\\\x09-\\\\x0D]+'), '')")).cast("long")


def weights_at(tokens: np.ndarray, exponent: float) -> np.ndarray:
    logs = exponent * np.log(tokens / tokens.sum())
    w = np.exp(logs - logs.max())
    return w / w.sum()


def entropy(w: np.ndarray) -> float:
    w = w[w > 0]
    return float(-(w * np.log(w)).sum())


def budget_of(tokens: np.ndarray, w: np.ndarray, budget: float | None) -> float:
    """The budget, or the least one with which every source is used once in full."""
    return float(budget) if budget is not None else float((tokens / w).max())


def solve(tokens: np.ndarray, budget: float | None, entropy_share: float, max_repeats: float, steps: int = 60) -> Mix:
    """Weights of sources with ``tokens`` > 0 each."""
    target = entropy_share * np.log(len(tokens))
    repeats = lambda a: float((weights_at(tokens, a) * budget_of(tokens, weights_at(tokens, a), budget) / tokens).max())

    def bisect(fine) -> float:
        """Largest exponent in 0..1 for which fine holds; fine(0) is taken to hold."""
        low, high = 0.0, 1.0
        if fine(high):
            return high
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if fine(mid) else (low, mid)
        return low

    exponent = bisect(lambda a: entropy(weights_at(tokens, a)) >= target - 1e-12)
    if repeats(exponent) > max_repeats:
        # repeats fall as the exponent grows; if even exponent 1 repeats more, the budget itself asks for that
        exponent = 1.0 - bisect(lambda b: 1 - b >= exponent and repeats(1 - b) <= max_repeats)
    w = weights_at(tokens, exponent)
    total = budget_of(tokens, w, budget)
    return Mix(exponent, total, w, w * total)


def mix(docs: DataFrame, budget: float | None = None, entropy_share: float = 0.95, max_repeats: float = 2.0,
        source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``row`` (the document as a struct), ``n_words``, ``epoch`` (from 1), ``block``: one row for each use of a document.

    ``budget`` is in words; without one, the least with which every document is used. The driver holds one row a source.
    """
    spark = docs.sparkSession
    source = F.coalesce(F.concat(F.lit("="), F.col(f"row.`{source_col}`").cast("string")), F.lit("-"))
    rows = docs.select(F.struct("*").alias("row")).select(
        "row", source.alias("s"), n_words(f"row`.`{text_col}").alias("n_words"),
        F.coalesce(F.col(f"row.`{id_col}`").cast("long"), F.lit(-1)).alias("id"))
    sums = {r.s: r.t for r in rows.groupBy("s").agg(F.sum("n_words").alias("t")).collect()}
    names = sorted(s for s, t in sums.items() if t > 0)
    tokens = np.array([sums[s] for s in names], float)
    found = solve(tokens, budget, entropy_share, max_repeats) if len(names) else Mix(1.0, 0.0, tokens, tokens)
    plan = []
    for s, t, q in zip(names, tokens, found.quotas, strict=True):
        whole = int(q / t + 1e-9)
        plan.append((s, whole, max(0, int(round(q - whole * t))), int(min(MAX_BLOCKS, max(1, t // BLOCK_TOKENS)))))
    plan += [(s, 1, 0, 1) for s, t in sums.items() if t == 0]
    table = F.broadcast(spark.createDataFrame(plan, "s string, whole long, rest long, blocks long"))  # one row a source
    rows = rows.join(table, "s").withColumn("block", F.pmod(F.xxhash64("id", F.lit(SEED)), F.col("blocks")))
    full = rows.filter("whole > 0").select(
        "row", "n_words", "block", F.explode(F.expr("sequence(1L, whole)")).alias("epoch"))
    # the part epoch: block sums in the epoch's order of blocks
    turn = F.xxhash64("s", "block", F.col("whole") + 1, F.lit(SEED))
    blocks = rows.filter("rest > 0").groupBy("s", "block").agg(
        F.sum("n_words").alias("t"), F.first("whole").alias("whole"), F.first("rest").alias("rest"))
    order = Window.partitionBy("s").orderBy(turn, "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = blocks.withColumn("upto", F.sum("t").over(order)).filter(F.col("upto") - F.col("t") < F.col("rest")).select(
        "s", "block", (F.col("upto") - F.col("t")).alias("before"), (F.col("upto") <= F.col("rest")).alias("fits"))
    part = rows.filter("rest > 0").join(placed, ["s", "block"])
    inner = Window.partitionBy("s", "block").orderBy(F.xxhash64("id", F.col("whole") + 1, F.lit(SEED)), "id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    cut = part.filter(~F.col("fits")).withColumn("upto", F.col("before") + F.sum("n_words").over(inner)).filter(
        F.col("upto") <= F.col("rest"))
    last = [p.select("row", "n_words", "block", (F.col("whole") + 1).alias("epoch")) for p in (part.filter("fits"), cut)]
    return full.unionByName(last[0]).unionByName(last[1])


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The documents, each as often as the mixture uses it, with the columns they came with."""
    return mix(docs, **options).select("row.*")
