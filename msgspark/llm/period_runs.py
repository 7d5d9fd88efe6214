"""Runs of words that repeat with a period, found tile by tile for each octave of periods.

A run is a stretch of words with smallest period q, at least ``max(LEAST, TIMES * q)`` words long, that no neighbouring
word extends. For the octave of periods P <= q < 2P a text has boundaries every 2P words, each with a tile of the 2P words
before it and the 4P words behind it. Word i agrees with word i + q all along a run, over 3q places at least,
so a boundary lies within them. There the Z-function of the words behind the boundary tells, for every q of the octave, how
far they agree to the right, and the Z-function of the mirrored tile how far to the left. A tile knows nothing of others: it
returns fragments of agreeing places, cut at its own ends, and fragments that touch are stitched by text and period. A
tile is solved only if near its boundary words agree for as long as any fragment must.

Texts up to ``segment`` words are tiled and solved where they are read. Longer ones are cut into rows of tiles that any task
can solve, so one endless text is shared by the cluster; the rows returned do not depend on it. Stitching groups
by text and period, on fragments alone.

Defined results: a null or empty text has no words and no runs. Rows are told apart by id and text, so different texts under
one id (or none) keep their own runs, and repeated rows get equal ones. Other columns are never read. Empty in, empty out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .batches import slices, utf8
from .storage import written
from .words import NOT_SPACE, Words

LEAST, TIMES = 6, 4
SEGMENT = 1 << 14
SHARED = 8  # octaves up to an eighth of a segment share its rows
PROBE = 8

ROWS = ("kind string, key string, doc_id long, n long, collapsed string, words binary, period long, first long, last long, "
        "octave long, until long, base long, numbers binary")
RESULT = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
          "collapsed_sha256 string")


@dataclass
class Piece:
    """Words ``base`` and on of a text of ``n`` words; its boundaries are those in [low, high)."""
    at: int
    base: int
    size: int
    n: int
    low: int
    high: int


def z_values(s: list) -> list:
    """For each place, how many values from there on agree with the beginning."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def tile(symbols: np.ndarray, b: int, n: int, p: int, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many places agree behind and before boundary ``b`` of one text, for each of ``periods``, 2p at most."""
    ahead = z_values(symbols[b: min(n, b + 4 * p)].tolist())
    left, hi = max(0, b - 2 * p), min(b + 2 * p - 2, n - 1)
    before = symbols[left:b][::-1].tolist()
    behind = z_values(before + [-1] + symbols[left: hi + 1][::-1].tolist())
    right = np.array([ahead[q] for q in periods], np.int64)
    return np.minimum(right, 2 * p), np.array([behind[len(before) + 1 + hi - (b - 1 + q)] for q in periods], np.int64)


def solve(symbols: np.ndarray, pieces: list[Piece], p: int) -> list[np.ndarray]:
    """[piece, period, first, last) of the fragments of one octave; places count from the text's first word."""
    chosen = [(i, x) for i, x in enumerate(pieces) if x.n >= max(LEAST, TIMES * p)]
    if not chosen:
        return []
    step = 2 * p
    owner, at = [], []
    for i, x in chosen:
        b = np.arange(-(-x.low // step) * step, min(x.high, x.n - p), step)
        at.append(b)
        owner.append(np.full(len(b), i))
    owner, at = np.concatenate(owner), np.concatenate(at)
    shift = np.array([x.at - x.base for x in pieces], np.int64)
    n = np.array([x.n for x in pieces], np.int64)
    found = []
    per = max(1, (1 << 20) // p)
    for a in range(0, len(at), per):
        own, b = owner[a: a + per], at[a: a + per]
        q = np.arange(p, 2 * p)
        other = np.minimum(b[:, None] + q, n[own][:, None] - 1)  # a place beyond the text is ruled out below
        agree = symbols[(b + shift[own])[:, None]] == symbols[other + shift[own][:, None]]
        agree &= (b[:, None] + q < n[own][:, None]) & (q <= n[own][:, None] // TIMES)
        row, col = np.nonzero(agree)
        if not len(row):
            continue
        # a fragment has 2p places, so p of them lie on one side of the boundary
        b, q, own = b[row], q[col], own[row]
        probe = min(p, PROBE)
        ahead, behind = np.ones(len(b), bool), np.ones(len(b), bool)
        for j in range(1, probe):
            i = np.minimum(b + j + q, n[own] - 1)
            ahead &= (b + j + q < n[own]) & (symbols[np.minimum(b + j, n[own] - 1) + shift[own]] == symbols[i + shift[own]])
        for j in range(1, probe + 1):
            i = np.maximum(b - j, 0)
            behind &= (b >= j) & (symbols[i + shift[own]] == symbols[i + q + shift[own]])
        live = np.flatnonzero(ahead | behind)
        if not len(live):
            continue
        own, b, q = own[live], b[live], q[live]
        cut = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (b[1:] != b[:-1])])
        for s, e in zip(cut, np.r_[cut[1:], len(b)], strict=True):
            x = pieces[own[s]]
            text = symbols[x.at: x.at + x.size]
            right, left = tile(text, int(b[s] - x.base), x.n - x.base, p, q[s:e])
            keep = (right + left >= (TIMES - 1) * q[s:e]) | (right >= step) | (left >= step)
            if keep.any():
                found.append(np.column_stack([own[s:e], q[s:e], b[s:e] - left, b[s:e] + right])[keep])
    return found


def stitched(found: list[np.ndarray]) -> np.ndarray:
    """Fragments of one piece and period that touch, made one."""
    if not found:
        return np.zeros((0, 4), np.int64)
    x = np.concatenate(found)
    x = x[np.lexsort((x[:, 3], x[:, 2], x[:, 1], x[:, 0]))]
    group = np.r_[0, np.cumsum((x[1:, 0] != x[:-1, 0]) | (x[1:, 1] != x[:-1, 1]))]
    wide = int(x[:, 3].max()) + 1
    reach = np.maximum.accumulate(x[:, 3] + group * wide) - group * wide
    new = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (x[1:, 2] > reach[:-1])])
    return np.column_stack([x[new, :3], reach[np.r_[new[1:], len(x)] - 1]])


def octaves(n: int) -> Iterator[int]:
    p = 1
    while TIMES * p <= n:
        yield p
        p *= 2


def tile_rows(key: str, numbers: np.ndarray, segment: int) -> Iterator[dict]:
    """A long text as rows of tiles, each with the words its boundaries need."""
    n = len(numbers)
    small = [p for p in octaves(n) if SHARED * 2 * p <= segment]
    for group in ([small] if small else []) + [[p] for p in octaves(n) if p not in small]:
        p = group[-1]
        core = max(1, segment // (2 * p)) * 2 * p
        for low in range(0, n, core):
            base = max(0, low - 2 * p)
            yield {"kind": "tiles", "key": key, "n": n, "octave": group[0], "until": p, "base": base, "first": low,
                   "last": min(n, low + core), "numbers": numbers[base: min(n, low + core + 2 * p)].tobytes()}


def planted(order: np.ndarray, texts: np.ndarray, ids: list) -> None:
    """The audit's own rows: from one word on, every tenth document (by crc32 of its id) repeats with a period."""
    for i, doc_id in enumerate(ids):
        first, n = int(texts[i]), int(texts[i + 1] - texts[i])
        if doc_id is None or not n:
            continue
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            order[first + a: first + n] = first + a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))


def _table(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=ARROW)


ARROW = pa.schema([("kind", pa.string()), ("key", pa.string()), ("doc_id", pa.int64()), ("n", pa.int64()),
                   ("collapsed", pa.string()), ("words", pa.binary()), ("period", pa.int64()), ("first", pa.int64()),
                   ("last", pa.int64()), ("octave", pa.int64()), ("until", pa.int64()), ("base", pa.int64()),
                   ("numbers", pa.binary())])


def _explode(plant: bool, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = utf8(part.column("text"))
                words, ids = Words(data, offsets, NOT_SPACE), part.column("doc_id").to_pylist()
                numbers, _ = words.numbered()
                order = np.arange(len(numbers))
                if plant:
                    planted(order, words.texts, ids)
                numbers = numbers[order]
                n = np.diff(words.texts)
                short = [i for i in range(len(n)) if n[i] <= segment]
                pieces = [Piece(int(words.texts[i]), 0, int(n[i]), int(n[i]), 0, int(n[i])) for i in short]
                found = []
                for p in octaves(int(n[short].max()) if short else 0):
                    found += solve(numbers, pieces, p)
                found = stitched(found)
                found = found[found[:, 3] - found[:, 2] + found[:, 1] >= np.maximum(LEAST, TIMES * found[:, 1])]
                asked = {short[i] for i in found[:, 0].tolist()} | {i for i in range(len(n)) if n[i] > segment}
                rows, keys = [], {}
                for i, doc_id in enumerate(ids):
                    text = words.joined(order[words.texts[i]: words.texts[i + 1]])
                    row = {"kind": "text", "doc_id": doc_id, "n": int(n[i]), "collapsed": hashlib.sha256(text).hexdigest()}
                    if i in asked:
                        keys[i] = f"{doc_id}:{row['collapsed']}"
                        row |= {"key": keys[i], "words": text}
                    rows.append(row)
                    if len(rows) >= 4096:
                        yield _table(rows)
                        rows = []
                rows += [{"kind": "part", "key": keys[short[i]], "period": q, "first": s, "last": e}
                         for i, q, s, e in found.tolist()]
                yield _table(rows)
                for i in sorted(asked - set(short)):
                    for row in tile_rows(keys[i], numbers[words.texts[i]: words.texts[i + 1]].astype(np.int32), segment):
                        yield _table([row])
    return run


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            numbers, found = np.frombuffer(row["numbers"], np.int32), []
            piece, p = Piece(0, row["base"], len(numbers), row["n"], row["first"], row["last"]), row["octave"]
            while p <= row["until"]:
                found += solve(numbers, [piece], p)
                p *= 2
            found = stitched(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["key"]] * len(found), pa.string()), *(pa.array(found[:, j]) for j in (1, 2, 3))],
                ["key", "period", "first", "last"])


def stitch(parts: DataFrame) -> DataFrame:
    """(key, start, length, period) of the runs, from fragments (key, period, first, last) of agreeing places."""
    by = Window.partitionBy("key", "period").orderBy("first", "last")
    reach = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach >= F.col("first"), 0).otherwise(1)
    island = F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = parts.distinct().withColumn("new", new).withColumn("island", island).groupBy("key", "period", "island").agg(
        F.min("first").alias("start"), F.max("last").alias("last"))
    length = F.col("last") - F.col("start") + F.col("period")
    runs = whole.withColumn("length", length).filter(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))
    return runs.groupBy("key", "start", "length").agg(F.min("period").alias("period"))  # multiples of a period have its place


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RESULT.split(", ")] + ["collapsed"]
    types = [pa.int64()] * 6 + [pa.string()] * 3
    for batch in batches:
        for row in batch.to_pylist():
            text, runs = row["words"], sorted((r["start"], r["period"], r["length"]) for r in row["runs"])
            best = runs[0]
            for r in runs[1:]:  # in order of start and period, so ties stay with the first
                if r[2] * best[1] > best[2] * r[1]:
                    best = r
            words = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), NOT_SPACE)
            gone = np.zeros(len(words.at) - 1, bool)
            for start, period, length in runs:
                gone[start + period: start + length] = True
            kept = words.joined(np.flatnonzero(~gone))
            listed = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
            values = [row["doc_id"], len(runs), best[0], best[2], best[1], 1000 * best[2] // best[1],
                      hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), kept.decode()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)


@dataclass
class Found:
    """``runs``: (key, start, length, period); ``documents``: one row for each input row, see ``report``."""
    runs: DataFrame
    documents: DataFrame


def find(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", plant: bool = False, segment: int = SEGMENT) -> Found:
    """All runs of ``docs`` and its rows with ``collapsed``, the text without repeats (null where nothing repeats)."""
    rows = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
                   .mapInArrow(_explode(plant, segment), ROWS), "tiles")
    tiles = rows.filter("kind = 'tiles'").select("key", "n", "octave", "until", "base", "first", "last", "numbers").repartition(
        "key", "until", "first")
    parts = rows.filter("kind = 'part'").select("key", "period", "first", "last").unionByName(
        tiles.mapInArrow(_solve, "key string, period long, first long, last long"))
    runs = written(stitch(parts), "runs")
    texts = rows.filter("kind = 'text'").select("key", "doc_id", "collapsed", "words")
    grouped = runs.groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    asked = texts.filter("key is not null").join(grouped, "key", "left")
    none = [F.lit(None).cast("long").alias(c) for c in ("start", "length", "period", "exponent_milli")]
    plain = lambda df: df.select("doc_id", F.lit(0).cast("long").alias("n_runs"), *none, F.sha2(F.lit(""), 256).alias("runs_sha256"),
                                 F.col("collapsed").alias("collapsed_sha256"), F.lit(None).cast("string").alias("collapsed"))
    cut = asked.filter("runs is not null").select("doc_id", "words", "runs").mapInArrow(_collapse, RESULT + ", collapsed string")
    documents = plain(texts.filter("key is null")).unionByName(plain(asked.filter("runs is null"))).unionByName(cut)
    return Found(runs, documents)


def report(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: its number of runs, the run of greatest exponent, digests of all runs and of the text
    without repeats."""
    return find(docs, **options).documents.drop("collapsed")
