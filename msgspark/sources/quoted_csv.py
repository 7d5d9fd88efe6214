"""CSV records of files of any size, cut by many tasks although quoted fields may hold line ends.

Spark's multi-line reader gives a whole file to one task. Here a file is read line by line in its ordinary splits. Whether a
split begins inside a quoted field cannot be seen from it alone, but what it does to either case can: a first pass
over the lines that hold quotes gives, for each split, the state at its end if it begins outside quotes and if it begins inside.
These maps of two states are composed along each file with a window, one row a split. The second pass then cuts records
in all splits at once; a record that crosses splits arrives in parts, which are joined by file and order.

Quotes count as in RFC 4180 and Python's reader: a quote opens a field at its start only, a doubled quote stands for itself, and what follows
a closing quote belongs to the field up to the next comma. Commas, quotes and line ends are the same bytes in
UTF-8 and Latin-1, so records are cut as bytes and decoded after.

Defined results: lines end with a line feed, a carriage return before it goes; a lone carriage return ends no line. Empty lines
outside quotes are no records. A quote that is never closed takes the rest of the file into one record; a record of
more than MAX_RECORD bytes fails the job with the file's name. A byte order mark at the beginning of a file goes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

MAX_RECORD = 64 << 20
RECORDS = "path string, position long, first boolean, record binary"
PARTS = "path string, block long, opens boolean, position long, first boolean, record binary"


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether the end of ``line`` is inside quotes, for a line that begins inside or outside of them."""
    i = 0
    while True:
        if not inside:
            inside = line.startswith(b'"', i)
            i += inside
        if inside:
            while True:
                i = line.find(b'"', i)
                if i < 0:
                    return True
                if not line.startswith(b'"', i + 1):
                    break
                i += 2
            i += 1
        i = line.find(b",", i)
        if i < 0:
            return False
        i, inside = i + 1, False


def lines_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, block, value): the lines of the files as bytes, in order within each split; ``block`` is the split's first byte."""
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"))


def stretches(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """Path, block and lines of the runs of one split in a batch."""
    n = batch.num_rows
    if not n:
        return
    paths = batch.column("path").dictionary_encode()
    code, block = paths.indices.to_numpy(), batch.column("block").to_numpy()
    cut = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])])
    for a, b in zip(cut, np.r_[cut[1:], n], strict=True):
        yield paths.dictionary[int(code[a])].as_py(), int(block[a]), batch.column("value").slice(a, b - a)


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, block, outside, inside): the state at a split's end, by its state at the beginning."""
    def row(key, states):
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), *(pa.array([s]) for s in states)],
                                          ["path", "block", "outside", "inside"])

    last, states = None, (False, True)
    for batch in batches:
        for path, block, lines in stretches(batch):
            if (path, block) != last:
                if last is not None:
                    yield row(last, states)
                last, states = (path, block), (False, True)
            for line in lines.to_pylist():
                out = ends_inside(line, states[0])
                states = (out, out if states[0] == states[1] else ends_inside(line, states[1]))
    if last is not None:
        yield row(last, states)


def end_states(lines: DataFrame) -> DataFrame:
    """(path, block, inside): the state at the end of every split that holds a quote."""
    maps = lines.filter(F.contains("value", F.lit('"').cast("binary"))).mapInArrow(
        _maps, "path string, block long, outside boolean, inside boolean")
    by = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a split that forgets how it began sets the state; one that swaps the states is counted; others change nothing
    forgets, swaps = F.col("outside") == F.col("inside"), F.col("outside") & ~F.col("inside")
    counted = maps.withColumn("swaps", F.sum(swaps.cast("long")).over(by))
    last = F.last(F.when(forgets, F.struct(F.col("outside").alias("to"), F.col("swaps").alias("at"))), ignorenulls=True).over(by)
    return counted.withColumn("last", last).select("path", "block", (
        F.coalesce(F.col("last.to"), F.lit(False)) != ((F.col("swaps") - F.coalesce(F.col("last.at"), F.lit(0))) % 2 == 1)).alias("inside"))


class Starts:
    """Which splits begin inside quotes."""

    def __init__(self, changes: list[tuple[str, int, bool]]):
        self.by_path: dict[str, tuple[list[int], list[bool]]] = {}
        for path, block, inside in sorted(changes):
            blocks, states = self.by_path.setdefault(path, ([], []))
            blocks.append(block)
            states.append(inside)

    def inside(self, path: str, block: int) -> bool:
        blocks, states = self.by_path.get(path, ((), ()))
        i = bisect_left(blocks, block)
        return i > 0 and states[i - 1]


def starts(lines: DataFrame) -> Starts:
    """The states at split ends, where they change: at most a row a split, less than the list of splits the driver holds anyway."""
    ends = end_states(lines)
    before = F.lag("inside", 1, False).over(Window.partitionBy("path").orderBy("block"))
    return Starts([tuple(r) for r in ends.withColumn("before", before).filter("inside <> before").select("path", "block", "inside").collect()])


def record_starts(lines: pa.Array, inside: bool) -> tuple[np.ndarray, bool]:
    """Which lines begin a record, and the state at the end of the last one."""
    begins = np.ones(len(lines), bool)
    done = 0
    for i in np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)):
        begins[done: i + 1] = not inside
        inside, done = ends_inside(lines[int(i)].as_py(), inside), i + 1
    begins[done:] = not inside
    return begins, inside


def _cut(found: Starts, parts: bool, limit: int):
    """Whole records of all splits, or the parts of the records that cross splits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, inside, index, held, size, place, opens, first = None, False, 0, [], 0, None, False, False

        def rows(path, block, positions, firsts, opened, records):
            n = len(records)
            if parts:
                return pa.RecordBatch.from_arrays([
                    pa.array([path] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array([opened] * n, pa.bool_()),
                    pa.array(positions, pa.int64()), pa.array(firsts, pa.bool_()), records], ["path", "block", "opens", "position", "first", "record"])
            return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(positions, pa.int64()), pa.array(firsts, pa.bool_()), records],
                                              ["path", "position", "first", "record"])

        def held_record():
            return pa.array([b"\n".join(x for lines in held for x in lines.to_pylist())], pa.binary())

        for batch in batches:
            for path, block, lines in stretches(batch):
                if (path, block) != last:
                    if held and parts:  # the split before ends inside quotes
                        yield rows(*last, [place], [first], opens, held_record())
                    last, index, held, size = (path, block), 0, [], 0
                    inside, place, opens, first = found.inside(path, block), block, False, False
                    seen = block > 0  # whether the file's first record is behind
                begins, end = record_starts(lines, inside)
                at = np.flatnonzero(begins)
                before = int(at[0]) if len(at) else len(lines)
                if before:
                    held.append(lines.slice(0, before))
                    size += held[-1].nbytes
                if held and len(at):
                    if parts != opens:  # began in this split: a whole record; else the end of one
                        yield rows(*last, [place], [first], False, held_record())
                    held, size = [], 0
                if len(at):
                    whole = len(at) - end  # the last record goes on if the state at the end is inside
                    if whole or end:
                        empty = pc.binary_length(lines).to_numpy(zero_copy_only=False)[at] == 0
                        flags = np.zeros(len(at), bool)
                        if not seen:
                            filled = np.flatnonzero(~empty)
                            if len(filled):
                                flags[filled[0]] = seen = True
                    if whole and not parts:
                        edge = pa.array(np.r_[at, len(lines)][: whole + 1].astype(np.int32))
                        own = pa.ListArray.from_arrays(edge, lines)
                        yield rows(path, block, block + index + at[:whole], flags[:whole], False, pc.binary_join(own, b"\n"))
                    if end:
                        held, place, opens, first = [lines.slice(int(at[-1]))], block + index + int(at[-1]), True, bool(flags[-1])
                        size = held[0].nbytes
                if size > limit:
                    raise ValueError(f"a record of {path} is longer than {limit} bytes: is a quote never closed?")
                inside, index = end, index + len(lines)
        if held and parts:
            yield rows(*last, [place], [first], opens, held_record())
    return run


def records(spark: SparkSession, paths: str | list[str], max_record: int = MAX_RECORD) -> DataFrame:
    """(path, position, first, record) of all files: ``position`` grows along a file, ``first`` marks its first record, ``record``
    is its bytes."""
    lines = lines_of(spark, paths)
    found = starts(lines)
    whole = lines.mapInArrow(_cut(found, False, max_record), RECORDS)
    if found.by_path:
        crossing = lines.mapInArrow(_cut(found, True, max_record), PARTS)
        order = Window.partitionBy("path").orderBy("block", "opens")  # the end of a record comes before the next one's beginning
        n = F.sum(F.col("opens").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        part = F.struct("block", "opens", F.col("record").cast("string").alias("text"))
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x.text), "\n")
        whole = whole.unionByName(crossing.withColumn("n", n).groupBy("path", "n").agg(
            F.max(F.when(F.col("opens"), F.col("position"))).alias("position"),
            F.bool_or(F.col("opens") & F.col("first")).alias("first"), joined.cast("binary").alias("record")).drop("n"))
    return whole.filter(~F.col("record").isin(F.lit(b""), F.lit(b"\r")))


def record_text(encoding: str | Column) -> Column:
    """The text of ``record`` without the line end's carriage return and the file's byte order mark."""
    encoding = F.lit(encoding) if isinstance(encoding, str) else encoding
    text = F.when(F.lower(encoding).isin("latin-1", "iso-8859-1"), F.decode("record", "ISO-8859-1")).otherwise(
        F.make_valid_utf8(F.col("record").cast("string")))
    text = F.when(F.col("first"), F.regexp_replace(text, "^﻿", "")).otherwise(text)
    return F.regexp_replace(text, "\\r\\z", "")


def rows(spark: SparkSession, paths: str | list[str], width: int, *, header: bool, encoding: str = "UTF-8") -> DataFrame:
    """(path, position, fields): the first ``width`` fields of each record, null where a record has fewer."""
    found = records(spark, paths)
    if header:
        found = found.filter("not first")
    names = [f"c{i}" for i in range(width)]
    parsed = F.from_csv(record_text(encoding), ", ".join(f"{c} STRING" for c in names),
                        {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"})
    return found.select("path", "position", parsed.alias("r")).select("path", "position", F.array(*[f"r.{c}" for c in names]).alias("fields"))
