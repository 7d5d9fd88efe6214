"""Terms of documents counted in Arrow batches, so that no row per word is hashed, sorted or exchanged.

A document is all rows of one key, which may repeat or be null. Its rows come one after the other (``arranged``), are split
into words in slices of bounded bytes, and leave a task as counted terms. A document larger than a slice is counted piece by
piece; of it only its different terms are held.

Terms can be limited to buckets of their 64-bit hashes, which are made from numbers of words, so that the other terms are
neither spelled nor sorted nor exchanged. ``occurrences`` has the sum of each bucket: no term of it occurs more often.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

TEXT = "_text"
SLICE_BYTES = 4 << 20
ROWS = 1 << 16  # of a batch that leaves a task
BUCKETS, PARTS = 1 << 20, 16


def arranged(docs: DataFrame, tokens: Column, *, row_id: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, keep..., words joined by a space) exchanged by ``row_id``; rows of one document follow each other."""
    words = docs.select(row_id, *keep, F.array_join(tokens, " ").alias(TEXT))
    return words.repartition(row_id).sortWithinPartitions(row_id, *keep)


class Counted(NamedTuple):
    """Counts of ``n`` documents: number of the document, of the term and how often, by document; the terms; a row of each document."""
    n: int
    doc: np.ndarray
    code: np.ndarray
    tf: np.ndarray
    terms: pa.Array
    rows: pa.Table


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _joined(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of terms with one word more."""
    return _mixed(left * np.uint64(0x9E3779B97F4A7C15) + word)


def _hashed(words: pa.Array) -> np.ndarray:
    """Hashes of words: the sum of each byte times the power of its place, mixed."""
    n, words = len(words), words.cast(pa.large_string())
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset: words.offset + n + 1] if n else np.zeros(1, np.int64)
    chars = np.frombuffer(words.buffers()[2], np.uint8)[at[0]: at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    size = np.diff(at)
    powers = np.cumprod(np.full(int(size.max(initial=0)) + 1, 0x100000001B3, np.uint64))
    place = np.arange(len(chars)) - np.repeat(at[:-1] - at[0], size)
    total = np.r_[np.zeros(1, np.uint64), np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * powers[place], dtype=np.uint64)]
    return _mixed(total[at[1:] - at[0]] - total[at[:-1] - at[0]])


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def buckets_of(terms: pa.Array) -> np.ndarray:
    """Whether any of ``terms`` is in each bucket."""
    split = pc.split_pattern(terms.drop_null(), " ")
    words, first = _hashed(split.flatten()), split.offsets.to_numpy() - split.offsets[0].as_py()
    size, hashes = np.diff(first), words[first[:-1]]
    for k in range(1, int(size.max(initial=0))):
        more = np.flatnonzero(size > k)
        hashes[more] = _joined(hashes[more], words[first[more] + k])
    kept = np.zeros(BUCKETS, bool)
    kept[_bucket(hashes)] = True
    return kept


class Level(NamedTuple):
    """The n-grams of some texts: text and number of each occurrence, hashes of the numbers, and what spells numbers."""
    row: np.ndarray
    gram: np.ndarray
    hashes: np.ndarray
    spelled: Callable[[np.ndarray], pa.Array]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts, and the text of each."""
    split = pc.split_pattern(texts.fill_null(""), " ")
    row = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    words = split.flatten()
    real = pc.not_equal(words, "")
    return words.filter(real), row[real.to_numpy(zero_copy_only=False)]


def _buckets(texts: pa.Array, low: int, high: int) -> Iterator[np.ndarray]:
    """The bucket of every occurrence of a ``low``..``high``-gram within the texts."""
    words, row = _words(texts)
    own = hashes = _hashed(words)
    at = np.arange(len(own))
    for n in range(1, high + 1):
        if n > 1:
            follows = np.flatnonzero(at + n - 1 < len(own))
            inside = follows[row[at[follows] + n - 1] == row[at[follows]]]
            at = at[inside]
            hashes = _joined(hashes[inside], own[at + n - 1])
        if n >= low:
            yield _bucket(hashes)


def _levels(texts: pa.Array, low: int, high: int) -> Iterator[Level]:
    """All ``low``..``high``-grams within the texts."""
    words, row = _words(texts)
    coded = words.dictionary_encode()
    word, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    own = _hashed(names)
    at, gram, hashes = np.arange(len(word)), word, own
    ends: list[tuple[np.ndarray, np.ndarray]] = []  # of each longer gram: the gram without its last word, and that word

    def spelled(codes: np.ndarray, n: int) -> pa.Array:
        if n == 1:
            return names.take(pa.array(codes))
        left, right = ends[n - 2]
        return pc.binary_join_element_wise(spelled(left[codes], n - 1), names.take(pa.array(right[codes])), " ")

    for n in range(1, high + 1):
        if n > 1:  # an (n-1)-gram and the word behind it
            follows = at + n - 1 < len(word)
            at, gram = at[follows], gram[follows]
            inside = row[at + n - 1] == row[at]
            at, gram = at[inside], gram[inside]
            pair = pa.array(gram * len(names) + word[at + n - 1]).dictionary_encode()
            left, right = np.divmod(pair.dictionary.to_numpy(), max(1, len(names)))
            gram = pair.indices.to_numpy().astype(np.int64)
            ends.append((left, right))
            hashes = _joined(hashes[left], own[right])
        if n >= low:
            yield Level(row[at], gram, hashes, lambda codes, n=n: spelled(codes, n))


def _count(texts: pa.Array, owner: np.ndarray, low: int, high: int, kept: np.ndarray | None = None
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Documents, codes and counts of the grams within the texts, and the terms that the codes number; only of ``kept`` buckets."""
    owners, codes, found, base = [], [], [], 0
    for row, gram, hashes, spelled in _levels(texts, low, high):
        chosen = np.arange(len(hashes))
        if kept is not None:
            wanted = kept[_bucket(hashes)]
            chosen, here = np.flatnonzero(wanted), wanted[gram]
            row, gram = row[here], (np.cumsum(wanted) - 1)[gram[here]]
        owners.append(owner[row])
        codes.append(gram + base)
        found.append(spelled(chosen))
        base += len(chosen)
    keys, tf = np.unique(np.concatenate(owners) * max(1, base) + np.concatenate(codes), return_counts=True)
    doc, code = np.divmod(keys, max(1, base))
    return doc, code, tf, pa.concat_arrays(found)


def _goes_on(keys: list[pa.Array]) -> np.ndarray:
    """Whether each row has the key of the row before it."""
    n = len(keys[0])
    same = np.ones(n, bool)
    same[:1] = False
    for c in keys:
        a, b = c.slice(0, max(0, n - 1)), c.slice(1)
        equal = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        if pa.types.is_floating(c.type):
            equal = pc.or_(equal, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        same[1:] &= equal.to_numpy(zero_copy_only=False)
    return same


def _pieces(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The rows in runs of about ``limit`` bytes of text; a longer text comes alone."""
    for batch in batches:
        if batch.num_rows:
            size = pc.fill_null(pc.binary_length(batch.column(TEXT)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = (np.cumsum(size) - size) // limit
            cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, batch.num_rows]
            yield from (batch.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def _merged(parts: list[tuple[np.ndarray, pa.Array]]) -> tuple[np.ndarray, pa.Array]:
    """One document's counts from those of its pieces."""
    both = pa.table({"term": pa.concat_arrays([t for _, t in parts]), "tf": np.concatenate([n for n, _ in parts])})
    total = both.group_by("term").aggregate([("tf", "sum")]).combine_chunks()
    return total.column("tf_sum").to_numpy(), pa.concat_arrays(total.column("term").chunks or [pa.array([], pa.string())])


def counted(batches: Iterator[pa.RecordBatch], low: int, high: int, limit: int = SLICE_BYTES,
            kept: np.ndarray | None = None) -> Iterator[Counted]:
    """Counts of whole documents, some documents at a time; with ``kept``, of the terms in these buckets."""
    held: list[pa.RecordBatch] = []
    parts: list[tuple[np.ndarray, pa.Array]] = []  # counts of the document that the held rows go on with

    def done(rows: pa.Table, goes_on: np.ndarray) -> Iterator[Counted]:
        first = 0
        if parts:  # the first document has pieces behind it
            first = int(np.argmin(np.r_[True, goes_on[1:], False]))
            _, code, tf, terms = _count(_column(rows.slice(0, first), TEXT), np.zeros(first, np.int64), low, high, kept)
            tf, terms = _merged([*parts, (tf, terms.take(pa.array(code)))])
            parts.clear()
            yield Counted(1, np.zeros(len(tf), np.int64), np.arange(len(tf)), tf, terms, rows.slice(0, 1))
        if first < rows.num_rows:
            starts = ~goes_on[first:]
            starts[0] = True
            owner = np.cumsum(starts) - 1
            counts = _count(_column(rows.slice(first), TEXT), owner, low, high, kept)
            yield Counted(int(owner[-1]) + 1, *counts, rows.slice(first).take(pa.array(np.flatnonzero(starts))))

    size = 0
    for piece in _pieces(batches, limit):
        held.append(piece)
        size += pc.sum(pc.binary_length(piece.column(TEXT))).as_py() or 0
        if size < limit:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        goes_on = _goes_on([_column(rows, c) for c in rows.column_names if c != TEXT])
        cut = int(np.flatnonzero(~goes_on)[-1])
        if cut:
            yield from done(rows.slice(0, cut), goes_on[:cut])
            held = rows.slice(cut).to_batches()
            size = pc.sum(pc.binary_length(rows.slice(cut).column(TEXT))).as_py() or 0
        if size >= limit:  # one document fills what is held
            _, code, tf, terms = _count(_column(rows.slice(cut), TEXT), np.zeros(rows.num_rows - cut, np.int64), low, high, kept)
            parts.append((tf, terms.take(pa.array(code))))
            if len(parts) > 8:
                parts[:] = [_merged(parts)]
            last = rows.slice(rows.num_rows - 1)
            held, size = last.set_column(last.column_names.index(TEXT), TEXT, pa.nulls(1, pa.string())).to_batches(), 0
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield from done(rows, _goes_on([_column(rows, c) for c in rows.column_names if c != TEXT]))


def _column(rows: pa.Table, name: str) -> pa.Array:
    column = rows.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _schema(docs: DataFrame, more: str) -> str:
    keys = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != TEXT]
    return ", ".join([*keys, more])


def row_counts(docs: DataFrame, low: int, high: int, keep_empty: bool) -> DataFrame:
    """(key..., term, tf) of ``arranged`` rows; with ``keep_empty`` a null term for a document without any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in counted(batches, low, high):
            doc, code, tf = c.doc, pa.array(c.code), c.tf
            if keep_empty:
                none = np.setdiff1d(np.arange(c.n), doc)
                doc, tf = np.r_[doc, none], np.r_[tf, np.zeros(len(none), np.int64)]
                code = pa.concat_arrays([code, pa.nulls(len(none), code.type)])
            for a in range(0, len(doc), ROWS):
                part = slice(a, a + ROWS)
                rows = c.rows.drop_columns(TEXT).take(pa.array(doc[part])).append_column("term", c.terms.take(code[part]))
                yield from rows.append_column("tf", pa.array(tf[part], pa.int64())).combine_chunks().to_batches()

    return docs.mapInArrow(run, _schema(docs, "term string, tf bigint"))


def occurrences(docs: DataFrame, low: int, high: int) -> tuple[np.ndarray, int]:
    """Occurrences of all terms by bucket, and the number of rows. Only these sums, of fixed size, leave a task and reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for piece in _pieces(batches, SLICE_BYTES):
            n += piece.num_rows
            for buckets in _buckets(piece.column(0), low, high):
                total += np.bincount(buckets, minlength=BUCKETS)
        if n:
            yield from _packed({i: part for i, part in enumerate([*np.split(total, PARTS), np.array([n])])})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, values in _unpacked(batch.to_pylist()):
                total[part] = total.get(part, 0) + values
        yield from _packed(total)

    schema = "part int, kind string, data binary"
    parts = docs.select(TEXT).mapInArrow(run, schema).repartition("part").mapInArrow(summed, schema).collect()
    found = dict(_unpacked(r.asDict() for r in parts))
    if not found:
        return np.zeros(BUCKETS, np.int64), 0
    return np.concatenate([found[i] for i in range(PARTS)]), int(found[PARTS][0])


def _packed(parts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sums in the fewest bytes that hold them."""
    for part, values in parts.items():
        kind = np.min_scalar_type(int(values.max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind.str]), pa.array(
            [values.astype(kind).tobytes()], pa.binary())], ["part", "kind", "data"])


def _unpacked(rows) -> Iterator[tuple[int, np.ndarray]]:
    return ((r["part"], np.frombuffer(r["data"], r["kind"]).astype(np.int64)) for r in rows)


def term_totals(docs: DataFrame, low: int, high: int, kept: np.ndarray | None = None) -> DataFrame:
    """(term, df, cf) over all documents of ``arranged`` rows; with ``kept``, of all terms in these buckets."""
    sent = None if kept is None else docs.sparkSession.sparkContext.broadcast(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in counted(batches, low, high, kept=None if sent is None else sent.value):
            n = len(c.terms)
            df, cf = np.bincount(c.code, minlength=n), np.bincount(c.code, c.tf, n).astype(np.int64)
            for a in range(0, n, ROWS):
                part = slice(a, a + ROWS)
                yield pa.RecordBatch.from_arrays([c.terms[part], pa.array(df[part], pa.int64()), pa.array(cf[part])], ["term", "df", "cf"])

    # slices are combined above: another combination before the exchange would hold all terms of a task at once
    found = docs.mapInArrow(run, "term string, df bigint, cf bigint").repartition("term")
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def known_rows(docs: DataFrame, table: DataFrame, values: tuple[str, ...], low: int, high: int, together: bool = False) -> DataFrame:
    """(key..., known) of every document of ``arranged`` rows: its terms of ``table`` as (term_idx, values..., tf) by term_idx.

    ``table`` is sent to all tasks. With ``together`` one row for each value of the first key, the row id: (row id,
    docs), an array of the other keys and known terms of its documents. It is held as a whole: the keys of one id should be few.
    """
    fields = [f for c in ("term_idx", *values) for f in table.schema if f.name == c]
    struct = ", ".join([*(f"{f.name}: {f.dataType.simpleString()}" for f in fields), "tf: bigint"])
    sent = docs.sparkSession.sparkContext.broadcast(table.select("term", *(f.name for f in fields)).toArrow().combine_chunks())

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        columns = {name: _column(sent.value, name) for name in sent.value.column_names}
        number = columns["term_idx"].to_numpy()
        for c in counted(batches, low, high, kept=buckets_of(columns["term"])):
            place = pc.fill_null(pc.index_in(c.terms, value_set=columns["term"]), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = place[c.code]
            known = at >= 0
            doc, at, tf = c.doc[known], at[known], c.tf[known]
            order = np.lexsort((number[at], doc))
            at = pa.array(at[order])
            arrays = [columns[f.name].take(at) for f in fields] + [pa.array(tf[order], pa.int64())]
            entries = pa.StructArray.from_arrays(arrays, names=[*(f.name for f in fields), "tf"])
            ends = np.r_[0, np.cumsum(np.bincount(doc, minlength=c.n))]
            yield c.rows.drop_columns(TEXT).append_column("known", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in found(batches):
            yield from t.combine_chunks().to_batches(ROWS)

    def of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # begins with the id that may go on

        def done(t: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
            inner = pa.StructArray.from_arrays([_column(t, c) for c in t.column_names[1:]], names=t.column_names[1:])
            ids = _column(t, t.column_names[0]).take(pa.array(first))
            both = pa.table([ids, pa.ListArray.from_arrays(pa.array(np.r_[first, t.num_rows], pa.int32()), inner)], names=[t.column_names[0], "docs"])
            yield from both.combine_chunks().to_batches(ROWS)

        for t in found(batches):
            held.append(t)
            t = pa.concat_tables(held)
            first = np.flatnonzero(~_goes_on([_column(t, t.column_names[0])]))
            if len(first) > 1:
                yield from done(t.slice(0, first[-1]), first[:-1])
                held = [t.slice(first[-1]).combine_chunks()]
        if held:
            yield from done(pa.concat_tables(held), np.zeros(1, np.int64))

    if not together:
        return docs.mapInArrow(rows, _schema(docs, f"known array<struct<{struct}>>"))
    id_, *others = [f"`{f.name}`|{f.dataType.simpleString()}" for f in docs.schema if f.name != TEXT]
    inner = ", ".join([*(o.replace("|", ": ", 1) for o in others), f"known: array<struct<{struct}>>"])
    return docs.mapInArrow(of_ids, f"{id_.replace('|', ' ', 1)}, docs array<struct<{inner}>>")
