"""Audit of sources: how far the term shares of a source lie from those of the other sources and of its language.

First pass: the number of documents of each (language, term), exact; terms in fewer than MIN_DOCS documents go. The kept
terms of a language are dealt into shards of about SHARD_KEYS by hash, and each shard becomes a minimal perfect hash that
stores its terms. Second pass: with all shards broadcast, a task looks up the different terms of a slice, compares
them with the stored ones, and adds to a dense row of slots for each (language, source) it meets; rows are given out when they
fill HELD counters. Shares and divergences are whole-number arithmetic on the summed slots.

The shards are broadcast only if their measured size is at most ``broadcast_bytes``. Beyond it the second pass sends its sums
by term and they meet their slots in a shuffle join: the same counts. Totals of groups are broadcast up to BROADCAST_GROUPS rows.

Defined results: null text, language or source count as ''. A row is a document, repeated rows and ids included. A group without
terms has count 0 of every kept term. A language without kept terms has divergence 0 between its sources, and no term rows.
Other columns are never read. Empty in, empty out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .batches import slices, utf8
from .perfect_hash import PerfectHash, hashes
from .storage import written
from .words import LETTERS, Words

MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
SHARD_KEYS, HELD = 1 << 14, 1 << 22
BROADCAST_BYTES, BROADCAST_GROUPS = 64 << 20, 100_000
SLICE = 8 << 20


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _counted(part: pa.RecordBatch, by: list[str]):
    """Of a slice: its groups (lists of the columns ``by``), the group of each word, each word's number, and the words."""
    words = Words(*utf8(part.column("text")), LETTERS, lower=True)
    numbers, different = words.numbered()
    groups = pa.table([part.column(c) for c in by], names=by).combine_chunks()
    keys, index, place = [], {}, np.empty(part.num_rows, np.int64)
    for i, key in enumerate(zip(*(groups.column(c).to_pylist() for c in by), strict=True)):
        if key not in index:
            index[key] = len(keys)
            keys.append(key)
        place[i] = index[key]
    per_doc = np.diff(words.texts)
    return keys, place, per_doc, numbers, different


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, limit=SLICE):
            keys, place, per_doc, numbers, different = _counted(part, ["lang"])
            if not len(numbers):
                continue
            k = len(different)
            pairs = np.unique(np.repeat(np.arange(len(per_doc)), per_doc) * k + numbers)
            n = np.bincount(place[pairs // k] * k + pairs % k, minlength=len(keys) * k)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([
                pa.array([key[0] for key in keys]).take(pa.array(at // k)),
                different.take(pa.array(at % k)).cast(pa.large_string()).cast(pa.string()), pa.array(n[at])], ["lang", "term", "n"])


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term) of the terms in at least ``min_docs`` documents of the language."""
    found = _texts(docs).select("lang", "text").mapInArrow(_frequencies, "lang string, term string, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("lang", "term")


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def shard(key, words):
        table = PerfectHash(words)
        return pa.RecordBatch.from_arrays([
            pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([key[2]], pa.int64()), pa.array([len(table)], pa.int64()),
            pa.array([pickle.dumps(table)], pa.binary())], ["lang", "shards", "shard", "n", "table"])

    last, words = None, []
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("lang", "shards", "shard")), strict=True)
        for key, term in zip(keys, batch.column("term").cast(pa.binary()).to_pylist(), strict=True):
            if key != last:
                if words:
                    yield shard(last, words)
                last, words = key, []
            words.append(term)
    if words:
        yield shard(last, words)


def hash_shards(terms: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(lang, shards, shard, n, table): the perfect hashes of each language's terms, by pmod(xxhash64(term), shards)."""
    sizes = terms.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / shard_keys).alias("shards"))
    dealt = terms.join(sizes, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")))
    return dealt.repartition("lang", "shard").sortWithinPartitions("lang", "shard").mapInArrow(
        _build, "lang string, shards long, shard long, n long, table binary")


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            keys = pickle.loads(batch.column("table")[i].as_py()).keys
            yield pa.RecordBatch.from_arrays([
                pa.array([batch.column("lang")[i].as_py()] * len(keys)), pa.array(np.full(len(keys), batch.column("shard")[i].as_py())),
                pa.array(np.arange(len(keys))), keys.cast(pa.large_string()).cast(pa.string())], ["lang", "shard", "slot", "term"])


class Shards:
    """All perfect hashes of a language, as one range of slots."""

    def __init__(self, tables: dict[int, bytes], count: int):
        self.tables = {shard: pickle.loads(table) for shard, table in tables.items()}
        self.count, self.numbers = count, np.array(sorted(self.tables), np.int64)
        self.first = np.r_[0, np.cumsum([len(self.tables[s]) for s in self.numbers])].astype(np.int64)

    def slots(self, words: pa.Array, h: np.ndarray) -> np.ndarray:
        out, shard = np.full(len(h), -1, np.int64), h.view(np.int64) % self.count
        for i, s in enumerate(self.numbers):
            own = np.flatnonzero(shard == s)
            if len(own):
                local = self.tables[int(s)].slots(words.take(pa.array(own)), h[own])
                out[own] = np.where(local >= 0, local + self.first[i], -1)
        return out


def _recount(held, limit: int):
    opened: dict[str, Shards] = {}

    def given_out(rows: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), row in rows.items():
            at = np.flatnonzero(row)
            shards = opened[lang]
            i = np.searchsorted(shards.first, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(at), pa.string()), pa.array([source] * len(at), pa.string()), pa.array(shards.numbers[i]),
                pa.array(at - shards.first[i]), pa.array(row[at])], ["lang", "source", "shard", "slot", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = {}, 0
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                keys, place, per_doc, numbers, different = _counted(part, ["lang", "source"])
                if not len(numbers):
                    continue
                k = len(different)
                n = np.bincount(np.repeat(place, per_doc) * k + numbers, minlength=len(keys) * k).reshape(-1, k)
                h = hashes(different.to_pylist())
                for lang in {key[0] for key in keys}:
                    if lang not in opened and lang in held.value:
                        opened[lang] = Shards(*held.value[lang])
                    if lang not in opened:
                        continue
                    groups = [g for g, key in enumerate(keys) if key[0] == lang]
                    seen = np.flatnonzero(n[groups].any(0))
                    slots = np.full(k, -1, np.int64)
                    slots[seen] = opened[lang].slots(different.take(pa.array(seen)), h[seen])
                    for g in groups:
                        if keys[g] not in rows:
                            rows[keys[g]] = np.zeros(opened[lang].first[-1], np.int64)
                            size += len(rows[keys[g]])
                        at = np.flatnonzero((n[g] > 0) & (slots >= 0))
                        rows[keys[g]][slots[at]] += n[g][at]
                        if size > limit:
                            yield from given_out(rows)
                            rows, size = {}, 0
        yield from given_out(rows)
    return run


def _by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, limit=SLICE):
            keys, place, per_doc, numbers, different = _counted(part, ["lang", "source"])
            k = len(different)
            n = np.bincount(np.repeat(place, per_doc) * k + numbers, minlength=len(keys) * k)
            at = np.flatnonzero(n)
            if len(at):
                yield pa.RecordBatch.from_arrays([
                    *(pa.array([key[j] for key in keys]).take(pa.array(at // k)) for j in (0, 1)),
                    different.take(pa.array(at % k)).cast(pa.large_string()).cast(pa.string()), pa.array(n[at])],
                    ["lang", "source", "term", "n"])


def recount(docs: DataFrame, shards: DataFrame, terms: DataFrame, broadcast_bytes: int = BROADCAST_BYTES,
            held: int = HELD) -> DataFrame:
    """(lang, source, shard, slot, n) of the stored terms that occur in a group."""
    size = shards.agg(F.coalesce(F.sum(F.length("table")), F.lit(0))).first()[0]
    texts = _texts(docs)
    if size <= broadcast_bytes:
        tables: dict[str, tuple[dict, int]] = {}
        for row in shards.toLocalIterator():  # at most broadcast_bytes together
            tables.setdefault(row.lang, ({}, row.shards))[0][row.shard] = bytes(row.table)
        found = texts.mapInArrow(_recount(docs.sparkSession.sparkContext.broadcast(tables), held),
                                 "lang string, source string, shard long, slot long, n long")
        return found.groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n"))
    found = texts.mapInArrow(_by_term, "lang string, source string, term string, n long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")).join(terms, ["lang", "term"]).select(
        "lang", "source", "shard", "slot", "n")


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), in whole numbers; the arguments are SQL expressions."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * cast({n} + 1 as decimal(20, 0))) div cast({total} + {terms} as decimal(20, 0))")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def group_totals(docs: DataFrame, counts: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, at, total, terms) of every group; ``at`` numbers the sources of a language."""
    groups = _texts(docs).select("lang", "source").distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    found = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    return found.select("lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("at"),
                        F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of (p - q)^2 div q over the slots of a task, for each ordered pair of a language's sources."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        cut = [i for i in range(len(langs)) if i == 0 or langs[i] != langs[i - 1]] + [len(langs)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            base = batch.column("base")[a].values.to_numpy()
            step = max(1, (1 << 20) // len(base))
            for c in range(a, b, step):
                part = batch.slice(c, min(b, c + step) - c)
                found = part.column("found")
                entries = found.flatten()
                p = np.repeat(base[None], part.num_rows, 0)
                p[np.repeat(np.arange(part.num_rows), np.diff(found.offsets.to_numpy())), entries.field("at").to_numpy()] = (
                    entries.field("p").to_numpy())
                total = sums.setdefault(langs[a], np.zeros((len(base), len(base)), np.int64))
                for j in range(len(base)):
                    q = p[:, j: j + 1]
                    total[:, j] += ((p - q) ** 2 // q).sum(0)
    for lang, total in sums.items():
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([
            pa.array([lang] * len(i), pa.string()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])],
            ["lang", "at", "other", "value"])


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, shard_keys: int = SHARD_KEYS,
          broadcast_bytes: int = BROADCAST_BYTES, held: int = HELD) -> DataFrame:
    """(lang, source, part, item, value, rank): part "pair" is every other source with its summed divergence, part "term"
    the terms that a group has more of than its language, the ``top`` most divergent ones."""
    shards = written(hash_shards(written(kept_terms(docs, min_docs), "terms"), shard_keys), "shards")
    terms = shards.select("lang", "shard", "table").mapInArrow(_stored, "lang string, shard long, slot long, term string")
    counts = written(recount(docs, shards, terms, broadcast_bytes, held), "counts")
    totals = written(group_totals(docs, counts, terms), "groups")
    small = totals.count() <= BROADCAST_GROUPS
    bounded = F.broadcast if small else (lambda df: df)
    with_share = counts.join(bounded(totals), ["lang", "source"]).withColumn("p", share("n", "total", "terms"))
    slots = with_share.groupBy("lang", "shard", "slot").agg(
        F.sum("n").alias("in_lang"), F.collect_list(F.struct("at", "source", "p")).alias("found"))
    slots = written(slots.join(terms, ["lang", "shard", "slot"]), "slots")

    by_lang = totals.withColumn("p", F.when(F.col("terms") > 0, share("0", "total", "terms"))).groupBy("lang").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "p"))), lambda x: x.p).alias("base"),
        F.sum("total").alias("lang_total"), F.max("terms").alias("terms"))
    sums = slots.select("lang", F.transform("found", lambda x: F.struct(x.at.alias("at"), x.p.alias("p"))).alias("found")).join(
        bounded(by_lang.select("lang", "base")), "lang").mapInArrow(_pair_sums, "lang string, at int, other int, value long")
    sums = sums.groupBy("lang", "at", "other").agg(F.sum("value").alias("value"))
    here = totals.select("lang", "source", "at")
    pairs = here.join(totals.select("lang", F.col("source").alias("item"), F.col("at").alias("other")), "lang").filter("at <> other")
    pairs = pairs.join(sums, ["lang", "at", "other"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    above = slots.join(bounded(by_lang.select("lang", "lang_total", "terms")), "lang").select(
        "lang", "term", share("in_lang", "lang_total", "terms").alias("q"), F.explode("found").alias("x")).select(
        "lang", F.col("x.source").alias("source"), F.col("term").alias("item"), F.col("x.p").alias("p"), "q").filter("p > q")
    most = above.select("lang", "source", F.lit("term").alias("part"), "item", divergence("p", "q").alias("value")).withColumn(
        "rank", ranked).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", ranked).unionByName(most)
