"""Language-model scores: a unigram base over exact counts, and a gated recurrent model of whole documents.

Counting: every token of every training document is counted; the table of counts grows with the corpus. The LOOKUP_WORDS most
frequent words at most are broadcast (a threshold on the counts, found from a histogram, decides which); all other words of a
document meet their counts in a shuffle join, so no count is ever approximated.

Model (module ``gru``): its items are the MODEL_WORDS most frequent words, the end token, and GROUPS groups of all other words by
their last two bytes. A word of a group adds its probability within the group, (c + 0.1) / (n + 0.1 * (v + 1)) from the exact counts of
the group's n tokens and v words, unknown words counting as one more. So the probabilities of all known words and one
unknown word a group add up to one after every history.

Training: ROUNDS rounds; in each, documents chosen by hash are dealt into lanes of about LANE tokens, a lane's task trains
a copy of the model on them by truncated backpropagation, and the copies' parameters are averaged by tokens. All rounds
together visit every training document, and MIN_VISITS tokens at least (documents come again in a small corpus,
at most once a round). Lanes go by a hash of the content, so neither partitioning nor retries change the model beyond rounding.

Scoring: whole documents in streams, the state carried from window to window. Scores are rounded to DIGITS digits. Texts become
items once, for training and scoring.

Defined results: a null or empty text is one end token. A null id counts for training. Rows are told apart by id and text; repeated
rows get equal scores. Without training documents N and V are 0 and all scores come from the smoothing alone. Other columns
are never read. Empty in, empty out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .batches import slices, utf8
from .gru import Gru
from .storage import written
from .words import NOT_SPACE, Words

SMOOTH, DIGITS = 0.1, 3
LOOKUP_WORDS, MODEL_WORDS, GROUPS = 1 << 18, 4096, 64
ROUNDS, LANE, MIN_VISITS, RATE = 6, 1 << 18, 3_000_000, 6e-3
SLICE, PARTS, STEPS_AN_OCTAVE, FRACTION = 8 << 20, 8, 16, 1 << 20


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id, as text, divides by 10; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def groups_of(words: pa.Array) -> np.ndarray:
    """Group of each word: by its last two bytes."""
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset: words.offset + len(words) + 1]
    chars = np.frombuffer(words.buffers()[2], np.uint8) if len(words) else np.zeros(0, np.uint8)
    last = chars[at[1:] - 1].astype(np.int64)
    second = np.where(at[1:] - at[:-1] > 1, chars[np.maximum(at[1:] - 2, 0)], 0)
    return (7 * last + 13 * second.astype(np.int64)) % GROUPS


@dataclass
class Model:
    """What scoring needs of the corpus; only ``counts`` grows with it, and stays a table."""
    counts: DataFrame
    tokens: int
    types: int
    words: pa.Array
    word_counts: np.ndarray
    items: np.ndarray
    ends: int
    group_tokens: np.ndarray
    group_types: np.ndarray
    net: Gru
    losses: list = field(default_factory=list)
    visits: int = 0  # tokens that training went over
    docs: tuple = ()  # the table fitted, its columns, and its rows in items: scored without going over its words again
    rows: DataFrame | None = None

    def sent(self) -> "Model":
        return Model(None, *[getattr(self, c) for c in ("tokens", "types", "words", "word_counts", "items", "ends", "group_tokens",
                                                        "group_types", "net")])

    @property
    def complete(self) -> bool:
        """Whether every known word is among the broadcast ones."""
        return len(self.words) == self.types - (self.ends > 0)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + SMOOTH) / (self.tokens + SMOOTH * (self.types + 1)))

    @property
    def group_mass(self) -> np.ndarray:
        return self.group_tokens + SMOOTH * (self.group_types + 1)

    def looked_up(self, words: pa.Array):
        """Count (-1: not among the broadcast ones), item and group of each word."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False) if len(self.words) else np.full(
            len(words), -1)
        group = groups_of(words)
        counts = np.where(at >= 0, self.word_counts[at] if len(self.words) else 0, 0 if self.complete else -1)
        item = self.items[at] if len(self.words) else np.full(len(words), -1)
        return counts, np.where((at >= 0) & (item >= 0), item, self.net.number[-GROUPS + group]), group, (at >= 0) & (item >= 0)

    @property
    def end(self) -> int:
        return int(self.net.number[-GROUPS - 1])


def _texts(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, limit=SLICE):
            numbers, words = Words(*utf8(part.column("text")), NOT_SPACE, lower=True).numbered()
            n = np.bincount(numbers, minlength=len(words))
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([words.cast(pa.large_string()).cast(pa.string()), pa.array([None], pa.string())]),
                pa.array(np.r_[groups_of(words), -1].astype(np.int32)), pa.array(np.r_[n, part.num_rows])], ["word", "grp", "n"])


def count_tokens(texts: DataFrame) -> DataFrame:
    """(word, grp, n) over all training documents; the end token has word null."""
    found = texts.filter("not held_out").select("text").mapInArrow(_count, "word string, grp int, n long")
    return written(found.groupBy("word", "grp").agg(F.sum("n").alias("n")), "counts")


def _frequent(counts: DataFrame, limit: int) -> pa.Table:
    """(word, grp, n) of at most ``limit`` words: all with counts from some octave step on."""
    words = counts.filter("word is not null").withColumn("step", F.floor(F.log2("n") * STEPS_AN_OCTAVE))
    histogram = sorted(((r.step, r["count"]) for r in words.groupBy("step").count().collect()), reverse=True)
    total, least = 0, None
    for step, n in histogram:
        total += n
        if total > limit:
            break
        least = step
    if least is None:
        return pa.table({"word": pa.array([], pa.string()), "grp": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
    return words.filter(F.col("step") >= least).select("word", "grp", "n").toArrow()


def _train(model, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def trained(texts: list[np.ndarray]) -> pa.RecordBatch:
            m, net = model.value, Gru.__new__(Gru)
            net.__dict__ |= m.net.__dict__
            net.p = {k: v.copy() for k, v in m.net.p.items()}
            net.fit(texts, m.end, rate)
            parts = np.array_split(net.packed(), PARTS)
            return pa.RecordBatch.from_arrays([
                pa.array(np.arange(PARTS, dtype=np.int32)), pa.array([float(sum(map(len, texts)))] * PARTS),
                pa.array([x.tobytes() for x in parts], pa.binary())], ["part", "weight", "data"])

        lane, texts = None, []
        for batch in batches:
            for own, ids in zip(batch.column("lane").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if own != lane and texts:
                    yield trained(texts)
                    texts = []
                lane = own
                texts.append(np.frombuffer(ids, np.int32))
        if texts:
            yield trained(texts)
    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for batch in batches:
        for part, weight, data in zip(*(batch.column(c).to_pylist() for c in ("part", "weight", "data")), strict=True):
            values = np.frombuffer(data, np.float32).astype(np.float64) * weight
            if part in total:
                total[part][0] += weight
                total[part][1] += values
            else:
                total[part] = [weight, values]
    for part, (weight, values) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([weight]), pa.array(
            [(values / weight).astype(np.float32).tobytes()], pa.binary())], ["part", "weight", "data"])


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_visits: int = MIN_VISITS, lookup_words: int = LOOKUP_WORDS,
        model_words: int = MODEL_WORDS, lane: int = LANE) -> Model:
    """Counts of all training tokens and the network trained on all training documents."""
    texts = _texts(docs, text_col, id_col)
    spark, counts = docs.sparkSession, count_tokens(texts)
    by_group = {r.grp: (r.n, r.v) for r in counts.groupBy("grp").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    ends = by_group.get(-1, (0, 0))[0]
    tokens, types = sum(n for n, _ in by_group.values()), sum(v for _, v in by_group.values())
    top = _frequent(counts, lookup_words)
    words = top.column("word").combine_chunks().cast(pa.large_string()).cast(pa.large_binary()) if len(top) else pa.array([], pa.large_binary())
    n, grp = top.column("n").to_numpy(), top.column("grp").to_numpy()
    order = np.lexsort((pc.rank(words, tiebreaker="first").to_numpy() if len(words) else n, -n))
    words, n, grp = words.take(pa.array(order)), n[order], grp[order]
    k = min(model_words, len(words))
    group_tokens, group_types = (np.array([by_group.get(g, (0, 0))[j] for g in range(GROUPS)], np.float64) for j in (0, 1))
    group_tokens -= np.bincount(grp[:k], n[:k], minlength=GROUPS)
    group_types -= np.bincount(grp[:k], minlength=GROUPS)
    net = Gru(np.r_[n[:k], ends, group_tokens])
    items = np.full(len(words), -1, np.int64)
    items[:k] = net.number[:k]
    model = Model(counts, tokens, types, words, n, items, ends, group_tokens, group_types, net)
    if not tokens:
        return model
    # of a round, in parts of all documents: the rounds together take every document
    width = min(FRACTION, -(-FRACTION * max(min_visits, tokens) // (ROUNDS * tokens)))
    model.docs, model.rows = (docs, text_col, id_col), _encoded(texts, model)
    at = F.pmod("hash", F.lit(FRACTION))
    coded = model.rows.filter("kind = 'text' and not held_out").select(at.alias("at"), "ids")
    lanes = max(1, round(tokens * width / FRACTION / lane))
    for r in range(ROUNDS):
        own = coded.filter(F.pmod(F.col("at") - r * width, F.lit(FRACTION)) < width).withColumn("hash", F.xxhash64("ids"))
        own = own.withColumn("lane", F.pmod("hash", F.lit(lanes))).repartition(lanes, "lane").sortWithinPartitions("lane", "hash")
        copies = own.select("lane", "ids").mapInArrow(
            _train(spark.sparkContext.broadcast(model.sent()), RATE * 0.75 ** r), "part int, weight double, data binary")
        parts = copies.repartition("part").sortWithinPartitions("part", F.xxhash64("data")).mapInArrow(
            _average, "part int, weight double, data binary").collect()
        model.visits += int(parts[0].weight) if parts else 0
        if parts:  # a round may find no document in a tiny corpus
            net.unpack(np.concatenate([np.frombuffer(p.data, np.float32) for p in sorted(parts, key=lambda p: p.part)]))
    return model


ROWS = ("kind string, key string, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inside double, "
        "hash long, ids binary, word string, grp int, n long")
NAMES = [c.split()[0] for c in ROWS.split(", ")]
TYPES = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.binary(),
         pa.string(), pa.int32(), pa.int64()]


def _encode(model):
    """A row of each text with its items and all that the counts at hand tell of it, and a row of each other word of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        end_base = float(m.base(np.array([m.ends]))[0])
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                words, n = Words(*utf8(part.column("text")), NOT_SPACE, lower=True), part.num_rows
                numbers, different = words.numbered()
                counts, items, group, own = m.looked_up(different) if len(different) else (np.zeros(0),) * 4
                known = counts >= 0
                base = np.where(known, m.base(np.maximum(counts, 0)), 0.0)
                inside = np.where(known & ~own, np.log10((np.maximum(counts, 0) + SMOOTH) / m.group_mass[group]), 0.0) if len(different) else base
                doc = np.repeat(np.arange(n), np.diff(words.texts))
                total = lambda of_word: np.bincount(doc, of_word[numbers], minlength=n) if len(numbers) else np.zeros(n)
                n_known = total((counts > 0).astype(float)).astype(np.int64) + (m.ends > 0)
                with_ends = np.insert(items[numbers] if len(numbers) else numbers, words.texts[1:], m.end).astype(np.int32)
                cut = words.texts + np.arange(n + 1)
                ids_of = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((4 * cut).astype(np.int32)), pa.py_buffer(with_ends)])
                open_ = ~known[numbers] if len(numbers) else np.zeros(0, bool)
                asked = np.bincount(doc[open_], minlength=n) > 0
                ids, texts = part.column("doc_id").to_pylist(), part.column("text")
                keys = [f"{ids[i]}:{hashlib.md5((texts[i].as_py() or '').encode()).hexdigest()}" if asked[i] else None for i in range(n)]
                columns = [["text"] * n, keys, ids, part.column("held_out"), np.diff(cut), n_known, total(base) + end_base,
                           total(inside), part.column("hash"), ids_of, [None] * n, [None] * n, [None] * n]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(
                    columns, TYPES, strict=True)], NAMES)
                pairs, many = np.unique(doc[open_] * max(1, len(different)) + numbers[open_], return_counts=True)
                keys = pa.array(keys, pa.string())
                for a in range(0, len(pairs), 1 << 16):
                    d, w = np.divmod(pairs[a: a + (1 << 16)], len(different))
                    columns = {"kind": pa.array(["word"], pa.string()).take(pa.array(np.zeros(len(d), np.int64))), "key": keys.take(pa.array(d)),
                               "word": different.take(pa.array(w)).cast(pa.large_string()).cast(pa.string()),
                               "grp": pa.array(group[w].astype(np.int32)), "n": pa.array(many[a: a + (1 << 16)])}
                    yield pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(len(d), t)) for c, t in zip(NAMES, TYPES, strict=True)], NAMES)
    return run


def _encoded(texts: DataFrame, model: Model) -> DataFrame:
    return written(texts.withColumn("hash", F.xxhash64("doc_id", "text")).mapInArrow(
        _encode(texts.sparkSession.sparkContext.broadcast(model.sent())), ROWS), "items")


SCORED = "key string, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in slices(batch, "ids", SLICE):
                net = m.net.score([np.frombuffer(x, np.int32) for x in part.column("ids").to_pylist()], m.end) / np.log(10)
                yield pa.RecordBatch.from_arrays([*(part.column(c.split()[0]) for c in SCORED.split(", ")[:-1]), pa.array(
                    net + part.column("inside").to_numpy(zero_copy_only=False))], [c.split()[0] for c in SCORED.split(", ")])
    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; scores are log10."""
    spark = docs.sparkSession
    fitted = model.docs and model.docs[0] is docs and model.docs[1:] == (text_col, id_col)
    rows = model.rows if fitted else _encoded(_texts(docs, text_col, id_col), model)
    documents = written(rows.filter("kind = 'text'").drop("kind", "hash", "word", "grp", "n").mapInArrow(
        _score(spark.sparkContext.broadcast(model.sent())), SCORED), "scored")
    mass = spark.createDataFrame([(g, float(x)) for g, x in enumerate(model.group_mass)], "grp int, mass double")
    c = F.coalesce(F.col("c"), F.lit(0)) + F.lit(SMOOTH)
    open_words = rows.filter("kind = 'word'").select("key", "word", "grp", "n").distinct()  # repeated rows have one key
    met = open_words.join(model.counts.filter("word is not null").select("word", F.col("n").alias("c")), "word", "left").join(
        F.broadcast(mass), "grp")
    rest = met.groupBy("key").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10(c / F.lit(model.tokens + SMOOTH * (model.types + 1)))).alias("more_base"),
        F.sum(F.col("n") * F.log10(c / F.col("mass"))).alias("more_score"))
    none = [F.lit(0).cast("long").alias("more_known"), *(F.lit(0.0).alias(x) for x in ("more_base", "more_score"))]
    both = documents.filter("key is null").select("*", *none).unionByName(documents.filter("key is not null").join(rest, "key").select(
        *documents.columns, "more_known", "more_base", "more_score"))
    return both.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("more_known")).alias("n_known"),
                       F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + F.col("more_base")).alias("base_score"),
                       F.round(F.col("score") + F.col("more_score"), DIGITS).alias("score"))
