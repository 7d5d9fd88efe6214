"""TF-IDF as relational operators over (row_id, term, tf) tables.

Shuffle plan: messages are preprocessed where they are read and their words exchanged once by
``row_id``; a document's terms are counted in its task (``grams``), looked up there, and weighted and
normalised within its row. A vocabulary of bounded size is found in two passes over the words, which are stored for them: sums
by bucket of the terms' hashes bound how often any term occurs, then only terms of the fullest buckets are counted. Only
their document frequencies are exchanged on ``term``. If a term outside could still belong to the vocabulary, a third
pass counts all buckets that could hold one, so the result is always exact. The vocabulary holds at most
``max_features`` rows, which is what bounds its broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..session import cut_lineage
from . import grams as G
from .ranking import global_rank

MAX_FEATURES = 5000
BROADCAST_TERMS = 1_000_000  # a vocabulary up to this size is broadcast
PREPARED = "_prepared_words"  # the column that tells stored words from rows of texts
FULLEST = 8  # buckets counted at first for each term of a bounded vocabulary


def _bounded(max_features: int | None) -> bool:
    return max_features is not None and max_features <= BROADCAST_TERMS


def _maybe_broadcast(vocab: DataFrame, max_features: int | None) -> DataFrame:
    return F.broadcast(vocab) if _bounded(max_features) else vocab


def arranged(docs: DataFrame, *, text: str = "text", row_id: str = "row_id", keep: tuple[str, ...] = (),
             preprocess: bool = True) -> DataFrame:
    """The words of every row, exchanged and sorted by ``row_id``; of ``prepared`` rows as they are."""
    if PREPARED in docs.columns:
        return docs.select(row_id, *keep, F.col(PREPARED).alias(G.TEXT))
    return G.arranged(docs, T.tokens(text) if preprocess else T.word_tokens(text), row_id=row_id, keep=keep)


def prepared(docs: DataFrame, *, text: str = "text", row_id: str = "row_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """The words of every row, stored once. All functions here take it in place of the rows, so none cleans them again."""
    return cut_lineage(arranged(docs, text=text, row_id=row_id, keep=keep).withColumnRenamed(G.TEXT, PREPARED))


def term_counts(docs: DataFrame, *, text: str = "text", row_id: str = "row_id", keep: tuple[str, ...] = (),
                ngram_range: tuple[int, int] = (1, 2), preprocess: bool = True,
                keep_empty: bool = False) -> DataFrame:
    """(row_id, keep..., term, tf). ``keep_empty`` leaves a null term for term-less rows."""
    return G.row_counts(arranged(docs, text=text, row_id=row_id, keep=keep, preprocess=preprocess), *_range(ngram_range), keep_empty)


def _range(ngram_range: tuple[int, int]) -> tuple[int, int]:
    low, high = ngram_range
    if not 1 <= low <= high:
        raise ValueError("need 1 <= low <= high")
    return low, high


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def vocabulary(counts: DataFrame, docs: DataFrame, *, min_df: int = 2, max_df: float = 0.95,
               max_features: int | None = MAX_FEATURES) -> DataFrame:
    """(term, term_idx, df, cf, idf): pruned by df, cut to the most frequent terms.

    ``docs`` supplies the number of documents, including those without any term.
    """
    return prune(document_frequencies(counts), docs, min_df=min_df, max_df=max_df, max_features=max_features)


def prune(frequencies: DataFrame, docs: DataFrame | int, *, min_df: int = 2, max_df: float = 0.95,
          max_features: int | None = MAX_FEATURES) -> DataFrame:
    """The vocabulary from (term, df, cf) and the documents or their number."""
    n = F.lit(docs).cast("bigint") if isinstance(docs, int) else docs.agg(F.count(F.lit(1))).scalar()
    kept = (
        frequencies
        .withColumn("n", n)
        .filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(float(max_df)) * F.col("n")))
        .select("term", "df", "cf", idf(F.col("n"), F.col("df")).alias("idf"))
    )
    if max_features is None:
        return global_rank(kept, order_by=["term"], name="term_idx")
    top = kept.orderBy(F.desc("cf"), F.asc("term")).limit(max_features)
    # at most max_features rows are left: one small sort numbers them
    return top.withColumn("term_idx", F.row_number().over(Window.orderBy("term")) - 1)


def fit_vocabulary(docs: DataFrame, *, text: str = "text", row_id: str = "row_id", ngram_range: tuple[int, int] = (1, 2),
                   min_df: int = 2, max_features: int | None = MAX_FEATURES, fullest: int = FULLEST, **pruning) -> DataFrame:
    """The vocabulary of ``docs``, stored once: later steps join it several times."""
    low, high = _range(ngram_range)
    if not _bounded(max_features):
        frequencies = G.term_totals(arranged(docs, text=text, row_id=row_id), low, high)
        return cut_lineage(prune(frequencies, docs, min_df=min_df, max_features=max_features, **pruning))
    words = arranged(docs if PREPARED in docs.columns else prepared(docs, text=text, row_id=row_id), row_id=row_id)
    seen, n = G.occurrences(words, low, high)
    least = max(1, min_df)  # a term of df documents occurs df times at least
    most = min(len(seen), max(1, fullest * max_features))
    kept = seen >= max(least, int(np.partition(seen, -most)[-most]))
    while True:
        vocab = cut_lineage(prune(G.term_totals(words, low, high, kept), n, min_df=min_df, max_features=max_features, **pruning))
        left = int(seen[~kept].max(initial=0))  # no term left out occurs more often
        size, last = vocab.agg(F.count(F.lit(1)), F.min("cf")).first()
        if left < least or not max_features or (size == max_features and last > left):
            return vocab
        kept = seen >= (max(least, last) if size == max_features else least)


def idf(n: Column, df: Column) -> Column:
    """Smoothed inverse document frequency."""
    return F.log((n + 1) / (df + 1)) + 1.0


def raw_weight(tf: Column, idf_: Column) -> Column:
    """Sub-linear term frequency times idf, before normalisation."""
    return (F.log(tf.cast("double")) + 1.0) * idf_


def known_counts(docs: DataFrame, table: DataFrame, *, values: tuple[str, ...] = ("idf",), text: str = "text",
                 row_id: str = "row_id", keep: tuple[str, ...] = (), ngram_range: tuple[int, int] = (1, 2),
                 max_features: int | None = MAX_FEATURES, keep_empty: bool = False) -> DataFrame:
    """(row_id, keep..., term_idx, values..., tf) of the terms in ``table`` (term, term_idx, values...).

    A bounded vocabulary is looked up where a document is counted: unknown terms drop out at once.
    Otherwise the join moves one row per document and term. ``keep_empty`` leaves rows with a null term_idx.
    """
    if _bounded(max_features):
        rows = known_rows(docs, table, values=values, text=text, row_id=row_id, keep=keep, ngram_range=ngram_range,
                          max_features=max_features)
        return _entries(rows, "known", row_id, keep, ("term_idx", *values, "tf"), outer=keep_empty)
    counts = term_counts(docs, text=text, row_id=row_id, keep=keep, ngram_range=ngram_range, keep_empty=keep_empty)
    return counts.join(table.select("term", "term_idx", *values), "term", "left" if keep_empty else "inner").select(
        row_id, *keep, "term_idx", *values, "tf")


def known_rows(docs: DataFrame, table: DataFrame, *, values: tuple[str, ...] = ("idf",), text: str = "text",
               row_id: str = "row_id", keep: tuple[str, ...] = (), ngram_range: tuple[int, int] = (1, 2),
               max_features: int | None = MAX_FEATURES) -> DataFrame:
    """One row per message: (row_id, keep..., known), its terms in ``table`` as (term_idx, values..., tf) by term_idx."""
    if _bounded(max_features):
        return G.known_rows(arranged(docs, text=text, row_id=row_id, keep=keep), table, values, *_range(ngram_range))
    counts = known_counts(docs, table, values=values, text=text, row_id=row_id, keep=keep, ngram_range=ngram_range,
                          max_features=None, keep_empty=True)
    entry = F.when(F.col("term_idx").isNotNull(), F.struct("term_idx", *values, "tf"))
    return counts.groupBy(row_id, *keep).agg(F.sort_array(F.collect_list(entry)).alias("known"))


def _entries(rows: DataFrame, column: str, row_id: str, keep: tuple[str, ...], fields: tuple[str, ...], outer: bool = False) -> DataFrame:
    expand = F.explode_outer if outer else F.explode
    return rows.select(row_id, *keep, expand(column).alias("_x")).select(row_id, *keep, *(F.col(f"_x.{f}").alias(f) for f in fields))


def raw_weights(known) -> Column:
    """Weights of ``known`` terms before normalisation, in their order."""
    return F.transform(known, lambda x: raw_weight(x["tf"], x["idf"]))


def squares(raw) -> Column:
    return F.aggregate(raw, F.lit(0.0), lambda total, x: total + x * x)


def tfidf(docs: DataFrame, vocab: DataFrame, *, text: str = "text", row_id: str = "row_id", keep: tuple[str, ...] = (),
          ngram_range: tuple[int, int] = (1, 2), max_features: int | None = MAX_FEATURES) -> DataFrame:
    """(row_id, keep..., term, term_idx, tf, weight), L2-normalised per row; sparse."""
    def over(known, raw, norm) -> Column:
        return F.zip_with(known, raw, lambda x, r: F.struct(
            x["term_idx"].alias("term_idx"), x["tf"].alias("tf"), (r / norm).alias("weight")))

    if keep and _bounded(max_features):  # rows of one id are normalised together, whatever they keep; they leave counting as one
        words = arranged(docs, text=text, row_id=row_id, keep=keep)
        rows = G.known_rows(words, vocab, ("idf",), *_range(ngram_range), together=True)
        own = F.transform("docs", lambda d: squares(raw_weights(d["known"])))
        norm = F.sqrt(F.aggregate(own, F.lit(0.0), lambda total, x: total + x))  # bound by let, else it is computed for every entry
        entries = T.let(norm, lambda norm: F.transform("docs", lambda d: F.struct(
            *(d[c].alias(c) for c in keep), over(d["known"], raw_weights(d["known"]), norm).alias("weighed"))))
        rows = rows.select(row_id, F.explode(entries).alias("_d")).select(row_id, *(F.col("_d").getField(c).alias(c) for c in keep), "_d.weighed")
    else:
        rows = known_rows(docs, vocab, text=text, row_id=row_id, keep=keep, ngram_range=ngram_range, max_features=max_features)
        if keep:
            own = rows.withColumn("norm", squares(raw_weights("known")))
            rows = own.withColumn("norm", F.sqrt(F.sum("norm").over(Window.partitionBy(row_id))))
            entries = over("known", raw_weights("known"), F.col("norm"))
        else:
            entries = T.let(raw_weights("known"), lambda raw: T.let(F.sqrt(squares(raw)), lambda norm: over("known", raw, norm)))
        rows = rows.select(row_id, *keep, entries.alias("weighed"))
    weights = _entries(rows, "weighed", row_id, keep, ("term_idx", "tf", "weight"))
    return weights.join(_maybe_broadcast(vocab.select("term_idx", "term"), max_features), "term_idx")


def tfidf_arrays(docs: DataFrame, vocab: DataFrame, *, text: str = "text", row_id: str = "row_id",
                 keep: tuple[str, ...] = (), ngram_range: tuple[int, int] = (1, 2),
                 max_features: int | None = MAX_FEATURES) -> DataFrame:
    """One row per message: (row_id, keep..., indices, values); all-unknown rows are empty."""
    rows = known_rows(docs, vocab, text=text, row_id=row_id, keep=keep, ngram_range=ngram_range, max_features=max_features)
    vector = T.let(raw_weights("known"), lambda raw: T.let(F.sqrt(squares(raw)), lambda norm: F.struct(
        F.col("known.term_idx").alias("indices"), F.transform(raw, lambda x: x / norm).alias("values"))))
    # two references keep the vector a column of its own, which a user function over it needs
    return rows.select(row_id, *keep, vector.alias("_v")).select(row_id, *keep, "_v.indices", "_v.values")


def tfidf_vectors(docs: DataFrame, vocab: DataFrame, *, size: int, **kw) -> DataFrame:
    """One sparse ML vector per message in column ``features`` (all-unknown rows are zero)."""
    return to_vectors(tfidf_arrays(docs, vocab, **kw), size=size)


def to_vectors(arrays: DataFrame, *, size: int) -> DataFrame:
    """(indices, values) arrays to a sparse ML vector in column ``features``: whole Arrow batches, no Python object a row."""
    from pyspark.ml.linalg import VectorUDT

    @F.arrow_udf(returnType=VectorUDT())
    def sparse(indices, values):
        n = len(indices)
        if indices.null_count or values.null_count or not pc.list_value_length(indices).equals(pc.list_value_length(values)):
            raise ValueError("index and value arrays not same length")
        ends = np.r_[0, np.cumsum(pc.list_value_length(indices).to_numpy())]
        at = indices.flatten().cast(pa.int32())
        place, first = at.to_numpy(), np.zeros(len(at) + 1, bool)
        first[ends] = True  # where a row begins
        if (~first[1:-1] & (place[1:] <= place[:-1])).any():
            raise TypeError("indices are not strictly increasing")
        if len(place) and not 0 <= place.min() <= place.max() < size:
            raise ValueError(f"index out of the size of vector with size={size}")
        found = values.flatten().cast(pa.float64()).fill_null(np.nan)
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (at, found)]
        return pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), *lists],
                                          names=["type", "size", "indices", "values"])

    rest = [c for c in arrays.columns if c not in ("indices", "values")]
    return arrays.select(*rest, sparse("indices", "values").alias("features"))


def long_weights(arrays: DataFrame, *, row_id: str = "row_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, keep..., term_idx, weight) back from (indices, values)."""
    pairs = F.arrays_zip(F.col("indices").alias("i"), F.col("values").alias("v"))
    return arrays.select(row_id, *keep, F.explode(pairs).alias("p")).select(
        row_id, *keep, F.col("p.i").alias("term_idx"), F.col("p.v").alias("weight"))


def feature_names(vocab: DataFrame) -> DataFrame:
    return vocab.select("term_idx", "term").orderBy("term_idx")
