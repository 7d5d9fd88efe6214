"""Multinomial naive Bayes as aggregations and joins (two classes, 0 and 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..session import cut_lineage
from . import features as feat


def class_priors(labelled: DataFrame, *, label: str = "label", weight: str | None = None) -> DataFrame:
    """One row: log prior of class 0 and 1."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    return labelled.agg(
        F.log(F.sum(F.when(F.col(label) == 0, w)) / F.sum(w)).alias("prior0"),
        F.log(F.sum(F.when(F.col(label) == 1, w)) / F.sum(w)).alias("prior1"),
    )


def fit_terms(weights: DataFrame, vocab: DataFrame, *, label: str = "label", alpha: float = 1.0,
              weight: str = "weight", key: str = "term_idx") -> DataFrame:
    """(term, term_idx, idf, theta0, theta1): smoothed log likelihoods on the full grid."""
    per_term = weights.groupBy(key).agg(
        F.sum(F.when(F.col(label) == 0, F.col(weight)).otherwise(0.0)).alias("s0"),
        F.sum(F.when(F.col(label) == 1, F.col(weight)).otherwise(0.0)).alias("s1"),
    )
    # stored once: the totals and the table itself both come from it
    grid = cut_lineage(vocab.join(per_term, key, "left").fillna(0.0, ["s0", "s1"]))
    total = grid.agg(F.sum("s0").alias("s0"), F.sum("s1").alias("s1"), F.count(F.lit(1)).alias("n")).first()  # one row

    def theta(s: str):
        return F.log((F.col(s) + float(alpha)) / F.lit((total[s] or 0.0) + alpha * total["n"]))

    return grid.select("term", "term_idx", "idf", theta("s0").alias("theta0"), theta("s1").alias("theta1"))


def fit(docs: DataFrame, *, text: str = "text", label: str = "label", row_id: str = "row_id",
        max_features: int = feat.MAX_FEATURES, **vocab_args) -> tuple[DataFrame, DataFrame]:
    """(term table, prior row) learned from labelled messages."""
    words = feat.prepared(docs, text=text, row_id=row_id, keep=(label,))
    vocab = feat.fit_vocabulary(words, row_id=row_id, max_features=max_features, **vocab_args)
    weights = feat.tfidf(words, vocab, row_id=row_id, keep=(label,), max_features=max_features)
    return fit_terms(weights, vocab, label=label), class_priors(docs, label=label)


def score(docs: DataFrame, terms: DataFrame, priors: DataFrame, *, text: str = "text", row_id: str = "row_id",
          keep: tuple[str, ...] = (), max_features: int | None = feat.MAX_FEATURES) -> DataFrame:
    """(row_id, keep..., l0, l1, prediction, confidence); term-less rows get the prior.

    The norm of a row divides the whole sum, so weighting, normalising and scoring stay within
    the row that counting leaves.
    """
    rows = feat.known_rows(docs, terms, values=("idf", "theta0", "theta1"), text=text, row_id=row_id, keep=keep,
                           max_features=max_features)

    def dot(raw, theta: str):
        shares = F.zip_with(raw, "known", lambda w, x: w * x[theta])
        return F.when(F.size("known") > 0, F.aggregate(shares, F.lit(0.0), lambda total, x: total + x))

    sums = rows.select(row_id, *keep, T.let(feat.raw_weights("known"), lambda raw: F.struct(
        dot(raw, "theta0").alias("d0"), dot(raw, "theta1").alias("d1"), F.sqrt(feat.squares(raw)).alias("norm"))).alias("_s"))
    sums = sums.select(row_id, *keep, "_s.d0", "_s.d1", "_s.norm")
    p0, p1 = priors.select("prior0").scalar(), priors.select("prior1").scalar()
    scored = sums.select(
        row_id, *keep,
        (p0 + F.coalesce(F.col("d0") / F.col("norm"), F.lit(0.0))).alias("l0"),
        (p1 + F.coalesce(F.col("d1") / F.col("norm"), F.lit(0.0))).alias("l1"),
    )
    return with_decision(scored)


def with_decision(scored: DataFrame) -> DataFrame:
    """Class with the larger likelihood (class 0 on a tie) and its probability."""
    gap = F.col("l1") - F.col("l0")
    return scored.withColumn("prediction", F.when(gap > 0, 1).otherwise(0)).withColumn(
        "confidence", 1.0 / (1.0 + F.exp(-F.abs(gap))))
