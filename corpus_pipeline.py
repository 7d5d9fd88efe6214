"""A corpus from raw documents: filter, keep one of each group of near copies, cut repeats, mix, tokenise.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. The first four return the
columns of documents; the last returns one row for each document of the mixture with its pieces.

Defined results: a null or empty text has no words, so the first stage rejects it; null ids, languages and sources stay as they
are. Equal rows are copies: of a group the rows of its smallest doc_id stay, all of them if the id repeats. Different texts
under one id keep their own words. A source that is null is a source. Other columns go on up to the mixture. An
empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from msgspark.llm import fm_dedup, jaccard_join, mixing, piece_nbest, quality_rules
from msgspark.llm.storage import documents, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.keep_one(docs, size=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the word windows that an earlier document has; n_chars follows the text."""
    kept = fm_dedup.cut_repeats(docs)
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", length) if "n_chars" in docs.columns else kept


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture uses them, each at least once; no source more than twice."""
    return mixing.mixture(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each text: their ids, the scores of the n best segmentations, and whether they decode to the text."""
    return piece_nbest.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram jaccard join", keep_one_of_each),
    ("substring dedup", cut_repeats),
    ("temperature mixing", mix_sources),
    ("pieces", to_pieces),
]

ORACLE_SQL = None  # the mixture's hash order and the segmentation search have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, "pipeline")
    return docs
