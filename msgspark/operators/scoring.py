"""Scoring tables of messages: good rows get a class, bad rows become error rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.labels import format_prediction
from ..functions.text import _col, let, preview, strip
from . import bayes

RESULT_COLUMNS = ("email_index", "email_text", "prediction", "confidence", "model_used", "processing_time",
                  "timestamp", "status", "error_message")


def scoring_error(c, max_length: int | None = fv.MAX_MESSAGE) -> Column:
    """Why a message cannot be scored, null when it can. ``max_length`` None: any length can."""
    limit = F.lit(max_length).cast("int")
    n = F.struct(F.coalesce(F.length(strip(c)), F.lit(0)).alias("bare"), F.length(_col(c)).alias("raw"))
    return let(n, lambda n: (
        F.when(n["bare"] == 0, "Empty email content")
        .when(n["bare"] < fv.MIN_MESSAGE, "Email content too short (minimum 10 characters)")
        .when(n["raw"] > limit, f"Invalid email text: {fv.ERR_LONG}")))


def result_rows(checked: DataFrame, scored: DataFrame, *, index: str = "email_index", text: str = "text",
                model_name: str = "naive_bayes", as_of: Column | None = None) -> DataFrame:
    """Result table from messages with ``error_message`` and scores (index, prediction, confidence)."""
    good = F.col("error_message").isNull()
    joined = checked.select(index, preview(text).alias("email_text"), "error_message").join(
        scored.select(index, "prediction", "confidence"), index, "left")
    stamp = F.lit(None).cast("timestamp") if as_of is None else as_of
    return joined.select(
        F.col(index).alias("email_index"), "email_text",
        F.when(good, format_prediction("prediction")).otherwise("Error").alias("prediction"),
        F.when(good, F.col("confidence")).otherwise(0.0).alias("confidence"),
        F.when(good, model_name).otherwise("None").alias("model_used"),
        F.lit(None).cast("double").alias("processing_time"), stamp.alias("timestamp"),
        F.when(good, "success").otherwise("error").alias("status"), "error_message")


def score_messages(df: DataFrame, terms: DataFrame, priors: DataFrame, *, text: str = "text",
                   index: str = "email_index", model_name: str = "naive_bayes", as_of: Column | None = None,
                   max_features: int | None = 5000, max_length: int | None = fv.MAX_MESSAGE) -> DataFrame:
    """Score with a relational naive Bayes model; one result row per message, none is lost.

    A message longer than ``max_length`` is an error row; None scores messages of any length as a whole.
    """
    checked = df.withColumn("error_message", scoring_error(text, max_length))
    good = checked.filter("error_message IS NULL").select(index, text)
    scored = bayes.score(good, terms, priors, text=text, row_id=index, max_features=max_features)
    return result_rows(checked, scored, index=index, text=text, model_name=model_name, as_of=as_of)


def attach_balancing(results: DataFrame, metrics: DataFrame) -> DataFrame:
    """Add model_balanced and, for balanced models, their method and false negative rate."""
    m = metrics.select(F.col("model_name").alias("model_used"), F.col("class_balancing_enabled").alias("_b"),
                       F.col("balancing_method").alias("_m"), F.col("false_negative_rate").alias("_f"))
    out = results.join(m, "model_used", "left").withColumn("model_balanced", F.coalesce("_b", F.lit(False)))
    return out.withColumns({
        "balancing_method": F.when(F.col("model_balanced"), F.col("_m")),
        "false_negative_rate": F.when(F.col("model_balanced"), F.col("_f")),
    }).drop("_b", "_m", "_f")
