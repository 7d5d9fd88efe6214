"""Row-level cleaning: filters, de-duplication, label mapping, defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fv
from ..functions.labels import encode_label, normalize_label
from ..functions.text import strip, truncate


def clean_messages(df: DataFrame, *, text: str = "text", on_long: str = "truncate",
                   min_length: int = fv.MIN_MESSAGE, max_length: int = fv.MAX_MESSAGE) -> DataFrame:
    """Strip, drop short messages, shorten (or drop) long ones; ``was_cut`` marks the cut."""
    if on_long not in ("truncate", "reject", "keep"):
        raise ValueError("on_long must be truncate, reject or keep")
    out = df.withColumn(text, strip(text)).filter(F.length(text) >= min_length)
    long = F.length(text) > max_length
    if on_long == "reject":
        return out.filter(~long).withColumn("was_cut", F.lit(False))
    if on_long == "keep":
        return out.withColumn("was_cut", F.lit(False))
    return out.withColumn("was_cut", long).withColumn(text, truncate(text, max_length))


def cleaning_summary(df: DataFrame, *, text: str = "text") -> DataFrame:
    """How many messages the cleaning drops and cuts, one row."""
    n = F.length(strip(text))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.coalesce(n, F.lit(0)) < fv.MIN_MESSAGE).alias("n_dropped"),
        F.count_if(n > fv.MAX_MESSAGE).alias("n_cut"),
    )


def drop_null_rows(df: DataFrame, *cols: str) -> DataFrame:
    return df.dropna(subset=list(cols))


def dedup_first(df: DataFrame, *, text: str = "text", row_id: str = "row_id") -> DataFrame:
    """Keep the row with the lowest ``row_id`` of every text.

    The rank filter is applied before the exchange as well (one row per text and map
    task), so a text that makes up a third of the table does not pile up in one reducer.
    """
    # a 128-bit digest stands for the text, so whole texts are never compared or sorted by; null is a text of its own
    w = Window.partitionBy(F.md5(F.encode(text, "UTF-8"))).orderBy(row_id)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def normalize_labels(df: DataFrame, *, label: str = "label") -> DataFrame:
    return df.withColumn(label, normalize_label(label))


def encode_labels(df: DataFrame, *, text: str = "text", label: str = "label") -> DataFrame:
    """Drop null rows and unmapped labels; label becomes 0 / 1."""
    return df.dropna(subset=[text, label]).withColumn(label, encode_label(label)).dropna(subset=[label])


def clean_labelled(df: DataFrame, *, text: str = "text", label: str = "label",
                   row_id: str = "row_id") -> DataFrame:
    """Strict-load cleaning: no nulls, first of equal texts, normalised labels."""
    return normalize_labels(dedup_first(drop_null_rows(df, text, label), text=text, row_id=row_id), label=label)


def since(ts: str, as_of: Column, *, hours: float, strict: bool = False) -> Column:
    """Predicate: ``ts`` lies within the last ``hours`` before ``as_of``."""
    edge = as_of - F.make_dt_interval(secs=F.lit(float(hours) * 3600))
    return F.col(ts) > edge if strict else F.col(ts) >= edge


METRIC_DEFAULTS = {
    "accuracy": 0.0, "precision": 0.0, "recall": 0.0, "f1_score": 0.0, "test_samples": 0,
    "class_balancing_enabled": False, "original_spam_ratio": 0.0, "balanced_spam_ratio": 0.0,
    "false_negative_rate": 0.0, "synthetic_samples_used": 0, "balancing_method": "none",
}


def fill_metric_defaults(df: DataFrame) -> DataFrame:
    """Missing metric columns and nulls get their defaults."""
    have = set(df.columns)
    out = df.withColumns({k: F.lit(v) for k, v in METRIC_DEFAULTS.items() if k not in have})
    return out.fillna({k: v for k, v in METRIC_DEFAULTS.items() if k in have})
