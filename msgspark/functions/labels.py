"""Label, identifier and tier expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import _col, strip


def normalize_label(c) -> Column:
    """spam / legitimate / unknown, never null (lower-cased and stripped first)."""
    v = strip(F.lower(_col(c).cast("string")))
    return (
        F.when(v.isin("spam", "1"), "spam")
        .when(v.isin("ham", "legitimate", "0"), "legitimate")
        .otherwise("unknown")
    )


def encode_label(c) -> Column:
    """1 for spam, 0 for ham / legitimate, null for anything else (no stripping)."""
    v = F.lower(_col(c).cast("string"))
    return F.when(v == "spam", 1).when(v.isin("ham", "legitimate"), 0)


def format_prediction(c) -> Column:
    v = F.lower(_col(c).cast("string"))
    return (
        F.when(v.isin("spam", "1", "1.0"), "Spam")
        .when(v.isin("legitimate", "ham", "0", "0.0"), "Legitimate")
        .otherwise("Unknown")
    )


def is_job_id(c) -> Column:
    """True for the UUID spellings a parser accepts: braces, urn prefix, hyphens optional."""
    digits = F.regexp_replace(
        F.regexp_replace(strip(c), "urn:|uuid:", ""), r"^[{}]+|[{}]+$", ""
    )
    return F.coalesce(F.replace(digits, F.lit("-"), F.lit("")).rlike("^[0-9a-fA-F]{32}$"), F.lit(False))


def accuracy_tier(c) -> Column:
    c = _col(c)
    return F.when(c >= 0.95, "green").when(c >= 0.90, "yellow").otherwise("red")


def fnr_tier(c) -> Column:
    c = _col(c)
    return F.when(c <= 0.02, "green").when(c <= 0.05, "yellow").otherwise("red")


def throughput_tier(per_second) -> Column:
    c = _col(per_second)
    return F.when(c > 10000, "high").when(c > 1000, "medium").otherwise("low")


def memory_tier(mb) -> Column:
    c = _col(mb)
    return (
        F.when(c < 500, "excellent").when(c < 1000, "good").when(c < 2000, "moderate").otherwise("poor")
    )


def parse_or_default(c, type_name: str, default) -> Column:
    """Typed value of a string, ``default`` where it cannot be read."""
    return F.coalesce(_col(c).try_cast(type_name), F.lit(default))
