"""Message, batch, payload and file-name validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.text import _col, let, strip


def _lengths(c) -> Column:
    """Length of the stripped and of the raw text, read once per message."""
    return F.struct(F.length(strip(c)).alias("bare"), F.length(_col(c)).alias("raw"))


def message_errors(c, *, on_stripped: bool = False, max_length: int | None = fv.MAX_MESSAGE) -> Column:
    """Array of error messages of a message; empty for a valid one. ``max_length`` None: no upper limit.

    ``on_stripped`` measures the upper limit on the stripped text (the request check)
    instead of the raw text (the loader check).
    """
    def rules(n: Column) -> Column:
        bare, measured = n["bare"], n["bare"] if on_stripped else n["raw"]
        return F.array_compact(F.array(
            F.when(bare.isNull(), fv.ERR_NONE),
            F.when(bare == 0, fv.ERR_EMPTY),
            F.when((bare > 0) & (bare < fv.MIN_MESSAGE), fv.ERR_SHORT),
            F.when((bare > 0) & (measured > F.lit(max_length).cast("int")), fv.ERR_LONG),
        ))
    return let(_lengths(c), rules)


def message_warnings(c) -> Column:
    return let(F.length(strip(c)), lambda n: F.array_compact(F.array(
        F.when((n >= fv.MIN_MESSAGE) & (n < fv.SHORT_MESSAGE), fv.WARN_SHORT))))


def request_error(c, field: str = "email_text") -> Column:
    """First failing request check as one message, null when the text passes."""
    return let(F.length(strip(c)), lambda n: (
        F.when(n.isNull(), f"{field} cannot be None")
        .when(n == 0, f"{field} cannot be empty")
        .when(n < fv.MIN_MESSAGE, f"{field} is too short (minimum 10 characters)")
        .when(n > fv.MAX_MESSAGE, f"{field} is too long (maximum 10,000 characters)")))


def validate_messages(df: DataFrame, *, text: str = "text", mode: str = "raw",
                      max_length: int | None = fv.MAX_MESSAGE) -> DataFrame:
    """Add ``is_valid``, ``errors`` and ``warnings``."""
    if mode not in ("raw", "stripped"):
        raise ValueError("mode must be 'raw' or 'stripped'")
    errors = message_errors(text, on_stripped=mode == "stripped", max_length=max_length)
    return (
        df.withColumn("errors", errors)
        .withColumn("warnings", message_warnings(text))
        .withColumn("is_valid", F.size("errors") == 0)
    )


def batch_messages(df: DataFrame, *, text: str = "text", index: str = "email_index") -> DataFrame:
    """One row per error or warning of a batch, numbered by the 1-based ``index``."""
    checked = validate_messages(df, text=text)
    tagged = F.concat(
        F.transform("errors", lambda m: F.struct(F.lit("error").alias("level"), m.alias("message"))),
        F.transform("warnings", lambda m: F.struct(F.lit("warning").alias("level"), m.alias("message"))),
    )
    return checked.select(F.col(index), F.explode(tagged).alias("m")).select(
        index,
        "m.level",
        F.concat(F.lit("Email "), F.col(index).cast("string"), F.lit(": "), F.col("m.message")).alias("message"),
    )


def batch_verdict(df: DataFrame, *, text: str = "text", max_rows: int | None = None) -> DataFrame:
    """One row: size, number of invalid rows and whether the batch is accepted."""
    checked = validate_messages(df, text=text)
    one = checked.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col("is_valid")).alias("n_invalid"),
        F.coalesce(F.sum(F.size("warnings")), F.lit(0)).cast("bigint").alias("n_warnings"),
    )
    over = F.lit(False) if max_rows is None else F.col("n_rows") > max_rows
    return one.withColumn("is_valid", (F.col("n_rows") > 0) & (F.col("n_invalid") == 0) & ~over)


def first_batch_error(df: DataFrame, *, text: str = "text", index: str = "email_index") -> DataFrame:
    """The first failing row of a request batch (0-based number in the message)."""
    bad = df.select(F.col(index), request_error(text).alias("problem")).filter("problem IS NOT NULL")
    return (
        bad.orderBy(index).limit(1)
        .select(index, F.concat(F.lit("Email at index "), (F.col(index) - 1).cast("string"),
                                F.lit(": "), F.col("problem")).alias("message"))
    )


def content_profile(df: DataFrame, *, text: str = "text", label: str = "label") -> DataFrame:
    """Nulls, unexpected labels and duplicate texts of a labelled table, one row.

    Equal texts are combined before the count (one partial row per text and task), so a
    text that fills a third of the table costs no more than a rare one.
    """
    per_text = (
        df.select(
            F.col(text).alias("t"),
            F.col(text).isNull().cast("bigint").alias("tn"),
            F.col(label).isNull().cast("bigint").alias("ln"),
        )
        .groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum("tn").alias("tn"), F.sum("ln").alias("ln"))
    )
    return per_text.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.coalesce(F.sum("tn"), F.lit(0)).cast("bigint").alias("missing_text"),
        F.coalesce(F.sum("ln"), F.lit(0)).cast("bigint").alias("missing_label"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_texts"),
    )


def unexpected_labels(df: DataFrame, *, label: str = "label") -> DataFrame:
    """Label values outside the expected set, with their counts."""
    expected = ("spam", "ham", "legitimate", "0", "1")
    value = F.col(label).cast("string")
    return (
        df.filter(value.isNotNull() & ~value.isin(*expected))
        .groupBy(value.alias("label")).agg(F.count(F.lit(1)).alias("n_rows"))
    )


def _truthy(j: Column, field: str) -> Column:
    """Whether a JSON object holds ``field`` with a value that is not empty, 0 or false."""
    v = F.get_json_object(j, f"$.{field}")
    numeric = v.try_cast("double")
    return F.coalesce(
        v.isNotNull() & ~v.isin("", "false", "[]", "{}", "null") & (numeric.isNull() | (numeric != 0)),
        F.lit(False),
    )


def missing_json_fields(c, fields: list[str]) -> Column:
    """Array of the required fields a JSON payload lacks; null for a broken payload."""
    j = _col(c)
    missing = F.array_compact(F.array(*[F.when(~_truthy(j, f), f) for f in fields]))
    return F.when(F.get_json_object(j, "$").isNotNull(), missing)


def check_payloads(df: DataFrame, *, payload: str, fields: list[str]) -> DataFrame:
    missing = missing_json_fields(payload, fields)
    code = (
        F.when(F.col("missing_fields").isNull(), "INVALID_JSON")
        .when(F.size("missing_fields") > 0, "MISSING_REQUIRED_FIELDS")
    )
    return df.withColumn("missing_fields", missing).withColumn("code", code)


def file_name_error(c, allowed: tuple[str, ...] = ("csv", "txt")) -> Column:
    """Why an upload name is refused, null when it is fine."""
    name = strip(c)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    shown = F.when(name.contains("."), ext).otherwise("none")
    listed = ", ".join(sorted(allowed))
    return (
        F.when(_col(c).isNull() | (_col(c) == ""), "No file selected. Please choose a file to upload.")
        .when(name == "", "Invalid filename. Please use a file with a valid name.")
        .when(name.rlike(r'[<>:"|?*\\/]'),
              'Invalid filename. Please use a filename without special characters like < > : " | ? * \\ /')
        .when(~(name.contains(".") & ext.isin(*allowed)),
              F.concat(F.lit("Invalid file format '"), shown,
                       F.lit(f"'. Please upload a file with one of these formats: {listed}")))
    )


def file_head_error(name, start, first_row) -> Column:
    """Why an uploaded CSV file is refused by its first characters and the fields of its first row, null when it is fine.

    Files of other kinds are not looked into; a null ``first_row`` (a head that was not read) passes.
    """
    row = _col(first_row)
    blank = row.isNotNull() & ~F.exists(row, lambda c: F.coalesce(strip(c), F.lit("")) != "")
    return F.when(strip(F.lower(_col(name))).endswith(".csv"), F.when(
        strip(F.coalesce(_col(start), F.lit(""))) == "", "The CSV file appears to be empty. Please upload a file with email data.").when(
        blank, "The CSV file has no valid data in the first row. Please ensure your file contains email data."))
