"""What the columns of a CSV file are, judged from its header and first rows.

All functions are Column expressions over arrays held in one row per file, so profiling
many files is one projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.text import let, strip


def _key(name: Column) -> Column:
    return strip(F.lower(name))


def _has_any(name: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | name.contains(w)
    return hit


def name_score(name: Column, known, keyword_groups) -> Column:
    def points_of(key: Column) -> Column:
        score = F.when(key.isin(*known), fv.EXACT_NAME_SCORE).otherwise(0)
        for points, words in keyword_groups:
            score = score + F.when(_has_any(key, words), points).otherwise(0)
        return score

    return let(_key(name), points_of)


def text_score(name: Column) -> Column:
    return name_score(name, fv.TEXT_NAMES, fv.TEXT_KEYWORDS)


def label_score(name: Column) -> Column:
    return name_score(name, fv.LABEL_NAMES, fv.LABEL_KEYWORDS)


def _first_best(header: Column, score) -> Column:
    """First name with the highest score, null unless that is positive."""
    ranked = F.transform(header, lambda h, i: F.struct(score(h).alias("s"), (-i).alias("i"), h.alias("h")))
    return let(F.array_max(ranked), lambda best: F.when(best["s"] > 0, best["h"]))


def text_column(header: Column) -> Column:
    """Name of the message column; always some column of a non-empty header."""
    plain = F.get(F.filter(header, lambda h: ~_has_any(_key(h), fv.ID_HINTS)), F.lit(0))
    fallback = F.when(F.size(header) == 1, F.get(header, F.lit(0))).otherwise(F.coalesce(plain, F.get(header, F.lit(0))))
    return F.coalesce(_first_best(header, text_score), fallback)


def label_column(header: Column) -> Column:
    return _first_best(header, label_score)


def is_header_row(row: Column) -> Column:
    """More known or telling names than long fields."""
    def points(h: Column) -> Column:
        return let(_key(h), lambda key: F.when(key.isin(*fv.TEXT_NAMES, *fv.LABEL_NAMES), 2).when(_has_any(key, fv.HEADER_HINTS), 1).otherwise(0))

    gained = F.aggregate(row, F.lit(0), lambda acc, h: acc + points(h))
    long = F.size(F.filter(row, lambda h: F.length(strip(h)) > 50))
    return F.coalesce((F.size(row) > 0) & (gained > long), F.lit(False))


def format_type(text_col: Column, label_col: Column) -> Column:
    return F.when(text_col.isNull(), "unknown").when(label_col.isNotNull(), "training_data").otherwise("batch_only")


def confidence(text_col: Column, label_col: Column, has_header: Column, sample_field: Column) -> Column:
    """0.4 text column, 0.3 / 0.2 with / without label, 0.3 known name, 0.2 long first field."""
    known = has_header & F.lower(text_col).isin(*fv.TEXT_NAMES)
    total = (
        F.when(text_col.isNotNull(), F.when(label_col.isNotNull(), 0.7).otherwise(0.6)).otherwise(0.0)
        + F.when(F.coalesce(known, F.lit(False)), 0.3).otherwise(0.0)
        + F.when(F.coalesce(F.length(strip(sample_field)) > 20, F.lit(False)), 0.2).otherwise(0.0)
    )
    return F.least(F.lit(1.0), F.round(total, 2))


def add_profile(df: DataFrame, first: str = "first_record", second: str = "second_record") -> DataFrame:
    """Add the format columns judged from the first two records (arrays of fields) of a file.

    A file without a header takes its first column as text and its second as label. One
    step per column, so each judgement is made once.
    """
    a, b = F.col(first), F.col(second)
    head = F.col("has_header")
    by_name = lambda name: F.array_position(a, F.col(name)) - 1
    pos = lambda name: F.when(head, F.when(by_name(name) >= 0, by_name(name))).otherwise(
        F.col(name).try_cast("bigint")).cast("int")
    df = df.withColumn("has_header", is_header_row(a))
    df = df.withColumns({
        "email_column": F.when(head, text_column(a)).when(F.size(a) >= 1, "0"),
        "label_column": F.when(head, label_column(a)).when(~head & (F.size(a) >= 2), "1"),
        "column_count": F.when(a.isNull(), 0).otherwise(F.size(a)),
        "_sample": F.when(b.isNotNull(), F.when(head, F.get(b, F.lit(0))).otherwise(F.get(a, F.lit(0)))),
    })
    return df.withColumns({
        "format_type": format_type(F.col("email_column"), F.col("label_column")),
        "confidence_score": confidence(F.col("email_column"), F.col("label_column"), head, F.col("_sample")),
        "text_pos": pos("email_column"), "label_pos": pos("label_column"),
    }).drop("_sample")


def unique_names(header: Column) -> Column:
    """Repeated names become c, c_1, c_2 in order of appearance."""
    return F.transform(header, lambda h, i: F.when(
        F.size(F.filter(F.slice(header, F.lit(1), i), lambda x: x == h)) > 0,
        F.concat(h, F.lit("_"), F.size(F.filter(F.slice(header, F.lit(1), i), lambda x: x == h)).cast("string"))).otherwise(h))


def strip_bom(name: Column) -> Column:
    return F.regexp_replace(name, "^\\ufeff", "")


def structure(header: Column, rows: Column, n_columns: Column, text_pos: Column, has_header: Column) -> tuple[Column, Column]:
    """(errors, warnings) of the header and the first data rows of a file."""
    blank = lambda c: F.coalesce(strip(c), F.lit("")) == ""
    named = F.when(has_header, F.size(F.filter(header, lambda c: ~blank(c)))).otherwise(1)
    unnamed = F.size(F.filter(header, blank))
    n_rows = F.size(rows)
    filled = F.filter(rows, lambda r: F.exists(r, lambda c: ~blank(c)))
    n_empty = n_rows - F.size(filled)
    ragged = F.size(F.filter(filled, lambda r: (F.size(r) != n_columns) & F.exists(
        F.slice(r, named + 1, F.greatest(F.size(r), F.lit(1))), lambda c: ~blank(c))))

    def row_note(r: Column, i: Column) -> Column:
        n = F.length(strip(F.get(r, text_pos)))
        usable = F.exists(r, lambda c: ~blank(c)) & (F.size(r) > text_pos)
        head = F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(": Email content is very "))
        tail = F.concat(F.lit(" ("), n.cast("string"), F.lit(" chars)"))
        return F.when(usable & (n < 5), F.concat(head, F.lit("short"), tail)).when(
            usable & (n > 5000), F.concat(head, F.lit("long"), tail))

    errors = F.array_compact(F.array(
        F.when(n_rows == 0, "No data rows found in CSV file"),
        F.when(ragged > 0, F.concat(F.lit("Inconsistent column count in "), ragged.cast("string"), F.lit(" rows")))))
    warnings = F.array_compact(F.concat(
        F.array(
            F.when(has_header & (F.size(header) != F.size(F.array_distinct(header))),
                   "Duplicate column names detected in header (will be automatically renamed)"),
            F.when(has_header & (unnamed > 0),
                   F.concat(F.lit("Empty column names found in header (will be automatically removed): "),
                            unnamed.cast("string"), F.lit(" columns")))),
        F.transform(rows, row_note),
        F.array(
            F.when((n_rows > 0) & (n_empty > n_rows * 0.5),
                   F.concat(F.lit("High number of empty rows detected ("), n_empty.cast("string"), F.lit("/"),
                            n_rows.cast("string"), F.lit(")"))),
            F.when(n_rows < 5, F.concat(F.lit("Very few data rows ("), n_rows.cast("string"),
                                        F.lit(") - ensure file contains sufficient data"))))))
    return errors, warnings


def suggestions() -> Column:
    """Advice joined by ' | ' from the profile columns."""
    unknown, score, n = F.col("format_type") == "unknown", F.col("confidence_score"), F.col("column_count")
    no_text = F.col("email_column").isNull()
    names = ", ".join(sorted(fv.TEXT_NAMES)[:6])
    rules = F.array_compact(F.array(
        F.when(unknown, "Ensure your CSV has a clear header row with column names"),
        F.when(unknown, f"Use one of these column names for email content: {names}"),
        F.when(unknown & (n == 0), "File appears to be empty or corrupted"),
        F.when(unknown & (n == 1), "Single column detected - name it 'email_content' or 'text'"),
        F.when(no_text & (n > 1), "Multiple columns detected but none recognized as email content"),
        F.when(no_text & (n > 1), "Rename your email column to: 'email_content', 'text', 'message', or 'content'"),
        F.when(no_text & (n <= 1), "Make sure you have a column containing email text"),
        F.when(no_text & (n <= 1), "For single column files, add a header row with 'email_content'"),
        F.when(score < 0.3, "Very low format confidence - check file structure"),
        F.when((score < 0.3) & ~F.col("has_header"), "Add a header row with column names"),
        F.when(score < 0.3, "Ensure data rows contain actual email text (not just numbers or short codes)"),
        F.when((score >= 0.3) & (score < 0.7), "Consider using standard column names for better detection"),
        F.when((score >= 0.3) & (score < 0.7), "Recommended: 'email_content' for text, 'label' for classification"),
        F.when(F.col("detected_encoding") != "utf-8",
               F.concat(F.lit("File encoding detected as "), F.col("detected_encoding"),
                        F.lit(" - consider saving as UTF-8"))),
        F.when(F.col("format_type") == "batch_only", "Format detected as batch processing (email content only)"),
        F.when(F.col("format_type") == "training_data", "Format detected as training data (email content + labels)"),
    ))
    return F.when(F.size(rules) == 0, "CSV format looks good!").otherwise(F.array_join(rules, " | "))


def file_messages(path: Column, length: Column) -> tuple[Column, Column]:
    """(errors, warnings) from the name and size of a file."""
    errors = F.array_compact(F.array(
        F.when(~F.lower(path).endswith(".csv"), "File must have .csv extension"),
        F.when(length == 0, "File is empty")))
    warnings = F.array_compact(F.array(
        F.when(length > 100 * 1024 * 1024, "File is very large (>100MB), processing may be slow")))
    return errors, warnings


def format_messages() -> tuple[Column, Column]:
    """(errors, warnings) about the detected format from the profile columns."""
    unknown, score = F.col("format_type") == "unknown", F.col("confidence_score")
    shown = F.format_string("%.2f", score)
    errors = F.array_compact(F.array(
        F.when(unknown, "Cannot automatically detect CSV format")
        .when(score < 0.3, F.concat(F.lit("Very low confidence in format detection ("), shown, F.lit(")"))),
        F.when(unknown | (score < 0.3), F.concat(F.lit("Format suggestions: "), suggestions())),
        F.when(F.col("email_column").isNull(), "No email content column detected in CSV file")))
    moderate = ~unknown & (score >= 0.3) & (score < 0.7)
    warnings = F.array_compact(F.array(
        F.when(moderate, F.concat(F.lit("Moderate confidence in format detection ("), shown, F.lit(")"))),
        F.when(moderate, F.concat(F.lit("Consider: "), suggestions()))))
    return errors, warnings


def batch_suitability() -> Column:
    """reject (unknown format), warn (confidence below one half) or accept."""
    return F.when(F.col("format_type") == "unknown", "reject").when(F.col("confidence_score") < 0.5, "warn").otherwise("accept")


def strict_messages(header: Column, rows: Column, n_rows: Column, *, text: str = "text", label: str = "label") -> tuple[Column, Column]:
    """(errors, warnings) of the strict loader: required names, width of five rows, any data."""
    errors = F.array_compact(F.array(
        F.when(header.isNull(), "CSV file has no header row"),
        F.when(header.isNotNull() & ~F.array_contains(header, text), f"Required column '{text}' not found in CSV"),
        F.when(header.isNotNull() & ~F.array_contains(header, label), f"Required column '{label}' not found in CSV"),
        F.when(header.isNotNull() & (n_rows == 0), "CSV file has no data rows")))
    warnings = F.array_compact(F.transform(F.slice(rows, 1, 5), lambda r, i: F.when(
        F.size(r) != F.size(header),
        F.concat(F.lit("Row "), (i + 2).cast("string"), F.lit(" has "), F.size(r).cast("string"),
                 F.lit(" columns, expected "), F.size(header).cast("string")))))
    return errors, warnings
