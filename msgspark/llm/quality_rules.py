"""Quality rules: one table of thresholds compiled into one projection of ratios.

Words are ``[^\\x20\\x09-\\x0D]+``. Every rule is a ratio with a lower and an upper bound; ``compile_rules``
turns the table into a single boolean column, so all rules are evaluated in one pass over the
text by Spark's own functions, with no exchange and no user function.

Defined results: a null text counts as empty. An empty or blank text has no words, fails the base rule
and is rejected. Rows are judged alone, so repeated rows and ties get equal results, and an empty
table gives an empty table. Extra columns pass through ``keep_good`` untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

WORD_GAP = r"[\\x20\\x09-\\x0D]+"
WINDOW = 8

# fixed values: frequent function words of English, Spanish, German and French
STOP_WORDS = (
    "the", "of", "and", "to", "in", "that", "is", "for", "it", "on", "with", "as", "was", "by", "at", "be", "this",
    "de", "la", "que", "el", "y", "los", "las", "del", "un", "una", "por", "con", "no", "se", "es", "lo", "su",
    "der", "die", "und", "den", "das", "von", "zu", "mit", "sich", "des", "ein", "eine", "dem", "nicht", "ist",
    "le", "et", "les", "des", "en", "est", "une", "du", "dans", "qui", "pour", "pas", "par", "sur", "au",
)


@dataclass(frozen=True)
class Rule:
    """``low <= top / bottom <= high``; a rule whose bottom is 0 passes."""
    name: str
    top: str
    bottom: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=2.0, high=16.0),
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.1),
    Rule("stop_word_share", "n_stop_words", "n_words", low=0.02),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", high=0.4),
)


def compile_rules(rules=RULES, prefix: str = "") -> Column:
    """One boolean column: every rule of the table holds."""
    verdict = F.lit(True)
    for r in rules:
        top, bottom = F.col(prefix + r.top).cast("double"), F.col(prefix + r.bottom).cast("double")
        for bound, holds in ((r.low, lambda b: top >= F.lit(b) * bottom), (r.high, lambda b: top <= F.lit(b) * bottom)):
            if bound is not None:
                verdict = verdict & ((bottom == 0) | holds(bound))
    return verdict


# A window found twice has an equal neighbour among the sorted (hash, start) pairs. array_distinct tells
# cheaply whether there is any; the pairs are made for such texts only.
_REPEATED = """
if(size(_q_windows) = size(array_distinct(_q_windows)), 0L,
  transform(array(sort_array(transform(_q_windows, (h, i) -> struct(h, i)))), pairs ->
    transform(array(sort_array(transform(
        filter(pairs, (p, k) -> get(pairs, k - 1).h = p.h or get(pairs, k + 1).h = p.h), p -> p.i))), starts ->
      aggregate(transform(starts, (s, k) -> cast(least({w}, coalesce(get(starts, k + 1), s + {w}) - s) as bigint)),
                0L, (a, b) -> a + b))[0])[0])
""".format(w=WINDOW)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``_q_row`` (the input row as a struct) with the counts of its text, each named ``_q_<count>``."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    words = docs.select(F.struct("*").alias("_q_row")).select(
        "_q_row", F.coalesce(F.col(f"_q_row.`{text_col}`"), F.lit("")).alias("_q_text")).select(
        "_q_row", "_q_text", F.expr(f"array_remove(split(_q_text, '{WORD_GAP}'), '')").alias("_q_words"),
        F.expr(r"filter(split(_q_text, '\\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("_q_lines"))
    windows = words.withColumn("_q_windows", F.expr(
        f"if(size(_q_words) < {WINDOW}, array(), transform(sequence(0, size(_q_words) - {WINDOW}),"
        f" i -> xxhash64(slice(_q_words, i + 1, {WINDOW}))))"))
    return windows.select(
        "_q_row",
        F.expr("cast(size(_q_words) as bigint)").alias("_q_n_words"),
        F.expr("cast(length(array_join(_q_words, '')) as bigint)").alias("_q_word_chars"),
        F.expr(r"cast(regexp_count(_q_text, '[#*$%&|<>]') as bigint)").alias("_q_n_symbols"),
        F.expr("cast(size(_q_lines) as bigint)").alias("_q_n_lines"),
        F.expr("cast(size(_q_lines) - size(array_distinct(_q_lines)) as bigint)").alias("_q_n_dup_lines"),
        F.expr(f"cast(size(filter(_q_words, w -> w in ({stop}))) as bigint)").alias("_q_n_stop_words"),
        F.expr(_REPEATED).alias("_q_n_repeat_words"))


def judge(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """``measure`` with ``_q_base_failed`` and ``_q_kept``."""
    base = (F.col("_q_n_words") < 20) | (100 * F.col("_q_n_repeat_words") > 30 * F.col("_q_n_words"))
    return measure(docs, text_col).withColumns({
        "_q_base_failed": base, "_q_kept": ~base & compile_rules(rules, "_q_")})


def keep_good(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows whose text passes all rules, with the columns they came with.

    The verdict drops a row by exploding none instead of one: a filter would be pushed below the projections, which
    puts the splitting of the text into every use of its words.
    """
    judged = judge(docs, text_col, rules)
    return judged.select(F.explode(F.when(F.col("_q_kept"), F.array("_q_row"))).alias("_q_row")).select("_q_row.*")


def report(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules=RULES) -> DataFrame:
    """One row per document: its counts, whether the base rule failed, and the verdict."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines",
             "n_stop_words")
    return judge(docs, text_col, rules).select(F.col(f"_q_row.`{id_col}`").alias(id_col),
                                               *[F.col(f"_q_{n}").alias(n) for n in names])
