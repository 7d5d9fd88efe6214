"""Text normalisation as Column expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fv

# White space as Python's str.strip() and \s see it, spelled out: Java's own \s is ASCII
# only and its Unicode mode (?U) is several times slower than an explicit class.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"\p{L}\p{N}_"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same characters as a plain string for trimming (no regular expression involved).
WS_CHARS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                             0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c) -> Column:
    """Trim all Unicode white space (Spark's ``trim`` drops U+0020 only)."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


def lower_text(c) -> Column:
    return F.lower(_col(c))


def strip_addresses(c) -> Column:
    """Drop every word that has an @ between other characters.

    The pattern takes the blank before a word with it, so it is tried once per word and is
    linear in the text even for very long words; texts without @ skip it.
    """
    c = _col(c)
    bare = F.regexp_replace(c, f"(^|[{WS}])[^{WS}][^{WS}@]*+@[^{WS}]++", "$1")
    return F.when(c.contains("@"), bare).otherwise(c)


def strip_urls(c) -> Column:
    return F.regexp_replace(_col(c), f"http[^{WS}]+|www[^{WS}]+", "")


def strip_tags(c) -> Column:
    return F.regexp_replace(_col(c), "<[^>]+>", "")


def collapse_space(c) -> Column:
    return F.regexp_replace(_col(c), f"[{WS}]+", " ")


def punctuation_to_space(c) -> Column:
    return F.regexp_replace(_col(c), f"[^{WORD}{WS}]", " ")


def drop_digits(c) -> Column:
    return F.regexp_replace(_col(c), r"\p{Nd}+", "")


def squeeze(c) -> Column:
    """Single spaces only, none at the ends; null becomes the empty string."""
    return F.coalesce(F.trim(collapse_space(c)), F.lit(""))


def clean_text(c) -> Column:
    """Lower-case, drop addresses, links, tags, punctuation and digits, squeeze spaces.

    Punctuation and white space both end as one space and digits vanish without one, so
    the last four steps need two passes over the text: digits, then every other
    non-word run.
    """
    bare = strip_tags(strip_urls(strip_addresses(lower_text(c))))
    words = F.regexp_replace(drop_digits(bare), f"[^{WORD}]+", " ")
    return F.coalesce(F.trim(words), F.lit(""))


def content_words(cleaned) -> Column:
    """Array of the words of a cleaned text without stop words and short words."""
    return F.filter(
        F.split(_col(cleaned), " "),
        lambda w: (F.length(w) >= fv.MIN_WORD_LENGTH) & ~w.isin(*fv.STOP_WORDS),
    )


def remove_stop_words(cleaned) -> Column:
    return F.array_join(content_words(cleaned), " ")


def tokens(c) -> Column:
    """Tokens of a raw text: cleaned, without stop words, in order, with repeats."""
    return content_words(clean_text(c))


def preprocess(c) -> Column:
    return F.array_join(tokens(c), " ")


def word_tokens(preprocessed) -> Column:
    """Tokens (two characters or more) of an already preprocessed text."""
    return F.filter(F.split(_col(preprocessed), " "), lambda w: F.length(w) >= 2)


def ngrams(toks, low: int = 1, high: int = 2) -> Column:
    """All ``low``..``high``-grams of a token array, words joined by one space."""
    if not 1 <= low <= high:
        raise ValueError("need 1 <= low <= high")
    toks = _col(toks)
    grams, step = ([toks] if low == 1 else []), toks
    for n in range(2, high + 1):
        # step holds the (n-1)-grams; pair each with the word that follows it
        step = F.zip_with(
            F.slice(step, F.lit(1), F.greatest(F.size(toks) - (n - 1), F.lit(0))),
            F.slice(toks, F.lit(n), F.greatest(F.size(toks) - (n - 1), F.lit(0))),
            lambda a, b: F.concat(a, F.lit(" "), b),
        )
        if n >= low:
            grams.append(step)
    return grams[0] if len(grams) == 1 else F.concat(*grams)


def preview(c, limit: int = fv.PREVIEW) -> Column:
    """First ``limit`` characters, with dots where something was cut."""
    c = _col(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def truncate(c, limit: int = fv.MAX_MESSAGE) -> Column:
    return F.substring(_col(c), 1, limit)
