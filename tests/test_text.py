"""Text functions against the same steps written with Python's re module."""

import random
import re

import pytest
from pyspark.sql import functions as F

from msgspark.functions import fixed_values as fv, labels as L, text as T

SAMPLES = [
    None, "", "   ", "\t\n ", "Hello World", "write to Bob@Example.com now", "@a", "a@", "@a@b", "see http://x.y/z?q=1 and WWW.site.org ok",
    "<p>Bold</p> text <br/>", "a<b and c>d", "a1b 22 c3", "line\none\r\nline two", "tab\tsep", "x\x1cy", "x\x0by", "x\x85y",
    "x y", "x y　z", "café naïve", "étude", "m² ½ cup", "你好 世界", "hi \U0001f600 there",
    "١٢٣ digits", "under_score a-b", "don't stop!!", "FREE $$$ winner!!! call 555-1234", "the and of a an I am",
    "z" * 9, "z" * 10, "z" * 49, "z" * 50, " " * 5 + "z" * 9 + "\t", "z" * 10000, "z" * 10001, "\t" * 3 + "z" * 10000,
]


def py_clean(text):
    if not isinstance(text, str):
        return ""
    text = text.lower()
    for pattern, to in ((r"\S+@\S+", ""), (r"http\S+|www\S+", ""), (r"<[^>]+>", ""), (r"\s+", " "), (r"[^\w\s]", " "), (r"\d+", "")):
        text = re.sub(pattern, to, text)
    return " ".join(text.split())


def py_tokens(text):
    return [w for w in py_clean(text).split() if w not in set(fv.STOP_WORDS) and len(w) > 2]


def run(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["o"] for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]


def test_clean_text(spark):
    assert run(spark, SAMPLES, T.clean_text) == [py_clean(s) for s in SAMPLES]


def test_tokens_and_preprocess(spark):
    assert run(spark, SAMPLES, T.tokens) == [py_tokens(s) for s in SAMPLES]
    assert run(spark, SAMPLES, T.preprocess) == [" ".join(py_tokens(s)) for s in SAMPLES]


def test_strip(spark):
    assert run(spark, SAMPLES, T.strip) == [None if s is None else s.strip() for s in SAMPLES]


def test_ngrams(spark):
    def grams(s, lo, hi):
        t = py_tokens(s)
        return [" ".join(t[i:i + n]) for n in range(lo, hi + 1) for i in range(len(t) - n + 1)]

    for lo, hi in ((1, 1), (1, 2), (2, 2), (1, 3)):
        assert run(spark, SAMPLES, lambda c: T.ngrams(T.tokens(c), lo, hi)) == [grams(s, lo, hi) for s in SAMPLES]
    with pytest.raises(ValueError):
        T.ngrams("t", 2, 1)


def test_clean_text_random(spark):
    rng = random.Random(7)
    alphabet = [chr(c) for c in range(1, 0x250)] + list(" \t\n<>@.1aZ") * 30
    values = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    assert run(spark, values, T.clean_text) == [py_clean(v) for v in values]


def test_preview_and_truncate(spark):
    assert run(spark, ["a" * 100, "a" * 101, None], T.preview) == ["a" * 100, "a" * 100 + "...", None]
    assert run(spark, ["a" * 10001], lambda c: F.length(T.truncate(c))) == [10000]


def test_labels(spark):
    values = ["spam", " SPAM ", "1", "ham", "Legitimate", "0", "2", "", None, "unknown"]
    assert run(spark, values, L.normalize_label) == ["spam", "spam", "spam", "legitimate", "legitimate", "legitimate"] + ["unknown"] * 4
    assert run(spark, values, L.encode_label) == [1, None, None, 0, 0, None, None, None, None, None]
    assert run(spark, ["1", "Spam", "HAM", "0", "x", None], L.format_prediction) == ["Spam", "Spam", "Legitimate", "Legitimate", "Unknown", "Unknown"]


def test_job_id(spark):
    import uuid

    good = [str(uuid.UUID(int=5)), uuid.UUID(int=7).hex, "{" + str(uuid.UUID(int=9)) + "}", "urn:uuid:" + str(uuid.UUID(int=1))]
    bad = ["", "abc", str(uuid.UUID(int=5))[:-1], "g" * 32, None]
    assert run(spark, good + bad, L.is_job_id) == [True] * len(good) + [False] * len(bad)


def test_tiers_and_parsing(spark):
    got = run(spark, ["0.95", "0.9", "0.5"], lambda c: L.accuracy_tier(c.cast("double")))
    assert got == ["green", "yellow", "red"]
    assert run(spark, ["0.02", "0.05", "0.06"], lambda c: L.fnr_tier(c.cast("double"))) == ["green", "yellow", "red"]
    assert run(spark, ["12", "x", None], lambda c: L.parse_or_default(c, "int", 7)) == [12, 7, 7]
