"""Terms counted within tasks: against brute force, with keys that repeat or are null, and documents larger than a slice."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from msgspark.operators import bayes, features as feat, grams

SCHEMA = "row_id bigint, text string, label int"


def rows_of(n=120, seed=4):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))), i % 2) for i in range(n)]
    rows += [(3, "wax wax wbx", 1), (3, "wbx wax", 0), (None, "wax wbx", 0), (None, "wcx", 0), (None, "wax", 1), (700, None, 0), (701, "", 1)]
    return rows


def of_text(text, high=2):
    words = (text or "").split()
    return [" ".join(words[i: i + n]) for n in range(1, high + 1) for i in range(len(words) - n + 1)]


def by_key(rows, key):
    found = {}
    for r in rows:
        found.setdefault(key(r), Counter()).update(of_text(r[1]))
    return found


def test_counts_equal_brute_force_for_repeated_and_null_keys(spark):
    rows = rows_of()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r.row_id, r.label, r.term): r.tf for r in feat.term_counts(docs, keep=("label",)).collect()}
    assert got == {(*k, t): n for k, c in by_key(rows, lambda r: (r[0], r[2])).items() for t, n in c.items()}
    none = feat.term_counts(docs, keep_empty=True).filter("term IS NULL").collect()
    assert sorted((r.row_id, r.tf) for r in none) == sorted((k, 0) for k, c in by_key(rows, lambda r: r[0]).items() if not c)
    documents = by_key(rows, lambda r: r[0]).values()
    cf, df = sum(documents, Counter()), Counter(t for c in documents for t in c)
    vocab = {r.term: (r.df, r.cf) for r in feat.fit_vocabulary(docs, max_df=1.0, max_features=None).collect()}
    assert vocab == {t: (df[t], n) for t, n in cf.items() if df[t] >= 2}


def test_documents_larger_than_a_slice():
    rows = sorted(((d, t) for d, t, _ in rows_of()), key=lambda r: (r[0] is not None, r[0] or 0))
    batches = [pa.RecordBatch.from_pylist([{"row_id": d, "_text": t} for d, t in rows[i: i + 7]], pa.schema(
        [("row_id", pa.int64()), ("_text", pa.string())])) for i in range(0, len(rows), 7)]
    want = by_key(rows, lambda r: r[0])
    for limit in (1, 5, 60, 1 << 20):
        got, n = {}, 0
        for c in grams.counted(iter(batches), 1, 2, limit):
            n += c.n
            ids = c.rows.column("row_id").to_pylist()
            for d, code, tf in zip(c.doc, c.code, c.tf):
                key = ids[d], c.terms[int(code)].as_py()
                assert key not in got
                got[key] = tf
        assert n == len(want) and got == {(d, t): tf for d, c in want.items() for t, tf in c.items()}


@pytest.mark.parametrize("high", [1, 3])
def test_other_lengths_of_grams(spark, high):
    docs = spark.createDataFrame(rows_of(30)[:30], SCHEMA)
    got = {(r.row_id, r.term): r.tf for r in feat.term_counts(docs, ngram_range=(high, high)).collect()}
    assert got == {(d, t): n for d, text, _ in rows_of(30)[:30] for t, n in Counter(
        t for t in of_text(text, high) if t.count(" ") == high - 1).items()}


def test_no_row_per_word_is_made_or_hashed(spark):
    docs = spark.createDataFrame(rows_of(), SCHEMA)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    terms, priors = bayes.fit(docs)
    for df in (feat.term_counts(docs), bayes.score(docs, terms, priors), feat.tfidf_arrays(docs, feat.fit_vocabulary(docs))):
        assert "Generate" not in plan(df) and "HashAggregate(keys=[row_id" not in plan(df)
    weights = feat.tfidf(docs, feat.fit_vocabulary(docs), keep=("label",))
    norms = weights.groupBy("row_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()
    assert norms and all(r.s == pytest.approx(1) for r in norms)  # rows of one id are one document, whatever their label


@pytest.mark.parametrize("high", [1, 2, 3])
def test_buckets_bound_the_occurrences_of_their_terms(spark, high):
    rows = rows_of()
    docs = feat.arranged(spark.createDataFrame(rows, SCHEMA).repartition(5))
    seen, n = grams.occurrences(docs, 1, high)
    cf = sum((Counter(of_text(t, high)) for _, t, _ in rows), Counter())
    assert n == len(rows) and seen.sum() == sum(cf.values())
    own = {t: grams.buckets_of(pa.array([t])) for t in cf}
    assert all(own[t].sum() == 1 and seen[own[t]][0] >= c for t, c in cf.items())
    kept = grams.buckets_of(pa.array(sorted(cf)[::3]))
    got = {r.term: r.cf for r in grams.term_totals(docs, 1, high, kept).collect()}
    assert got == {t: c for t, c in cf.items() if kept[own[t]].all()}
    none = feat.arranged(spark.createDataFrame([], SCHEMA))
    assert grams.occurrences(none, 1, high)[1] == 0


@pytest.mark.parametrize("fullest", [1, 8])
def test_bounded_vocabulary_is_exact_and_exchanges_few_terms(spark, monkeypatch, fullest):
    """Terms of every document are most frequent, but left out by max_df: the first buckets do not hold enough terms."""
    letters = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(60)]
    rows = [(i, " ".join([*[f"qall{a}"] * 9, f"qpair{letters[i % 20]}{a}", f"qone{letters[i]}{a}"]), 0) for i in range(60) for a in letters[:20]]
    docs = spark.createDataFrame(rows, SCHEMA)
    documents = by_key(rows, lambda r: r[0]).values()
    cf, df = sum(documents, Counter()), Counter(t for c in documents for t in c)
    asked = []
    counted = grams.term_totals
    monkeypatch.setattr(grams, "term_totals", lambda words, low, high, kept=None: asked.append(kept) or counted(words, low, high, kept))
    for most in (0, 3, 30, 100_000):
        asked.clear()
        got = [(r.term, r.df, r.cf) for r in feat.fit_vocabulary(docs, max_df=0.04, max_features=most, fullest=fullest).orderBy("term_idx").collect()]
        fit = sorted((t for t in cf if 2 <= df[t] <= 0.04 * len(rows)), key=lambda t: (-cf[t], t))[:most]
        assert got == [(t, df[t], cf[t]) for t in sorted(fit)]
        assert asked and all(k is not None and k.sum() < len(cf) for k in asked)
    words = feat.prepared(docs)
    assert feat.fit_vocabulary(words, max_features=40).collect() == feat.fit_vocabulary(docs, max_features=40).collect()


def test_no_known_terms_are_exchanged_to_normalise_documents(spark):
    docs = spark.createDataFrame(rows_of(), SCHEMA)
    words = feat.prepared(docs, keep=("label",))
    vocab = feat.fit_vocabulary(words)
    weights = feat.tfidf(words, vocab, keep=("label",))
    assert "Window" not in weights._jdf.queryExecution().executedPlan().toString()
    plain = feat.tfidf(docs, vocab.limit(5000), keep=("label",), max_features=None)
    key = lambda df: sorted((r.row_id is not None, r.row_id or 0, r.label, r.term, r.tf, round(r.weight, 9)) for r in df.collect())
    assert key(weights) == key(plain)


def test_documents_of_one_id_are_held_together_across_slices(spark, monkeypatch):
    monkeypatch.setattr(grams.counted, "__defaults__", (40, None))
    test_no_known_terms_are_exchanged_to_normalise_documents(spark)
