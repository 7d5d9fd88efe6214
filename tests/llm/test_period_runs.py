"""op11 against brute force: every period of every text, on periodic, random, empty, null, long and repeated rows."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from msgspark.llm import period_runs

SCHEMA = "doc_id long, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        s = 0
        while s < n - q:
            e = s
            while e < n - q and words[e] == words[e + q]:
                e += 1
            if e - s + q >= max(6, 4 * q):
                found.setdefault((s, e - s + q), q)
            s = e + 1
    return sorted((s, q, length) for (s, length), q in found.items())


def brute(doc_id, text, plant):
    words = (text or "").encode().split()
    if plant and doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    gone = {i for s, q, length in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1])) if runs else None
    listed = "".join(f"{s},{length},{q}\n" for s, q, length in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4),
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def table(seed=4, n=260):
    rng, rows = random.Random(seed), []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            base = [rng.choice("ab" if rng.random() < 0.4 else ["the", "x", "Ünd", "c\x1cd", "　", "of"]) for _ in range(rng.randint(1, 30))]
            parts += (base * rng.randint(1, 9))[: rng.randint(1, 200)]
        rows.append((i, rng.choice([" ", "\n", "\t  "]).join(parts)))
    return rows + [(None, "a b " * 5), (None, "c " * 9), (None, None), (900, None), (901, ""), (902, " \n"), (903, "z " * 700),
                   (903, "z " * 700), (903, "y x " * 300), (904, "p q r s t " * 400)]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("segment", [1 << 14, 64, 16])
def test_runs_equal_brute_force(spark, segment):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(((d, *brute(d, t, True)) for d, t in rows), key=repr)
    assert got(period_runs.report(df.repartition(5), plant=True, segment=segment)) == want
    assert {r[0] for r in want if r[1]} >= {None, 903, 904}


def test_runs_without_planting_and_their_texts(spark):
    rows = table(9, 60)
    found = period_runs.find(spark.createDataFrame(rows, SCHEMA))
    documents = [r.asDict() for r in found.documents.collect()]
    for r in documents:
        assert (r["collapsed"] is None) == (r["n_runs"] == 0)
        if r["n_runs"]:
            assert hashlib.sha256(r["collapsed"].encode()).hexdigest() == r["collapsed_sha256"]
    assert sorted((r["doc_id"], r["collapsed_sha256"], r["n_runs"]) for r in documents if r["doc_id"] is not None) == sorted(
        (d, w[6], w[0]) for d, t in rows if d is not None for w in [brute(d, t, False)])
    assert found.runs.count() == sum(w[0] for d, t in {(d, t) for d, t in rows} for w in [brute(d, t, False)])


def test_z_function():
    rng = random.Random(2)
    for _ in range(60):
        s = [rng.randint(0, 1) for _ in range(rng.randint(0, 40))]
        assert period_runs.z_values(s) == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]


def test_one_word_text_of_any_length_and_few_words(spark):
    rows = [(1, "w " * 5), (2, "w " * 6), (3, "a b " * 4), (4, "a b " * 3 + "a"), (5, "w " * 40_000)]
    result = {r.doc_id: (r.n_runs, r.start, r.length, r.period) for r in period_runs.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert result == {1: (0, None, None, None), 2: (1, 0, 6, 1), 3: (1, 0, 8, 2), 4: (0, None, None, None), 5: (1, 0, 40_000, 1)}


def test_empty_table_and_clashing_columns(spark):
    assert period_runs.report(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "a " * 8, "k", 7, "t", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, n long, runs string, first long")
    assert [(r.doc_id, r.n_runs, r.length) for r in period_runs.report(df).collect()] == [(1, 1, 8)]


def test_longest_text_is_shared_out():
    rows = list(period_runs.tile_rows("k", np.arange(5000, dtype=np.int32), 512))
    assert max(len(r["numbers"]) // 4 for r in rows) <= 6 * 1024 + 512
    assert {(r["octave"], r["until"]) for r in rows} == {(1, 32), *((p, p) for p in (64, 128, 256, 512, 1024))}
    for p in (1, 64, 1024):
        own = sorted((r["first"], r["last"]) for r in rows if r["octave"] <= p <= r["until"])
        assert own[0][0] == 0 and own[-1][1] == 5000 and all(a[1] == b[0] for a, b in zip(own, own[1:]))
