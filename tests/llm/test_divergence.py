"""op12 against a re-statement with dictionaries and whole numbers of any size; perfect hashes against dictionaries."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from msgspark.llm import divergence, perfect_hash

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, min_docs=3, top=200):
    docs, groups = {}, {}
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        counts = groups.setdefault((lang, source), {})
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        for w in set(words):
            docs[lang, w] = docs.get((lang, w), 0) + 1
    out = []
    for (lang, source), own in groups.items():
        kept = [w for (other, w), n in docs.items() if other == lang and n >= min_docs]
        sources = {s: {w: c.get(w, 0) for w in kept} for (other, s), c in groups.items() if other == lang}
        whole = {w: sum(c[w] for c in sources.values()) for w in kept}
        share = lambda c, w: 1 + (10**9 * (c[w] + 1)) // (sum(c.values()) + len(kept))
        far = lambda p, q: (p - q) ** 2 // q
        pairs = [(-sum(far(share(sources[source], w), share(c, w)) for w in kept), s.encode(), s) for s, c in sources.items() if s != source]
        out += [(lang, source, "pair", s, -v, i + 1) for i, (v, _, s) in enumerate(sorted(pairs))]
        terms = [(-far(share(sources[source], w), share(whole, w)), w.encode(), w) for w in kept
                 if sources[source][w] and share(sources[source], w) > share(whole, w)]
        out += [(lang, source, "term", w, -v, i + 1) for i, (v, _, w) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def table(seed=1, n=400):
    rng = random.Random(seed)
    words = ["The", "the", "of", "naïve", "x1y", "ÄB", "日本", "don't", "q\x00r", "a_b"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words[: rng.randint(2, len(words))], k=rng.randint(0, 60))), rng.choice(["en", "en", "de", None, ""]),
             rng.choice(["hot"] * 4 + ["a", "b", None, "Ü", "z"])) for i in range(n)]
    return rows + [(1, None, "en", "silent"), (None, "", "fr", "one"), (None, "alone here", "fr", "two"), (7, "the the", "en", "hot"),
                   (7, "the the", "en", "hot"), (8, "solo solo solo", "it", "s")]


@pytest.mark.parametrize("options", [{}, {"shard_keys": 16, "held": 500}, {"broadcast_bytes": 0, "shard_keys": 50}])
def test_audit_equals_brute_force(spark, options):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((r.lang, r.source, r.part, r["item"], r.value, r.rank) for r in divergence.audit(df, top=9, **options).collect())
    assert got == brute(rows, top=9)


def test_group_totals_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    rows = table(5, 80)
    got = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(
        spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows)


def test_nothing_kept_and_empty_table(spark):
    rows = [(1, "one two", "en", "a"), (2, None, "en", "b"), (3, "three", None, None)]
    got = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(
        spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_clashing_columns_and_long_text(spark):
    rows = [(i, "long words of one text " * (20_000 if i == 0 else 1), "en", s, 1, "t", 2) for i, s in enumerate("aabbb")]
    df = spark.createDataFrame(rows, SCHEMA + ", n long, term string, shard int")
    got = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(df).collect())
    assert got == brute([r[:4] for r in rows])


def test_perfect_hash_is_minimal_and_knows_strangers(monkeypatch):
    words = [f"w{i}".encode() for i in range(20_000)] + ["ü".encode(), b"x" * 5000, b""]
    table = perfect_hash.PerfectHash(words)
    h = perfect_hash.hashes(words)
    slots = table.slots(pa.array(words, pa.large_binary()), h)
    assert sorted(slots) == list(range(len(words))) and not table.rest
    others = [f"v{i}".encode() for i in range(20_000)]
    assert (table.slots(pa.array(others, pa.large_binary()), perfect_hash.hashes(others)) == -1).all()
    assert (table.slots(pa.array(others, pa.large_binary()), h[: len(others)]) == -1).all()  # equal hashes, other strings
    monkeypatch.setattr(perfect_hash, "hashes", lambda w: np.full(len(w), 7, np.uint64))
    same = perfect_hash.PerfectHash(words[:50])
    assert len(same.rest) == 50
    assert list(same.slots(pa.array(words[:60], pa.large_binary()), np.full(60, 7, np.uint64))) == [*range(50), *[-1] * 10]
    assert len(perfect_hash.PerfectHash([])) == 0


def test_hash_agrees_with_spark(spark):
    words = ["", "a", "über", "x" * 100]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()
    assert [r[0] for r in rows] == perfect_hash.hashes([w.encode() for w in words]).view(np.int64).tolist()
