"""op1, op2 and op6 against brute force on small tables with copies, ties, empty, null, long and repeated rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from msgspark.llm import anchors, fm_dedup, jaccard_join, suffix_dedup
from msgspark.llm.components import components

SCHEMA = "doc_id long, text string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def spliced(n=150, seed=1, words=30):
    rng = random.Random(seed)
    w = ["ab", "c　c", "dd", "éa", "xyz", "q\x1cq"]
    passages = [" ".join(rng.choice(w) for _ in range(words)) for _ in range(5)]
    rows = [(i, rng.choice([" ", "\n", "\t"]).join(
        rng.choice(passages + [" ".join([rng.choice(w)] * rng.randint(1, 40))]) for _ in range(rng.randint(0, 5)))) for i in range(n)]
    return rows + [(None, passages[0]), (1000, None), (1001, ""), (1002, "a " * 3000), (1003, "a " * 3010), (1004, "a" * 99)]


def brute_bytes(rows, length):
    seen, out = set(), {}
    for d, t in by_id(rows):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            w = data[i: i + length]
            if w in seen:
                gone[i: i + length] = True
            seen.add(w)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[d] = (len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("length", "hot"), [(100, 8192), (100, 3), (40, 8192)])
def test_suffix_array_removes_later_copies(spark, length, hot):
    rows = spliced()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in suffix_dedup.remove_repeats(df, length, hot=hot).collect()}
    assert got == brute_bytes(rows, length)


def test_suffix_array_repeated_rows_and_empty(spark):
    rows = [(1, "x" * 150), (1, "x" * 150), (2, "x" * 150)]
    got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 149), (1, 149), (2, 150)] or got[0] == got[1]
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_longest_previous_factor_against_brute_force():
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 2, 300)
    limit, starts = 12, np.arange(289)
    got = suffix_dedup.longest_previous(symbols, starts, starts, limit)
    for i in starts:
        best = 0
        for j in range(i):
            k = 0
            while k < limit and symbols[i + k] == symbols[j + k]:
                k += 1
            best = max(best, k)
        assert got[i] == best


def test_long_text_in_pieces():
    """An anchor of every window, also across the borders of pieces."""
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, anchors.PIECE + 5000).astype(np.uint8)
    scheme = anchors.Scheme(100, 32, True)
    values, offsets = anchors.byte_symbols(data, np.array([0, len(data)]))
    pos = np.unique(np.concatenate([p for _, p, *_ in anchors.find(values, offsets, scheme)]))
    assert np.diff(pos).max() <= 100 - 32 + 1 and pos[0] <= 68 and pos[-1] >= len(data) - 100


def test_words_in_pieces(monkeypatch):
    text = "  ab cd\n\n" + "ef" * 40 + " é　x " * 30
    data = np.frombuffer((text * 3).encode(), np.uint8)
    one = len(text.encode())
    offsets = np.array([0, one, one, 2 * one, 3 * one])
    whole = anchors.word_values(data, offsets)
    monkeypatch.setattr(anchors, "PIECE", 64)
    pieces = anchors.word_values(data, offsets)
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()
    n = len(WORD.findall(text.encode()))
    assert whole[1].tolist() == [0, n, n, 2 * n, 3 * n]


def brute_words(rows, window):
    first, out = {}, {}
    split = [(d, WORD.findall((t or "").encode())) for d, t in by_id(rows)]
    for d, w in split:
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i: i + window]), d)
    for d, w in split:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i: i + window])] != d:
                gone[i: i + window] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("window", "hot"), [(13, 8192), (13, 3), (5, 8192)])
def test_fm_index_removes_words_of_earlier_documents(spark, window, hot):
    rows = spliced(seed=2)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256)
           for r in fm_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), window, hot=hot).collect()}
    assert got == brute_words(rows, window)


def test_fm_index_matching_statistics():
    rng = np.random.default_rng(4)
    texts = [rng.integers(1, 4, n).astype(np.uint64) for n in (30, 1, 25, 40)]
    symbols, offsets = np.concatenate(texts), np.r_[0, np.cumsum([len(t) for t in texts])]
    index = fm_dedup.FMIndex(symbols, offsets, np.array([9, 4, 7, 2]), 6)
    stream = np.r_[texts[0], rng.integers(1, 6, 60).astype(np.uint64)]
    ends = np.arange(1, len(stream) + 1)
    length, low, high = index.match(index.symbols(stream), ends, np.minimum(ends, 6))
    found = {tuple(t[i: i + k]): [] for k in range(1, 7) for t in texts for i in range(len(t) - k + 1)}
    for k in range(1, 7):
        for t, owner in zip(texts, (9, 4, 7, 2), strict=True):
            for i in range(len(t) - k + 1):
                found[tuple(t[i: i + k])].append(owner)
    for e, n, a, b in zip(ends, length, low, high, strict=True):
        want = max((k for k in range(1, min(e, 6) + 1) if tuple(stream[e - k: e]) in found), default=0)
        assert n == want
        if n:
            hits = found[tuple(stream[e - n: e])]
            assert b - a == len(hits) and index.first_owner(np.array([a]), np.array([b]))[0] == min(hits)


def test_cut_repeats_keeps_columns(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, text, "a", 5, "r"), (2, "x  y " + text, "b", 6, "s"), (3, "x  y", None, 7, "t")],
                               "doc_id long, text string, spans string, n_words int, `key` string")
    out = fm_dedup.cut_repeats(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert sorted(tuple(r) for r in out.collect()) == [
        (1, text, "a", 5, "r"), (2, "x y", "b", 6, "s"), (3, "x  y", None, 7, "t")]


def shingles(text, k):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in WORD.findall((text or "").encode())]
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i: i + k]) for i in range(len(w) - k + 1)}


def brute_components(rows, k, percent):
    sets = [(d, shingles(t, k)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            both = len(s & t)
            if both and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets}


def near_copies(n=160, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 100, 200]))] for _ in range(8)]
    rows = []
    for i in range(n):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            b[rng.randrange(len(b))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            b += rng.choice(base)
        rows.append((i, " ".join(b).upper() if i % 5 == 0 else " ".join(b)))
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "a"), (1004, "A"), (1005, "a a a a a a a a a")]


@pytest.mark.parametrize(("k", "percent", "tokens"), [(4, 85, 1 << 21), (4, 85, 700), (5, 80, 1 << 21), (1, 50, 900)])
def test_prefix_tree_join_finds_all_components(spark, k, percent, tokens):
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_components(
        spark.createDataFrame(rows, SCHEMA), k, percent, group_tokens=tokens).collect()}
    assert got == brute_components(rows, k, percent)


def test_prefix_tree_join_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL_GROUP", 3)
    rows = near_copies(seed=7)
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in jaccard_join.link_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_components(rows, 4, 85)


def test_prefix_tree_join_nulls_and_repeated_rows(spark):
    text = "one two three four five six"
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (6, "else"), (7, None)], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link_components(df).collect()), key=str)
    assert got == sorted([(None, 3, None), (5, 3, None), (5, 3, None), (6, 1, 6), (7, 0, 7)], key=str)
    assert [r.doc_id for r in jaccard_join.keep_one(df).orderBy("doc_id").collect()] == [None, 6, 7]
    assert jaccard_join.link_components(df.limit(0)).count() == 0


@pytest.mark.parametrize(("k", "percent", "tokens", "each"), [(4, 85, 1 << 21, 2048), (4, 85, 700, 5), (1, 50, 900, 2048)])
def test_prefix_tree_join_gives_all_links(spark, k, percent, tokens, each):
    rows = near_copies()
    sets = {d: shingles(t, k) for d, t in rows}
    first = {}
    for d in sorted(sets):
        first.setdefault(frozenset(sets[d]) or d, d)
    class_of = {d: first[frozenset(s) or d] for d, s in sets.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and
             100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.a, r.b) for r in jaccard_join.link_pairs(df, k, percent, group_tokens=tokens, pair_sets=each).collect()}
    assert got == {(class_of[a], class_of[b]) for a, b in links if class_of[a] < class_of[b]} | {
        (class_of[b], class_of[a]) for a, b in links if class_of[b] < class_of[a]}
    got = {r.doc_id: (r.n_shingles, r.class_id, r.n_links)
           for r in jaccard_join.link_counts(df, k, percent, group_tokens=tokens, pair_sets=each).collect()}
    assert got == {d: (len(s), class_of[d], sum(d in x for x in links)) for d, s in sets.items()}


def test_trie_links_against_all_pairs():
    rng = np.random.default_rng(2)
    base = [rng.choice(400, 60, replace=False) for _ in range(6)]
    sets = [np.unique(np.r_[base[rng.integers(6)][rng.random(60) > 0.08], rng.choice(400, rng.integers(0, 4))]).astype(np.uint64)
            for _ in range(120)]
    links = jaccard_join.link_sets(sets, np.zeros(16, np.int64), 70)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        both = len(np.intersect1d(sets[i], sets[j]))
        assert 100 * both >= 70 * (len(sets[i]) + len(sets[j]) - both)
        parent[find(i)] = find(j)
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 70 * (len(sets[i]) + len(sets[j]) - both):
                assert find(i) == find(j)


def test_prefix_tree_join_one_doc_id_with_different_texts(spark):
    text = lambda p, n=30: " ".join(f"{p}{i}" for i in range(n))
    rows = [(5, text("a")), (5, text("b")), (7, text("a") + " x"), (8, text("b") + " x"),  # 5 represents both
            (3, text("c")), (9, text("c")), (9, text("d")), (10, text("d") + " x"), (11, text("e"))]
    got = {(r.doc_id, r.component_id) for r in jaccard_join.link_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(5, 5), (7, 5), (8, 5), (3, 3), (9, 3), (10, 3), (11, 11)}


def brute_groups(sets, percent):
    groups = [{i} for i in range(len(sets))]
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and groups[i] is not groups[j]:
                groups[i] |= groups[j]
                for k in groups[j]:
                    groups[k] = groups[i]
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("seed", range(6))
def test_trie_links_sets_that_are_prefixes_of_others(seed):
    rng = np.random.default_rng(seed)
    sets = {}
    for _ in range(60):  # A and B agree only with each other; in global order each is a prefix of a longer set
        at, s = int(rng.integers(0, 40)) * 100, np.arange(2, 14)
        for first in (0, 1):
            short = np.r_[first, s] + at
            sets[short.tobytes()] = short
            long = np.r_[short, np.sort(rng.choice(np.arange(20, 90), 4, replace=False)) + at]
            sets[long.tobytes()] = long
    sets = [s.astype(np.uint64) for s in sets.values()]
    groups = [{i} for i in range(len(sets))]
    for i, j in jaccard_join.link_sets(sets, np.zeros(16, np.int64), 85):
        if groups[i] is not groups[j]:
            groups[i] |= groups[j]
            for k in groups[j]:
                groups[k] = groups[i]
    assert {frozenset(g) for g in groups} == brute_groups(sets, 85)


def test_trie_walk_alone_finds_sets_at_inner_nodes():
    s = np.arange(2, 14)
    sets = [np.r_[0, s], np.r_[1, s], np.r_[0, s, 20:24], np.r_[1, s, 30:34]]
    trie = jaccard_join.Trie([x.astype(np.int64) for x in sets], 40, 85)
    trie.walk_all()
    assert sorted(tuple(sorted(x)) for x in trie.links) == [(0, 1)]


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    rng = random.Random(1)
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_different_texts_under_one_id_keep_their_own_spans(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("w", 20), ("q", 25), ("z", 40)))
    rows = [(1, a), (2, a), (2, b), (None, c), (None, c + " tail"), (3, b), (None, b + " " + b)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in fm_dedup.remove_repeats(df).collect())
    assert got == [(-1, 40, 0), (-1, 41, 0), (-1, 50, 0), (1, 20, 0), (2, 20, 20), (2, 25, 25), (3, 25, 25)]
    texts = sorted(r.text for r in fm_dedup.cut_repeats(df).collect())
    assert texts == sorted(["", "", "", a, c, c + " tail", b + " " + b])
    one, two = "abcdefghij" * 9 + "k" * 60, "".join(chr(33 + i % 90) for i in range(384))
    got = {(r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(spark.createDataFrame(
        [(None, one), (None, two), (5, one)], SCHEMA)).collect()}
    assert (384, brute_bytes([(0, two)], 100)[0][1]) in got and (150, 150) in got


def test_long_words_that_a_polynomial_confuses_are_told_apart(spark):
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = thue.translate(str.maketrans("ab", "ba"))
    words = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([thue, *words])), (2, " ".join([other, *words]))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id: r.n_removed for r in fm_dedup.remove_repeats(df).collect()} == {1: 0, 2: 0}
    sets = spark.createDataFrame([(1, f"{thue} a b c"), (2, f"{other} a b c")], SCHEMA)
    assert {r.doc_id: r.component_id for r in jaccard_join.link_components(sets).collect()} == {1: 1, 2: 2}


def test_places_of_shingles_round_trip_in_gaps():
    rng = np.random.default_rng(4)
    at = np.sort(rng.integers(0, 1 << 16, 3000))
    for own in (at, at[:1], np.array([0, 0, 254, 255, 510, 65535, 65535])):
        assert jaccard_join.from_gaps(jaccard_join.gaps(own, np.array([0]))[0]).tolist() == own.tolist()


def test_common_shingles_stand_out_of_full_buckets():
    """A shingle of 200 documents, in buckets that hold 36 others each, is ordered after nearly all that occur once."""
    total = np.random.default_rng(5).poisson(36, 1 << 16)
    total[::100] += 200
    level = jaccard_join.levels(total)
    level = np.stack([level & 15, level >> 4], axis=1).ravel()
    assert level[::100].min() > level[np.arange(len(total)) % 100 > 0].max()


def test_sketch_counts_documents_of_each_shingle(spark):
    rows = [(i, f"common words of all texts w{i} x{i}") for i in range(40)]
    texts = anchors.texts_of(spark.createDataFrame(rows, SCHEMA).repartition(3), "text", "doc_id")
    order = jaccard_join.sketch(texts, 4)
    h, offsets = jaccard_join.shingle_sets(pa.array([rows[0][1]]), 4)
    assert len(h) == 4 and int(order.counts.sum()) == 4 * 40
    found = order.of_buckets()
    first = h[jaccard_join.by_level(h, np.zeros(4, np.int8), found)]
    at = jaccard_join.buckets(first)
    levels = found[at >> 1] >> ((at & 1) << 2).astype(np.uint8) & 15
    assert levels[1] < levels[2] and levels[2] == levels[3]  # two shingles of one text, two of all


def test_texts_that_no_unit_asks_for_are_not_exchanged(spark):
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(-3, 3000)], "key long, text string")
    wanted = texts.filter("key % 100 = 0").select("key")
    kept = {r.key: r.text for r in jaccard_join.with_keys(texts, wanted).collect()}
    assert all(kept[k] == f"t{k}" for k in range(0, 3000, 100)) and len(kept) < 40


def test_candidates_exchange_prefix_shingles_once(spark):
    rows = [(i, 10, [7, 100 + i // 2]) for i in range(40)]
    found = jaccard_join.candidates(spark.createDataFrame(rows, "key long, n long, prefix array<long>"), 85)
    edges = {(r.a, r.b) for r in found.collect()}
    assert {(0, i) for i in range(1, 40)} <= edges  # tied by the shingle of all
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
