"""op13: counts and base scores against dictionaries, the network against a direct pass and numeric gradients."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from msgspark.llm import gru, lm_score

SCHEMA = "doc_id long, text string"


def table(n=300, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["The", "the", "Ünd", "x\x1cy", "　"]
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(rng.choices(words[: 5 + i], k=rng.randint(0, 70)))) for i in range(n)]
    return rows + [(None, "no id here"), (None, None), (500, None), (501, " \n "), (502, "again and again"), (502, "again and again"),
                   (502, "other text"), (503, "unseen " * 5000)]


def words_of(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def brute(rows):
    counts = Counter()
    for d, t in rows:
        if not held(d):
            counts.update([*words_of(t), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        own = [*words_of(t), None]
        out.append((d, held(d), len(own), sum(counts[w] > 0 for w in own), n,
                    round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), 6)))
    return sorted(out, key=repr)


def direct(net, ids, start):
    """A document's log probability, one step and one full softmax after the other."""
    h, last, total = np.zeros(gru.WIDTH), start, 0.0
    p = {k: x.astype(np.float64) for k, x in net.p.items()}
    w = gru.WIDTH
    sig = lambda x: 1 / (1 + np.exp(-x))
    for y in ids:
        x = p["embed"][last] @ p["inward"] + p["offset"]
        g = h @ p["inner"]
        r, z = sig(x[:w] + g[:w]), sig(x[w: 2 * w] + g[w: 2 * w])
        new = np.tanh(x[2 * w:] + r * (g[2 * w:] + p["inner_offset"]))
        h = (1 - z) * new + z * h
        c = np.exp(h @ p["to_class"] + p["class_offset"])
        c /= c.sum()
        probability = np.empty(len(p["embed"]))
        for k, (a, b) in enumerate(zip(net.first[:-1], net.first[1:])):
            e = np.exp(p["to_item"][a:b] @ h + p["item_offset"][a:b])
            probability[a:b] = c[k] * e / e.sum()
        assert abs(probability.sum() - 1) < 1e-9
        total += math.log(probability[y])
        last = y
    return total


def random_net(n=90, seed=0):
    net = gru.Gru(np.random.default_rng(seed).integers(1, 500, n))
    rng = np.random.default_rng(seed + 1)
    for k in net.p:
        net.p[k] = net.p[k] + (0.3 * rng.standard_normal(net.p[k].shape)).astype(np.float32)
    return net


def test_scores_of_whole_documents_equal_a_direct_pass():
    net, rng = random_net(), np.random.default_rng(5)
    texts = [rng.integers(0, 90, n).astype(np.int32) for n in (1, 3, 700, 20, 5, 1, 90, 16, 17)]
    got = net.score(texts, 4)
    for x, s in zip(texts, got):
        assert s == pytest.approx(direct(net, x, 4), rel=1e-5)
        assert net.score([x], 4)[0] == pytest.approx(s, rel=1e-5)  # alone as among others
    assert len(net.score([], 4)) == 0


def test_gradients_equal_differences():
    net, rng = random_net(40), np.random.default_rng(6)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 40, (2, 7, 3))
    fresh, weight = rng.random((7, 3)) < 0.2, (rng.random((7, 3)) < 0.8).astype(float)
    h = rng.standard_normal((3, gru.WIDTH))
    grads = net.window(x, y, fresh, weight, h)[1]
    for k, g in grads.items():
        for i in rng.choice(net.p[k].size, 12, replace=False):
            at = np.unravel_index(i, net.p[k].shape)
            keep, losses = net.p[k][at], []
            for e in (1e-3, -1e-3):
                net.p[k][at] = keep + e
                losses.append(net.window(x, y, fresh, weight, h)[0])
            net.p[k][at] = keep
            assert g[at] == pytest.approx((losses[0] - losses[1]) / 2e-3, abs=2e-5)


def test_training_lowers_the_loss_and_classes_hold_all_items():
    rng = np.random.default_rng(1)
    cycle = rng.permutation(12)
    texts = [np.tile(np.roll(cycle, k), 5)[: rng.integers(5, 60)].astype(np.int32) for k in range(200)]
    net = gru.Gru(np.ones(12))
    before = net.score(texts, 0).sum()
    for _ in range(30):
        net.fit(texts, 0, 1e-2)
    assert net.score(texts, 0).sum() > 0.3 * before
    order, first, of_item = gru.classes_of(np.array([5.0, 1, 1, 100, 0, 7]), 3)
    assert sorted(order) == list(range(6)) and first[0] == 0 and first[-1] == 6 and (np.diff(first) > 0).all()


def test_windows_hold_only_streams_that_go_on(monkeypatch):
    rng, places, window = np.random.default_rng(2), [], gru.Gru.window
    monkeypatch.setattr(gru.Gru, "window", lambda self, x, *rest: places.append(x.size) or window(self, x, *rest))
    texts = [rng.integers(0, 90, n).astype(np.int32) for n in (1000, *[10] * 100)]
    random_net().fit(texts, 4, 1e-3)
    assert 2000 <= sum(places) < 2100


def test_fitted_table_is_scored_like_any_other(spark):
    rows = table(60)
    df = spark.createDataFrame(rows, SCHEMA)
    for limit in (1 << 18, 70):
        model = lm_score.fit(df, lookup_words=limit, **SMALL)
        assert model.rows is not None
        own, other = (sorted(map(tuple, lm_score.score(d, model).collect()), key=repr) for d in (df, spark.createDataFrame(rows, SCHEMA)))
        assert own == other and len(own) == len(rows)


def rows_of(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect()), key=repr)


SMALL = {"min_visits": 20_000, "lane": 4_000, "model_words": 60}


def test_counts_and_base_equal_brute_force(spark):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA)
    model = lm_score.fit(df, **SMALL)
    assert rows_of(lm_score.score(df, model)) == brute(rows)
    few = lm_score.fit(df, lookup_words=70, **SMALL)  # most words meet their counts by a join
    assert len(few.words) <= 70 and not few.complete
    assert rows_of(lm_score.score(df, few)) == brute(rows)
    one, two = ({(r.doc_id, r.n_tokens): r.score for r in lm_score.score(df, m).collect()} for m in (model, few))
    assert all(abs(one[k] - two[k]) < 0.02 * abs(one[k]) for k in one)


def test_model_does_not_depend_on_partitions_and_beats_the_base(spark):
    rng = random.Random(1)
    cycles = [[f"c{k}w{i}" for i in range(9)] for k in range(6)]
    rows = [(i, " ".join((rng.choice(cycles) * 9)[: rng.randint(5, 60)])) for i in range(400)]
    scores = []
    for n in (1, 7):
        df = spark.createDataFrame(rows, SCHEMA).repartition(n)
        scores.append({r.doc_id: (r.score, r.base_score, r.held_out) for r in lm_score.score(df, lm_score.fit(
            df, min_visits=80_000, lane=4_000)).collect()})
    assert all(a[0] == pytest.approx(scores[1][d][0], rel=1e-3) for d, a in scores[0].items())
    unseen = [a for a in scores[0].values() if a[2]]
    assert unseen and sum(a[0] for a in unseen) > 0.95 * sum(a[1] for a in unseen)


def test_training_goes_over_every_training_document(spark):
    df = spark.createDataFrame(table(), SCHEMA)
    model = lm_score.fit(df, min_visits=0, lane=4_000, model_words=60)
    assert model.tokens <= model.visits < 1.2 * model.tokens  # once; a round's edge is rounded up
    assert lm_score.fit(df, min_visits=10 ** 9, lane=40_000, model_words=60).visits == lm_score.ROUNDS * model.tokens


def test_probabilities_of_rare_words_add_up(spark):
    df = spark.createDataFrame(table(), SCHEMA)
    model = lm_score.fit(df, **SMALL)
    counts = {r.word: (r.grp, r.n) for r in model.counts.collect() if r.word is not None}
    own = {w.as_py().decode() for w in model.words.take(pa.array(np.flatnonzero(model.items >= 0)))}
    for g in range(lm_score.GROUPS):
        rest = [n for w, (grp, n) in counts.items() if grp == g and w not in own]
        assert (len(rest), sum(rest)) == (model.group_types[g], model.group_tokens[g])
        assert sum(n + 0.1 for n in [*rest, 0]) == pytest.approx(model.group_mass[g])


def test_small_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lm_score.score(empty, lm_score.fit(empty)).collect() == []
    rows = [(4, "only held out"), (4, None)]
    assert held(4) or not held(4)
    only = next(i for i in range(100) if held(i))
    df = spark.createDataFrame([(only, "only held out")], SCHEMA)
    r = lm_score.score(df, lm_score.fit(df)).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 4, 0, 0, 0.0) and r.score < 0
    clash = spark.createDataFrame([(d, t, "w", 1, "k", True) for d, t in rows], SCHEMA + ", word string, n long, key string, held_out boolean")
    assert lm_score.score(clash, lm_score.fit(clash, **SMALL)).count() == 2
