"""op4, op7, op8, op9, op10 and the pipeline on small tables."""

import zlib

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from msgspark.llm import byte_cnn, mixing, quality_rules, rp_forest, sharding


def test_shards_are_even_and_keep_copies_together(spark):
    rows = [(i, f"text {i % 90} " * (1 + i % 13)) for i in range(1200)] + [(5, None), (6, ""), (None, "null id"), (5, None)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 8).toPandas()
    assert len(got) == len(rows)
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 8 and load.max() < 1.1 * load.min()
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    size = {}
    for d, t in rows:
        size.setdefault((d if d is not None else -1), set()).add((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())))
    assert all((r.size, r.text_crc32) in size[-1 if np.isnan(r.doc_id) else int(r.doc_id)] for r in got[
        ["doc_id", "size", "text_crc32"]].rename(columns={"size": "size"}).itertuples(index=False))
    by_text = got.groupby("text_crc32").shard.nunique()
    assert by_text.max() == 1


def test_a_hot_text_is_cut_only_beyond_a_shard(spark):
    rows = [(i, "hot text " * 40 if i % 2 else f"t{i} " * (i % 50)) for i in range(3000)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 8).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert load.max() < 1.1 * load.min()
    assert sharding.shard_by_bytes(spark.createDataFrame([], "doc_id long, text string"), 8).count() == 0


def test_mixing_meets_budget_and_limit(spark):
    rows = [(i, "hot" if i % 3 else ("b" if i % 2 else None), "w " * (1 + i % 40)) for i in range(900)] + [(2000, "empty", ""), (2001, "hot", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    tokens = {}
    for _, s, t in rows:
        tokens[s] = tokens.get(s, 0) + len((t or "").split())
    for options in ({}, {"budget": 9000.0}, {"max_repeats": 1.3}, {"entropy_share": 1.0, "max_repeats": 9.0}):
        got = mixing.mix(df, **options).selectExpr("row.doc_id", "row.source", "n_words", "epoch").collect()
        used = {}
        for r in got:
            used[r.source] = used.get(r.source, 0) + r.n_words
        live = [s for s in tokens if tokens[s]]
        plan = mixing.solve(np.array([tokens[s] for s in live], float), options.get("budget"),
                            options.get("entropy_share", 0.95), options.get("max_repeats", 2.0))
        for s, q, t in zip(live, plan.quotas, [tokens[s] for s in live], strict=True):
            assert q - 41 <= used[s] <= q + 1
            assert q / t <= options.get("max_repeats", 2.0) + 1e-6
        assert len({(r.doc_id, r.epoch) for r in got}) == len(got)
        if "budget" not in options:
            assert {r.doc_id for r in got} == {d for d, *_ in rows}
    again = mixing.mix(df.repartition(5), budget=9000.0).selectExpr("row.doc_id", "epoch").collect()
    assert sorted(again) == sorted(mixing.mix(df, budget=9000.0).selectExpr("row.doc_id", "epoch").collect())


def test_mixing_solves_entropy():
    tokens = np.array([1000.0, 100.0, 10.0])
    plan = mixing.solve(tokens, 1e3, 0.9, 1e9)
    assert abs(mixing.entropy(plan.weights) - 0.9 * np.log(3)) < 1e-6
    limited = mixing.solve(tokens, 1110.0, 0.9, 2.0)
    assert abs((limited.quotas / tokens).max() - 2.0) < 1e-6 and limited.exponent > plan.exponent


def test_mixing_keeps_columns_and_empty(spark):
    df = spark.createDataFrame([(1, None, None, 5), (2, "a", "", 6), (None, "a", "x y", 7), (2, "a", "", 6)],
                               "doc_id long, source string, text string, n_words int")
    out = mixing.mixture(df)
    assert out.columns == df.columns and out.count() == 4
    assert mixing.mixture(df.limit(0)).count() == 0


def brute_nearest(ids, x, queries, k):
    score = x[queries] @ x.T
    out = {}
    for q, s in zip(queries, score, strict=True):
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
        out[ids[q]] = [(ids[j], s[j]) for j in order]
    return out


@pytest.mark.parametrize("kind", ["flat", "clustered", "scaled"])
def test_forest_recall(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 24))
    if kind == "clustered":
        x = 0.2 * x + rng.standard_normal((20, 24))[rng.integers(0, 20, 3000)]
    if kind == "scaled":
        x *= rng.uniform(0.1, 3, (3000, 1))
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {}
    for r in rp_forest.nearest(df, F.pmod("id", F.lit(20)) == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute_nearest(ids, x, ids[::20], 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert np.mean(hits) / 20 >= 0.9
    assert all(abs(s - float(x[q] @ x[i])) < 1e-9 for q in got for i, s in got[q])


def test_forest_odd_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [3.0, 1.0]),
            (7, [3.0, 1.0]), (8, [1.0, 2.0, 3.0]), (20, [1.0, 2.0]), (9, [-5.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in rp_forest.nearest(df, F.pmod("id", F.lit(20)) == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 6, 5.0), (0, 2, 7, 5.0), (0, 3, 20, 5.0), (0, 4, 9, -3.0),
                   (20, 1, 0, 5.0), (20, 2, 6, 5.0), (20, 3, 7, 5.0), (20, 4, 9, -3.0)]
    assert rp_forest.nearest(df.limit(0), F.col("id") == 0).count() == 0


def test_cnn_gradients_are_the_slopes():
    net = byte_cnn.Network()
    texts, y = [b"some text here", b"OTHER!! " * 60, b""], np.array([1, 0, 1], np.float32)

    def loss():
        data = np.frombuffer(b"".join(texts), np.uint8)
        p = net.score(data, np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64))
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    grads = net.gradients(texts, y)
    for param, grad in zip((net.filters, net.unit, net.bias), (grads[0], grads[2], grads[3]), strict=True):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        keep, step = param[at], 2e-3
        param[at] = keep + step
        up = loss()
        param[at] = keep - step
        down = loss()
        param[at] = keep
        assert abs((up - down) / (2 * step) - grad[at]) < 0.05 * abs(grad[at]) + 1e-4


def test_cnn_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = byte_cnn.score(docs, byte_cnn.train(docs, labels)).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.93
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) for i in got.doc_id)


def test_cnn_whole_texts_and_odd_rows(spark):
    net = byte_cnn.Network()
    long = b"clean words here. " * 20000
    both = np.frombuffer(long + b"", np.uint8)
    one = net.score(both, np.array([0, len(both)]))
    pooled = net.score(np.r_[both, np.frombuffer(b"#" * 300, np.uint8)], np.array([0, len(both) + 300]))
    assert one.shape == (1,) and one[0] != pooled[0]  # the last bytes count
    df = spark.createDataFrame([(1, None), (2, ""), (None, "abc"), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, None), (9, 0)], "doc_id long, quality int")
    got = byte_cnn.score(df, byte_cnn.train(df, labels)).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert byte_cnn.score(df.limit(0), byte_cnn.train(df.limit(0), labels.limit(0))).count() == 0


def test_rules_on_odd_texts(spark):
    good = "the cat sat on a mat and it was happy in that place of its own by the sea with one dog as well"
    rows = [(1, good), (2, None), (3, ""), (4, " \n\t "), (5, (good + "\n") * 5), (6, "# " * 30), (7, good.upper()), (None, good), (1, good)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.report(df).collect()}
    assert got[1].kept and got[None].kept and not got[2].kept and got[2].base_failed and got[3].n_words == 0
    assert got[5].n_repeat_words == got[5].n_words and got[5].n_dup_lines == 4 and got[5].base_failed
    assert got[6].n_symbols == 30 and not got[7].kept
    wide = df.select("*", F.lit("x").alias("kept"), F.lit(3).alias("_q_kept"), F.lit(None).cast("string").alias("n_words"))
    kept = quality_rules.keep_good(wide)
    assert kept.columns == wide.columns and sorted(kept.select("doc_id").collect(), key=str) == sorted([(1,), (1,), (None,)], key=str)
    assert quality_rules.keep_good(df.limit(0)).count() == 0


def test_pipeline_stages_and_rows(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == columns, name
        before = after = spark.createDataFrame(after.collect(), docs.schema)
    rows = corpus_pipeline.run(spark, sf).collect()
    assert len(rows) == before.count() and all(r.restored for r in rows)
    ids = {r.doc_id for r in before.select("doc_id").collect()}
    assert {r.doc_id for r in rows} == ids
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_intermediate_tables_can_be_deleted(spark):
    from msgspark.llm import storage

    storage.clear(spark)
    table = storage.written(spark.range(5).toDF("x"), "five")
    assert table.count() == 5
    file = table.inputFiles()[0]
    assert storage.clear(spark) == 1 and storage.clear(spark) == 0
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        spark.read.parquet(file)


def direct_score(net, data):
    """The network's score of one text, window by window."""
    lead = byte_cnn.WIDTH - byte_cnn.STRIDE
    n_halves = -(-(len(data) + lead) // byte_cnn.HALF)
    padded = np.full(n_halves * byte_cnn.HALF + byte_cnn.WIDTH, byte_cnn.PAD)
    padded[lead: lead + len(data)] = np.frombuffer(data, np.uint8)
    filters, offset, unit = (x.astype(np.float64) for x in (net.filters, net.offset, net.unit))
    out = np.array([net.features[padded[i: i + byte_cnn.WIDTH]].astype(np.float64).ravel() @ filters + offset
                    for i in range(0, n_halves * byte_cnn.HALF, byte_cnn.STRIDE)]).reshape(n_halves, -1, byte_cnn.FILTERS)
    halves = np.maximum(out.max(1), 0)
    chunks = np.array([np.maximum(halves[i], halves[i + 1]) for i in range(n_halves - 1)]) if n_halves > 1 else halves
    return 1 / (1 + np.exp(-(np.r_[chunks.max(0), chunks.min(0), chunks.mean(0)] @ unit + float(net.bias[0]))))


def test_a_byte_score_depends_on_its_text_alone():
    net = byte_cnn.Network()
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 120, 123, 124, 125, 126, 127, 128, 129, 252, 256, 700, 4000)]
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    together = net.score(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for t, s in zip(texts, together):
        alone = net.score(np.frombuffer(t, np.uint8), np.array([0, len(t)], np.int64))[0]
        assert s == pytest.approx(alone, abs=1e-6) and s == pytest.approx(direct_score(net, t), abs=1e-5)


def test_byte_scores_do_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net = byte_cnn.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    one, two = (sorted((r.doc_id, round(r.score, 4)) for r in byte_cnn.score(d, net).collect()) for d in (docs.coalesce(1), docs.repartition(7)))
    assert [d for d, _ in one] == [d for d, _ in two] and max(abs(a - b) for (_, a), (_, b) in zip(one, two)) <= 1.1e-4
