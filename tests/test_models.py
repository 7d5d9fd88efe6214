"""Evaluation goldens, splits, balancing, neighbours, oversampling, trained models."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from msgspark.operators import balance as B, bayes, evaluate as ev, features as feat, models as M, neighbors as N
from msgspark.operators import quality as Q, ranking, smote as sm, split as sp

# confusion counts and the metrics published for them
GOLDEN = [
    ("naive_bayes", 2938, 277, 80, 1450, 0.924763, 0.930322, 0.925849),
    ("random_forest", 932, 2283, 0, 1530, 0.518862, 0.806939, 0.489217),
    ("decision_tree", 1399, 1816, 23, 1507, 0.612434, 0.812827, 0.609099),
]


@pytest.fixture(scope="module")
def metrics(spark):
    conf = spark.createDataFrame([g[:5] for g in GOLDEN], "model_name string, tn bigint, fp bigint, fn bigint, tp bigint")
    return ev.rates(ev.weighted_metrics(conf))


def test_golden_metrics(metrics):
    got = {r["model_name"]: r for r in metrics.collect()}
    for name, *_, acc, prec, f1 in GOLDEN:
        r = got[name]
        assert [round(r[k], 6) for k in ("accuracy", "precision", "recall", "f1_score")] == [acc, prec, acc, f1]
        assert r["test_samples"] == 4745


def test_best_models(metrics):
    a = {r["model_name"]: round(r["s"], 4) for r in metrics.select("model_name", ev.composite_score(fnr="weighted").alias("s")).collect()}
    b = {r["model_name"]: round(r["s"], 4) for r in metrics.select("model_name", ev.composite_score().alias("s")).collect()}
    assert a == {"naive_bayes": 0.9250, "decision_tree": 0.6118, "random_forest": 0.5129}
    assert b == {"naive_bayes": 0.9365, "decision_tree": 0.7980, "random_forest": 0.7535}
    assert ev.best_model(metrics).first()["model_name"] == "naive_bayes"
    assert ev.fallback_model(metrics.select("model_name")).first()["model_name"] == "decision_tree"


def test_golden_quota(spark):
    q = B.quota_from_counts(spark.createDataFrame([(11577, 5508)], "n0 bigint, n1 bigint")).first()
    assert (q["target_count"], q["n_synthetic"]) == (11754, 6246)
    assert round(q["target_count"] / (q["target_count"] + 11577), 4) == 0.5038


def test_quota_edges(spark):
    rows = spark.createDataFrame([(100, 9), (0, 50), (100, 10)], "n0 bigint, n1 bigint")
    assert [r["n_synthetic"] for r in B.quota_from_counts(rows).collect()][:2] == [0, 0]
    assert B.quota_from_counts(rows.filter("n1 = 10")).first()["k_effective"] == 3
    with pytest.raises(ValueError):
        B.smote_quota(rows, target_ratio=0.95)


def test_zero_division(spark):
    conf = spark.createDataFrame([("m", 5, 0, 3, 0)], "model_name string, tn bigint, fp bigint, fn bigint, tp bigint")
    r = ev.rates(ev.weighted_metrics(conf)).first()
    assert r["false_negative_rate"] == 1.0 and r["false_positive_rate"] == 0.0 and 0 < r["precision"] < 1


def test_split_is_exact_and_disjoint(spark):
    df = spark.range(5003).select(F.col("id").alias("row_id"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    a = sp.stratified_split(df).collect()
    b = sp.stratified_split(df.repartition(13)).collect()
    assert {(r["row_id"], r["split"]) for r in a} == {(r["row_id"], r["split"]) for r in b} and len(a) == 5003
    n_test = math.ceil(0.2 * 5003)
    n_val = math.ceil(0.1 * (5003 - n_test))
    count = lambda s: sum(r["split"] == s for r in a)
    assert (count("test"), count("validation"), count("train")) == (n_test, n_val, 5003 - n_test - n_val)
    share = sum(r["label"] for r in a if r["split"] == "test") / n_test
    assert abs(share - 715 / 5003) < 0.001


def test_undersample_and_folds(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    u = sp.undersample(df, 150, majority=0)
    assert {r["label"]: r["count"] for r in u.groupBy("label").count().collect()} == {0: 150, 1: 100}
    f = {(r["label"], r["fold"]): r["count"] for r in sp.folds(df, 5).groupBy("label", "fold").count().collect()}
    assert set(f.values()) == {180, 20} and len(f) == 10


def test_global_rank_with_hot_group(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise((F.col("id") % 5).cast("string")).alias("g"),
                                  (F.hash("id") % 50).alias("v"), "id")
    got = ranking.global_rank(df, order_by=["v", "id"], partition_by=["g"]).toPandas()
    want = got.sort_values(["g", "v", "id"]).groupby("g").cumcount()
    assert (got["rank"] == want.reindex(got.index)).all() and len(got) == 4000
    sums = ranking.running_sums(df, order_by=["v", "id"], partition_by=["g"], sums={"s": F.col("id")}).toPandas()
    want = sums.sort_values(["g", "v", "id"]).groupby("g")["id"].cumsum()
    assert (sums["s"] == want.reindex(sums.index)).all()


def brute(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize("tuning", [{}, {"n_pivots": 9, "rows_per_block": 25}])
def test_knn_matches_brute_force_with_copies(spark, tuning):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(120, 5)), np.repeat(rng.normal(size=(1, 5)), 70, 0), np.repeat(rng.normal(size=(2, 5)), 2, 0)])
    pts = spark.createDataFrame([(i, [], v.tolist()) for i, v in enumerate(x)], "id bigint, indices array<int>, values array<double>")
    got = {r["id"]: [n["dist"] for n in r["neighbors"]] for r in N.knn(pts, k=3, dim=5, **tuning).collect()}
    assert len(got) == len(x)
    assert np.allclose([got[i] for i in range(len(x))], brute(x, 3), atol=1e-6)


@pytest.mark.parametrize("shift", [0.0, 1000.0, 1e20])
def test_nearest_measures_all_that_short_floats_cannot_tell_apart(shift, monkeypatch):
    monkeypatch.setattr(N, "TILE", (32, 16))
    x = np.random.default_rng(8).integers(0, 4, (150, 3)) * max(1.0, shift) / 8 + shift  # many ties
    table = pa.table({"id": np.arange(150), "copies": np.ones(150, np.int64),
                      "indices": pa.array([[]] * 150, pa.list_(pa.int32())), "values": pa.array(x.tolist(), pa.list_(pa.float64()))})
    near = N.Nearest(table, 3, 3)
    for i in (100, 0, 50):
        near.meet(table.slice(i, 50))
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)
    np.fill_diagonal(d, np.inf)
    for i in range(150):
        order = np.lexsort((np.arange(150), d[i]))[:4]
        assert near.nn[i].tolist() == order.tolist() and near.dist[i].tolist() == d[i, order].tolist()
    assert near.rows().num_rows == 600


def test_every_unit_has_a_partition(spark):
    for parts in (1, 7, 300):
        rows = spark.createDataFrame([(int(x),) for x in N.slots(spark, parts)], "slot bigint").repartition(parts, "slot")
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() == parts


def test_smote_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(160, 4))
    rows = [(i, int(i < 30), x[i].tolist()) for i in range(160)]
    df = spark.createDataFrame(rows, "row_id bigint, label int, features array<double>")
    a, b = sm.smote(df), sm.smote(df.repartition(11), rows_per_block=17, n_pivots=4)
    made = a.filter("is_synthetic").collect()
    quota = B.smote_quota(df).first()
    assert len(made) == quota["n_synthetic"]
    key = lambda r: (r["base_id"], r["neighbor_id"], round(r["lam"], 12))
    assert sorted(map(key, made)) == sorted(map(key, b.filter("is_synthetic").collect()))
    per_base = {}
    for r in made:
        p, q = x[r["base_id"]], x[r["neighbor_id"]]
        assert np.allclose(r["features"], p + r["lam"] * (q - p)) and 0 <= r["lam"] < 1 and r["label"] == 1
        per_base[r["base_id"]] = per_base.get(r["base_id"], 0) + 1
    assert max(per_base.values()) - min(per_base.values()) <= 1
    none = sm.smote(df.filter("label = 0 OR row_id < 5"))
    assert none.filter("is_synthetic").count() == 0


def test_smote_sparse_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.random((60, 12)) * (rng.random((60, 12)) < 0.4)
    rows = [(i, int(i < 15), np.flatnonzero(x[i]).tolist(), x[i][x[i] != 0].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id bigint, label int, indices array<int>, values array<double>")
    made = sm.smote(df, features=None, dim=12).filter("is_synthetic").collect()
    assert made
    for r in made:
        got = np.zeros(12)
        got[r["indices"]] = r["values"]
        p, q = x[r["base_id"]], x[r["neighbor_id"]]
        assert np.allclose(got, p + r["lam"] * (q - p)) and len(r["indices"]) == len(r["values"])


def test_balance_methods(spark):
    df = spark.createDataFrame([(i, int(i < 12), [float(i), 1.0]) for i in range(60)], "row_id bigint, label int, features array<double>")
    assert B.balance(df, method="class_weights").filter("is_synthetic").count() == 0
    assert B.balance(df, method="smote").filter("is_synthetic").count() > 0
    with pytest.raises(ValueError):
        B.balance(df, method="magic")


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 30 + [(1,)] * 10, "label int")
    w = {r["label"]: r["weight"] for r in B.class_weights(df).collect()}
    assert w == {0: 40 / 60, 1: 40 / 20 * 1.5}
    assert {r["label"]: r["weight"] for r in B.class_weights(df, custom={0: 1, 1: 9}).collect()} == {0: 1.0, 1: 9.0}


def test_ks_and_quantiles(spark):
    rng = np.random.default_rng(8)
    s, o = np.round(rng.normal(size=300), 1), np.round(rng.normal(0.3, size=210), 1)
    rows = [(0, True, float(v), 1) for v in s] + [(0, False, float(v), 1) for v in o]
    cdf = Q.ecdf(spark.createDataFrame(rows, "feature int, is_synthetic boolean, value double, weight bigint"))
    grid = np.unique(np.concatenate([s, o]))
    want = max(abs((s <= g).mean() - (o <= g).mean()) for g in grid)
    r = Q.ks_statistic(cdf).first()
    assert abs(r["statistic"] - want) < 1e-12 and 0 <= r["p_value"] <= 1
    q = Q.quantiles(cdf, {"a": 0.25, "b": 0.75, "c": 0.1}).first()
    assert np.allclose([q["a"], q["b"], q["c"]], np.percentile(o, [25, 75, 10]))


def test_zero_mass_equals_dense(spark):
    rng = np.random.default_rng(9)
    x = rng.random((50, 6)) * (rng.random((50, 6)) < 0.3)
    dense = [(f, bool(i < 20), float(x[i, f]), 1) for i in range(50) for f in range(6)]
    schema = "feature int, is_synthetic boolean, value double, weight bigint"
    sparse = spark.createDataFrame([d for d in dense if d[2] != 0], schema)
    totals = spark.createDataFrame([(True, 20), (False, 30)], "is_synthetic boolean, n_rows bigint")
    a = {r["feature"]: round(r["statistic"], 12) for r in Q.ks_statistic(Q.ecdf(spark.createDataFrame(dense, schema))).collect()}
    b = {r["feature"]: round(r["statistic"], 12) for r in Q.ks_statistic(Q.ecdf(Q.with_zero_mass(sparse, totals))).collect()}
    assert a == b


def test_isolation_forest_finds_far_rows(spark):
    rng = np.random.default_rng(10)
    real = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 3)))]
    far = [(1000 + i, v.tolist()) for i, v in enumerate(rng.normal(8.0, size=(50, 3)))]
    schema = "row_id bigint, features array<double>"
    r = Q.outlier_share(spark.createDataFrame(real, schema), spark.createDataFrame(far, schema), dim=3).first()
    assert r["outlier_percentage"] > 95 and r["quality_impact"] == "high"
    same = Q.outlier_share(spark.createDataFrame(real, schema), spark.createDataFrame(real, schema), dim=3).first()
    assert 8 <= same["outlier_percentage"] <= 10.5


def corpus(spark):
    words = ["offer", "prize", "money", "meeting", "report", "lunch", "winner", "project", "click", "review"]
    rng = np.random.default_rng(11)
    rows = []
    for i in range(160):
        spam = i % 4 == 0
        p = np.array([5, 5, 5, 1, 1, 1, 5, 1, 5, 1] if spam else [1, 1, 1, 5, 5, 5, 1, 5, 1, 5], float)
        rows.append((i, " ".join(rng.choice(words, 12, p=p / p.sum())), "spam" if spam else "ham"))
    rows.append((900, "!!! 12", "ham"))
    return spark.createDataFrame(rows, "row_id bigint, text string, label string")


def test_relational_bayes_equals_ml_likelihood(spark):
    docs = corpus(spark).withColumn("label", (F.col("label") == "spam").cast("int"))
    terms, priors = bayes.fit(docs)
    size = terms.count()
    vec = feat.tfidf_vectors(docs, feat.fit_vocabulary(docs), size=size, keep=("label",))
    model = M.estimators()["naive_bayes"].fit(vec)
    rows = terms.orderBy("term_idx").collect()
    assert np.allclose(model.theta.toArray(), [[r["theta0"] for r in rows], [r["theta1"] for r in rows]])
    scored = bayes.score(docs, terms, priors, keep=("label",))
    assert scored.count() == docs.count()
    assert scored.filter("row_id = 900").first()["prediction"] == 0  # no known term: the prior decides
    assert scored.filter("label = prediction").count() >= 0.95 * docs.count()


def test_unbounded_vocabulary_gives_the_same_weights(spark):
    docs = corpus(spark)
    a = feat.tfidf(docs, feat.fit_vocabulary(docs))
    b = feat.tfidf(docs, feat.fit_vocabulary(docs, max_features=None), max_features=None)
    key = lambda df: {(r["row_id"], r["term"], r["term_idx"], r["tf"], round(r["weight"], 8)) for r in df.collect()}
    assert key(a) == key(b)


def test_training_flow(spark, tmp_path):
    from pyspark.ml.classification import NaiveBayesModel

    from msgspark.plans.training import train
    from msgspark.sources import sinks

    res = train(corpus(spark), names=("naive_bayes", "decision_tree"), max_features=50)
    assert res.metrics.count() == 2 and min(res.train_accuracy.values()) > 0.8
    assert res.distribution.first()["synthetic_samples"] > 0
    sinks.save_models(res.models, str(tmp_path / "m"))
    back = sinks.load_models({"naive_bayes": NaiveBayesModel}, str(tmp_path / "m"))
    assert np.allclose(back["naive_bayes"].theta.toArray(), res.models["naive_bayes"].theta.toArray())
    with pytest.raises(ValueError):
        train(corpus(spark).limit(20))


def test_tree_samples_are_the_lowest_hashes(spark):
    from pyspark.sql import Window

    from msgspark.operators import quality

    points = spark.range(-2000, 9000).repartition(5)
    got = quality.lowest_hashes(points, n_trees=7, tree_rows=40, seed=42)
    drawn = points.select("id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("tree")).withColumn("_h", F.xxhash64("id", "tree", F.lit(42)))
    want = drawn.withColumn("r", F.row_number().over(Window.partitionBy("tree").orderBy("_h", "id"))).filter("r <= 40")
    key = lambda df: sorted((r.tree, r["_h"], r.id) for r in df.collect())
    assert key(got) == key(want) and got.count() == 280
    assert quality.lowest_hashes(points.limit(3), n_trees=2, tree_rows=40, seed=1).count() == 6


def test_vectors_are_made_from_whole_batches(spark):
    rows = [(1, [0, 2], [0.25, 0.5]), (2, [], []), (3, [4], [1.0]), (4, [1, 3, 4], [None, 0.0, 2.0])]
    made = lambda rows, size=5: feat.to_vectors(spark.createDataFrame(
        rows, "row_id bigint, indices array<bigint>, values array<double>").coalesce(1), size=size)
    vectors = made(rows)
    # 101 is a user function that is called for each row
    assert "sparse(" in (plan := vectors._jdf.queryExecution().executedPlan().toString()) and ", 101" not in plan
    got = {r.row_id: r.features for r in vectors.collect()}
    assert all(v.size == 5 for v in got.values())
    for i, at, values in rows:
        assert got[i].indices.tolist() == at
        assert np.array_equal(got[i].values, np.array(values, float), equal_nan=True)
    for bad in ([1, 1], [2, 1], [0, 5], [-1, 0], [0], None, [None, 1]):
        with pytest.raises(Exception):
            made([(0, bad, [1.0, 1.0])]).collect()
    assert made([]).collect() == []
