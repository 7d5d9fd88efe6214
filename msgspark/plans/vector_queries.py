"""Registered queries: neighbours, oversampling, distribution tests, trained models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import bayes, features as feat, models as M, neighbors as N, quality as Q, smote as sm
from . import oracle_text as o
from .model_queries import split_sql
from .registry import query, table
from .text_queries import labelled
from .training import prepare, train


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def dims(e: DataFrame) -> int:
    return e.select(F.size("embedding").alias("d")).first()["d"]


def rare(spark, sf) -> DataFrame:
    """Embeddings with label 0 as the minority class 1."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), (F.col("label") == 0).cast("int").alias("label"),
                    F.col("embedding").cast("array<double>").alias("features"))


DISTANCES = """SELECT a.vec_id AS id, b.vec_id AS nn, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2])))) AS dist
  FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id"""


@query("knn", f"""SELECT id, r AS rank, round(dist, 5) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nn) AS r FROM ({DISTANCES})) WHERE r <= 3""")
def knn(spark, sf):
    e = table(spark, sf, "embeddings")
    near = N.knn(N.as_points(e, row_id="vec_id", features="embedding"), k=3, dim=dims(e))
    return near.select("id", F.posexplode("neighbors").alias("p", "n")).select(
        "id", (F.col("p") + 1).cast("bigint").alias("rank"), F.round("n.dist", 5).alias("dist"))


SMOTE_COUNTS = """c AS (SELECT count(*) FILTER (label <> 0) AS ma, count(*) FILTER (label = 0) AS mi FROM embeddings),
 e AS (SELECT *, greatest(0.48::DOUBLE, mi::DOUBLE / (ma + mi) + 0.02::DOUBLE) AS eff FROM c),
 t AS (SELECT ma, mi, CAST(floor(greatest(floor(eff * ma / (1.0::DOUBLE - eff)), mi) * 1.1::DOUBLE) AS BIGINT) - mi AS made FROM e)"""


@query("smote_counts", f"""WITH {SMOTE_COUNTS} SELECT 0 AS label, false AS is_synthetic, ma AS n, true AS on_segment FROM t
UNION ALL SELECT 1, false, mi, true FROM t UNION ALL SELECT 1, true, made, true FROM t""")
def smote_counts(spark, sf):
    """Class sizes after oversampling; every synthetic row lies between its two parents."""
    data = rare(spark, sf)
    s = sm.smote(data)
    parent = data.select(F.col("row_id").alias("pid"), F.col("features").alias("pf"))
    a = parent.select(F.col("pid").alias("base_id"), F.col("pf").alias("a"))
    b = parent.select(F.col("pid").alias("neighbor_id"), F.col("pf").alias("b"))
    j = s.join(a, "base_id", "left").join(b, "neighbor_id", "left")
    want = F.zip_with("a", "b", lambda x, y: x + F.col("lam") * (y - x))
    off = F.aggregate(F.zip_with("features", want, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, v: F.greatest(acc, v))
    ok = ~F.col("is_synthetic") | ((off < 1e-9) & (F.col("lam") >= 0) & (F.col("lam") < 1))
    return j.groupBy("label", "is_synthetic").agg(F.count(F.lit(1)).alias("n"), F.bool_and(ok).alias("on_segment"))


@query("smote")
def smote(spark, sf):
    return sm.smote(rare(spark, sf))


@query("smote_sparse", f"""WITH src AS ({o.LABELLED}), c AS (SELECT count(*) FILTER (label = 0) AS ma, count(*) FILTER (label = 1) AS mi FROM src),
 e AS (SELECT *, greatest(0.48::DOUBLE, mi::DOUBLE / (ma + mi) + 0.02::DOUBLE) AS eff FROM c),
 t AS (SELECT ma, mi, CAST(floor(greatest(floor(eff * ma / (1.0::DOUBLE - eff)), mi) * 1.1::DOUBLE) AS BIGINT) - mi AS made FROM e)
SELECT 0 AS label, false AS is_synthetic, ma AS n FROM t UNION ALL SELECT 1, false, mi FROM t UNION ALL SELECT 1, true, made FROM t""")
def smote_sparse(spark, sf):
    words = feat.prepared(labelled(spark, sf), keep=("label",))
    vocab = feat.fit_vocabulary(words)
    arrays = feat.tfidf_arrays(words, vocab, keep=("label",))
    return sm.smote(arrays, features=None, dim=feat.MAX_FEATURES).groupBy("label", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


# ---- distribution tests: odd labels play the synthetic rows, even labels the originals -----------
def long(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings").select((F.col("label") % 2 == 1).alias("is_synthetic"), F.col("embedding").alias("features"))
    return Q.to_long(e)


LNG = """lng AS (SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS feature, label % 2 = 1 AS is_synthetic, unnest(embedding)::DOUBLE AS value FROM embeddings)"""


@query("feature_stats", f"""WITH {LNG} SELECT feature, is_synthetic, count(*) AS n, 0 AS n_bad, round(avg(value), 6) AS mean,
  round(var_pop(value), 6) AS variance, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value FROM lng GROUP BY ALL""")
def feature_stats(spark, sf):
    return Q.feature_stats(long(spark, sf)).select("feature", "is_synthetic", "n", "n_bad", *r6("mean", "variance", "min_value", "max_value"))


SIDES = f"""{LNG}, s AS (SELECT feature, min(value) FILTER (is_synthetic) AS sl, max(value) FILTER (is_synthetic) AS sh,
  min(value) FILTER (NOT is_synthetic) AS ol, max(value) FILTER (NOT is_synthetic) AS oh,
  avg(value) FILTER (is_synthetic) AS sm, avg(value) FILTER (NOT is_synthetic) AS om,
  stddev_pop(value) FILTER (is_synthetic) AS ss, stddev_pop(value) FILTER (NOT is_synthetic) AS os FROM lng GROUP BY 1)"""


def _range(name, expansion):
    @query(name, f"WITH {SIDES} SELECT feature, sl < ol - (oh - ol) * {expansion}::DOUBLE OR sh > oh + (oh - ol) * {expansion}::DOUBLE AS out_of_range FROM s")
    def run(spark, sf):
        return Q.range_check(long(spark, sf), expansion=expansion).select("feature", "out_of_range")


_range("range_bounds", 1.5)
_range("range_violations", 0.2)
_range("range_strict", 0.0)


@query("mean_std_gap", f"WITH {SIDES} SELECT feature, round(abs(sm - om), 6) AS mean_difference, round(abs(ss - os), 6) AS std_difference FROM s")
def mean_std_gap(spark, sf):
    return Q.mean_std_gap(long(spark, sf)).select("feature", *r6("mean_difference", "std_difference"))


def ks_ctes(lng: str) -> str:
    """CTEs ending in ks (feature, n_s, n_o, statistic) over lng (feature, is_synthetic, value, weight)."""
    return f"""{lng}, v AS (SELECT feature, value, sum(weight) FILTER (is_synthetic) AS s, sum(weight) FILTER (NOT is_synthetic) AS o FROM lng GROUP BY 1, 2),
 cum AS (SELECT feature, sum(coalesce(s, 0)) OVER w AS cs, sum(coalesce(o, 0)) OVER w AS co FROM v WINDOW w AS (PARTITION BY feature ORDER BY value)),
 tot AS (SELECT feature, CAST(sum(s) AS BIGINT) AS n_s, CAST(sum(o) AS BIGINT) AS n_o FROM v GROUP BY 1),
 ks AS (SELECT feature, n_s, n_o, max(abs(cs::DOUBLE / n_s - co::DOUBLE / n_o)) AS statistic FROM cum JOIN tot USING (feature) GROUP BY ALL)"""


KS = ks_ctes(LNG.replace("AS value FROM", "AS value, 1 AS weight FROM"))


@query("ks_stat", f"""WITH {KS}, p AS (SELECT *, statistic * statistic * n_s * n_o / (n_s + n_o) AS x2 FROM ks)
SELECT feature, n_s, n_o, round(statistic, 6) AS statistic,
  round(CASE WHEN x2 < 0.04 THEN 1.0 ELSE least(1.0, greatest(0.0, list_sum(list_transform(range(1, 101), lambda j: CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * j * j * x2))))) END, 6)::DOUBLE AS p_value FROM p""")
def ks_stat(spark, sf):
    k = Q.ks_statistic(Q.ecdf(long(spark, sf)))
    return k.select("feature", "n_s", "n_o", *r6("statistic", "p_value"))


@query("ks_similarity", f"WITH {KS} SELECT round(avg(1 - statistic), 6) AS overall_similarity FROM ks")
def ks_similarity(spark, sf):
    return Q.similarity(Q.ks_statistic(Q.ecdf(long(spark, sf)))).select(*r6("overall_similarity"))


SPARSE = f"""{o.tfidf_ctes(o.LABELLED)}, nz AS (SELECT term AS feature, label = 1 AS is_synthetic, weight AS value, 1 AS weight FROM weights),
 sz AS (SELECT label = 1 AS is_synthetic, count(*) AS n FROM src GROUP BY 1),
 lng AS (SELECT * FROM nz UNION ALL SELECT f.feature, sz.is_synthetic, 0.0, n - (SELECT count(*) FROM nz WHERE nz.feature = f.feature AND nz.is_synthetic = sz.is_synthetic)
   FROM (SELECT DISTINCT feature FROM nz) f, sz)"""


@query("ks_sparse", f"WITH {ks_ctes(SPARSE)} SELECT feature, n_s, n_o, round(statistic, 5) AS statistic FROM ks")
def ks_sparse(spark, sf):
    """TF-IDF columns of spam against legitimate messages, zeros counted once per column."""
    docs = labelled(spark, sf)
    words = feat.prepared(docs, keep=("label",))
    w = feat.tfidf(words, feat.fit_vocabulary(words), keep=("label",))
    nz = w.select(F.col("term").alias("feature"), (F.col("label") == 1).alias("is_synthetic"), F.col("weight").alias("value"),
                  F.lit(1).cast("bigint").alias("weight"))
    totals = docs.groupBy((F.col("label") == 1).alias("is_synthetic")).agg(F.count(F.lit(1)).alias("n_rows"))
    k = Q.ks_statistic(Q.ecdf(Q.with_zero_mass(nz, totals)))
    return k.select("feature", "n_s", "n_o", F.round("statistic", 5).alias("statistic"))


@query("quantiles", f"""WITH {LNG} SELECT feature, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75
FROM lng WHERE NOT is_synthetic GROUP BY 1""")
def quantiles(spark, sf):
    return Q.quantiles(Q.ecdf(long(spark, sf)), {"q25": 0.25, "q75": 0.75}).select("feature", *r6("q25", "q75"))


@query("range_iqr", f"""WITH {LNG}, q AS (SELECT feature, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM lng WHERE NOT is_synthetic GROUP BY 1)
SELECT feature, round(b + 3 * (b - a), 6) AS threshold, count(*) AS n_s, count(*) FILTER (value > b + 3 * (b - a)) AS n_above,
  count(*) FILTER (value > b + 3 * (b - a)) > 0.05 * count(*) AS is_extreme FROM lng JOIN q USING (feature) WHERE is_synthetic GROUP BY feature, a, b""")
def range_iqr(spark, sf):
    return Q.extreme_outliers(Q.ecdf(long(spark, sf))).select("feature", *r6("threshold"), "n_s", "n_above", "is_extreme")


@query("iforest")
def iforest(spark, sf):
    e = table(spark, sf, "embeddings")
    return Q.outlier_share(e.filter("label % 2 = 0"), e.filter("label % 2 = 1"), row_id="vec_id", features="embedding", dim=dims(e))


@query("synthetic_quality")
def synthetic_quality(spark, sf):
    """All checks of the synthetic rows made for the rare class against its original rows."""
    from ..session import cut_lineage

    minority = cut_lineage(sm.smote(rare(spark, sf)).filter("label = 1"))
    made = minority.filter("is_synthetic").select(F.xxhash64("base_id", "neighbor_id", "lam").alias("row_id"), "features")
    real = minority.filter(~F.col("is_synthetic")).select("row_id", "features")
    d = real.select(F.size("features").alias("d")).first()["d"]
    parts = Q.quality_parts(Q.to_long(minority), Q.outlier_share(real, made, dim=d))
    return Q.quality_score(parts)


# ---- trained models ------------------------------------------------------------------------------
@query("cv_accuracy")
def cv_accuracy(spark, sf):
    words = feat.prepared(labelled(spark, sf), keep=("label",))
    vocab = feat.fit_vocabulary(words)
    data = feat.tfidf_vectors(words, vocab, size=max(1, vocab.count()), keep=("label",))
    mean, spread = M.cross_validate(data, "naive_bayes")
    return spark.range(1).select(F.lit(mean).alias("cv_mean"), F.lit(spread).alias("cv_spread"))


@query("train_models")
def train_models(spark, sf):
    """The whole training flow: split, TF-IDF, oversampling, weights, three models, test metrics."""
    return train(labelled(spark, sf), min_rows=1).metrics




PART = f"WITH {split_sql(o.LABELLED)} SELECT row_id, text, label, r <= n_test AS is_test, r > n_test + kept - n_train AS is_train FROM ranked JOIN quota USING (label)"


@query("nb_holdout", f"""WITH {o.tfidf_ctes(f"SELECT row_id, text, label FROM ({PART}) WHERE is_train")}, {o.NB_CTES},
 {o.nb_score_ctes(f"SELECT row_id, text FROM ({PART}) WHERE is_test")},
 e AS (SELECT s.prediction, l.toxic AS label FROM scored s JOIN labels l ON l.doc_id = s.row_id)
SELECT count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp,
  count(*) AS test_samples, round(avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM e""")
def nb_holdout(spark, sf):
    """Relational naive Bayes learned on the training split, scored on the test split."""
    from ..operators import evaluate as ev

    rows = prepare(labelled(spark, sf))
    terms, priors = bayes.fit(rows.filter("split = 'train'"))
    scored = bayes.score(rows.filter("split = 'test'"), terms, priors, keep=("label",))
    m = ev.evaluate_models(scored.withColumn("model_name", F.lit("naive_bayes")))
    return m.select("tn", "fp", "fn", "tp", "test_samples", *r6("accuracy"))
