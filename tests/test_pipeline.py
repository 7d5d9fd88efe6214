"""The saved pipeline: stages, round trips, odd rows."""

import math

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from msgspark.operators import bayes, features as feat, pipeline as P

ROWS = [(i, f"{'win a prize now' if i % 3 == 0 else 'project meeting notes'} number {w} item", int(i % 3 == 0))
        for i, w in enumerate("alpha beta gamma delta epsilon zeta eta theta iota kappa".split() * 6)]


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(ROWS, "row_id bigint, text string, label int")


def test_loaded_scores_equal_those_in_memory_and_the_relational_ones(spark, train, tmp_path):
    model = P.text_pipeline(max_features=40).fit(train)
    model.write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    odd = spark.createDataFrame([(100, None), (101, ""), (102, "unknown words only"), (103, "win win win prize"), (104, "meeting " * 3000)],
                                "row_id bigint, text string").unionByName(train.select("row_id", "text"))
    rows = lambda df: {r.row_id: (r.prediction, r.confidence) for r in df.collect()}
    first, second = rows(model.transform(odd)), rows(loaded.transform(odd))
    assert first == second and len(first) == odd.count()
    terms, priors = bayes.fit(train, max_features=40)
    want = rows(bayes.score(odd, terms, priors, max_features=40))
    assert all(first[k][0] == want[k][0] and math.isclose(first[k][1], want[k][1], abs_tol=1e-9) for k in want) and set(want) == set(first)
    assert [s.__class__.__name__ for s in loaded.stages] == ["Tokens", "TfidfModel", "BayesModel"]
    assert [r.term for r in feat.fit_vocabulary(train, max_features=40).orderBy("term_idx").collect()] == loaded.stages[1].getOrDefault("vocabulary")


def test_user_steps_are_stages_that_are_saved(spark, train, tmp_path):
    model = P.text_pipeline(steps=["replace({c}, 'zzz', '')"]).fit(train)
    model.save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    assert loaded.stages[0].getOrDefault("expression") == "replace({c}, 'zzz', '')"
    spoilt = train.withColumn("text", F.regexp_replace("text", "prize", "przzzize"))
    got = {r.row_id: r.prediction for r in loaded.transform(spoilt).collect()}
    assert got == {r.row_id: r.prediction for r in model.transform(train).collect()}


def test_unfitted_pipeline_and_other_columns(spark, train, tmp_path):
    made = Pipeline(stages=[P.Tokens(inputCol="body", maxGram=1), P.TfidfEstimator(minDF=1, maxDF=1.0, maxFeatures=5), P.BayesEstimator(labelCol="spam")])
    made.save(str(tmp_path / "p"))
    again = Pipeline.load(str(tmp_path / "p"))
    data = train.select(F.col("text").alias("body"), F.col("label").alias("spam"), F.lit("kept").alias("features2"))
    out = again.fit(data).transform(data)
    assert {"body", "spam", "features2", "prediction", "confidence"} <= set(out.columns) and not [c for c in out.columns if c.startswith("_")]
    assert len(again.fit(data).stages[1].getOrDefault("vocabulary")) == 5


def test_no_terms_at_all(spark):
    blank = spark.createDataFrame([(1, "", 0), (2, None, 1), (3, " ", 1)], "row_id bigint, text string, label int")
    out = P.text_pipeline().fit(blank).transform(blank).collect()
    assert [r.prediction for r in out] == [1, 1, 1] and all(math.isclose(r.confidence, 2 / 3) for r in out)
