"""Whole-file encoding, rejected files, message length options, and the training flow on a small corpus."""

import math

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from msgspark.operators import bayes, rows, scoring, validate
from msgspark.plans.batch_scoring import score_files
from msgspark.plans.training import train
from msgspark.sources import csv_files

LONG = "a message that is long enough to be one"


def test_encoding_is_judged_over_the_whole_file(spark, tmp_path):
    f = tmp_path / "late.csv"
    f.write_bytes(("text,label\n" + f"{LONG},ham\n" * 200).encode() + f"{LONG} café,spam\n".encode("latin-1"))
    assert csv_files.profile_files(spark, str(f)).first()["detected_encoding"] == "latin-1"
    texts = {r["text"] for r in csv_files.read_messages(spark, str(f)).collect()}
    assert f"{LONG} café" in texts


def test_files_left_out_are_reported(spark, tmp_path):
    good, empty = tmp_path / "good.csv", tmp_path / "empty.csv"
    good.write_text("text,label\n" + f"{LONG},ham\n" * 3)
    empty.write_text("")
    left = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in csv_files.rejected_files(spark, [str(good), str(empty)]).collect()}
    assert left == {"empty.csv": "File is empty"}
    data = spark.createDataFrame([(i, f"{w} message number text", int(w == "spam")) for i, w in enumerate(["spam", "plain"] * 20)],
                                 "row_id bigint, text string, label int")
    res, jobs = score_files(spark, [str(good), str(empty)], *bayes.fit(data))
    assert res.count() == 3
    assert {(r["job_id"].rsplit("/", 1)[1], r["status"], r["failure"]) for r in jobs.collect()} == {
        ("good.csv", "completed", None), ("empty.csv", "failed", "File is empty")}


@pytest.mark.parametrize("name", ["Email Body", "email body", "body"])
def test_text_column_by_name_in_any_case_or_in_part(spark, tmp_path, name):
    f = tmp_path / "named.csv"
    f.write_text("id,text,Email Body\n" + f"1,{LONG} one,{LONG} two\n" * 3)
    assert {r["text"] for r in csv_files.read_messages(spark, str(f), text_col=name).collect()} == {f"{LONG} two"}


def test_long_messages_are_scored_whole_on_request(spark):
    data = spark.createDataFrame([(i, f"{w} message number text", int(w == "spam")) for i, w in enumerate(["spam", "plain"] * 20)],
                                 "row_id bigint, text string, label int")
    terms, priors = bayes.fit(data)
    df = spark.createDataFrame([(1, "plain filler " * 1000 + "spam " * 5000)], "email_index bigint, text string")
    assert scoring.score_messages(df, terms, priors).first()["status"] == "error"
    assert scoring.score_messages(df, terms, priors, max_length=None).first()["prediction"] == "Spam"
    assert not validate.validate_messages(df).first()["is_valid"]
    assert validate.validate_messages(df, max_length=None).first()["is_valid"]


def test_dedup_keeps_the_first_of_each_text_and_of_null(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (5, None), (4, "b")], "row_id bigint, text string")
    assert sorted(r["row_id"] for r in rows.dedup_first(df).collect()) == [1, 2, 4]


class Broken:
    def fit(self, data):
        raise RuntimeError("cannot fit this")


def test_training_flow_smooths_by_its_vocabulary_and_shows_failures(spark):
    words = ["offer", "prize", "winner", "cash"], ["meeting", "report", "lunch", "project"]
    data = [(i, " ".join([words[i % 2][(i + k) % 4] for k in range(3)] + ["common", "text"]), i % 2) for i in range(120)]
    df = spark.createDataFrame(data, "row_id bigint, text string, label int")
    got = train(df, names=("naive_bayes",), method="class_weights", user_models={
        "logistic": lambda weight: LogisticRegression(maxIter=5, **({"weightCol": weight} if weight else {})),
        "broken": lambda weight: Broken()})
    width = got.vocabulary.count()
    model = got.models["naive_bayes"]
    assert model.numFeatures == width
    # smoothing 1 over the vocabulary: each row of probabilities sums to 1 over exactly these terms
    assert all(abs(sum(math.exp(x) for x in row) - 1) < 1e-9 for row in model.theta.toArray())
    metrics = {r["model_name"]: r for r in got.metrics.collect()}
    assert set(metrics) == {"naive_bayes", "logistic", "broken"}
    assert metrics["broken"]["error"].startswith("RuntimeError") and metrics["broken"]["accuracy"] is None
    assert metrics["logistic"]["accuracy"] > 0.9 and got.train_accuracy["broken"] is None
    assert metrics["naive_bayes"]["class_balancing_enabled"] is True


def test_training_without_balancing_says_so(spark):
    data = [(i, f"{'offer prize' if i % 2 else 'meeting report'} text {i % 5}", i % 2) for i in range(120)]
    df = spark.createDataFrame(data, "row_id bigint, text string, label int")
    row = train(df, names=("naive_bayes",), method="smote").metrics.first()
    assert row["class_balancing_enabled"] is False and row["balancing_method"] is None
    assert df.filter(F.col("label") == 1).count() == 60
