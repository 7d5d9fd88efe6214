"""Registered queries: a saved pipeline and saved metrics give what they gave before."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ..operators import pipeline as P
from ..sources import sinks
from . import derived as d
from .csv_queries import scratch
from .registry import query
from .stream_queries import as_stream
from .text_queries import NB_SCORE, labelled, messages


def saved_pipeline(spark, sf, path: str, **options) -> PipelineModel:
    P.text_pipeline(**options).fit(labelled(spark, sf)).write().overwrite().save(f"{path}/model")
    return PipelineModel.load(f"{path}/model")


@query("model_round_trip", f"{NB_SCORE} SELECT row_id, prediction, round(confidence, 5) AS confidence FROM scored")
def model_round_trip(spark, sf):
    model = saved_pipeline(spark, sf, scratch(spark, "model"))
    return model.transform(messages(spark, sf)).select("row_id", "prediction", F.round("confidence", 5).alias("confidence"))


@query("stream_pipeline", f"{NB_SCORE} SELECT row_id, prediction, round(confidence, 5) AS confidence FROM scored")
def stream_pipeline(spark, sf):
    # the loaded pipeline follows readStream directly: no micro-batch function, no exchange
    path = scratch(spark, "model")
    scored = saved_pipeline(spark, sf, path).transform(as_stream(messages(spark, sf), path)).select("row_id", "prediction", "confidence")
    scored.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.schema(scored.schema).parquet(f"{path}/out").withColumn("confidence", F.round("confidence", 5))


@query("user_text_steps", f"{NB_SCORE} SELECT row_id, prediction FROM scored")
def user_text_steps(spark, sf):
    # the user's steps undo what was done to the texts; they are saved and loaded with the rest
    model = saved_pipeline(spark, sf, scratch(spark, "model"), steps=["replace({c}, '~', '')", "concat(' ', {c})"])
    return model.transform(messages(spark, sf).withColumn("text", F.concat(F.lit("~"), "text", F.lit("~")))).select("row_id", "prediction")


@query("metrics_round_trip", f"WITH {d.METRICS} SELECT model_name, round(accuracy, 6) AS accuracy, test_samples, class_balancing_enabled FROM metrics")
def metrics_round_trip(spark, sf):
    path = scratch(spark, "metrics")
    m = d.metrics(spark, sf)
    first = m.filter("model_name = 'naive_bayes'")
    sinks.append_metrics(first, path)
    sinks.append_metrics(m.filter("model_name <> 'naive_bayes'").drop("balancing_method"), path)  # an older version lacks a column
    return sinks.read_metrics(spark, path).select("model_name", F.round("accuracy", 6).alias("accuracy"), "test_samples", "class_balancing_enabled")
