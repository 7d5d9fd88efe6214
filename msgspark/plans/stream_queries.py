"""The streaming jobs run to the end of a table (availableNow) and compared with the batch SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators import bayes
from ..streaming import jobs as S
from . import derived as d
from .csv_queries import scratch
from .registry import ORACLES, query
from .text_queries import labelled, messages


def as_stream(df: DataFrame, path: str) -> DataFrame:
    """The table as a stream of the files it is written to."""
    df.write.parquet(f"{path}/in")
    return df.sparkSession.readStream.schema(df.schema).parquet(f"{path}/in")


def run_through(df: DataFrame, path: str, build: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """What ``build`` makes of the stream: all batches (append) or the last state (complete)."""
    out = build(as_stream(df, path))

    def sink(batch: DataFrame, batch_id: int) -> None:
        part = f"batch={batch_id}" if mode == "append" else "last"
        batch.write.mode("overwrite").parquet(f"{path}/out/{part}")

    running = out.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(
        availableNow=True).start()
    running.awaitTermination()
    return df.sparkSession.read.schema(out.schema).option("recursiveFileLookup", True).parquet(f"{path}/out")


PARTS, FILES = 4, 4


def parts_of(df: DataFrame, ts: str = "ts") -> DataFrame:
    """``df`` with ``part``: the quarter of the covered time a row lies in."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    ends = df.agg(F.min(us).alias("lo"), F.max(us).alias("hi")).first()  # one row
    return df.withColumn("part", F.floor(F.lit(PARTS) * (us - F.lit(ends.lo)) / F.lit(ends.hi - ends.lo + 1)).cast("int"))


def run_in_parts(df: DataFrame, path: str, build: Callable[[DataFrame], DataFrame], mode: str, stop_after: int | None = None) -> DataFrame:
    """What ``build`` makes of a stream whose parts (column ``part``) arrive one after the other, one micro-batch each.

    With ``stop_after`` the query ends when that many parts are done, the other parts arrive, and a new query goes on from
    its checkpoint. Rows carry their ``batch``.
    """
    spark, schema = df.sparkSession, df.drop("part").schema
    halves = [range(PARTS)] if stop_after is None else [range(stop_after), range(stop_after, PARTS)]

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    for half in halves:
        for k in half:  # files are taken in the order of their times, so parts are written one by one
            df.filter(F.col("part") == k).drop("part").repartition(FILES).write.mode("append").parquet(f"{path}/in")
        out = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(f"{path}/in"))
        running = out.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(
            availableNow=True).start()
        running.awaitTermination()
    return spark.read.schema(out.schema.add("batch", "long")).parquet(f"{path}/out")


@query("stream_sliding_performance", f"""WITH {d.PERF}, pk AS (SELECT *, unnest(range(12)) AS k FROM perf),
 w AS (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) - k * INTERVAL 5 MINUTE AS s FROM pk),
 fin AS (SELECT max(ts) - INTERVAL 10 MINUTE AS t FROM perf)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, round(sum(processing_time_ms), 4) AS processing_time_ms, round(sum(accuracy), 6) AS accuracy,
  round(sum(false_negative_rate), 6) AS fnr, sum(samples_processed)::BIGINT AS total_samples_processed, count(*) AS operations_count
FROM w, fin WHERE s + INTERVAL 1 HOUR <= t GROUP BY s""")
def stream_sliding_performance(spark, sf):
    # four micro-batches, stopped and resumed after two; a window is emitted once, when the watermark has passed its end
    got = run_in_parts(parts_of(d.perf(spark, sf)), scratch(spark, "stream"), S.sliding_performance, "append", stop_after=2)
    total = lambda c, digits: F.round(F.col(f"avg_{c}") * F.col("operations_count"), digits).alias(c)  # noqa: E731  means have endless digits
    return got.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), total("processing_time_ms", 4),
                      total("accuracy", 6), total("fnr", 6), "total_samples_processed", "operations_count")


@query("stream_error_patterns", f"SELECT component, operation, error_id FROM ({ORACLES['error_patterns']})")
def stream_error_patterns(spark, sf):
    got = run_in_parts(parts_of(d.errors(spark, sf)), scratch(spark, "stream"), lambda e: S.error_pattern_stream(e, 100), "update", stop_after=2)
    last = got.groupBy("component", "operation").agg(F.max_by("error_ids", "batch").alias("ids"))
    return last.select("component", "operation", F.explode("ids").alias("error_id"))


def late_requests(spark, sf) -> DataFrame:
    """Requests in parts; one in fifty of the first half arrives with the last part."""
    late = (F.col("part") < 2) & (F.col("request_id") % 50 == 0)
    return parts_of(d.requests(spark, sf)).withColumn("part", F.when(late, PARTS - 1).otherwise(F.col("part")))


@query("stream_late_windows", f"""WITH {d.REQUESTS}, ends AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM requests),
 p AS (SELECT *, floor({PARTS} * (epoch_us(ts) - lo) / (hi - lo + 1)) AS first_part FROM requests, ends),
 a AS (SELECT *, first_part < 2 AND request_id % 50 = 0 AS late, date_trunc('hour', ts) AS h FROM p),
 marks AS (SELECT max(ts) FILTER (NOT late AND first_part < 2) - INTERVAL 1 HOUR AS early, max(ts) - INTERVAL 1 HOUR AS final FROM a)
SELECT strftime(h, '%Y-%m-%d %H') AS hour, count(*) AS processed, round(sum(seconds), 4) AS total_time FROM a, marks
WHERE NOT (late AND h + INTERVAL 1 HOUR <= early) AND h + INTERVAL 1 HOUR <= final GROUP BY h""")
def stream_late_windows(spark, sf):
    # rows behind the watermark are dropped, windows come when it has passed them; resumed after two parts
    got = run_in_parts(late_requests(spark, sf), scratch(spark, "stream"), lambda r: S.request_stats(r, every="1 hour"), "append", stop_after=2)
    return got.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "processed", F.round("total_time", 4).alias("total_time"))


@query("alert_handlers", f"""SELECT handler, metric_id, level, component FROM ({ORACLES['threshold_alerts']}), (VALUES ('log'), ('mail')) v(handler)
  WHERE handler = 'log' OR level = 'error'""")
def alert_handlers(spark, sf):
    path = scratch(spark, "stream")
    log = lambda b, i: b.write.mode("overwrite").parquet(f"{path}/log/batch={i}")
    mail = lambda b, i: b.filter("level = 'error'").write.mode("overwrite").parquet(f"{path}/mail/batch={i}")
    alerts = S.alert_stream(as_stream(d.perf(spark, sf), path), keep=("metric_id",))
    S.send_alerts(alerts, [log, mail], checkpoint=f"{path}/state", once=True).awaitTermination()
    parts = [spark.read.schema(alerts.schema).parquet(f"{path}/{h}").select(F.lit(h).alias("handler"), "metric_id", "level", "component")
             for h in ("log", "mail")]
    return parts[0].unionByName(parts[1])


@query("stream_request_stats", f"""WITH {d.REQUESTS}
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS processed, round(sum(seconds), 4) AS total_time FROM requests GROUP BY 1""")
def stream_request_stats(spark, sf):
    got = run_through(d.requests(spark, sf), scratch(spark, "stream"), S.request_stats, "complete")
    return got.select(F.to_date("window_start").cast("string").alias("day"), "processed", F.round("total_time", 4).alias("total_time"))


@query("stream_alerts", f"SELECT metric_id, level, component FROM ({ORACLES['threshold_alerts']})")
def stream_alerts(spark, sf):
    return run_through(d.perf(spark, sf), scratch(spark, "stream"), lambda m: S.alert_stream(m, keep=("metric_id",))).select(
        "metric_id", "level", "component")


@query("stream_rate_limit", ORACLES["rate_limit_exact"])
def stream_rate_limit(spark, sf):
    return run_through(d.requests(spark, sf), scratch(spark, "stream"),
                       lambda r: S.rate_limit_stream(r, limit=2, window_minutes=1440)).select("request_id", "client", "accepted")


@query("stream_error_counts", f"WITH {d.ERRORS} SELECT category, error_type, count(*) AS count FROM errors GROUP BY ALL")
def stream_error_counts(spark, sf):
    return run_through(d.errors(spark, sf), scratch(spark, "stream"), S.error_count_stream, "complete").select(
        "category", "error_type", "count")


@query("stream_dedup", "SELECT md5(text) AS digest, count(*) AS n FROM (SELECT DISTINCT text FROM documents) GROUP BY 1")
def stream_dedup(spark, sf):
    arriving = messages(spark, sf).select("text", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("row_id")).alias("ts"))
    got = run_through(arriving, scratch(spark, "stream"), lambda m: S.dedup_stream(m, within="36500 days"))
    return got.groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_scores", f"SELECT email_index, prediction, confidence, status FROM ({ORACLES['score_messages']})")
def stream_scores(spark, sf):
    terms, priors = bayes.fit(labelled(spark, sf))
    path = scratch(spark, "stream")
    arriving = as_stream(messages(spark, sf).withColumnRenamed("row_id", "email_index"), path)
    S.score_stream(arriving, terms, priors, out=f"{path}/out", checkpoint=f"{path}/state", once=True,
                   max_length=None).awaitTermination()
    got = spark.read.parquet(f"{path}/out")
    return got.select("email_index", "prediction", F.round("confidence", 5).alias("confidence"), "status")
