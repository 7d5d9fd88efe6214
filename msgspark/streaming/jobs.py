"""Streaming scoring, statistics, alerts, rate limits, error tracking and de-duplication.

Every function takes a streaming DataFrame and returns one, or starts a query where a sink
is part of the job. Time columns are event times; late rows beyond the watermark are dropped
as the engine does it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import fixed_values as fv
from ..operators.scoring import score_messages
from ..operators.telemetry import epoch_micros, threshold_alerts
from .state import LatestIds, RateLimiter, use_rocksdb


def _event_time(df: DataFrame, ts: str, late: str) -> DataFrame:
    """Watermark on ``ts``, which has to be a zoned timestamp for it."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def _start(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, *, once: bool) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def score_stream(messages: DataFrame, terms: DataFrame, priors: DataFrame, *, out: str, checkpoint: str,
                 text: str = "text", index: str = "email_index", once: bool = False,
                 max_length: int | None = fv.MAX_MESSAGE) -> StreamingQuery:
    """Score arriving messages; good and error rows land in separate partitions.

    A micro-batch writes its own folder and overwrites it when it is retried, so a restart
    neither loses nor doubles rows.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        scored = score_messages(batch, terms, priors, text=text, index=index, max_length=max_length)
        scored.write.mode("overwrite").partitionBy("status").parquet(f"{out}/batch_id={batch_id}")

    return _start(messages, sink, checkpoint, once=once)


def request_stats(requests: DataFrame, *, ts: str = "ts", value: str = "seconds", every: str = "1 day",
                  late: str = "1 hour") -> DataFrame:
    """Requests and mean latency per tumbling window."""
    return (
        _event_time(requests, ts, late).groupBy(F.window(ts, every).alias("w"))
        .agg(F.count(F.lit(1)).alias("processed"), F.sum(value).alias("total_time"))
        .select(F.col("w.start").alias("window_start"), "processed", "total_time",
                (F.col("total_time") / F.col("processed")).alias("avg_time"))
    )


def sliding_performance(metrics: DataFrame, *, ts: str = "ts", length: str = "1 hour", step: str = "5 minutes",
                        late: str = "10 minutes") -> DataFrame:
    """Averages over the last hour, advanced every five minutes."""
    return (
        _event_time(metrics, ts, late).groupBy(F.window(ts, length, step).alias("w"))
        .agg(F.avg("processing_time_ms").alias("avg_processing_time_ms"), F.avg("memory_usage_mb").alias("avg_memory_usage_mb"),
             F.avg("accuracy").alias("avg_accuracy"), F.avg("false_negative_rate").alias("avg_fnr"),
             F.sum("samples_processed").alias("total_samples_processed"), F.count(F.lit(1)).alias("operations_count"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "avg_processing_time_ms",
                "avg_memory_usage_mb", "avg_accuracy", "avg_fnr", "total_samples_processed", "operations_count")
    )


def alert_stream(metrics: DataFrame, *, keep: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Threshold alerts row by row, no state."""
    return threshold_alerts(metrics, keep=keep)


def send_alerts(alerts: DataFrame, handlers: list[Callable[[DataFrame, int], None]], *, checkpoint: str,
                once: bool = False) -> StreamingQuery:
    """Hand every micro-batch of alerts to all handlers."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        for handler in handlers:
            handler(batch, batch_id)

    return _start(alerts, sink, checkpoint, once=once)


def rate_limit_stream(requests: DataFrame, *, limit: int = 100, window_minutes: float = 60, client: str = "client",
                      ts: str = "ts", request_id: str = "request_id", late: str = "1 hour") -> DataFrame:
    """(client, request_id, accepted), decided in the order of time within each micro-batch.

    State is at most ``limit`` times per client and is dropped once the event time has
    passed the window of the last accepted request.
    """
    use_rocksdb(requests.sparkSession)
    keyed = _event_time(requests, ts, late).select(
        F.col(client).alias("client"), F.col(request_id).alias("request_id"), ts, epoch_micros(ts).alias("at"))
    key_type = keyed.schema["client"].dataType.simpleString()
    id_type = keyed.schema["request_id"].dataType.simpleString()
    return keyed.groupBy("client").transformWithStateInPandas(
        RateLimiter(limit, int(window_minutes * 60_000_000)), f"client {key_type}, request_id {id_type}, accepted boolean", "append", "EventTime")


def error_count_stream(errors: DataFrame, *, ts: str = "ts") -> DataFrame:
    """Running count, first and last time per category and type (update or complete mode)."""
    return errors.groupBy("category", "error_type").agg(
        F.count(F.lit(1)).alias("count"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def error_pattern_stream(errors: DataFrame, n: int = 100, *, ts: str = "ts", error_id: str = "error_id") -> DataFrame:
    """The ids of the ``n`` latest errors per component and operation, by every micro-batch that has some (update mode)."""
    use_rocksdb(errors.sparkSession)
    rows = errors.select("component", "operation", F.col(error_id).cast("bigint").alias("error_id"), epoch_micros(ts).alias("at"))
    return rows.groupBy("component", "operation").transformWithStateInPandas(
        LatestIds(n), "component string, operation string, error_ids array<bigint>", "update", "None")


def dedup_stream(messages: DataFrame, *, text: str = "text", ts: str = "ts", within: str = "1 day") -> DataFrame:
    """First arrival of every text; repeats within the watermark delay are dropped."""
    keyed = _event_time(messages, ts, within).withColumn("_h", F.xxhash64(text))
    return keyed.dropDuplicatesWithinWatermark(["_h", text]).drop("_h")
