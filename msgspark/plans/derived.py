"""Job, metric, request, alert, health and error tables derived from the event stream.

Every table is a projection or grouping of all events, so it grows with them. The SQL text
next to each function states the same derivation for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import evaluate as ev
from ..operators.ranking import global_rank
from .registry import table

AS_OF_TEXT = "2024-01-30 00:00:00"
AS_OF_SQL = f"TIMESTAMP '{AS_OF_TEXT}'"


def as_of():
    return F.lit(AS_OF_TEXT).cast("timestamp_ntz")


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def stamp_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


EVENTS = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"

# model, balanced, value limits: purchases above the first and anything above the second
# count as spam; errors count as spam above the third
RULES = (
    ("naive_bayes", False, 30, 150, 0), ("naive_bayes", True, 10, 120, 0),
    ("random_forest", False, 60, 200, 20), ("random_forest", True, 25, 90, 0),
    ("decision_tree", False, 5, 60, 5), ("decision_tree", True, 0, 55, 0),
)


def scored(spark, sf) -> DataFrame:
    """Three rule models before and after balancing, applied to every event."""
    rules = F.array(*[F.struct(F.lit(m + ("_balanced" if b else "")).alias("model_name"), F.lit(m).alias("base"),
                               F.lit(b).alias("class_balancing_enabled"), F.lit(p).alias("p"), F.lit(a).alias("a"),
                               F.lit(e).alias("e")) for m, b, p, a, e in RULES])
    e = events(spark, sf).select("event_id", "event_type", "value", F.explode(rules).alias("r")).select(
        "event_id", "event_type", "value", "r.*")
    spam = ((F.col("event_type") == "error") & (F.col("value") > F.col("e"))) | (
        (F.col("event_type") == "purchase") & (F.col("value") > F.col("p"))) | (F.col("value") > F.col("a"))
    return e.select("event_id", "model_name", "base", "class_balancing_enabled",
                    F.col("event_type").isin("error", "purchase").cast("int").alias("label"),
                    spam.cast("int").alias("prediction"))


_RULE_ROWS = ", ".join(f"('{m}{'_balanced' if b else ''}', '{m}', {str(b).lower()}, {p}, {a}, {e})" for m, b, p, a, e in RULES)
SCORED = f"""{EVENTS}, rules(model_name, base, class_balancing_enabled, p, a, e) AS (VALUES {_RULE_ROWS}),
  scored AS (SELECT event_id, model_name, base, class_balancing_enabled,
    CASE WHEN event_type IN ('error', 'purchase') THEN 1 ELSE 0 END AS label,
    CASE WHEN (event_type = 'error' AND value > e) OR (event_type = 'purchase' AND value > p) OR value > a
      THEN 1 ELSE 0 END AS prediction FROM ev, rules)"""


def metrics(spark, sf) -> DataFrame:
    """One metrics row per model."""
    return ev.evaluate_models(scored(spark, sf), by=("model_name", "base", "class_balancing_enabled"))


def _div(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END"


METRICS = f"""{SCORED}, conf AS (SELECT model_name, base, class_balancing_enabled,
    count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
    count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp
    FROM scored GROUP BY ALL),
  parts AS (SELECT *, tn + fp AS n0, fn + tp AS n1, {_div('tn', 'tn + fn')} AS p0, {_div('tp', 'tp + fp')} AS p1,
    {_div('tn', 'tn + fp')} AS r0, {_div('tp', 'fn + tp')} AS r1 FROM conf),
  fs AS (SELECT *, {_div('2 * p0 * r0', 'p0 + r0')} AS f0, {_div('2 * p1 * r1', 'p1 + r1')} AS f1 FROM parts),
  metrics AS (SELECT model_name, base, class_balancing_enabled, tn, fp, fn, tp, n0 + n1 AS test_samples,
    (tn + tp)::DOUBLE / (n0 + n1) AS accuracy, (n0 * p0 + n1 * p1) / (n0 + n1) AS precision,
    (n0 * r0 + n1 * r1) / (n0 + n1) AS recall, (n0 * f0 + n1 * f1) / (n0 + n1) AS f1_score,
    {_div('fn', 'fn + tp')} AS false_negative_rate, {_div('fp', 'fp + tn')} AS false_positive_rate,
    {_div('tp', 'tp + fn')} AS spam_detection_rate, p0, p1, r0, r1, f0, f1, n0, n1 FROM fs)"""


def before_after(spark, sf) -> DataFrame:
    """Each base model before and after balancing."""
    m = metrics(spark, sf).drop("model_name").withColumnRenamed("base", "model_name")
    return ev.before_after(m.filter(~F.col("class_balancing_enabled")), m.filter("class_balancing_enabled"))


_M = ("accuracy", "precision", "recall", "f1_score", "false_negative_rate", "false_positive_rate")
DELTAS = f"""{METRICS}, deltas AS (SELECT o.base AS model_name,
    {', '.join(f'o.{m} AS original_{m}, b.{m} AS balanced_{m}' for m in _M)},
    b.accuracy - o.accuracy AS accuracy_improvement, b.precision - o.precision AS precision_improvement,
    b.recall - o.recall AS recall_improvement, b.f1_score - o.f1_score AS f1_improvement,
    o.false_negative_rate - b.false_negative_rate AS fnr_reduction,
    b.false_positive_rate - o.false_positive_rate AS fpr_change
  FROM metrics o JOIN metrics b USING (base) WHERE NOT o.class_balancing_enabled AND b.class_balancing_enabled)"""


def requests(spark, sf) -> DataFrame:
    return events(spark, sf).select(F.col("event_id").alias("request_id"), F.col("user_id").alias("client"), "ts",
                                    F.col("event_type").alias("endpoint"), (F.col("value") / 60.0).alias("seconds"))


REQUESTS = """requests AS (SELECT event_id AS request_id, user_id AS client, ts, event_type AS endpoint,
  value / 60.0::DOUBLE AS seconds FROM events)"""


def perf(spark, sf) -> DataFrame:
    return events(spark, sf).select(
        F.col("event_id").alias("metric_id"), "ts", (F.col("value") * 100).alias("processing_time_ms"),
        (F.col("value") * 15).alias("memory_usage_mb"), F.col("k").alias("samples_processed"),
        (F.col("value") / 2000.0).alias("false_negative_rate"), (1.0 - F.col("value") / 1000.0).alias("accuracy"),
        (F.col("k") * (F.col("user_id") % 4)).alias("synthetic_samples_created"),
        F.col("event_type").alias("balancing_method"), (F.col("value") / 100.0).alias("seconds"))


PERF = f"""{EVENTS}, perf AS (SELECT event_id AS metric_id, ts, value * 100 AS processing_time_ms,
  value * 15 AS memory_usage_mb, k AS samples_processed, value / 2000.0::DOUBLE AS false_negative_rate,
  1.0::DOUBLE - value / 1000.0::DOUBLE AS accuracy, k * (user_id % 4) AS synthetic_samples_created,
  event_type AS balancing_method, value / 100.0::DOUBLE AS seconds FROM ev)"""


def jobs(spark, sf) -> DataFrame:
    """One job per user and day."""
    g = events(spark, sf).groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("total_emails"), F.count_if(F.col("event_type") == "error").alias("error_count"),
        F.min("ts").alias("created_at"), F.max("ts").alias("last"))
    status = (F.when(F.col("error_count") == 0, "completed").when(F.col("error_count") == 1, "processing")
              .when(F.col("error_count") == 2, "failed").otherwise("cancelled"))
    job_id = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("day").cast("string"))
    g = g.withColumns({"job_id": job_id, "status": status})
    done = F.col("status").isin("completed", "failed")
    return g.select(
        "job_id", "status", "total_emails", (F.col("total_emails") - F.col("error_count")).alias("processed_emails"),
        "created_at", F.when(done, F.col("last")).alias("completed_at"),
        F.when(done, F.concat(F.lit("results/batch_results_"), "job_id", F.lit(".csv"))).alias("result_file_path"),
        "error_count")


JOBS = """jobs AS (SELECT job_id, status, total_emails, total_emails - error_count AS processed_emails, created_at,
    CASE WHEN status IN ('completed', 'failed') THEN last END AS completed_at,
    CASE WHEN status IN ('completed', 'failed') THEN 'results/batch_results_' || job_id || '.csv' END AS result_file_path,
    error_count
  FROM (SELECT user_id || '-' || CAST(ts AS DATE) AS job_id, count(*) AS total_emails,
      count(*) FILTER (event_type = 'error') AS error_count, min(ts) AS created_at, max(ts) AS last,
      CASE count(*) FILTER (event_type = 'error') WHEN 0 THEN 'completed' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed'
        ELSE 'cancelled' END AS status
    FROM events GROUP BY user_id, CAST(ts AS DATE)))"""


def files(spark, sf) -> DataFrame:
    """Result files: the job's own for even events, a partial one for odd events."""
    e = events(spark, sf)
    own = F.concat(F.lit("results/batch_results_"), F.col("user_id").cast("string"), F.lit("-"),
                   F.to_date("ts").cast("string"), F.lit(".csv"))
    part = F.concat(F.lit("results/partial_results_"), F.col("event_id").cast("string"), F.lit(".csv"))
    return e.groupBy(F.when(F.col("event_id") % 2 == 0, own).otherwise(part).alias("path")).agg(F.max("ts").alias("modified"))


FILES = """files AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'results/batch_results_' || user_id || '-' || CAST(ts AS DATE) || '.csv'
    ELSE 'results/partial_results_' || event_id || '.csv' END AS path, max(ts) AS modified FROM events GROUP BY 1)"""


def results(spark, sf) -> DataFrame:
    """Scored messages of one job per user, numbered in event order."""
    e = global_rank(events(spark, sf), order_by=["event_id"], partition_by=["user_id"], name="rank")
    bad = (F.col("event_type") == "error") | (F.col("value") < 6)
    return e.select(
        F.col("user_id").alias("job_id"), (F.col("rank") + 1).alias("email_index"), "event_id",
        F.when(bad, "error").otherwise("success").alias("status"),
        F.when(bad, F.concat(F.lit("bad "), "event_type")).alias("error_message"),
        F.when(bad, "Error").when(F.col("value") > 60, "Spam").otherwise("Legitimate").alias("prediction"))


RESULTS = """results AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS email_index,
  event_id, CASE WHEN event_type = 'error' OR value < 6 THEN 'error' ELSE 'success' END AS status,
  CASE WHEN event_type = 'error' OR value < 6 THEN 'bad ' || event_type END AS error_message,
  CASE WHEN event_type = 'error' OR value < 6 THEN 'Error' WHEN value > 60 THEN 'Spam' ELSE 'Legitimate' END AS prediction
  FROM events)"""


def alerts(spark, sf) -> DataFrame:
    solved = F.col("value") > 40
    return events(spark, sf).select(
        F.col("event_id").alias("alert_id"), "ts", F.when(F.col("value") > 100, "error").otherwise("warning").alias("level"),
        F.col("event_type").alias("component"), solved.alias("resolved"),
        F.when(solved, F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("resolution_time"))


ALERTS = """alerts AS (SELECT event_id AS alert_id, ts, CASE WHEN value > 100 THEN 'error' ELSE 'warning' END AS level,
  event_type AS component, value > 40 AS resolved, CASE WHEN value > 40 THEN ts + INTERVAL 1 HOUR END AS resolution_time
  FROM events)"""


def health(spark, sf) -> DataFrame:
    v = F.col("value")
    return events(spark, sf).select(
        F.col("event_id").alias("check_id"), "ts", F.col("event_type").alias("component"),
        F.when(v < 60, "healthy").when(v < 120, "degraded").otherwise("unhealthy").alias("status"))


HEALTH = """health AS (SELECT event_id AS check_id, ts, event_type AS component,
  CASE WHEN value < 60 THEN 'healthy' WHEN value < 120 THEN 'degraded' ELSE 'unhealthy' END AS status FROM events)"""

ERROR_TYPES = ("ValidationError", "ServiceNotReadyError", "ModelError", "ProcessingError", "MemoryError")


def errors(spark, sf) -> DataFrame:
    v = F.col("value")
    kinds = F.array(*[F.lit(t) for t in ERROR_TYPES])
    return events(spark, sf).select(
        F.col("event_id").alias("error_id"), "ts", F.get(kinds, (F.col("k") % 5).cast("int")).alias("error_type"),
        F.when(F.col("event_type") == "error", "model_operation").when(v > 80, "system_resource")
        .otherwise("validation").alias("category"),
        F.when(v < 20, "low").when(v < 60, "medium").when(v < 120, "high").otherwise("critical").alias("severity"),
        F.concat(F.lit("component_"), (F.col("user_id") % 5).cast("string")).alias("component"),
        F.col("event_type").alias("operation"))


ERRORS = f"""{EVENTS}, errors AS (SELECT event_id AS error_id, ts,
  [{', '.join(f"'{t}'" for t in ERROR_TYPES)}][k % 5 + 1] AS error_type,
  CASE WHEN event_type = 'error' THEN 'model_operation' WHEN value > 80 THEN 'system_resource' ELSE 'validation' END AS category,
  CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'medium' WHEN value < 120 THEN 'high' ELSE 'critical' END AS severity,
  'component_' || (user_id % 5) AS component, event_type AS operation FROM ev)"""


def operations(spark, sf) -> DataFrame:
    """Event 2i starts operation i, event 2i+1 ends it."""
    e = events(spark, sf)
    return e.select(F.floor(F.col("event_id") / 2).cast("bigint").alias("operation_id"),
                    F.when(F.col("event_id") % 2 == 0, "start").otherwise("end").alias("phase"), "ts",
                    F.col("event_type").alias("component"),
                    F.concat(F.lit("op_"), (F.col("user_id") % 3).cast("string")).alias("operation"),
                    (F.col("value") < 90).alias("success"), "event_id")


OPERATIONS = """ops AS (SELECT event_id // 2 AS operation_id, CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'end' END AS phase, ts,
  event_type AS component, 'op_' || (user_id % 3) AS operation, value < 90 AS success, event_id FROM events)"""
