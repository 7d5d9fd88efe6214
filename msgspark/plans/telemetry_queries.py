"""Registered queries: jobs, requests, metrics, alerts, health, errors, rate limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs as J, rows as R, telemetry as G
from . import derived as d
from .registry import query, table

S, AS = d.stamp_sql, d.AS_OF_SQL


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


# ---- jobs --------------------------------------------------------------------------------------
GATE = f"""{d.RESULTS}, run AS (SELECT *, sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY email_index) AS errs FROM results),
 stop AS (SELECT job_id, min(email_index) AS abort_index FROM run WHERE errs > 10 AND status = 'error' AND email_index <= 50 GROUP BY 1)"""


@query("abort_index", f"WITH {GATE} SELECT job_id, abort_index FROM stop")
def abort_index(spark, sf):
    return J.abort_index(d.results(spark, sf))


@query("abort_gate", f"""WITH {GATE} SELECT r.job_id, email_index, status, abort_index IS NOT NULL AS partial,
  CASE WHEN abort_index IS NULL THEN 'completed' ELSE 'failed' END AS job_status
FROM results r LEFT JOIN stop s ON r.job_id = s.job_id WHERE abort_index IS NULL OR email_index <= abort_index""")
def abort_gate(spark, sf):
    return J.gate_results(d.results(spark, sf)).select("job_id", "email_index", "status", "partial", "job_status")


@query("job_progress", f"""WITH {d.RESULTS} SELECT job_id, count(*) AS processed, count(*) FILTER (status = 'error') AS error_count,
  round(100.0::DOUBLE * count(*) FILTER (status <> 'error') / count(*), 6) AS success_rate FROM results GROUP BY 1""")
def job_progress(spark, sf):
    return J.progress(d.results(spark, sf)).select("job_id", "processed", "error_count", *r6("success_rate"))


@query("last_errors", f"""WITH {d.RESULTS} SELECT job_id, email_index, 'Email ' || email_index || ': ' || error_message AS error_message FROM results
WHERE status = 'error' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY email_index DESC) <= 10""")
def last_errors(spark, sf):
    return J.last_errors(d.results(spark, sf))


@query("job_summary", f"""WITH {d.JOBS}, {d.FILES} SELECT job_id, status, round(100.0::DOUBLE * processed_emails / total_emails, 6) AS progress_percentage,
  round(epoch_us(completed_at - created_at) / 1000000.0::DOUBLE, 6) AS processing_time_seconds, f.path IS NOT NULL AS result_file_available
FROM jobs LEFT JOIN files f ON f.path = result_file_path""")
def job_summary(spark, sf):
    s = J.job_summary(d.jobs(spark, sf), d.files(spark, sf))
    return s.select("job_id", "status", *r6("progress_percentage", "processing_time_seconds"), "result_file_available")


DAILY = """daily AS (SELECT CAST(completed_at AS DATE) AS day, count(*) AS jobs_today, CAST(sum(processed_emails) AS BIGINT) AS processed_today,
  sum(epoch_us(completed_at - created_at) / 1000000.0::DOUBLE) AS total_processing_time,
  count(*) FILTER (status = 'completed') AS successful_jobs, count(*) FILTER (status = 'failed') AS failed_jobs
  FROM jobs WHERE completed_at IS NOT NULL GROUP BY 1)"""


@query("daily_job_stats", f"""WITH {d.JOBS}, {DAILY} SELECT CAST(day AS VARCHAR) AS day, jobs_today, processed_today, round(total_processing_time, 3) AS total_processing_time,
  successful_jobs, failed_jobs, round(processed_today::DOUBLE / jobs_today, 6) AS avg_emails_per_job,
  round(total_processing_time / jobs_today, 3) AS avg_processing_time, round(100.0::DOUBLE * successful_jobs / jobs_today, 6) AS success_rate FROM daily""")
def daily_job_stats(spark, sf):
    s = J.daily_job_stats(d.jobs(spark, sf))
    return s.select(F.col("day").cast("string").alias("day"), "jobs_today", "processed_today",
                    F.round("total_processing_time", 3).alias("total_processing_time"), "successful_jobs", "failed_jobs",
                    *r6("avg_emails_per_job", "success_rate"), F.round("avg_processing_time", 3).alias("avg_processing_time"))


@query("status_counts", f"""WITH {d.JOBS} SELECT s AS status, (SELECT count(*) FROM jobs WHERE CASE WHEN status IN ('processing', 'completed', 'failed') THEN status ELSE 'pending' END = s) AS n_jobs
FROM (SELECT unnest(['processing', 'completed', 'failed', 'pending']) AS s)""")
def status_counts(spark, sf):
    return J.status_counts(d.jobs(spark, sf))


@query("retention", f"""WITH {d.JOBS}, r AS (SELECT job_id, status, CASE WHEN completed_at IS NOT NULL AND epoch_us({AS} - completed_at) > 24 * 3600000000 THEN 'expired'
  WHEN status = 'failed' AND epoch_us({AS} - coalesce(completed_at, created_at)) > 3600000000 THEN 'failed' END AS reason FROM jobs)
SELECT * FROM r WHERE reason IS NOT NULL""")
def retention(spark, sf):
    return J.expired_jobs(d.jobs(spark, sf), d.as_of()).select("job_id", "status", "reason")


@query("missing_files", f"""WITH {d.JOBS}, {d.FILES} SELECT job_id, epoch_us({AS} - completed_at) > 3600000000 AS drop_job
FROM jobs ANTI JOIN files ON files.path = jobs.result_file_path WHERE result_file_path IS NOT NULL""")
def missing_files(spark, sf):
    return J.missing_files(d.jobs(spark, sf), d.files(spark, sf), d.as_of())


@query("orphans_anti", f"""WITH {d.JOBS}, {d.FILES} SELECT path, {S('modified')} AS modified FROM files
WHERE path NOT IN (SELECT result_file_path FROM jobs WHERE result_file_path IS NOT NULL) AND epoch_us({AS} - modified) > 24 * 3600000000""")
def orphans_anti(spark, sf):
    return J.orphan_files(d.files(spark, sf), d.jobs(spark, sf), d.as_of()).select("path", d.stamp("modified").alias("modified"))


# ---- requests ----------------------------------------------------------------------------------
@query("last100_latency", f"""WITH {d.REQUESTS} SELECT count(*) AS n_recent, round(avg(seconds), 6) AS avg_response_time
FROM (SELECT seconds FROM requests ORDER BY ts DESC, request_id DESC LIMIT 100)""")
def last100_latency(spark, sf):
    return G.last_n_average(d.requests(spark, sf)).select("n_recent", *r6("avg_response_time"))


@query("daily_stats", f"""WITH {d.REQUESTS}, g AS (SELECT CAST(ts AS DATE) AS day, count(*) AS processed, sum(seconds) AS total_time FROM requests GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, processed, round(total_time, 4) AS total_time, round(total_time / processed, 6) AS avg_time,
  CAST(sum(processed) OVER (ORDER BY day) AS BIGINT) AS total_processed FROM g""")
def daily_stats(spark, sf):
    return G.daily_requests(d.requests(spark, sf)).select(
        F.col("day").cast("string").alias("day"), "processed", F.round("total_time", 4).alias("total_time"), *r6("avg_time"), "total_processed")


@query("prediction_distribution", f"""WITH {d.RESULTS}, c AS (SELECT count(*) FILTER (prediction = 'Spam') AS spam_count, count(*) FILTER (prediction = 'Legitimate') AS legitimate_count FROM results)
SELECT *, spam_count + legitimate_count AS total_count, round(spam_count * 100.0::DOUBLE / (spam_count + legitimate_count), 1) AS spam_percentage,
  round(legitimate_count * 100.0::DOUBLE / (spam_count + legitimate_count), 1) AS legitimate_percentage FROM c""")
def prediction_distribution(spark, sf):
    return G.prediction_distribution(d.results(spark, sf))


@query("latency_hist", f"""WITH {d.REQUESTS}, b AS (SELECT CASE WHEN seconds < 1 THEN '0-1s' WHEN seconds < 2 THEN '1-2s' WHEN seconds < 3 THEN '2-3s' WHEN seconds < 4 THEN '3-4s' ELSE '4s+' END AS bucket FROM requests)
SELECT s AS bucket, (SELECT count(*) FROM b WHERE bucket = s) AS n FROM (SELECT unnest(['0-1s', '1-2s', '2-3s', '3-4s', '4s+']) AS s)""")
def latency_hist(spark, sf):
    return G.latency_histogram(d.requests(spark, sf))


DASH = f"""{d.REQUESTS}, {d.JOBS}, a AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, sum(seconds) AS s FROM requests GROUP BY 1),
 b AS (SELECT CAST(completed_at AS DATE) AS day, sum(processed_emails) AS n FROM jobs WHERE completed_at IS NOT NULL GROUP BY 1)"""


@query("dashboard_days", f"""WITH {DASH} SELECT CAST(coalesce(a.day, b.day) AS VARCHAR) AS day, CAST(coalesce(a.n, 0) + coalesce(b.n, 0) AS BIGINT) AS processed_today,
  round(coalesce(a.s / a.n, 0), 6) AS avg_response_time FROM a FULL JOIN b ON a.day = b.day""")
def dashboard_days(spark, sf):
    return G.dashboard_days(d.requests(spark, sf), d.jobs(spark, sf)).select(
        F.col("day").cast("string").alias("day"), "processed_today", *r6("avg_response_time"))


@query("cached_snapshot", f"""SELECT event_id AS snapshot_id, event_type AS active_model FROM events
WHERE ts > {AS} - INTERVAL 60 MINUTE AND ts <= {AS} ORDER BY ts DESC, event_id DESC LIMIT 1""")
def cached_snapshot(spark, sf):
    s = d.events(spark, sf).select(F.col("event_id").alias("snapshot_id"), "ts", F.col("event_type").alias("active_model"))
    return G.cached_snapshot(s, d.as_of(), minutes=60).select("snapshot_id", "active_model")


# ---- metrics -----------------------------------------------------------------------------------
@query("recent_rows", f"SELECT event_id FROM events WHERE ts >= {AS} - INTERVAL 24 HOUR")
def recent_rows(spark, sf):
    return d.events(spark, sf).filter(R.since("ts", d.as_of(), hours=24)).select("event_id")


@query("perf_last_hour", f"""WITH {d.PERF} SELECT round(avg(processing_time_ms), 6) AS avg_processing_time_ms, round(avg(memory_usage_mb), 6) AS avg_memory_usage_mb,
  round(avg(accuracy), 6) AS avg_accuracy, round(avg(false_negative_rate), 6) AS avg_fnr,
  CAST(coalesce(sum(samples_processed), 0) AS BIGINT) AS total_samples_processed, count(*) AS operations_count
FROM perf WHERE ts > {AS} - INTERVAL 1 HOUR AND ts <= {AS}""")
def perf_last_hour(spark, sf):
    p = G.recent_performance(d.perf(spark, sf), d.as_of())
    return p.select(*r6(*[c for c in p.columns if c.startswith("avg")]), "total_samples_processed", "operations_count")


LONG = """lng AS (SELECT period, x, unnest(['processing_time', 'memory_usage', 'accuracy', 'false_negative_rate']) AS metric,
   unnest([processing_time_ms, memory_usage_mb, accuracy, false_negative_rate]) AS y FROM ranked)"""
TREND = """SELECT period, metric, count(*) AS n, round(min(y), 6) AS min, round(max(y), 6) AS max, round(avg(y), 6) AS avg,
  round(regr_slope(y, x), 7) + 0.0::DOUBLE AS slope, CASE WHEN count(*) < 2 OR abs(regr_slope(y, x)) < 0.01 THEN 'stable' WHEN regr_slope(y, x) > 0 THEN 'increasing' ELSE 'decreasing' END AS trend
FROM lng GROUP BY ALL"""


def _trend_columns(t):
    return t.select("period", "metric", "n", *r6("min", "max", "avg"), (F.round("slope", 7) + 0.0).alias("slope"), "trend")


@query("trend_slope", f"""WITH {d.PERF}, ranked AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS period,
  row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, metric_id) - 1 AS x, perf.* FROM perf), {LONG} {TREND}""")
def trend_slope(spark, sf):
    return _trend_columns(G.trends(d.perf(spark, sf), period=F.to_date("ts").cast("string")))


@query("trend_all", f"""WITH {d.PERF}, ranked AS (SELECT 'all' AS period, row_number() OVER (ORDER BY ts, metric_id) - 1 AS x, perf.* FROM perf), {LONG} {TREND}""")
def trend_all(spark, sf):
    return _trend_columns(G.trends(d.perf(spark, sf)))


@query("threshold_alerts", f"""WITH {d.PERF}, r AS (
 SELECT metric_id, 'warning' AS level, 'performance' AS component, printf('Processing time exceeded threshold: %.1fms > 30000ms', processing_time_ms) AS message FROM perf WHERE processing_time_ms > 30000
 UNION ALL SELECT metric_id, 'warning', 'performance', printf('Memory usage exceeded threshold: %.1fMB > 4096MB', memory_usage_mb) FROM perf WHERE memory_usage_mb > 4096
 UNION ALL SELECT metric_id, 'error', 'performance', printf('Accuracy below threshold: %.3f < 0.900', accuracy) FROM perf WHERE accuracy < 0.9
 UNION ALL SELECT metric_id, 'error', 'performance', printf('False negative rate exceeded threshold: %.3f > 0.100', false_negative_rate) FROM perf WHERE false_negative_rate > 0.1
 UNION ALL SELECT metric_id, 'warning', 'balancing', printf('Synthetic sample ratio exceeded threshold: %.2f > 2.0', synthetic_samples_created::DOUBLE / samples_processed) FROM perf
   WHERE samples_processed > 0 AND synthetic_samples_created::DOUBLE / samples_processed > 2.0)
SELECT metric_id, level, component, split_part(message, ':', 1) AS message FROM r""")
def threshold_alerts(spark, sf):
    a = G.threshold_alerts(d.perf(spark, sf), keep=("metric_id",))
    # digits are left out: the two engines round exact ties of %.1f differently
    return a.select("metric_id", "level", "component", F.substring_index("message", ":", 1).alias("message"))


@query("resource_tiers", f"""WITH {d.PERF} SELECT metric_id, round(samples_processed / greatest(seconds, 0.001), 4) AS samples_per_second,
  CASE WHEN samples_processed / greatest(seconds, 0.001) > 10000 THEN 'high' WHEN samples_processed / greatest(seconds, 0.001) > 1000 THEN 'medium' ELSE 'low' END AS optimization_level,
  CASE WHEN memory_usage_mb < 500 THEN 'excellent' WHEN memory_usage_mb < 1000 THEN 'good' WHEN memory_usage_mb < 2000 THEN 'moderate' ELSE 'poor' END AS memory_efficiency FROM perf""")
def resource_tiers(spark, sf):
    t = G.resource_tiers(d.perf(spark, sf))
    return t.select("metric_id", F.round("samples_per_second", 4).alias("samples_per_second"), "optimization_level", "memory_efficiency")


@query("retained_metrics", f"""WITH {d.PERF} SELECT metric_id FROM perf WHERE ts >= {AS} - INTERVAL 24 HOUR ORDER BY ts DESC, metric_id DESC LIMIT 1000""")
def retained_metrics(spark, sf):
    return G.retained(d.perf(spark, sf), d.as_of(), max_rows=1000, tie="metric_id").select("metric_id")


@query("open_alerts", f"WITH {d.ALERTS} SELECT alert_id, level, component FROM alerts WHERE NOT resolved")
def open_alerts(spark, sf):
    return G.open_alerts(d.alerts(spark, sf)).select("alert_id", "level", "component")


@query("retained_alerts", f"WITH {d.ALERTS} SELECT alert_id FROM alerts WHERE NOT (resolved AND resolution_time < {AS} - INTERVAL 1 HOUR)")
def retained_alerts(spark, sf):
    return G.retained_alerts(d.alerts(spark, sf), d.as_of()).select("alert_id")


# ---- health ------------------------------------------------------------------------------------
LATEST = f"""{d.HEALTH}, last AS (SELECT component, arg_max(status, (ts, check_id)) AS status FROM health GROUP BY 1)"""


@query("latest_health", f"WITH {LATEST} SELECT * FROM last")
def latest_health(spark, sf):
    return G.latest_health(d.health(spark, sf))


@query("health_rollup", f"""WITH {LATEST}, c AS (SELECT count(*) FILTER (status = 'unhealthy') AS n_unhealthy, count(*) FILTER (status = 'degraded') AS n_degraded, count(*) FILTER (status = 'healthy') AS n_ready FROM last)
SELECT *, CASE WHEN n_unhealthy > 0 THEN 'unhealthy' WHEN n_degraded > 0 THEN 'degraded' ELSE 'healthy' END AS overall_health,
  CASE WHEN n_ready >= 4 THEN 'healthy' WHEN n_ready >= 2 THEN 'degraded' WHEN n_ready >= 1 THEN 'unhealthy' ELSE 'not_ready' END AS readiness FROM c""")
def health_rollup(spark, sf):
    return G.overall_health(d.health(spark, sf))


@query("health_alerts", f"""WITH {d.HEALTH} SELECT check_id, CASE status WHEN 'unhealthy' THEN 'error' ELSE 'warning' END AS level, component,
  CASE status WHEN 'unhealthy' THEN 'Health check failed: ' ELSE 'Health check degraded: ' END || component AS message FROM health WHERE status <> 'healthy'""")
def health_alerts(spark, sf):
    return G.health_alerts(d.health(spark, sf), keep=("check_id",))


# ---- errors ------------------------------------------------------------------------------------
COUNTS = f"""{d.ERRORS}, cnt AS (SELECT category || ':' || error_type AS error_key, count(*) AS count, min(ts) AS first_seen, max(ts) AS last_seen,
  arg_min(severity, (ts, error_id)) AS severity, arg_min(component, (ts, error_id)) AS component FROM errors GROUP BY 1)"""
SHOW = f"SELECT error_key, count, {S('first_seen')} AS first_seen, {S('last_seen')} AS last_seen, severity, component FROM cnt"


def _shown(c):
    return c.select("error_key", "count", d.stamp("first_seen").alias("first_seen"), d.stamp("last_seen").alias("last_seen"), "severity", "component")


@query("error_counts", f"WITH {COUNTS} {SHOW}")
def error_counts(spark, sf):
    return _shown(G.error_counts(d.errors(spark, sf)))


@query("frequent_errors", f"WITH {COUNTS} {SHOW} ORDER BY count DESC, error_key LIMIT 10")
def frequent_errors(spark, sf):
    return _shown(G.frequent_errors(d.errors(spark, sf)))


@query("error_patterns", f"""WITH {d.ERRORS} SELECT error_id, component, operation, error_type FROM errors
QUALIFY row_number() OVER (PARTITION BY component, operation ORDER BY ts DESC, error_id DESC) <= 100""")
def error_patterns(spark, sf):
    return G.error_patterns(d.errors(spark, sf)).select("error_id", "component", "operation", "error_type")


@query("error_summary", f"WITH {d.ERRORS} SELECT count(DISTINCT category || ':' || error_type) AS total_error_types, count(*) AS total_errors FROM errors")
def error_summary(spark, sf):
    return G.error_summary(d.errors(spark, sf))


@query("error_codes", f"""WITH {d.ERRORS} SELECT error_id,
  CASE WHEN error_type = 'ServiceNotReadyError' AND contains(category, 'model') THEN 'DASHBOARD_MODEL_NOT_TRAINED'
    WHEN error_type = 'ServiceNotReadyError' THEN 'DASHBOARD_SERVICE_NOT_READY' WHEN error_type = 'ModelError' THEN 'DASHBOARD_MODEL_NOT_TRAINED'
    WHEN error_type = 'ProcessingError' THEN 'DASHBOARD_METRICS_ERROR' WHEN error_type = 'ValidationError' THEN 'VALIDATION_ERROR'
    ELSE 'DASHBOARD_DATA_UNAVAILABLE' END AS dashboard_code,
  CASE error_type WHEN 'ServiceNotReadyError' THEN 503 WHEN 'ModelError' THEN 503 WHEN 'ValidationError' THEN 400 ELSE 500 END AS dashboard_status,
  CASE WHEN error_type = 'ValidationError' AND operation = 'view' THEN 'BATCH_FILE_INVALID' WHEN error_type = 'ValidationError' THEN 'BATCH_INVALID_CSV'
    WHEN error_type = 'ServiceNotReadyError' THEN 'BATCH_SERVICE_NOT_READY' WHEN error_type = 'MemoryError' THEN 'BATCH_FILE_TOO_LARGE'
    ELSE 'BATCH_PROCESSING_FAILED' END AS batch_code,
  CASE error_type WHEN 'ValidationError' THEN 400 WHEN 'ServiceNotReadyError' THEN 503 WHEN 'MemoryError' THEN 413 ELSE 500 END AS batch_status,
  CASE severity WHEN 'low' THEN 'INFO' WHEN 'medium' THEN 'WARNING' WHEN 'high' THEN 'ERROR' ELSE 'CRITICAL' END AS log_level FROM errors""")
def error_codes(spark, sf):
    e = d.errors(spark, sf)
    dc, ds = G.dashboard_code(F.col("error_type"), F.col("category"))
    bc, bs = G.batch_code(F.col("error_type"), F.when(F.col("operation") == "view", "file").otherwise("data"))
    return e.select("error_id", dc.alias("dashboard_code"), ds.alias("dashboard_status"), bc.alias("batch_code"),
                    bs.alias("batch_status"), G.log_level(F.col("severity")).alias("log_level"))


# ---- operations --------------------------------------------------------------------------------
@query("operation_alerts", f"""WITH {d.OPERATIONS} SELECT event_id, 'error' AS level, 'balancing_' || operation AS component,
  'Balancing operation failed: ' || operation AS message FROM ops WHERE NOT success""")
def operation_alerts(spark, sf):
    return G.operation_alerts(d.operations(spark, sf), keep=("event_id",))


PAIRED = f"""{d.OPERATIONS}, paired AS (SELECT s.operation_id, s.component, s.operation, e.success, epoch_us(e.ts - s.ts) / 1000000.0::DOUBLE AS duration
  FROM (SELECT * FROM ops WHERE phase = 'start') s LEFT JOIN (SELECT * FROM ops WHERE phase = 'end') e USING (operation_id))"""


@query("op_log", f"WITH {PAIRED} SELECT operation_id, component, operation, success, round(duration, 6) AS duration FROM paired")
def op_log(spark, sf):
    return G.pair_operations(d.operations(spark, sf)).select("operation_id", "component", "operation", "success", *r6("duration"))


@query("op_stats", f"""WITH {PAIRED} SELECT component, operation, count(*) AS n_operations, count(*) FILTER (NOT success) AS n_failed,
  round(avg(duration), 4) AS avg_duration, round(count(*) FILTER (NOT success)::DOUBLE / count(*), 6) AS failure_rate FROM paired GROUP BY ALL""")
def op_stats(spark, sf):
    s = G.operation_stats(G.pair_operations(d.operations(spark, sf)))
    return s.select("component", "operation", "n_operations", "n_failed", F.round("avg_duration", 4).alias("avg_duration"), *r6("failure_rate"))


@query("batch_completion", f"""WITH {d.JOBS} SELECT job_id, round(processed_emails::DOUBLE / total_emails * 100, 2) AS completion FROM jobs""")
def batch_completion(spark, sf):
    return d.jobs(spark, sf).select("job_id", G.completion_percentage(F.col("processed_emails"), F.col("total_emails")).alias("completion"))


@query("stats_summary", f"""WITH {d.REQUESTS}, {d.JOBS}, {d.PERF},
 a AS (SELECT count(*) AS total_processed FROM requests), b AS (SELECT round(avg(seconds), 6) AS avg_response_time FROM (SELECT seconds FROM requests ORDER BY ts DESC, request_id DESC LIMIT 100)),
 c AS (SELECT count(*) AS jobs, CAST(sum(processed_emails) AS BIGINT) AS batch_processed FROM jobs WHERE completed_at IS NOT NULL),
 e AS (SELECT count(*) AS recent_operations FROM perf WHERE ts > {AS} - INTERVAL 1 HOUR AND ts <= {AS}) SELECT * FROM a, b, c, e""")
def stats_summary(spark, sf):
    req, done, p = d.requests(spark, sf), d.jobs(spark, sf).filter("completed_at IS NOT NULL"), d.perf(spark, sf)
    one = req.agg(F.count(F.lit(1)).alias("total_processed"))
    return one.withColumns({
        "avg_response_time": F.round(G.last_n_average(req).select("avg_response_time").scalar(), 6),
        "jobs": done.agg(F.count(F.lit(1))).scalar(), "batch_processed": done.agg(F.sum("processed_emails")).scalar(),
        "recent_operations": G.recent_performance(p, d.as_of()).select("operations_count").scalar()})


# ---- rate limit --------------------------------------------------------------------------------
@query("rate_limit_offered", f"""WITH {d.REQUESTS} SELECT request_id, client, count(*) OVER (PARTITION BY client ORDER BY epoch_us(ts)
  RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS load FROM requests""")
def rate_limit_offered(spark, sf):
    return G.offered_load(d.requests(spark, sf), window_minutes=1440).select("request_id", "client", "load")


# The accepted requests of a client, one recursion step per request in time order. The state
# is the list of accepted times.
@query("rate_limit_exact", f"""WITH RECURSIVE {d.REQUESTS},
 num AS (SELECT client, request_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY client ORDER BY ts, request_id) AS r FROM requests),
 walk(client, r, request_id, accepted, taken) AS (
   SELECT client, r, request_id, true, [t] FROM num WHERE r = 1
   UNION ALL
   SELECT n.client, n.r, n.request_id, len(list_filter(w.taken, lambda x: x > n.t - 86400000000)) < 2,
     CASE WHEN len(list_filter(w.taken, lambda x: x > n.t - 86400000000)) < 2
       THEN list_append(list_filter(w.taken, lambda x: x > n.t - 86400000000), n.t)
       ELSE list_filter(w.taken, lambda x: x > n.t - 86400000000) END
   FROM walk w JOIN num n ON n.client = w.client AND n.r = w.r + 1)
SELECT request_id, client, accepted FROM walk""")
def rate_limit_exact(spark, sf):
    return G.rate_limit(d.requests(spark, sf), limit=2, window_minutes=1440).select("request_id", "client", "accepted")
