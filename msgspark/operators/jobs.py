"""Batch-job tables: abort gate, progress, statistics, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .evaluate import _ratio

STATUSES = ("processing", "completed", "failed", "pending")
GATE_ROWS = 50
GATE_ERRORS = 10


def seconds_between(later: Column, earlier: Column) -> Column:
    """Elapsed seconds with fractions."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / 1e6


def abort_index(results: DataFrame, *, job: str = "job_id", index: str = "email_index", status: str = "status") -> DataFrame:
    """(job, abort_index): the row among the first 50 at which the errors exceed ten.

    Only rows numbered 1..50 enter the window, at most 50 per job.
    """
    head = results.filter(F.col(index) <= GATE_ROWS).select(job, index, (F.col(status) == "error").cast("int").alias("e"))
    running = F.sum("e").over(Window.partitionBy(job).orderBy(index).rowsBetween(Window.unboundedPreceding, 0))
    over = head.withColumn("_errors", running).filter((F.col("_errors") > GATE_ERRORS) & (F.col("e") == 1))
    return over.groupBy(job).agg(F.min(index).alias("abort_index"))


def gate_results(results: DataFrame, *, job: str = "job_id", index: str = "email_index", status: str = "status") -> DataFrame:
    """Rows a job keeps (up to its abort row), with ``partial`` and ``job_status``."""
    stops = abort_index(results, job=job, index=index, status=status)
    kept = results.join(stops, job, "left").filter(F.col("abort_index").isNull() | (F.col(index) <= F.col("abort_index")))
    stopped = F.col("abort_index").isNotNull()
    return kept.withColumn("partial", stopped).withColumn(
        "job_status", F.when(stopped, "failed").otherwise("completed")).drop("abort_index")


def progress(results: DataFrame, *, job: str = "job_id", status: str = "status") -> DataFrame:
    """Processed rows, errors and success rate per job."""
    return results.groupBy(job).agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(F.col(status) == "error").alias("error_count"),
    ).withColumn("success_rate", _ratio((F.col("processed") - F.col("error_count")) * 100.0, F.col("processed")))


def last_errors(results: DataFrame, n: int = 10, *, job: str = "job_id", index: str = "email_index",
                status: str = "status", message: str = "error_message") -> DataFrame:
    """The ``n`` latest error rows of every job (limited per task before the exchange)."""
    w = Window.partitionBy(job).orderBy(F.desc(index))
    return (
        results.filter(F.col(status) == "error").select(job, index, message)
        .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
        .withColumn(message, F.concat(F.lit("Email "), F.col(index).cast("string"), F.lit(": "), F.col(message)))
    )


def job_summary(jobs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Progress, duration and result availability; ``files`` is an optional (path) listing."""
    out = jobs.withColumns({
        "progress_percentage": _ratio(F.col("processed_emails") * 100.0, F.col("total_emails")),
        "processing_time_seconds": seconds_between(F.col("completed_at"), F.col("created_at")),
    })
    if files is None:
        return out.withColumn("result_file_available", F.col("result_file_path").isNotNull())
    have = files.select(F.col("path").alias("result_file_path")).distinct().withColumn("_f", F.lit(True))
    return out.join(have, "result_file_path", "left").withColumn(
        "result_file_available", F.coalesce("_f", F.lit(False))).drop("_f")


def daily_job_stats(jobs: DataFrame) -> DataFrame:
    """Finished jobs per completion day."""
    done = jobs.filter(F.col("status").isin("completed", "failed") & F.col("completed_at").isNotNull())
    secs = seconds_between(F.col("completed_at"), F.col("created_at"))
    out = done.groupBy(F.to_date("completed_at").alias("day")).agg(
        F.count(F.lit(1)).alias("jobs_today"), F.sum("processed_emails").alias("processed_today"),
        F.sum(secs).alias("total_processing_time"),
        F.count_if(F.col("status") == "completed").alias("successful_jobs"),
        F.count_if(F.col("status") == "failed").alias("failed_jobs"))
    return out.withColumns({
        "avg_emails_per_job": _ratio(F.col("processed_today"), F.col("jobs_today")),
        "avg_processing_time": _ratio(F.col("total_processing_time"), F.col("jobs_today")),
        "success_rate": _ratio(F.col("successful_jobs") * 100.0, F.col("jobs_today")),
    })


def status_counts(jobs: DataFrame) -> DataFrame:
    """Jobs per known status, zero rows included; unknown statuses count as pending."""
    known = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("pending")
    counts = jobs.agg(*[F.count_if(known == s).alias(s) for s in STATUSES])
    pairs = F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("n_jobs")) for s in STATUSES])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def expired_jobs(jobs: DataFrame, as_of: Column, *, hours: float = 24, failed_hours: float = 1) -> DataFrame:
    """Jobs to drop and why: finished too long ago, or failed (shorter limit)."""
    age = lambda c: seconds_between(as_of, c) / 3600
    terminal = F.col("status").isin("completed", "failed") & F.col("completed_at").isNotNull()
    old = terminal & (age(F.col("completed_at")) > hours)
    failed = (F.col("status") == "failed") & (age(F.coalesce("completed_at", "created_at")) > failed_hours)
    reason = F.when(old, "expired").when(failed, "failed")
    return jobs.select("job_id", "status", "result_file_path", reason.alias("reason")).filter("reason IS NOT NULL")


def missing_files(jobs: DataFrame, files: DataFrame, as_of: Column, *, hours: float = 1) -> DataFrame:
    """Jobs whose result file is gone: path cleared, and dropped once finished ``hours`` ago."""
    gone = jobs.filter("result_file_path IS NOT NULL").join(
        files.select(F.col("path").alias("result_file_path")), "result_file_path", "left_anti")
    drop = F.coalesce(seconds_between(as_of, F.col("completed_at")) / 3600 > hours, F.lit(False))
    return gone.select("job_id", drop.alias("drop_job"))


def orphan_files(files: DataFrame, jobs: DataFrame, as_of: Column, *, hours: float = 24) -> DataFrame:
    """Result files (path, modified) no job refers to, older than ``hours``."""
    named = F.element_at(F.split("path", "/"), -1).rlike(r"^(batch_results_|partial_results_).*\.csv$")
    old = seconds_between(as_of, F.col("modified")) > hours * 3600
    used = jobs.filter("result_file_path IS NOT NULL").select(F.col("result_file_path").alias("path"))
    return files.filter(named & old).join(used, "path", "left_anti")
