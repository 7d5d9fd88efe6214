"""The batch flow: files in, gated result files and a job row per file out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed_values as fv
from ..operators import bayes, jobs as J, scoring as S
from ..operators.rows import clean_messages
from ..session import cut_lineage
from ..sources import csv_files, sinks


def score_files(spark: SparkSession, paths: str | list[str], terms: DataFrame, priors: DataFrame, *,
                as_of: Column | None = None, results_path: str | None = None, on_long: str = "keep",
                gate: bool = False, min_confidence: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(results, jobs) of scoring CSV files; each file is one job.

    Whole messages are scored; ``on_long="truncate"`` cuts them at the loader's limit instead. With ``gate`` a job
    that fails the abort gate keeps the rows up to it, marked ``partial``; ``gated_emails`` counts the rows it lost. A file whose
    layout is not recognised is a failed job with its reason.
    """
    profile = cut_lineage(csv_files.profile_files(spark, paths))
    read = csv_files.read_messages(spark, paths, min_confidence=min_confidence, profile=profile)
    numbered = csv_files.number_messages(clean_messages(read, on_long=on_long))
    rows = cut_lineage(numbered.withColumn("message_id", F.concat_ws("#", "path", F.col("email_index").cast("string"))))
    checked = rows.withColumn("error_message", S.scoring_error("text", fv.MAX_MESSAGE if on_long != "keep" else None))
    good = checked.filter("error_message IS NULL").select("message_id", "text")
    scored = bayes.score(good, terms, priors, row_id="message_id")
    res = S.result_rows(checked, scored, index="message_id", as_of=as_of)
    res = res.withColumnRenamed("email_index", "message_id").join(
        rows.select("message_id", F.col("path").alias("job_id"), "email_index"), "message_id").drop("message_id")
    kept = J.gate_results(res) if gate else res.withColumns({"partial": F.lit(False), "job_status": F.lit("completed")})
    if results_path:
        sinks.write_results(kept, results_path)
    stamp = F.lit(None).cast("timestamp") if as_of is None else as_of
    total = rows.groupBy(F.col("path").alias("job_id")).agg(F.count(F.lit(1)).alias("total_emails"))
    done = kept.groupBy("job_id").agg(
        F.max("job_status").alias("status"), F.count(F.lit(1)).alias("processed_emails"),
        F.count_if(F.col("status") == "error").alias("error_count"))
    done = total.join(done, "job_id", "left").withColumns({
        "gated_emails": F.col("total_emails") - F.coalesce("processed_emails", F.lit(0)),
        "failure": F.lit(None).cast("string")})
    failed = csv_files.rejected_files(spark, paths, min_confidence=min_confidence, profile=profile).select(
        F.col("path").alias("job_id"), F.lit("failed").alias("status"), F.col("reason").alias("failure"))
    jobs = done.unionByName(failed, allowMissingColumns=True).withColumns(
        {"completed_at": stamp, "result_file_path": F.lit(results_path)})
    return kept, jobs
