"""Registered queries over CSV files of four layouts, made from all documents.

One file for each language and bucket: English has a blank-named column, German no header, an all-empty third column and a first row
of its own, French a repeated name, Spanish (and any other language) rows too wide and too short. Texts are quoted and
keep their line ends, so most records span lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import parse_or_default
from ..operators import balance as B, bayes, validate
from ..sources import csv_files
from . import oracle_text as o
from .batch_scoring import score_files
from .csv_queries import scratch
from .registry import query, table
from .text_queries import NB_SCORE, labelled
from .vector_queries import rare

BUCKETS = 4
FILE_TASKS = 256  # many more than files, so that one task seldom sorts the rows of two
FILLER = "An opening line of this list that is clearly longer than fifty characters"
HEADERS = {"en": "id,message, ,is_spam", "fr": "text,text,label", "": "label,text"}


def _layout(lang):
    return F.when(lang.isin("en", "de", "fr"), lang).otherwise("")


def message_files(spark, sf) -> str:
    """The documents as one CSV file a language and bucket; returns their folder."""
    path = scratch(spark, "files")
    t = table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("file_lang"), (F.col("doc_id") % BUCKETS).alias("bucket"), _layout(F.col("lang")).alias("k"),
        F.concat(F.lit('"'), F.regexp_replace("text", '"', '""'), F.lit('"')).alias("q"),
        F.when(F.col("doc_id") % 3 == 0, "spam").otherwise("ham").alias("y"))
    row = (F.when(F.col("k") == "en", F.concat_ws(",", F.col("doc_id").cast("string"), "q", F.lit("x"), "y"))
           .when(F.col("k") == "de", F.concat_ws(",", "q", (F.col("doc_id") % 3 == 0).cast("int").cast("string"), F.lit("")))
           .when(F.col("k") == "fr", F.concat_ws(",", "q", F.lit("copy"), "y"))
           .when(F.col("doc_id") % 13 == 0, F.col("y"))
           .when(F.col("doc_id") % 17 == 0, F.concat_ws(",", "y", "q", F.lit("wide")))
           .otherwise(F.concat_ws(",", "y", "q")))
    rows = t.select("file_lang", "bucket", F.col("doc_id").alias("i"), row.alias("value"))
    first = F.when(F.col("k") == "de", F.lit(f"{FILLER},0,"))
    for k, header in HEADERS.items():
        first = F.when(F.col("k") == k, F.lit(header)).otherwise(first)
    tops = t.select("file_lang", "bucket", "k").distinct().select("file_lang", "bucket", F.lit(-1).cast("long").alias("i"), first.alias("value"))
    keys = ["file_lang", "bucket"]
    rows.unionByName(tops).repartition(FILE_TASKS, *keys).sortWithinPartitions(*keys, "i").drop("i").write.partitionBy(*keys).text(path)
    return path


def _keyed(df: DataFrame) -> DataFrame:
    at = lambda k: F.regexp_extract("path", f"{k}=([^/]*)", 1)
    return df.withColumns({"lang": at("file_lang"), "bucket": at("bucket").cast("int")})


#: Rows of the files as they were written: k layout, text as in the file, and whether the row is too wide or short.
WRITTEN = f"""msrc AS (SELECT doc_id, lang, (doc_id % {BUCKETS})::INT AS bucket, coalesce(text, '') AS text,
   CASE WHEN lang IN ('en', 'de', 'fr') THEN lang ELSE '' END AS k,
   CASE WHEN lang = 'de' THEN CASE WHEN doc_id % 3 = 0 THEN '1' ELSE '0' END WHEN doc_id % 3 = 0 THEN 'spam' ELSE 'ham' END AS label FROM documents),
 wr AS (SELECT *, k = '' AND doc_id % 13 = 0 AS short, k = '' AND doc_id % 13 <> 0 AND doc_id % 17 = 0 AS wide FROM msrc
   UNION ALL SELECT DISTINCT -1, 'de', bucket, '{FILLER}', 'de', '0', false, false FROM msrc WHERE k = 'de'),
 files AS (SELECT lang, bucket, any_value(k) AS k, bool_or(wide) AS by_hand FROM wr GROUP BY lang, bucket)"""
READ = f"""{WRITTEN}, took AS (SELECT w.lang, w.bucket, doc_id, label, by_hand, CASE WHEN by_hand AND short THEN 'Not enough columns, skipping' END AS problem,
   CASE WHEN short THEN NULL WHEN by_hand THEN nullif({o.strip('text')}, '') ELSE nullif(text, '') END AS s
   FROM wr w JOIN files f ON w.lang = f.lang AND w.bucket = f.bucket),
 loaded AS (SELECT lang, bucket, row_number() OVER (PARTITION BY lang, bucket ORDER BY doc_id) AS row_no, s AS text, label, problem FROM took
   WHERE s IS NOT NULL OR problem IS NOT NULL)"""


@query("load_flexible", f"WITH {READ} SELECT * FROM loaded")
def load_flexible(spark, sf):
    rows, _ = csv_files.read_flexible(spark, message_files(spark, sf))
    numbered = csv_files.number_messages(rows).withColumnRenamed("email_index", "row_no")
    return _keyed(numbered).select("lang", "bucket", "row_no", "text", "label", "problem")


@query("load_report", f"""WITH {READ}, n AS (SELECT lang, bucket, count(text) AS n_rows, count(problem) AS n_short FROM loaded GROUP BY lang, bucket)
SELECT f.lang, f.bucket, CASE k WHEN 'en' THEN 'id|message|is_spam' WHEN 'de' THEN '0|1' WHEN 'fr' THEN 'text|text_1|label' ELSE 'label|text' END AS columns,
  CASE WHEN k IN ('en', 'de') THEN 1 ELSE 0 END AS n_removed, CASE WHEN k = 'fr' THEN 1 ELSE 0 END AS n_renamed,
  coalesce(n_rows, 0) AS n_rows, coalesce(n_short, 0) AS n_short, CASE WHEN by_hand THEN 'manual' ELSE 'plain' END AS mode,
  CASE WHEN coalesce(n_rows, 0) = 0 THEN 'No valid email content found in CSV file' END AS error
FROM files f LEFT JOIN n ON f.lang = n.lang AND f.bucket = n.bucket""")
def load_report(spark, sf):
    _, report = csv_files.read_flexible(spark, message_files(spark, sf))
    return _keyed(report).select("lang", "bucket", F.array_join("columns", "|").alias("columns"), "n_removed", "n_renamed", "n_rows", "n_short",
                                 "mode", "error")


HEADS = f"""{WRITTEN}, rws AS (SELECT *, row_number() OVER (PARTITION BY lang, bucket ORDER BY doc_id) AS row_no,
   NOT short AS used, CASE k WHEN 'en' THEN doc_id || '|' || text || '|x|' || label WHEN 'de' THEN text || '|' || label || '|' WHEN 'fr' THEN text || '|copy|' || label
     ELSE label || CASE WHEN short THEN '' WHEN wide THEN '|' || text || '|wide' ELSE '|' || text END END AS line FROM wr),
 prof AS (SELECT lang, bucket, any_value(k) AS k, count(*) AS n, count(*) FILTER (row_no <= 10 AND wide) AS n_wide,
   string_agg(line, chr(10) ORDER BY row_no) FILTER (row_no <= 5) AS sample,
   count(*) FILTER (row_no <= 10 AND used AND length({o.strip('text')}) < 5 AND (k <> 'de' OR length({o.strip('text')}) >= 0)) AS n_short,
   count(*) FILTER (row_no <= 10 AND used AND length({o.strip('text')}) > 5000) AS n_long FROM rws GROUP BY lang, bucket)"""


@query("file_profile_details", f"""WITH {HEADS} SELECT lang, bucket, CASE k WHEN 'en' THEN 'message' WHEN 'de' THEN '0' ELSE 'text' END AS email_column,
  CASE k WHEN 'en' THEN 'is_spam' WHEN 'de' THEN '1' ELSE 'label' END AS label_column, CASE k WHEN 'en' THEN 4 WHEN '' THEN 2 ELSE 3 END AS column_count,
  k <> 'de' AS has_header, 'utf-8' AS detected_encoding, 'training_data' AS format_type, (CASE WHEN k = 'de' THEN 0.9 ELSE 1.0 END)::DOUBLE AS confidence_score,
  CASE k WHEN 'en' THEN 1 WHEN '' THEN 1 ELSE 0 END AS text_pos, CASE k WHEN 'en' THEN 3 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 0 END AS label_pos,
  CASE k WHEN 'en' THEN 'id|message| |is_spam' WHEN 'de' THEN '{FILLER}|0|' WHEN 'fr' THEN 'text|text|label' ELSE 'label|text' END AS columns,
  sample, false AS is_valid, 'File must have .csv extension' || CASE WHEN n_wide > 0 THEN ' | Inconsistent column count in ' || n_wide || ' rows' ELSE '' END AS errors,
  n_short, n_long, k = 'fr' AS warns_duplicates, k = 'en' AS warns_unnamed, n < 5 AS warns_few, 'Format detected as training data (email content + labels)' AS suggestion,
  'accept' AS batch_use, true AS has_size FROM prof""")
def file_profile_details(spark, sf):
    p = _keyed(csv_files.profile_files(spark, message_files(spark, sf)))
    has = lambda s: F.size(F.filter("warnings", lambda w: w.contains(s)))
    sample = F.array_join(F.transform("sample_rows", lambda r: F.array_join(r, "|")), "\n")
    return p.select(
        "lang", "bucket", "email_column", "label_column", "column_count", "has_header", "detected_encoding", "format_type", "confidence_score",
        "text_pos", "label_pos", F.array_join("columns", "|").alias("columns"), sample.alias("sample"), "is_valid",
        F.array_join("errors", " | ").alias("errors"), has("very short").alias("n_short"), has("very long").alias("n_long"),
        (has("Duplicate column names") > 0).alias("warns_duplicates"), (has("Empty column names found") > 0).alias("warns_unnamed"),
        (has("Very few data rows") > 0).alias("warns_few"), "suggestion", "batch_use",
        ((F.col("length") > 0) & F.col("modified").isNotNull() & F.col("head_error").isNull()).alias("has_size"))


@query("upload_heads", f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 NOT IN (1, 2, 3) AND NOT blank THEN NULL WHEN doc_id % 5 = 2 THEN 'empty'
  WHEN doc_id % 5 = 3 THEN 'empty' ELSE 'row' END AS problem FROM (
  SELECT doc_id, length({o.strip("replace(string_split(text, chr(10))[1], ',', ' ')")}) = 0 AS blank FROM documents)""")
def upload_heads(spark, sf):
    # every document is an upload; some begin with a blank row, some hold nothing
    k = F.col("doc_id") % 5
    content = F.when(k == 1, F.concat(F.lit(" ,, \n"), "text")).when(k == 2, " \n\t").when(k == 3, "").otherwise(F.col("text"))
    name = F.when(F.col("doc_id") % 3 == 0, "notes.txt").otherwise("Mails.CSV")
    t = table(spark, sf, "documents").select("doc_id", content.alias("content"), name.alias("name"))
    t = t.select("doc_id", validate.file_head_error("name", F.substring("content", 1, 1024), F.split(F.get(F.split("content", "\n"), F.lit(0)), ",")).alias("e"))
    return t.select("doc_id", F.when(F.col("e").contains("to be empty"), "empty").when(F.col("e").isNotNull(), "row").alias("problem"))


HEAD_LIMIT = 20_000


@query("rejected_files", f"""WITH {HEADS}, sizes AS (SELECT lang, bucket, any_value(k) AS k, sum(strlen(line) + 3 + length(text) - length(replace(text, '"', ''))) AS n
  FROM rws WHERE row_no <= 10 GROUP BY lang, bucket)
SELECT lang, bucket, CASE WHEN n > {HEAD_LIMIT} THEN 'The first 11 records do not end within {HEAD_LIMIT} bytes' ELSE 'Could not determine CSV format (confidence 0.90)' END AS reason
FROM sizes WHERE n > {HEAD_LIMIT} OR k = 'de'""")
def rejected_files(spark, sf):
    path = message_files(spark, sf)
    profile = csv_files.profile_files(spark, path, head_bytes=HEAD_LIMIT)
    return _keyed(csv_files.rejected_files(spark, path, min_confidence=0.95, profile=profile)).select("lang", "bucket", "reason")


SCORED = f"""{NB_SCORE}, {WRITTEN}, sent AS (SELECT lang, bucket, doc_id, row_number() OVER (PARTITION BY lang, bucket ORDER BY doc_id) AS email_index
   FROM wr WHERE NOT short AND k <> 'de' AND length({o.strip('text')}) >= 10)"""


@query("score_files", f"""{SCORED} SELECT lang, bucket, email_index, CASE prediction WHEN 1 THEN 'Spam' ELSE 'Legitimate' END AS prediction, 'success' AS status,
  false AS partial FROM sent JOIN scored ON row_id = doc_id""")
def score_message_files(spark, sf):
    terms, priors = bayes.fit(labelled(spark, sf))
    results, _ = score_files(spark, message_files(spark, sf), terms, priors, min_confidence=0.95)
    return _keyed(results.withColumnRenamed("job_id", "path")).select("lang", "bucket", "email_index", "prediction", "status", "partial")


@query("score_files_jobs", f"""WITH {WRITTEN}, n AS (SELECT lang, bucket, any_value(k) AS k, count(*) FILTER (NOT short AND length({o.strip('text')}) >= 10) AS n FROM wr GROUP BY lang, bucket)
SELECT lang, bucket, CASE WHEN k = 'de' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN k <> 'de' THEN n END AS total_emails,
  CASE WHEN k <> 'de' THEN n END AS processed_emails, CASE WHEN k <> 'de' THEN 0 END AS error_count, CASE WHEN k <> 'de' THEN 0 END AS gated_emails,
  CASE WHEN k = 'de' THEN 'Could not determine CSV format (confidence 0.90)' END AS failure FROM n WHERE k = 'de' OR n > 0""")
def score_files_jobs(spark, sf):
    terms, priors = bayes.fit(labelled(spark, sf))
    _, jobs = score_files(spark, message_files(spark, sf), terms, priors, min_confidence=0.95)
    return _keyed(jobs.withColumnRenamed("job_id", "path")).select(
        "lang", "bucket", "status", "total_emails", "processed_emails", "error_count", "gated_emails", "failure")


@query("load_v1v2", "SELECT label, count(*) AS n_rows, sum(length(text))::BIGINT AS n_chars FROM (SELECT regexp_replace(text, '[^\\x{00}-\\x{ff}]', '?', 'g') AS text, CASE WHEN doc_id % 3 = 0 THEN 'spam' ELSE 'ham' END AS label FROM documents) WHERE length(text) > 0 GROUP BY label")
def load_v1v2(spark, sf):
    # training files in ISO-8859-1 with upper-case labels and three unnamed columns; the first path that exists is taken
    path = scratch(spark, "v1v2")
    t = table(spark, sf, "documents").select(
        F.upper(F.when(F.col("doc_id") % 3 == 0, "spam").otherwise("ham")).alias("v1"),
        F.regexp_replace("text", r"[^\x00-\xff]", "?").alias("v2"), *[F.lit(None).cast("string").alias(f"_c{i}") for i in (2, 3, 4)])
    t.write.option("header", True).option("encoding", "ISO-8859-1").option("escape", '"').csv(path)
    found = csv_files.first_existing(spark, [f"{path}-missing", path])
    return csv_files.read_v1v2(spark, found).groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text")).alias("n_chars"))


@query("parsed_settings", "SELECT event_id, coalesce(try_cast(v AS BIGINT), 48) AS hours, coalesce(try_cast(v AS DOUBLE), 0.5) AS ratio FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN event_id::VARCHAR END AS v FROM events)")
def parsed_settings(spark, sf):
    v = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 3 == 1, F.col("event_id").cast("string"))
    return table(spark, sf, "events").withColumn("v", v).select(
        "event_id", parse_or_default("v", "bigint", 48).alias("hours"), parse_or_default("v", "double", 0.5).alias("ratio"))


@query("balance_methods", """SELECT m AS method, label, made AS is_synthetic, n FROM (
  SELECT *, unnest(['class_weights', 'smote', 'both']) AS m FROM (SELECT count(*) FILTER (label <> 0) AS ma, count(*) FILTER (label = 0) AS mi FROM embeddings)) c,
  LATERAL (SELECT greatest(0.48::DOUBLE, mi::DOUBLE / (ma + mi) + 0.02::DOUBLE) AS eff) e,
  LATERAL (SELECT CAST(floor(greatest(floor(eff * ma / (1.0::DOUBLE - eff)), mi) * 1.1::DOUBLE) AS BIGINT) - mi AS extra) t,
  LATERAL (SELECT * FROM (VALUES (0, false, ma), (1, false, mi), (1, true, extra)) v(label, made, n)) r
WHERE NOT (made AND m = 'class_weights')""")
def balance_methods(spark, sf):
    # label 0 of the vectors is the rare class
    data = rare(spark, sf)
    parts = [B.balance(data, method=m).groupBy("label", "is_synthetic").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(m).alias("method"), "label", "is_synthetic", "n") for m in ("class_weights", "smote", "both")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
