"""Registered queries: header scoring, format detection, structure checks, CSV round trips.

Every document plays one file: its header is built from its id, language and source (or is
its own first line, for German texts, which have no header), its lines are the data rows.
"""

from __future__ import annotations



from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv
from ..operators import scoring, validate
from ..operators.rows import clean_messages
from ..session import ensure_checkpoint_dir
from ..sources import csv_files, headers as H, sinks
from . import derived as d, oracle_text as o
from .registry import query, table
from .text_queries import labelled, messages

FIRST = ("id", "row_num", "text", " Message ", "label", "email_index", "count")
SECOND = ("msg", "body", "is_spam", "category", "subject", "data", "notes", "v2", "")


def _pick(names, key):
    return F.get(F.array(*[F.lit(n) for n in names]), (F.col(key) % len(names)).cast("int"))


def heads(spark, sf) -> DataFrame:
    """(file_id, first_record, second_record, data_rows) per document."""
    t = table(spark, sf, "documents", spread_by="doc_id").withColumn("lines", F.split("text", "\n"))
    rows = F.transform(F.slice("lines", 1, 10), lambda s: F.split(s, ","))
    named = F.array(_pick(FIRST, "doc_id"), _pick(SECOND, "doc_id"), F.col("lang"), F.col("source"))
    bare = F.col("lang") == "de"
    return t.select(
        F.col("doc_id").alias("file_id"), F.when(bare, F.get(rows, F.lit(0))).otherwise(named).alias("first_record"),
        F.when(bare, F.get(rows, F.lit(1))).otherwise(F.get(rows, F.lit(0))).alias("second_record"),
        rows.alias("data_rows"))


def _list(names):
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


HEADS = f"""heads AS (SELECT doc_id AS file_id, lines, CASE WHEN lang = 'de' THEN string_split(lines[1], ',')
    ELSE [{_list(FIRST)}[doc_id % {len(FIRST)} + 1], {_list(SECOND)}[doc_id % {len(SECOND)} + 1], lang, source] END AS header,
    CASE WHEN lang = 'de' THEN string_split(lines[2], ',') ELSE string_split(lines[1], ',') END AS second
  FROM (SELECT *, string_split(text, chr(10)) AS lines FROM documents))"""


def _any(key, words):
    return "(" + " OR ".join(f"contains({key}, '{w}')" for w in words) + ")"


def _score(key, known, groups):
    s = f"CASE WHEN {key} IN ({', '.join(repr(n) for n in known)}) THEN 10 ELSE 0 END"
    for pts, words in groups:
        s += f" + CASE WHEN {_any(key, words)} THEN {pts} ELSE 0 END"
    return s


KEY = o.strip("lower(name)")
COLS = f"""{HEADS}, cols AS (SELECT file_id, name, pos, {KEY} AS k FROM (
   SELECT file_id, unnest(header) AS name, generate_subscripts(header, 1) AS pos FROM heads)),
 sc AS (SELECT *, {_score('k', fv.TEXT_NAMES, fv.TEXT_KEYWORDS)} AS ts, {_score('k', fv.LABEL_NAMES, fv.LABEL_KEYWORDS)} AS ls,
   CASE WHEN k IN ({', '.join(repr(n) for n in fv.TEXT_NAMES + fv.LABEL_NAMES)}) THEN 2 WHEN {_any('k', fv.HEADER_HINTS)} THEN 1 ELSE 0 END AS hs,
   CASE WHEN length({o.strip('name')}) > 50 THEN 1 ELSE 0 END AS lng, {_any('k', fv.ID_HINTS)} AS idlike FROM cols),
 pick AS (SELECT file_id, count(*) AS n, sum(hs) > sum(lng) AS has_header,
   coalesce(CASE WHEN max(ts) > 0 THEN arg_min(name, (-ts, pos)) END,
            CASE WHEN count(*) = 1 THEN min(name) END, arg_min(name, pos) FILTER (NOT idlike), arg_min(name, pos)) AS tcol,
   CASE WHEN max(ls) > 0 THEN arg_min(name, (-ls, pos)) END AS lcol FROM sc GROUP BY file_id)"""


@query("csv_text_col_score", f"WITH {COLS} SELECT file_id, pos, name, ts AS text_score, ls AS label_score FROM sc")
def csv_text_col_score(spark, sf):
    h = heads(spark, sf).select("file_id", F.posexplode("first_record").alias("p", "name"))
    return h.select("file_id", (F.col("p") + 1).cast("bigint").alias("pos"), "name", H.text_score(F.col("name")).alias("text_score"),
                    H.label_score(F.col("name")).alias("label_score"))


@query("csv_column_choice", f"WITH {COLS} SELECT file_id, tcol AS text_column, lcol AS label_column FROM pick")
def csv_column_choice(spark, sf):
    return heads(spark, sf).select("file_id", H.text_column(F.col("first_record")).alias("text_column"),
                                   H.label_column(F.col("first_record")).alias("label_column"))


@query("csv_is_header", f"WITH {COLS} SELECT file_id, has_header FROM pick")
def csv_is_header(spark, sf):
    return heads(spark, sf).select("file_id", H.is_header_row(F.col("first_record")).alias("has_header"))


PROFILE = f"""{COLS}, prof AS (SELECT p.file_id, has_header, CASE WHEN has_header THEN tcol ELSE '0' END AS email_column,
   CASE WHEN has_header THEN lcol WHEN n >= 2 THEN '1' END AS label_column, n AS column_count,
   CASE WHEN second IS NULL THEN '' WHEN has_header THEN second[1] ELSE header[1] END AS sample
   FROM pick p JOIN heads h USING (file_id)),
 fmt AS (SELECT *, CASE WHEN label_column IS NULL THEN 'batch_only' ELSE 'training_data' END AS format_type,
   round(least(1.0, CASE WHEN label_column IS NULL THEN 0.6 ELSE 0.7 END
     + CASE WHEN has_header AND lower(email_column) IN ({', '.join(repr(n) for n in fv.TEXT_NAMES)}) THEN 0.3 ELSE 0 END
     + CASE WHEN length({o.strip('sample')}) > 20 THEN 0.2 ELSE 0 END), 2)::DOUBLE AS confidence_score FROM prof)"""


def profiled(spark, sf) -> DataFrame:
    return H.add_profile(heads(spark, sf)).withColumn("detected_encoding", F.lit("utf-8"))


@query("csv_confidence", f"WITH {PROFILE} SELECT file_id, has_header, email_column, label_column, column_count, format_type, confidence_score FROM fmt")
def csv_confidence(spark, sf):
    return profiled(spark, sf).select("file_id", "has_header", "email_column", "label_column",
                                      F.col("column_count").cast("bigint").alias("column_count"), "format_type", "confidence_score")


@query("csv_suggestions", f"""WITH {PROFILE} SELECT file_id, concat_ws(' | ',
  CASE WHEN confidence_score < 0.7 THEN 'Consider using standard column names for better detection' END,
  CASE WHEN confidence_score < 0.7 THEN 'Recommended: ''email_content'' for text, ''label'' for classification' END,
  CASE format_type WHEN 'batch_only' THEN 'Format detected as batch processing (email content only)'
    ELSE 'Format detected as training data (email content + labels)' END) AS suggestion,
  CASE WHEN confidence_score < 0.5 THEN 'warn' ELSE 'accept' END AS batch_use,
  CASE WHEN confidence_score < 0.7 THEN 1 ELSE 0 END AS moderate FROM fmt""")
def csv_suggestions(spark, sf):
    _, warn = H.format_messages()
    return profiled(spark, sf).select("file_id", H.suggestions().alias("suggestion"), H.batch_suitability().alias("batch_use"),
                                      F.when(F.size(warn) > 0, 1).otherwise(0).alias("moderate"))


def _nonblank(x):
    return f"length({o.strip(x)}) > 0"


STRUCT = f"""{PROFILE}, rws AS (SELECT h.file_id, header, i, string_split(lines[i], ',') AS cells
    FROM heads h, (SELECT unnest(range(1, 11)) AS i) WHERE i <= len(lines)),
 r AS (SELECT rws.*, has_header, column_count, email_column, list_position(header, email_column) AS tpos,
   len(list_filter(cells, lambda c: {_nonblank('c')})) AS filled,
   CASE WHEN has_header THEN len(list_filter(header, lambda c: {_nonblank('c')})) ELSE 1 END AS expected FROM rws JOIN fmt USING (file_id)),
 r2 AS (SELECT *, filled > 0 AND len(cells) <> column_count AND len(list_filter(cells[expected + 1:], lambda c: {_nonblank('c')})) > 0 AS ragged,
   length({o.strip('cells[CASE WHEN has_header THEN tpos ELSE 1 END]')}) AS tlen, len(cells) >= CASE WHEN has_header THEN tpos ELSE 1 END AS reach FROM r)"""


@query("csv_structure", f"""WITH {STRUCT} SELECT file_id, CASE WHEN count(*) FILTER (ragged) > 0 THEN 'Inconsistent column count in ' || count(*) FILTER (ragged) || ' rows' ELSE '' END AS errors,
  count(*) FILTER (filled > 0 AND reach AND tlen < 5) AS n_short, count(*) FILTER (filled > 0 AND reach AND tlen > 5000) AS n_long,
  count(*) FILTER (filled = 0) > 0.5 * count(*) AS mostly_empty, count(*) < 5 AS few_rows FROM r2 GROUP BY file_id""")
def csv_structure(spark, sf):
    p = profiled(spark, sf)
    e, w = H.structure(F.col("first_record"), F.col("data_rows"), F.col("column_count"), F.col("text_pos"), F.col("has_header"))
    out = p.select("file_id", F.array_join(e, " | ").alias("errors"), w.alias("w"))
    has = lambda s: F.size(F.filter("w", lambda x: x.contains(s)))
    return out.select("file_id", "errors", has("very short").cast("bigint").alias("n_short"), has("very long").cast("bigint").alias("n_long"),
                      (has("High number of empty") > 0).alias("mostly_empty"), (has("Very few data rows") > 0).alias("few_rows"))


@query("csv_strict_check", f"""WITH {HEADS} SELECT file_id, list_contains(header, 'text') AS has_text, list_contains(header, 'label') AS has_label,
  len(list_filter(lines[1:5], lambda s: len(string_split(s, ',')) <> len(header))) AS n_width_warnings FROM heads""")
def csv_strict_check(spark, sf):
    h = heads(spark, sf)
    e, w = H.strict_messages(F.col("first_record"), F.col("data_rows"), F.size("data_rows"))
    miss = lambda c: ~F.exists("e", lambda m: m.contains(f"'{c}'"))
    return h.select("file_id", e.alias("e"), F.size(w).cast("bigint").alias("n_width_warnings")).select(
        "file_id", miss("text").alias("has_text"), miss("label").alias("has_label"), "n_width_warnings")


@query("csv_unique_names", f"""WITH {HEADS} SELECT file_id, array_to_string(list_transform(h, lambda x, i: CASE WHEN len(list_filter(h[:i - 1], lambda y: y = x)) > 0
  THEN x || '_' || len(list_filter(h[:i - 1], lambda y: y = x)) ELSE x END), '|') AS names FROM (SELECT file_id, list_concat(header, header) AS h FROM heads)""")
def csv_unique_names(spark, sf):
    h = heads(spark, sf).select("file_id", F.concat("first_record", "first_record").alias("h"))
    return h.select("file_id", F.array_join(H.unique_names(F.col("h")), "|").alias("names"))


@query("file_checks", f"""WITH {d.FILES} SELECT path, path LIKE '%.csv' AS is_csv, length(path) * 4000000 > 104857600 AS is_large FROM files""")
def file_checks(spark, sf):
    f = d.files(spark, sf)
    e, w = H.file_messages(F.col("path"), F.length("path") * 4000000)
    return f.select("path", (F.size(e) == 0).alias("is_csv"), (F.size(w) > 0).alias("is_large"))


@query("encoding_check", "SELECT doc_id AS row_id, 'utf-8' AS as_stored, CASE WHEN regexp_matches(text, '[\\x{80}-\\x{ff}]') THEN 'latin-1' ELSE 'utf-8' END AS as_latin1 FROM documents")
def encoding_check(spark, sf):
    # in Latin-1, texts with accents are not valid UTF-8; characters it lacks become question marks
    t = messages(spark, sf).withColumn("latin", F.regexp_replace("text", r"[^\x00-\xff]", "?"))
    name = lambda ok: F.when(ok, "utf-8").otherwise("latin-1")
    return t.select("row_id", name(F.is_valid_utf8("text")).alias("as_stored"),
                    name(F.is_valid_utf8(F.encode("latin", "ISO-8859-1").cast("string"))).alias("as_latin1"))


@query("ragged_rows", f"""SELECT doc_id AS row_id, line_no, s AS text, s IS NULL AS too_short FROM (
  SELECT doc_id, line_no, CASE WHEN length({o.strip('string_split(l, chr(44))[2]')}) > 0 THEN {o.strip('string_split(l, chr(44))[2]')} END AS s, l,
    len(string_split(l, ',')) < 2 AS short FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents))
WHERE length({o.strip('replace(l, chr(44), chr(32))')}) > 0 AND NOT contains(l, '"') AND (s IS NULL) = short""")
def ragged_rows(spark, sf):
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "value"))
    r = csv_files.ragged_fields(lines.filter(~F.col("value").contains('"')), text_pos=1)
    r = r.filter(F.col("text").isNull() == F.col("problem").isNotNull())
    return r.select("row_id", F.col("line_no").cast("bigint").alias("line_no"), "text", F.col("problem").isNotNull().alias("too_short"))


# fields of a line by the quote rule: closed quotes with what follows them, a quote left open, plain, empty
FIELD = '"(?:[^"]|"")*"(?:[^",][^,]*)?,|"(?:[^"]|"")*$|[^",][^,]*,|,'
UNQUOTED = """CASE WHEN NOT starts_with(x, '"') THEN x WHEN regexp_matches(x, '(?s)^"(?:[^"]|"")*"(?:[^"].*)?$')
   THEN replace(regexp_extract(x, '(?s)^"((?:[^"]|"")*)"(?:[^"].*)?$', 1), '""', '"') || regexp_extract(x, '(?s)^"(?:[^"]|"")*"([^"].*)?$', 1)
   ELSE replace(substr(x, 2), '""', '"') END"""


@query("ragged_lines", f"""WITH l AS (SELECT doc_id AS row_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
 f AS (SELECT row_id, line_no, list_transform(list_transform(regexp_extract_all(l || ',', '{FIELD}'), lambda m: m[:-2]), lambda x: {UNQUOTED}) AS fields FROM l),
 s AS (SELECT row_id, line_no, list_transform(fields, lambda x: {o.strip('x')}) AS fields FROM f)
SELECT row_id, line_no, nullif(fields[2], '') AS text, len(fields) < 2 AS too_short FROM s WHERE len(list_filter(fields, lambda x: length(x) > 0)) > 0""")
def ragged_lines(spark, sf):
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "value"))
    return csv_files.ragged_fields(lines, text_pos=1).select(
        "row_id", F.col("line_no").cast("bigint").alias("line_no"), "text", F.col("problem").isNotNull().alias("too_short"))


# ---- round trips through files -------------------------------------------------------------------
def scratch(spark, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    import uuid

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def csv_copy(spark, sf, columns: list[str]) -> str:
    """The labelled documents as CSV files under other column names."""
    path = scratch(spark, "csv")
    t = labelled(spark, sf).select("row_id", "text", F.when(F.col("label") == 1, "spam").otherwise("ham").alias("label"))
    t.toDF(*columns).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return path


LOADED = f"SELECT text, count(*) AS n FROM ({o.LABELLED}) GROUP BY text"


@query("load_messages", f"SELECT s AS text, label, count(*) AS n FROM (SELECT {o.strip('text')} AS s, CASE label WHEN 1 THEN 'spam' ELSE 'ham' END AS label FROM ({o.LABELLED})) WHERE length(s) >= 10 GROUP BY ALL")
def load_messages(spark, sf):
    path = csv_copy(spark, sf, ["id", "message", "is_spam"])
    rows = csv_files.read_messages(spark, path)
    # line ends inside a text are normalised by the CSV reader only if they are \r\n
    return clean_messages(rows, on_long="keep").groupBy("text", "label").agg(F.count(F.lit(1)).alias("n"))


@query("load_labelled", f"SELECT label, count(*) AS n_rows, sum(length(text))::BIGINT AS n_chars FROM (SELECT text, CASE arg_min(label, row_id) WHEN 1 THEN 'spam' ELSE 'legitimate' END AS label FROM ({o.LABELLED}) GROUP BY text) GROUP BY label")
def load_labelled(spark, sf):
    path = scratch(spark, "csv")
    t = labelled(spark, sf).select("row_id", "text", F.when(F.col("label") == 1, "SPAM").otherwise("Ham").alias("label"))
    t.repartitionByRange("row_id").sortWithinPartitions("row_id").select("text", "label").write.option("header", True).option("escape", '"').csv(path)
    rows = csv_files.read_labelled(spark, path)
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text")).alias("n_chars"))


@query("load_batch", f"SELECT count(*) AS n_rows FROM (SELECT DISTINCT text FROM ({o.LABELLED}) WHERE {o.errors('text')} = '')")
def load_batch(spark, sf):
    path = csv_copy(spark, sf, ["id", "text", "label"])
    return csv_files.read_batch(spark, path).agg(F.count(F.lit(1)).alias("n_rows"))


@query("file_profiles", f"""SELECT 'message' AS email_column, 'is_spam' AS label_column, 3 AS column_count, true AS has_header, 'utf-8' AS detected_encoding, 'training_data' AS format_type,
  count(*) > 0 AS any_file FROM documents""")
def file_profiles(spark, sf):
    path = csv_copy(spark, sf, ["id", "message", "is_spam"])
    return csv_files.profile_files(spark, path).groupBy(
        "email_column", "label_column", "column_count", "has_header", "detected_encoding", "format_type").agg(
        (F.count(F.lit(1)) > 0).alias("any_file"))


@query("results_csv", f"""SELECT email_index, email_text, prediction, status FROM (SELECT doc_id AS email_index,
   CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS email_text,
   CASE WHEN length({o.strip('text')}) < 10 OR length(text) > 10000 THEN 'Error' WHEN lang = 'en' THEN 'Spam' ELSE 'Legitimate' END AS prediction,
   CASE WHEN length({o.strip('text')}) < 10 OR length(text) > 10000 THEN 'error' ELSE 'success' END AS status FROM documents)""")
def results_csv(spark, sf):
    t = table(spark, sf, "documents").select(F.col("doc_id").alias("email_index"), "text", "lang")
    checked = t.withColumn("error_message", scoring.scoring_error("text"))
    scores = t.select("email_index", (F.col("lang") == "en").cast("int").alias("prediction"), F.lit(0.9).alias("confidence"))
    path = scratch(spark, "results")
    sinks.write_results(scoring.result_rows(checked, scores, as_of=d.as_of()), path)
    back = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .schema("email_index BIGINT, email_text STRING, prediction STRING, confidence DOUBLE, model_used STRING, "
                    "processing_time DOUBLE, timestamp STRING, status STRING, error_message STRING").csv(path))
    return back.select("email_index", "email_text", "prediction", "status")


@query("partial_results", f"""WITH {d.RESULTS}, run AS (SELECT *, sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY email_index) AS errs FROM results),
 stop AS (SELECT job_id, min(email_index) AS a FROM run WHERE errs > 10 AND status = 'error' AND email_index <= 50 GROUP BY 1)
SELECT a IS NOT NULL AS partial, count(*) AS n_rows FROM results r LEFT JOIN stop s ON r.job_id = s.job_id WHERE a IS NULL OR email_index <= a GROUP BY 1""")
def partial_results(spark, sf):
    from ..operators import jobs as J

    kept = J.gate_results(d.results(spark, sf))
    rows = kept.select("email_index", F.lit("").alias("email_text"), "prediction", F.lit(0.5).alias("confidence"),
                       F.lit("naive_bayes").alias("model_used"), F.lit(None).cast("double").alias("processing_time"),
                       F.lit(None).cast("timestamp").alias("timestamp"), "status", "error_message", "partial")
    path = scratch(spark, "partial")
    sinks.write_results(rows, path)
    back = spark.read.option("header", True).csv(path)
    return back.groupBy(F.col("partial").cast("boolean").alias("partial")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("metrics_export", f"WITH {d.PERF} SELECT metric_id, round(accuracy, 6) AS accuracy FROM perf WHERE ts >= {d.AS_OF_SQL} - INTERVAL 48 HOUR")
def metrics_export(spark, sf):
    path = scratch(spark, "metrics")
    sinks.export_metrics(d.perf(spark, sf), path, d.as_of(), hours=48)
    back = spark.read.schema("metric_id BIGINT, accuracy DOUBLE").json(path)
    return back.select("metric_id", F.round("accuracy", 6).alias("accuracy"))


@query("alert_log", f"WITH {d.PERF} SELECT metric_id, 'error' AS level FROM perf WHERE accuracy < 0.9 UNION ALL SELECT metric_id, 'error' FROM perf WHERE false_negative_rate > 0.1 UNION ALL SELECT metric_id, 'warning' FROM perf WHERE processing_time_ms > 30000 UNION ALL SELECT metric_id, 'warning' FROM perf WHERE memory_usage_mb > 4096 UNION ALL SELECT metric_id, 'warning' FROM perf WHERE samples_processed > 0 AND synthetic_samples_created::DOUBLE / samples_processed > 2.0")
def alert_log(spark, sf):
    from ..operators import telemetry as G

    path = scratch(spark, "alerts")
    a = G.threshold_alerts(d.perf(spark, sf), keep=("metric_id",))
    sinks.append_alerts(a.filter("level = 'warning'"), path)
    sinks.append_alerts(a.filter("level = 'error'"), path)
    return spark.read.schema("metric_id BIGINT, level STRING").json(path)


@query("result_listing", f"""WITH {d.JOBS} SELECT status, count(*) AS n_files FROM (SELECT DISTINCT status FROM jobs WHERE result_file_path IS NOT NULL) GROUP BY 1""")
def result_listing(spark, sf):
    path = scratch(spark, "listing")
    j = d.jobs(spark, sf).filter("result_file_path IS NOT NULL")
    j.select("job_id", "status").repartition(1, "status").write.partitionBy("status").csv(path)
    files = csv_files.list_files(spark, path, "*.csv")
    return files.groupBy(F.regexp_extract("path", "status=([a-z]+)", 1).alias("status")).agg(F.count(F.lit(1)).alias("n_files"))


@query("vocabulary_table", f"WITH {o.tfidf_ctes(o.LABELLED)} SELECT term, round(idf, 6) AS idf FROM vocab")
def vocabulary_table(spark, sf):
    from ..operators import features as feat

    docs = labelled(spark, sf)
    path = scratch(spark, "vocab")
    sinks.write_vocabulary(feat.fit_vocabulary(docs), path)
    return spark.read.parquet(path).select("term", F.round("idf", 6).alias("idf"))
