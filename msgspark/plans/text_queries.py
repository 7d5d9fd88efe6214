"""Registered queries: validation, cleaning, tokens, TF-IDF, naive Bayes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed_values as fv, labels as L, text as T
from ..operators import bayes, evaluate as ev, features as feat, rows as R, validate as V
from . import oracle_text as o
from .registry import query, table


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents", spread_by="doc_id").select(F.col("doc_id").alias("row_id"), "text")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with 0 / 1 labels."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), F.col("toxic").alias("label"))
    return messages(spark, sf).join(labels, "row_id")


# Raw labels of every document: mixed spellings derived from the labels table, null where
# a document has no label.
def raw_labelled(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("row_id"),
        F.when(F.col("toxic") == 1, F.when(F.col("quality") == 1, " SPAM ").otherwise("1"))
        .when(F.col("quality") == 1, "Ham").otherwise("maybe").alias("label"))
    return messages(spark, sf).join(labels, "row_id", "left")


RAW_LABELLED = """SELECT d.doc_id AS row_id, d.text, CASE WHEN toxic = 1 AND quality = 1 THEN ' SPAM '
    WHEN toxic = 1 THEN '1' WHEN quality = 1 THEN 'Ham' WHEN toxic = 0 THEN 'maybe' END AS label
    FROM documents d LEFT JOIN labels l USING (doc_id)"""


# ---- validation ------------------------------------------------------------------------
@query("email_validate", f"""
SELECT doc_id AS row_id, {o.errors('text')} AS errors,
  CASE WHEN length({o.strip('text')}) BETWEEN 10 AND 49 THEN '{fv.WARN_SHORT}' ELSE '' END AS warnings,
  {o.errors('text')} = '' AS is_valid FROM documents""")
def email_validate(spark, sf):
    v = V.validate_messages(messages(spark, sf))
    return v.select("row_id", F.array_join("errors", " | ").alias("errors"),
                    F.array_join("warnings", " | ").alias("warnings"), "is_valid")


@query("email_validate_api", f"""
SELECT conv_id, turn, CASE WHEN text IS NULL THEN 'email_text cannot be None'
  WHEN {o.strip('text')} = '' THEN 'email_text cannot be empty'
  WHEN length({o.strip('text')}) < 10 THEN 'email_text is too short (minimum 10 characters)'
  WHEN length({o.strip('text')}) > 10000 THEN 'email_text is too long (maximum 10,000 characters)' END AS problem
FROM conversations""")
def email_validate_api(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", V.request_error("text").alias("problem"))


@query("batch_messages", f"""
SELECT email_index, level, 'Email ' || email_index || ': ' || message AS message FROM (
  SELECT doc_id + 1 AS email_index, 'error' AS level, unnest(string_split(e, ' | ')) AS message
  FROM (SELECT doc_id, {o.errors('text')} AS e FROM documents) WHERE e <> ''
  UNION ALL
  SELECT doc_id + 1, 'warning', '{fv.WARN_SHORT}' FROM documents
  WHERE length({o.strip('text')}) BETWEEN 10 AND 49)""")
def batch_messages(spark, sf):
    m = messages(spark, sf).select((F.col("row_id") + 1).alias("email_index"), "text")
    return V.batch_messages(m)


@query("batch_verdict", f"""
SELECT count(*) AS n_rows, count(*) FILTER (e <> '') AS n_invalid,
  count(*) FILTER (length({o.strip('text')}) BETWEEN 10 AND 49) AS n_warnings,
  count(*) FILTER (e <> '') = 0 AND count(*) > 0 AS is_valid
FROM (SELECT text, {o.errors('text')} AS e FROM documents)""")
def batch_verdict(spark, sf):
    return V.batch_verdict(messages(spark, sf))


@query("first_batch_error", f"""
SELECT email_index, 'Email at index ' || (email_index - 1) || ': ' || problem AS message FROM (
  SELECT doc_id + 1 AS email_index, CASE WHEN {o.strip('text')} = '' THEN 'email_text cannot be empty'
    WHEN length({o.strip('text')}) < 10 THEN 'email_text is too short (minimum 10 characters)'
    WHEN length({o.strip('text')}) > 10000 THEN 'email_text is too long (maximum 10,000 characters)' END AS problem
  FROM documents) WHERE problem IS NOT NULL ORDER BY email_index LIMIT 1""")
def first_batch_error(spark, sf):
    m = messages(spark, sf).select((F.col("row_id") + 1).alias("email_index"), "text")
    return V.first_batch_error(m)


@query("content_profile", f"""
WITH r AS ({RAW_LABELLED})
SELECT count(*) AS n_rows, count(*) FILTER (text IS NULL) AS missing_text,
  count(*) FILTER (label IS NULL) AS missing_label,
  count(*) - count(DISTINCT text) - (CASE WHEN count(*) FILTER (text IS NULL) > 0 THEN 1 ELSE 0 END) AS duplicate_texts
FROM r""")
def content_profile(spark, sf):
    return V.content_profile(raw_labelled(spark, sf))


@query("unexpected_labels", f"""
WITH r AS ({RAW_LABELLED})
SELECT label, count(*) AS n_rows FROM r
WHERE label IS NOT NULL AND label NOT IN ('spam', 'ham', 'legitimate', '0', '1') GROUP BY label""")
def unexpected_labels(spark, sf):
    return V.unexpected_labels(raw_labelled(spark, sf))


@query("json_required_fields", """
SELECT event_id,
  concat_ws(',', CASE WHEN coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) = 0 THEN 'k' END, 'email_text') AS missing,
  'MISSING_REQUIRED_FIELDS' AS code FROM events""")
def json_required_fields(spark, sf):
    e = V.check_payloads(table(spark, sf, "events"), payload="props", fields=["k", "email_text"])
    return e.select("event_id", F.array_join("missing_fields", ",").alias("missing"), "code")


@query("valid_job_id", """
SELECT event_id, CAST(job_id AS VARCHAR) AS job_id,
  regexp_matches(job_id, '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') AS ok
FROM (SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-'
        || substr(h, 17, 4) || '-' || substr(h, 21, CASE WHEN event_type = 'error' THEN 11 ELSE 12 END) AS job_id
      FROM (SELECT event_id, event_type, md5(CAST(event_id AS VARCHAR)) AS h FROM events))""")
def valid_job_id(spark, sf):
    h = F.md5(F.col("event_id").cast("string").cast("binary"))
    e = table(spark, sf, "events").select("event_id", F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"),
        F.substring(h, 17, 4), F.lit("-"),
        F.substring(h, F.lit(21), F.when(F.col("event_type") == "error", 11).otherwise(12))).alias("job_id"))
    return e.select("event_id", "job_id", L.is_job_id("job_id").alias("ok"))


@query("valid_filename", """
SELECT page_id, CASE WHEN name = '' THEN 'name' WHEN regexp_matches(name, '[<>:"|?*\\\\/]') THEN 'characters'
  WHEN ext NOT IN ('csv', 'txt') OR ext IS NULL THEN 'extension' END AS problem FROM (
  SELECT page_id, name, CASE WHEN contains(name, '.') THEN lower(string_split(name, '.')[-1]) END AS ext FROM (
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN string_split(url, '/')[-1] || '.csv'
      WHEN page_id % 3 = 1 THEN string_split(url, '/')[-1] ELSE url END AS name FROM pages))""")
def valid_filename(spark, sf):
    last = F.element_at(F.split("url", "/"), -1)
    name = F.when(F.col("page_id") % 3 == 0, F.concat(last, F.lit(".csv"))).when(
        F.col("page_id") % 3 == 1, last).otherwise(F.col("url"))
    p = table(spark, sf, "pages").select("page_id", V.file_name_error(name).alias("e"))
    return p.select("page_id", F.when(F.col("e").contains("special characters"), "characters")
                    .when(F.col("e").contains("file format"), "extension").when(F.col("e").isNotNull(), "name").alias("problem"))


# ---- cleaning ----------------------------------------------------------------------------
STEPS = {
    "lower_text": (T.lower_text, "lower(text)"),
    "strip_addresses": (T.strip_addresses, o.rx("text", f"[^{o.W}]+@[^{o.W}]+")),
    "strip_urls": (T.strip_urls, o.rx("text", f"http[^{o.W}]+|www[^{o.W}]+")),
    "collapse_space": (T.collapse_space, o.rx("text", f"[{o.W}]+", " ")),
    "punctuation_to_space": (T.punctuation_to_space, o.rx("text", rf"[^\p{{L}}\p{{N}}_{o.W}]", " ")),
    "drop_digits": (T.drop_digits, o.rx("text", r"\p{Nd}+")),
    "squeeze": (T.squeeze, o.rx(o.rx("text", f"[{o.W}]+", " "), "^ +| +$")),
    "clean_text": (T.clean_text, o.clean("text")),
    "stopword_filter": (lambda c: T.remove_stop_words(T.squeeze(T.lower_text(c))),
                        f"array_to_string({o.words(o.rx(o.rx('lower(text)', f'[{o.W}]+', ' '), '^ +| +$'))}, ' ')"),
    "preprocess": (T.preprocess, f"array_to_string({o.words(o.clean('text'))}, ' ')"),
    "text_preview": (T.preview, "CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END"),
}


def _step(name, fn, sql):
    @query(name, f"SELECT doc_id AS row_id, {sql} AS text FROM documents")
    def run(spark, sf):
        return messages(spark, sf).select("row_id", fn("text").alias("text"))
    return run


for _name, (_fn, _sql) in STEPS.items():
    _step(_name, _fn, _sql)


@query("strip_tags", f"SELECT page_id, {o.rx('html', '<[^>]+>')} AS text FROM pages")
def strip_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.strip_tags("html").alias("text"))


@query("clean_html", f"SELECT page_id, {o.clean('html')} AS text FROM pages")
def clean_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.clean_text("html").alias("text"))


@query("tokenize", f"""
SELECT item_id, unnest(list_filter(string_split(p, ' '), lambda w: length(w) >= 2)) AS token
FROM (SELECT item_id, array_to_string({o.words(o.clean('text'))}, ' ') AS p FROM benchmark)""")
def tokenize(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select("item_id", F.explode(T.word_tokens(T.preprocess("text"))).alias("token"))


@query("ngrams", f"""
WITH tok AS (SELECT conv_id, turn, {o.words(o.clean('text'))} AS toks FROM conversations)
SELECT conv_id, turn, unnest({o.grams('toks')}) AS term FROM tok""")
def ngrams(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", T.tokens("text").alias("tokens"))
    return c.select("conv_id", "turn", F.explode(T.ngrams("tokens")).alias("term"))


@query("clean_messages", f"""
SELECT doc_id AS row_id, substr(s, 1, 10000) AS text, length(s) > 10000 AS was_cut
FROM (SELECT doc_id, {o.strip('text')} AS s FROM documents) WHERE length(s) >= 10""")
def clean_messages(spark, sf):
    return R.clean_messages(messages(spark, sf))


@query("cleaning_summary", f"""
SELECT count(*) AS n_rows, count(*) FILTER (length(s) < 10) AS n_dropped, count(*) FILTER (length(s) > 10000) AS n_cut
FROM (SELECT {o.strip('text')} AS s FROM documents)""")
def cleaning_summary(spark, sf):
    return R.cleaning_summary(messages(spark, sf))


@query("drop_null_rows", f"SELECT row_id, label FROM ({RAW_LABELLED}) WHERE text IS NOT NULL AND label IS NOT NULL")
def drop_null_rows(spark, sf):
    return R.drop_null_rows(raw_labelled(spark, sf), "text", "label").select("row_id", "label")


@query("dedup_first", """
SELECT row_id, text FROM (SELECT doc_id AS row_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r
FROM documents) WHERE r = 1""")
def dedup_first(spark, sf):
    return R.dedup_first(messages(spark, sf))


@query("label_normalize_a", f"SELECT row_id, {o.normalize_label('label')} AS label FROM ({RAW_LABELLED})")
def label_normalize_a(spark, sf):
    return R.normalize_labels(raw_labelled(spark, sf)).select("row_id", "label")


@query("label_normalize_b", f"""
SELECT row_id, CASE WHEN lower(label) = 'spam' THEN 1 ELSE 0 END AS label FROM ({RAW_LABELLED})
WHERE lower(label) IN ('spam', 'ham', 'legitimate')""")
def label_normalize_b(spark, sf):
    return R.encode_labels(raw_labelled(spark, sf)).select("row_id", "label")


@query("clean_labelled", f"""
WITH r AS ({RAW_LABELLED})
SELECT row_id, text, {o.normalize_label('label')} AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY row_id) AS k FROM r WHERE label IS NOT NULL AND text IS NOT NULL)
WHERE k = 1""")
def clean_labelled(spark, sf):
    return R.clean_labelled(raw_labelled(spark, sf))


@query("format_prediction", f"""
SELECT row_id, CASE WHEN lower(label) IN ('spam', '1') THEN 'Spam' WHEN lower(label) IN ('legitimate', 'ham', '0')
  THEN 'Legitimate' ELSE 'Unknown' END AS prediction FROM ({RAW_LABELLED})""")
def format_prediction(spark, sf):
    return raw_labelled(spark, sf).select("row_id", L.format_prediction("label").alias("prediction"))


@query("valid_messages_only", f"""
SELECT doc_id AS row_id, length(text) AS n FROM documents WHERE {o.errors('text')} = ''""")
def valid_messages_only(spark, sf):
    v = V.validate_messages(messages(spark, sf)).filter("is_valid")
    return v.select("row_id", F.length("text").cast("bigint").alias("n"))


# ---- TF-IDF --------------------------------------------------------------------------------
ALL_DOCS = "SELECT doc_id AS row_id, text, 0 AS label FROM documents"


@query("term_counts", f"WITH {o.tfidf_ctes(ALL_DOCS)} SELECT row_id, term, tf FROM counts")
def term_counts(spark, sf):
    return feat.term_counts(messages(spark, sf))


@query("vocab", f"WITH {o.tfidf_ctes(ALL_DOCS)} SELECT term, term_idx, df, cf FROM vocab")
def vocab(spark, sf):
    docs = messages(spark, sf)
    v = feat.fit_vocabulary(docs)
    return v.select("term", F.col("term_idx").cast("bigint").alias("term_idx"), "df", "cf")


@query("idf", f"WITH {o.tfidf_ctes(ALL_DOCS)} SELECT term, round(idf, 6) AS idf FROM vocab")
def idf(spark, sf):
    docs = messages(spark, sf)
    v = feat.fit_vocabulary(docs)
    return v.select("term", F.round("idf", 6).alias("idf"))


@query("feature_names", f"WITH {o.tfidf_ctes(ALL_DOCS)} SELECT term_idx, term FROM vocab ORDER BY term_idx")
def feature_names(spark, sf):
    docs = messages(spark, sf)
    v = feat.feature_names(feat.fit_vocabulary(docs))
    return v.select(F.col("term_idx").cast("bigint").alias("term_idx"), "term")


@query("tfidf_l2", f"WITH {o.tfidf_ctes(ALL_DOCS)} SELECT row_id, term, tf, round(weight, 6) AS weight FROM weights")
def tfidf_l2(spark, sf):
    words = feat.prepared(messages(spark, sf))
    w = feat.tfidf(words, feat.fit_vocabulary(words))
    return w.select("row_id", "term", "tf", F.round("weight", 6).alias("weight"))


@query("tfidf_transform", f"""
WITH {o.tfidf_ctes(o.LABELLED)},
 tgt AS (SELECT d.doc_id AS row_id, d.text FROM documents d ANTI JOIN labels l USING (doc_id)),
 tt AS (SELECT row_id, {o.words(o.clean('text'))} AS toks FROM tgt),
 tc AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest({o.grams('toks')}) AS term FROM tt) GROUP BY ALL),
 tu AS (SELECT row_id, term_idx, (1.0::DOUBLE + ln(tf)) * idf AS u FROM tc JOIN vocab USING (term))
SELECT t.row_id, count(u) AS nnz, round(coalesce(sqrt(sum(u * u)), 0), 5) AS norm
FROM tgt t LEFT JOIN tu USING (row_id) GROUP BY t.row_id""")
def tfidf_transform(spark, sf):
    train, docs = labelled(spark, sf), messages(spark, sf)
    new = docs.join(train.select("row_id"), "row_id", "left_anti")
    v = feat.fit_vocabulary(train)
    counts = feat.known_counts(new, v, keep_empty=True)
    u = feat.raw_weight(F.col("tf"), F.col("idf"))
    return counts.groupBy("row_id").agg(
        F.count(u).alias("nnz"), F.round(F.coalesce(F.sqrt(F.sum(u * u)), F.lit(0.0)), 5).alias("norm"))


@query("tfidf_arrays", f"WITH {o.tfidf_ctes(ALL_DOCS)} SELECT row_id, term_idx, round(weight, 6) AS weight FROM weights")
def tfidf_arrays(spark, sf):
    words = feat.prepared(messages(spark, sf))
    arrays = feat.tfidf_arrays(words, feat.fit_vocabulary(words))
    w = feat.long_weights(arrays)
    return w.select("row_id", F.col("term_idx").cast("bigint").alias("term_idx"), F.round("weight", 6).alias("weight"))


@query("tfidf_vectors", f"""WITH {o.tfidf_ctes(ALL_DOCS)}
SELECT s.row_id, count(weight) AS nnz, round(coalesce(sum(weight), 0), 5) AS total,
  round(coalesce(sum(weight * (term_idx + 1)), 0), 3) AS moment FROM src s LEFT JOIN weights w ON s.row_id = w.row_id GROUP BY s.row_id""")
def tfidf_vectors(spark, sf):
    """The vectors, read back as entries: their number, sum, and sum weighted by position."""
    words = feat.prepared(messages(spark, sf))
    v = feat.fit_vocabulary(words)
    sparse = feat.tfidf_vectors(words, v, size=max(1, v.count())).select("row_id", F.unwrap_udt("features").alias("x"))
    summed = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    return sparse.select("row_id", F.size(F.filter("x.values", lambda e: e != 0)).cast("bigint").alias("nnz"),
                         F.round(summed(F.col("x.values")), 5).alias("total"),
                         F.round(summed(F.zip_with("x.indices", "x.values", lambda i, e: e * (i + 1))), 3).alias("moment"))


# ---- naive Bayes -----------------------------------------------------------------------------
@query("nb_params", f"""
WITH {o.tfidf_ctes(o.LABELLED)}, {o.NB_CTES}
SELECT term, round(theta0, 6) AS theta0, round(theta1, 6) AS theta1 FROM theta""")
def nb_params(spark, sf):
    terms, _ = bayes.fit(labelled(spark, sf))
    return terms.select("term", F.round("theta0", 6).alias("theta0"), F.round("theta1", 6).alias("theta1"))


@query("nb_priors", f"""
WITH src AS ({o.LABELLED})
SELECT round(ln(count(*) FILTER (label = 0)::DOUBLE / count(*)), 9) AS prior0,
       round(ln(count(*) FILTER (label = 1)::DOUBLE / count(*)), 9) AS prior1 FROM src""")
def nb_priors(spark, sf):
    p = bayes.class_priors(labelled(spark, sf))
    return p.select(F.round("prior0", 9).alias("prior0"), F.round("prior1", 9).alias("prior1"))


NB_SCORE = f"WITH {o.tfidf_ctes(o.LABELLED)}, {o.NB_CTES}, {o.nb_score_ctes('SELECT doc_id AS row_id, text FROM documents')}"


def nb_scored(spark, sf) -> DataFrame:
    terms, priors = bayes.fit(labelled(spark, sf))
    return bayes.score(messages(spark, sf), terms, priors)


@query("nb_score", f"{NB_SCORE} SELECT row_id, prediction, round(confidence, 5) AS confidence FROM scored")
def nb_score(spark, sf):
    return nb_scored(spark, sf).select("row_id", "prediction", F.round("confidence", 5).alias("confidence"))


@query("nb_confusion", f"""
{NB_SCORE}, e AS (SELECT s.prediction, l.toxic AS label FROM scored s JOIN labels l ON l.doc_id = s.row_id)
SELECT 'naive_bayes' AS model_name, count(*) FILTER (label = 0 AND prediction = 0) AS tn,
  count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn,
  count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM e""")
def nb_confusion(spark, sf):
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), F.col("toxic").alias("label"))
    scored = nb_scored(spark, sf).join(labels, "row_id").withColumn("model_name", F.lit("naive_bayes"))
    return ev.confusion(scored)
