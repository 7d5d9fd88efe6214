"""Registered queries: evaluation, model choice, balancing, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv, labels as L
from ..operators import balance as B, evaluate as ev, models as M, rows as R, scoring as S, split as sp
from ..sources import sinks
from . import derived as d, oracle_text as o
from .registry import query, table
from .text_queries import NB_SCORE, labelled, messages, nb_scored

SIX = ("accuracy", "precision", "recall", "f1_score")


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def q6(*names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query("confusion", f"WITH {d.METRICS} SELECT model_name, tn, fp, fn, tp FROM metrics")
def confusion(spark, sf):
    return ev.confusion(d.scored(spark, sf))


@query("weighted_metrics", f"WITH {d.METRICS} SELECT model_name, test_samples, {q6(*SIX)} FROM metrics")
def weighted_metrics(spark, sf):
    return d.metrics(spark, sf).select("model_name", "test_samples", *r6(*SIX))


RATES = ("false_negative_rate", "false_positive_rate", "spam_detection_rate")


@query("rates", f"WITH {d.METRICS} SELECT model_name, {q6(*RATES)} FROM metrics")
def rates(spark, sf):
    return d.metrics(spark, sf).select("model_name", *r6(*RATES))


def _line(name, p, r, f, n):
    return f"SELECT model_name, '{name}' AS class, round({p}, 6) AS precision, round({r}, 6) AS recall, round({f}, 6) AS f1_score, {n} AS support FROM metrics"


@query("class_report", f"WITH {d.METRICS} " + " UNION ALL ".join([
    _line("Legitimate", "p0", "r0", "f0", "n0"), _line("Spam", "p1", "r1", "f1", "n1"),
    _line("accuracy", "accuracy", "accuracy", "accuracy", "test_samples"),
    _line("macro avg", "(p0 + p1) / 2", "(r0 + r1) / 2", "(f0 + f1) / 2", "test_samples"),
    _line("weighted avg", "precision", "recall", "f1_score", "test_samples")]))
def class_report(spark, sf):
    return ev.class_report(ev.confusion(d.scored(spark, sf))).select(
        "model_name", "class", *r6("precision", "recall", "f1_score"), "support")


@query("train_accuracy", f"""WITH {d.SCORED} SELECT model_name,
  round(avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END), 6) AS train_accuracy FROM scored GROUP BY 1""")
def train_accuracy(spark, sf):
    return ev.train_accuracy(d.scored(spark, sf)).select("model_name", *r6("train_accuracy"))


@query("label_counts", "SELECT toxic AS label, count(*) AS n_rows FROM labels GROUP BY 1")
def label_counts(spark, sf):
    return ev.label_counts(table(spark, sf, "labels").select(F.col("toxic").alias("label")))


@query("model_compare", f"WITH {d.METRICS} SELECT model_name, {q6(*SIX)} FROM metrics ORDER BY accuracy DESC, model_name")
def model_compare(spark, sf):
    return ev.compare_models(d.metrics(spark, sf)).select("model_name", *r6(*SIX))


@query("best_model_a", f"""WITH {d.METRICS} SELECT model_name, round(0.4 * recall + 0.3 * accuracy + 0.2 * f1_score + 0.1 * recall, 6) AS composite_score
FROM metrics ORDER BY 0.4 * recall + 0.3 * accuracy + 0.2 * f1_score + 0.1 * recall DESC, model_name LIMIT 1""")
def best_model_a(spark, sf):
    return ev.best_model(d.metrics(spark, sf), fnr="weighted").select("model_name", *r6("composite_score"))


COMPOSITE = "0.4 * (1 - false_negative_rate) + 0.3 * accuracy + 0.2 * f1_score + 0.1 * spam_detection_rate"


@query("best_model_b", f"""WITH {d.METRICS} SELECT model_name, round({COMPOSITE}, 6) AS composite_score
FROM metrics ORDER BY {COMPOSITE} DESC, model_name LIMIT 1""")
def best_model_b(spark, sf):
    return ev.best_model(d.metrics(spark, sf)).select("model_name", *r6("composite_score"))


@query("fallback_model", f"""WITH {d.METRICS} SELECT model_name FROM metrics WHERE model_name IN ('decision_tree', 'random_forest', 'naive_bayes')
ORDER BY CASE model_name WHEN 'decision_tree' THEN 1 WHEN 'random_forest' THEN 2 ELSE 3 END LIMIT 1""")
def fallback_model(spark, sf):
    return ev.fallback_model(d.metrics(spark, sf).select("model_name"))


@query("best_model_info", f"""WITH {d.METRICS} SELECT model_name, {q6('accuracy', 'f1_score')},
  array_to_string(list_transform(string_split(model_name, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS display_name
FROM metrics ORDER BY metrics.accuracy DESC, model_name LIMIT 1""")
def best_model_info(spark, sf):
    return ev.best_by_accuracy(d.metrics(spark, sf)).select("model_name", *r6("accuracy", "f1_score"), "display_name")


@query("model_summary", f"""WITH {d.METRICS} SELECT count(*) AS total_models_evaluated,
  round(avg(false_negative_rate), 6) AS average_false_negative_rate, round(min(false_negative_rate), 6) AS best_false_negative_rate,
  round(avg(accuracy), 6) AS average_accuracy, round(max(accuracy), 6) AS best_accuracy,
  round(avg(spam_detection_rate), 6) AS average_spam_detection_rate, round(max(spam_detection_rate), 6) AS best_spam_detection_rate,
  min(false_negative_rate) < 0.05 AS target_fnr_achieved FROM metrics""")
def model_summary(spark, sf):
    s = ev.summary(d.metrics(spark, sf))
    return s.select("total_models_evaluated", *r6(*[c for c in s.columns if c.startswith(("average", "best"))]), "target_fnr_achieved")


@query("balanced_summary", f"""WITH {d.METRICS} SELECT count(*) AS total_models,
  count(*) FILTER (class_balancing_enabled) AS balanced_models_count,
  count(*) FILTER (NOT class_balancing_enabled) AS unbalanced_models_count,
  string_agg(model_name, ',' ORDER BY model_name) FILTER (class_balancing_enabled) AS balanced_models,
  string_agg(model_name, ',' ORDER BY model_name) FILTER (NOT class_balancing_enabled) AS unbalanced_models,
  round(avg(false_negative_rate) FILTER (class_balancing_enabled), 6) AS avg_fnr_balanced,
  round(100.0::DOUBLE * count(*) FILTER (class_balancing_enabled) / count(*), 6) AS coverage_percentage FROM metrics""")
def balanced_summary(spark, sf):
    s = ev.balanced_summary(d.metrics(spark, sf))
    return s.withColumns({c: F.round(c, 6) for c in ("avg_fnr_balanced", "coverage_percentage")})


GAINS = ("accuracy_improvement", "precision_improvement", "recall_improvement", "f1_improvement", "fnr_reduction", "fpr_change")


@query("before_after", f"WITH {d.DELTAS} SELECT model_name, {q6(*GAINS)} FROM deltas")
def before_after(spark, sf):
    return d.before_after(spark, sf).select("model_name", *r6(*GAINS))


@query("comparison_advice", f"""WITH {d.DELTAS} SELECT model_name,
  CASE WHEN accuracy_improvement > 0 THEN 'Improved' WHEN accuracy_improvement < 0 THEN 'Decreased' ELSE 'No Change' END AS accuracy_direction,
  CASE WHEN recall_improvement > 0 THEN 'Better Spam Detection' WHEN recall_improvement < 0 THEN 'Worse Spam Detection' ELSE 'No Change' END AS recall_direction,
  CASE WHEN recall_improvement > 0.01 AND accuracy_improvement > -0.02 THEN 'Use balanced model - improved spam detection with minimal accuracy loss'
    WHEN recall_improvement > 0.02 THEN 'Consider balanced model - significant spam detection improvement'
    WHEN accuracy_improvement < -0.05 THEN 'Use original model - balancing caused significant accuracy loss'
    ELSE 'Evaluate based on business requirements' END AS recommendation FROM deltas""")
def comparison_advice(spark, sf):
    return ev.comparison_advice(d.before_after(spark, sf)).select(
        "model_name", "accuracy_direction", "recall_direction", "recommendation")


def _clamp(c):
    return f"greatest(0, least(1, {c} + 0.5::DOUBLE))"


EFFECT = (f"0.4 * {_clamp('recall_improvement')} + 0.3 * {_clamp('fnr_reduction')} + 0.2 * {_clamp('f1_improvement')}"
          f" + 0.1 * {_clamp('accuracy_improvement')}")


@query("effectiveness", f"WITH {d.DELTAS} SELECT model_name, round({EFFECT}, 6) AS effectiveness_score, {EFFECT} > 0.5 AS balancing_successful FROM deltas")
def effectiveness(spark, sf):
    return ev.effectiveness(d.before_after(spark, sf)).select("model_name", *r6("effectiveness_score"), "balancing_successful")


@query("verdict", f"""WITH {d.DELTAS} SELECT model_name, balanced_false_negative_rate <= 0.05 AS fnr_target_met,
  round(balanced_accuracy / original_accuracy, 6) AS retention_ratio, balanced_accuracy / original_accuracy >= 0.95 AS accuracy_maintained,
  balanced_false_negative_rate <= 0.05 AND balanced_accuracy / original_accuracy >= 0.95 AS overall_passed FROM deltas""")
def verdict(spark, sf):
    return ev.effectiveness_verdict(d.before_after(spark, sf)).select(
        "model_name", "fnr_target_met", *r6("retention_ratio"), "accuracy_maintained", "overall_passed")


@query("verdict_recommendations", f"""WITH {d.DELTAS} SELECT model_name, concat_ws(' | ',
  CASE WHEN balanced_false_negative_rate <= 0.05 THEN 'Excellent: FNR target achieved (' || printf('%.3f', balanced_false_negative_rate) || ' ≤ 0.050)'
    WHEN fnr_reduction > 0 THEN 'FNR improved by ' || printf('%.3f', fnr_reduction) || ' but target not met. Consider adjusting target ratio or SMOTE parameters.'
    ELSE 'FNR did not improve. Consider using class weights instead of SMOTE or adjusting balancing strategy.' END,
  CASE WHEN balanced_accuracy / original_accuracy >= 0.95 THEN 'Good: Accuracy adequately maintained after balancing.'
    ELSE 'Accuracy retention below threshold (' || printf('%.3f', balanced_accuracy / original_accuracy) || '). Consider reducing synthetic sample ratio.' END,
  'Excellent: Synthetic samples maintain good quality characteristics.') AS recommendations FROM deltas""")
def verdict_recommendations(spark, sf):
    v = ev.verdict_recommendations(ev.effectiveness_verdict(d.before_after(spark, sf)))
    return v.select("model_name", F.array_join("recommendations", " | ").alias("recommendations"))


@query("improvement_verdict", f"""WITH {d.DELTAS}, f AS (SELECT *, fnr_reduction > 0.01 AS a, accuracy_improvement >= -0.02 AS b, fpr_change <= 0.05 AS c FROM deltas)
SELECT model_name, a AS fnr_improved, b AS accuracy_kept, recall_improvement > 0 AS recall_improved,
  precision_improvement >= -0.05 AS precision_acceptable, c AS fpr_acceptable, a AND b AND c AS overall_improvement,
  CASE WHEN a AND b AND c THEN 'Recommend using balanced model - significant improvement achieved'
    WHEN a AND b THEN 'Consider using balanced model - good FNR improvement with acceptable accuracy'
    WHEN NOT b THEN 'Use original model - accuracy loss too significant'
    ELSE 'Evaluate based on business requirements - mixed results' END AS recommendation FROM f""")
def improvement_verdict(spark, sf):
    return ev.improvement_verdict(d.before_after(spark, sf)).select(
        "model_name", "fnr_improved", "accuracy_kept", "recall_improved", "precision_acceptable", "fpr_acceptable",
        "overall_improvement", "recommendation")


@query("final_recommendations", f"""WITH {d.DELTAS}, f AS (SELECT *, balanced_false_negative_rate <= 0.05 AS met, balanced_accuracy / original_accuracy >= 0.95 AS kept,
  fnr_reduction > 0.01 AND accuracy_improvement >= -0.02 AND fpr_change <= 0.05 AS better FROM deltas)
SELECT model_name, concat_ws(' | ', CASE WHEN met AND kept THEN '✓ Class balancing validation PASSED - recommend using balanced models in production'
    ELSE '✗ Class balancing validation FAILED - consider adjustments before production deployment' END,
  CASE WHEN met AND kept THEN '✓ False negative rate target achieved - excellent spam detection performance' END,
  CASE WHEN met AND kept THEN '✓ Accuracy adequately maintained - good balance between spam detection and overall performance' END,
  CASE WHEN NOT met THEN '• FNR target not met - consider increasing target spam ratio or adjusting SMOTE parameters' END,
  CASE WHEN NOT kept THEN '• Accuracy loss too significant (' || printf('%+.3f', accuracy_improvement) || ') - consider reducing synthetic sample ratio' END,
  CASE WHEN better THEN '✓ Overall performance improvement confirmed' ELSE '• Mixed performance results - evaluate based on business priorities' END) AS recommendations FROM f""")
def final_recommendations(spark, sf):
    x = ev.final_recommendations(ev.improvement_verdict(ev.effectiveness_verdict(d.before_after(spark, sf))))
    return x.select("model_name", F.array_join("final_recommendations", " | ").alias("recommendations"))


@query("balancing_recommendations", f"""WITH {d.DELTAS}, t AS (SELECT count(*) AS original_samples FROM events),
 s AS (SELECT count(*) AS synthetic_samples FROM events WHERE value > 30)
SELECT model_name, concat_ws(' | ',
  CASE WHEN fnr_reduction > 0.02 THEN 'Excellent FNR reduction achieved. Consider using balanced model in production.'
    WHEN fnr_reduction > 0.01 THEN 'Good FNR reduction. Monitor performance on new data before deployment.'
    ELSE 'Limited FNR improvement. Consider adjusting target ratio or trying different balancing method.' END,
  CASE WHEN accuracy_improvement < -0.02 THEN 'Significant accuracy decrease detected. Consider reverting to unbalanced model.'
    WHEN accuracy_improvement < 0 THEN 'Slight accuracy decrease. Evaluate if FNR improvement justifies the trade-off.' END,
  CASE WHEN fpr_change > 0.05 THEN 'High false positive rate increase. Consider adjusting class weights or target ratio.' END,
  CASE WHEN abs(balanced_recall - 0.9) <= 0.05 THEN 'Target spam ratio successfully achieved.' ELSE 'Target spam ratio not achieved. Consider adjusting SMOTE parameters.' END,
  CASE WHEN 100.0 * synthetic_samples / original_samples > 100 THEN 'Very high number of synthetic samples created. Validate sample quality.'
    WHEN 100.0 * synthetic_samples / original_samples > 50 THEN 'Moderate number of synthetic samples created. Monitor for overfitting.' END) AS recommendations
FROM deltas, t, s""")
def balancing_recommendations(spark, sf):
    e = d.events(spark, sf)
    total, made = e.agg(F.count(F.lit(1))).scalar(), e.filter("value > 30").agg(F.count(F.lit(1))).scalar()
    x = d.before_after(spark, sf).withColumns({
        "target_achieved": ev.target_reached(F.col("balanced_recall"), F.lit(0.9)),
        "synthetic_samples": made, "original_samples": total})
    return ev.balancing_recommendations(x).select("model_name", F.array_join("recommendations", " | ").alias("recommendations"))


@query("best_pair", f"""WITH {d.METRICS},
 o AS (SELECT * FROM metrics WHERE NOT class_balancing_enabled ORDER BY accuracy DESC, model_name LIMIT 1),
 b AS (SELECT * FROM metrics WHERE class_balancing_enabled ORDER BY accuracy DESC, model_name LIMIT 1)
SELECT o.model_name AS original_model, b.model_name AS balanced_model, round(b.accuracy - o.accuracy, 6) AS accuracy_improvement,
  round(o.false_negative_rate - b.false_negative_rate, 6) AS fnr_reduction FROM o, b""")
def best_pair(spark, sf):
    return ev.best_pair(d.metrics(spark, sf)).select(
        "original_model", "balanced_model", *r6("accuracy_improvement", "fnr_reduction"))


@query("quality_gates", f"""WITH {d.METRICS} SELECT (SELECT count(*) FROM labels) >= 100 AS enough_rows, max(accuracy) >= 0.95 AS accuracy_reached FROM metrics""")
def quality_gates(spark, sf):
    n = table(spark, sf, "labels").agg(F.count(F.lit(1))).scalar()
    return d.metrics(spark, sf).agg(F.max("accuracy").alias("best")).select(*ev.quality_gates(n, F.col("best")))


@query("model_tiers", f"""WITH {d.METRICS} SELECT model_name, CASE WHEN accuracy >= 0.95 THEN 'green' WHEN accuracy >= 0.9 THEN 'yellow' ELSE 'red' END AS accuracy_tier,
  CASE WHEN false_negative_rate <= 0.02 THEN 'green' WHEN false_negative_rate <= 0.05 THEN 'yellow' ELSE 'red' END AS fnr_tier FROM metrics""")
def model_tiers(spark, sf):
    return d.metrics(spark, sf).select("model_name", L.accuracy_tier("accuracy").alias("accuracy_tier"),
                                       L.fnr_tier("false_negative_rate").alias("fnr_tier"))


@query("metric_defaults", f"""WITH {d.METRICS} SELECT model_name, round(CASE WHEN class_balancing_enabled THEN accuracy ELSE 0 END, 6) AS accuracy,
  0 AS synthetic_samples_used, 'none' AS balancing_method FROM metrics""")
def metric_defaults(spark, sf):
    m = d.metrics(spark, sf).withColumn("accuracy", F.when(F.col("class_balancing_enabled"), F.col("accuracy")))
    return R.fill_metric_defaults(m).select("model_name", *r6("accuracy"), "synthetic_samples_used", "balancing_method")


@query("model_report", f"""WITH {d.METRICS} SELECT model_name, {q6(*SIX)}, test_samples, tn, fp, fn, tp,
  round(false_negative_rate * 100, 1) AS fnr_percentage FROM metrics""")
def model_report(spark, sf):
    return sinks.model_report(d.metrics(spark, sf))


@query("report_lines", f"""WITH {d.METRICS} SELECT model_name, CAST(unnest(range(12)) AS INTEGER) AS line_no, unnest([
  'Detailed Results for ' || model_name || ':', repeat('-', 40), 'Accuracy:  ' || printf('%.4f', accuracy),
  'Precision: ' || printf('%.4f', precision), 'Recall:    ' || printf('%.4f', recall), 'F1-Score:  ' || printf('%.4f', f1_score),
  'Confusion Matrix:', '                Predicted', 'Actual    Legit  Spam', printf('Legit     %5d %5d', tn, fp),
  printf('Spam      %5d %5d', fn, tp), repeat('-', 60)]) AS line FROM metrics""")
def report_lines(spark, sf):
    return sinks.report_lines(d.metrics(spark, sf))


# ---- model tables ------------------------------------------------------------------------------
@query("balancing_info", f"""WITH {d.METRICS} SELECT model_name, class_balancing_enabled, round(false_negative_rate, 6) AS false_negative_rate FROM metrics""")
def balancing_info(spark, sf):
    m = R.fill_metric_defaults(d.metrics(spark, sf))
    return M.balancing_info(m).select("model_name", "class_balancing_enabled", *r6("false_negative_rate"))


@query("metrics_of", f"WITH {d.METRICS} SELECT model_name, {q6(*SIX)} FROM metrics WHERE model_name = 'naive_bayes'")
def metrics_of(spark, sf):
    return M.metrics_of(d.metrics(spark, sf), "naive_bayes").select("model_name", *r6(*SIX))


@query("balanced_models", f"WITH {d.METRICS} SELECT model_name FROM metrics WHERE class_balancing_enabled")
def balanced_models(spark, sf):
    return M.balanced_models(d.metrics(spark, sf)).select("model_name")


@query("metrics_upsert", f"""WITH {d.METRICS} SELECT model_name, round(accuracy, 6) AS accuracy,
  round(CASE WHEN class_balancing_enabled THEN false_negative_rate / 2 ELSE false_negative_rate END, 6) AS false_negative_rate FROM metrics""")
def metrics_upsert(spark, sf):
    m = d.metrics(spark, sf)
    new = m.filter("class_balancing_enabled").select("model_name", (F.col("false_negative_rate") / 2).alias("false_negative_rate"))
    return M.upsert_metrics(m, new).select("model_name", *r6("accuracy", "false_negative_rate"))


SAVED = """saved AS (SELECT 'model_' || event_type AS model_name, CASE WHEN value > 20 THEN '2.0' END AS version,
  'models/' || event_id AS path, ts AS saved_at FROM events WHERE event_type <> 'view')"""


def saved(spark, sf):
    return d.events(spark, sf).filter("event_type <> 'view'").select(
        F.concat(F.lit("model_"), "event_type").alias("model_name"), F.when(F.col("value") > 20, "2.0").alias("version"),
        F.concat(F.lit("models/"), F.col("event_id").cast("string")).alias("path"), F.col("ts").alias("saved_at"))


@query("model_versions", f"""WITH {SAVED} SELECT model_name, arg_max(path, (saved_at, path)) AS path,
  {d.stamp_sql('max(saved_at)')} AS saved_at FROM saved GROUP BY 1""")
def model_versions(spark, sf):
    return M.latest_versions(saved(spark, sf)).select("model_name", "path", d.stamp("saved_at").alias("saved_at"))


@query("model_compatibility", f"""WITH {SAVED}, n AS (SELECT DISTINCT 'model_' || event_type AS model_name FROM events),
 l AS (SELECT * FROM saved QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY saved_at DESC, path DESC) = 1)
SELECT n.model_name, CASE WHEN l.model_name IS NULL THEN 'not_found' WHEN version IS NULL THEN 'legacy_v1.0' ELSE 'version_' || version END AS status
FROM n LEFT JOIN l USING (model_name)""")
def model_compatibility(spark, sf):
    names = d.events(spark, sf).select(F.concat(F.lit("model_"), "event_type").alias("model_name")).distinct()
    return M.compatibility(names, saved(spark, sf))


# ---- scoring -----------------------------------------------------------------------------------
CHECKED = f"""checked AS (SELECT doc_id AS email_index, text, CASE WHEN text IS NULL OR {o.strip('text')} = '' THEN 'Empty email content'
   WHEN length({o.strip('text')}) < 10 THEN 'Email content too short (minimum 10 characters)'
   WHEN length(text) > 10000 THEN 'Invalid email text: {fv.ERR_LONG}' END AS error_message FROM documents)"""


# messages of any length are scored as a whole
SCORABLE = "\n".join(line for line in CHECKED.split("\n") if "> 10000" not in line) + " END AS error_message FROM documents)"


@query("score_messages", f"""{NB_SCORE}, {SCORABLE}
SELECT email_index, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS email_text,
  CASE WHEN error_message IS NOT NULL THEN 'Error' WHEN prediction = 1 THEN 'Spam' ELSE 'Legitimate' END AS prediction,
  round(CASE WHEN error_message IS NULL THEN confidence ELSE 0 END, 5) AS confidence,
  CASE WHEN error_message IS NULL THEN 'naive_bayes' ELSE 'None' END AS model_used,
  CASE WHEN error_message IS NULL THEN 'success' ELSE 'error' END AS status, error_message
FROM checked JOIN scored ON row_id = email_index""")
def score_messages(spark, sf):
    from ..operators import bayes
    terms, priors = bayes.fit(labelled(spark, sf))
    docs = messages(spark, sf).withColumnRenamed("row_id", "email_index")
    res = S.score_messages(docs, terms, priors, max_length=None)
    return res.select("email_index", "email_text", "prediction", F.round("confidence", 5).alias("confidence"),
                      "model_used", "status", "error_message")


@query("attach_balancing", f"""WITH {d.METRICS}, {d.RESULTS}
SELECT event_id, model_used, coalesce(class_balancing_enabled, false) AS model_balanced,
  round(CASE WHEN class_balancing_enabled THEN false_negative_rate END, 6) AS false_negative_rate
FROM (SELECT event_id, CASE WHEN status = 'error' THEN 'None' WHEN prediction = 'Spam' THEN 'random_forest_balanced' ELSE 'naive_bayes' END AS model_used FROM results) r
LEFT JOIN metrics m ON r.model_used = m.model_name""")
def attach_balancing(spark, sf):
    res = d.results(spark, sf).select("event_id", F.when(F.col("status") == "error", "None").when(
        F.col("prediction") == "Spam", "random_forest_balanced").otherwise("naive_bayes").alias("model_used"))
    out = S.attach_balancing(res, R.fill_metric_defaults(d.metrics(spark, sf)))
    return out.select("event_id", "model_used", "model_balanced", *r6("false_negative_rate"))


# ---- balancing ---------------------------------------------------------------------------------
LAB = "WITH lab AS (SELECT doc_id AS row_id, toxic AS label FROM labels)"
DIST = """dist AS (SELECT count(*) AS total_samples, count(*) FILTER (label = 1) AS spam_count,
  count(*) FILTER (label <> 1) AS legitimate_count FROM lab)"""


def toxic(spark, sf):
    return table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), F.col("toxic").alias("label"))


@query("class_distribution", f"""{LAB}, {DIST} SELECT *, round(spam_count::DOUBLE / total_samples, 6) AS spam_ratio,
  round(legitimate_count::DOUBLE / total_samples, 6) AS legitimate_ratio,
  round(least(spam_count, legitimate_count)::DOUBLE / greatest(spam_count, legitimate_count), 6) AS imbalance_ratio FROM dist""")
def class_distribution(spark, sf):
    x = B.class_distribution(toxic(spark, sf))
    return x.withColumns({c: F.round(c, 6) for c in ("spam_ratio", "legitimate_ratio", "imbalance_ratio")})


@query("imbalance", f"""{LAB}, {DIST} SELECT total_samples, round(spam_count::DOUBLE / total_samples, 6) AS spam_ratio,
  spam_count::DOUBLE / total_samples < 0.45 AS is_imbalanced FROM dist""")
def imbalance(spark, sf):
    return B.imbalance(toxic(spark, sf)).withColumn("spam_ratio", F.round("spam_ratio", 6))


WEIGHTS = f"""{LAB}, w AS (SELECT label, (SELECT count(*) FROM lab)::DOUBLE / ((SELECT count(DISTINCT label) FROM lab) * count(*))
  * CASE WHEN label = 1 THEN 1.5 ELSE 1.0 END AS weight FROM lab GROUP BY label)"""


@query("class_weights", f"{WEIGHTS} SELECT label, round(weight, 6) AS weight FROM w")
def class_weights(spark, sf):
    return B.class_weights(toxic(spark, sf)).withColumn("weight", F.round("weight", 6))


@query("model_weights", f"""{WEIGHTS} SELECT m AS model_name, label, round(weight * CASE WHEN label = 1 AND m = 'random_forest' THEN 2.0
  WHEN label = 1 AND m = 'decision_tree' THEN 1.8 ELSE 1.0 END, 6) AS weight
FROM w, (SELECT unnest(['naive_bayes', 'random_forest', 'decision_tree']) AS m)""")
def model_weights(spark, sf):
    w = B.model_weights(B.class_weights(toxic(spark, sf)), M.MODEL_NAMES)
    return w.withColumn("weight", F.round("weight", 6))


@query("sample_weights", f"{WEIGHTS} SELECT d.doc_id AS row_id, round(coalesce(w.weight, 1.0), 6) AS weight FROM documents d LEFT JOIN lab ON lab.row_id = d.doc_id LEFT JOIN w USING (label)")
def sample_weights(spark, sf):
    t = toxic(spark, sf)
    rows = messages(spark, sf).select("row_id").join(t, "row_id", "left")
    return B.sample_weights(rows, B.class_weights(t)).select("row_id", F.round("weight", 6).alias("weight"))


QUOTA = """q AS (SELECT *, least(n0, n1) AS mi, greatest(n0, n1) AS ma FROM cls),
 e AS (SELECT *, greatest(0.48::DOUBLE, mi::DOUBLE / (n0 + n1) + 0.02::DOUBLE) AS eff FROM q),
 t AS (SELECT *, CASE WHEN mi >= 10 AND ma > 0 THEN CAST(floor(greatest(floor(eff * ma / (1.0::DOUBLE - eff)), mi) * 1.1::DOUBLE) AS BIGINT) ELSE mi END AS target_count FROM e)"""


@query("smote_quota", f"""WITH cls AS (SELECT event_type AS grp, count(*) FILTER (value <= 60) AS n0, count(*) FILTER (value > 60) AS n1 FROM events GROUP BY 1), {QUOTA}
SELECT grp, n0, n1, CASE WHEN n1 < n0 THEN 1 ELSE 0 END AS minority_label, mi AS minority_count, target_count, target_count - mi AS n_synthetic,
  greatest(least(3, mi - 1), 0) AS k_effective FROM t""")
def smote_quota(spark, sf):
    e = d.events(spark, sf).select(F.col("event_type").alias("grp"), (F.col("value") > 60).cast("int").alias("label"))
    q = B.smote_quota(e, by=("grp",))
    return q.select("grp", "n0", "n1", "minority_label", "minority_count", "target_count", "n_synthetic", "k_effective")


@query("balance_report", f"""{LAB.replace('WITH lab', 'WITH lab0')}, x AS (SELECT row_id, 1 AS label, true AS is_synthetic FROM lab0 WHERE label = 1
   UNION ALL SELECT row_id, label, false FROM lab0)
SELECT count(*) FILTER (NOT is_synthetic) AS original_samples, count(*) FILTER (is_synthetic) AS synthetic_samples, count(*) AS balanced_samples,
  round(count(*) FILTER (NOT is_synthetic AND label = 1)::DOUBLE / count(*) FILTER (NOT is_synthetic), 6) AS original_spam_ratio,
  round(count(*) FILTER (label = 1)::DOUBLE / count(*), 6) AS balanced_spam_ratio,
  round(100.0::DOUBLE * count(*) FILTER (is_synthetic) / count(*) FILTER (NOT is_synthetic), 6) AS samples_added_percentage,
  abs(count(*) FILTER (label = 1)::DOUBLE / count(*) - 0.48) <= 0.05 AS target_achieved FROM x""")
def balance_report(spark, sf):
    t = toxic(spark, sf).withColumn("is_synthetic", F.lit(False))
    both = t.filter("label = 1").withColumn("is_synthetic", F.lit(True)).unionByName(t)
    r = B.balance_report(both)
    return r.select("original_samples", "synthetic_samples", "balanced_samples",
                    *r6("original_spam_ratio", "balanced_spam_ratio", "samples_added_percentage"), "target_achieved")


@query("synthetic_placeholder", """SELECT doc_id AS row_id, CASE WHEN lang = 'en' THEN '[SYNTHETIC_SAMPLE_' || doc_id || ']' ELSE text END AS text FROM documents""")
def synthetic_placeholder(spark, sf):
    x = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text", (F.col("lang") == "en").alias("is_synthetic"))
    return B.synthetic_placeholder(x, position="row_id").select("row_id", "text")


# ---- splits ------------------------------------------------------------------------------------
def _share(n_c, take):
    """Largest remainder shares of ``take`` over classes of size ``n_c`` (window over all classes)."""
    return f"""CAST({n_c} * ({take}) // sum({n_c}) OVER () AS BIGINT) AS fl, CAST({n_c} * ({take}) % sum({n_c}) OVER () AS BIGINT) AS rem"""


def split_sql(source, test=0.2, val=0.1):
    return f"""src AS ({source}), c AS (SELECT label, count(*) AS n FROM src GROUP BY 1),
 a1 AS (SELECT *, CAST(sum(n) OVER () - ceil({test}::DOUBLE * sum(n) OVER ()) AS BIGINT) AS take FROM c),
 a2 AS (SELECT *, n * take // (sum(n) OVER ()) AS fl, n * take % (sum(n) OVER ()) AS rem FROM a1),
 a3 AS (SELECT label, n, CAST(fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, label) <= take - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS kept FROM a2),
 b1 AS (SELECT *, CAST(sum(kept) OVER () - ceil({val}::DOUBLE * sum(kept) OVER ()) AS BIGINT) AS take FROM a3),
 b2 AS (SELECT *, kept * take // (sum(kept) OVER ()) AS fl, kept * take % (sum(kept) OVER ()) AS rem FROM b1),
 quota AS (SELECT label, n, n - kept AS n_test, kept, CAST(fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, label) <= take - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS n_train FROM b2),
 ranked AS (SELECT src.*, row_number() OVER (PARTITION BY label ORDER BY md5(row_id || '-42'), row_id) AS r FROM src)"""


@query("split_quotas", f"WITH {split_sql('SELECT event_id AS row_id, event_type AS label FROM events')} SELECT label, n AS n_rows, n_test, kept - n_train AS n_val, n_train FROM quota")
def split_quotas(spark, sf):
    return sp.split_quotas(d.events(spark, sf).select(F.col("event_id").alias("row_id"), F.col("event_type").alias("label")))


@query("stratified_split", f"""WITH {split_sql('SELECT event_id AS row_id, event_type AS label FROM events')}
SELECT row_id, label, CASE WHEN r <= n_test THEN 'test' WHEN r <= n_test + kept - n_train THEN 'validation' ELSE 'train' END AS split
FROM ranked JOIN quota USING (label)""")
def stratified_split(spark, sf):
    e = d.events(spark, sf).select(F.col("event_id").alias("row_id"), F.col("event_type").alias("label"))
    return sp.stratified_split(e)


@query("direct_split", f"""WITH {split_sql('SELECT doc_id AS row_id, toxic AS label FROM labels', val=0.0)}
SELECT row_id, label, CASE WHEN r <= n_test THEN 'test' ELSE 'train' END AS split FROM ranked JOIN quota USING (label)""")
def direct_split(spark, sf):
    return sp.stratified_split(toxic(spark, sf), validation_size=0.0)


@query("cv_folds", """WITH src AS (SELECT doc_id AS row_id, toxic AS label FROM labels),
 c AS (SELECT label, count(*) AS n FROM src GROUP BY 1),
 r AS (SELECT src.*, row_number() OVER (PARTITION BY label ORDER BY md5(row_id || '-42'), row_id) AS r FROM src)
SELECT row_id, label, (CASE WHEN r > n * 1 // 5 THEN 1 ELSE 0 END + CASE WHEN r > n * 2 // 5 THEN 1 ELSE 0 END
  + CASE WHEN r > n * 3 // 5 THEN 1 ELSE 0 END + CASE WHEN r > n * 4 // 5 THEN 1 ELSE 0 END) AS fold FROM r JOIN c USING (label)""")
def cv_folds(spark, sf):
    return sp.folds(toxic(spark, sf))


@query("undersample", """WITH src AS (SELECT doc_id AS row_id, toxic AS label FROM labels)
SELECT row_id, label FROM src QUALIFY label = 1 OR row_number() OVER (PARTITION BY label ORDER BY md5(row_id || '-42'), row_id)
  <= (SELECT 2 * count(*) FROM src WHERE label = 1)""")
def undersample(spark, sf):
    t = toxic(spark, sf)
    n = t.filter("label = 1").count()
    return sp.undersample(t, 2 * n, majority=0)
