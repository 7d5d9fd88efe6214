"""Evaluation: confusion counts, rates, reports, model choice, before/after verdicts.

Predictions are reduced to one confusion row per model first (combined on the map side);
every later measure is arithmetic on those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fv


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, *, label: str = "label", prediction: str = "prediction",
              by: tuple[str, ...] = ("model_name",)) -> DataFrame:
    y, p = F.col(label), F.col(prediction)
    return df.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def class_scores(tp: Column, pred: Column, actual: Column) -> tuple[Column, Column, Column]:
    precision, recall = _ratio(tp, pred), _ratio(tp, actual)
    return precision, recall, _ratio(2 * precision * recall, precision + recall)


def weighted_metrics(conf: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 of confusion rows."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n0, n1, n = tn + fp, fn + tp, tn + fp + fn + tp
    c0, c1 = class_scores(tn, tn + fn, n0), class_scores(tp, tp + fp, n1)
    names = ("precision", "recall", "f1_score")
    return conf.withColumns({
        "test_samples": n,
        "accuracy": _ratio(tn + tp, n),
        **{k: _ratio(n0 * a + n1 * b, n) for k, a, b in zip(names, c0, c1)},
    })


def rates(conf: DataFrame) -> DataFrame:
    """False negative, false positive and spam detection rates, 0 for empty classes."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return conf.withColumns({
        "false_negative_rate": _ratio(fn, fn + tp),
        "false_positive_rate": _ratio(fp, fp + tn),
        "spam_detection_rate": _ratio(tp, tp + fn),
    })


def evaluate_models(df: DataFrame, *, label: str = "label", prediction: str = "prediction",
                    by: tuple[str, ...] = ("model_name",)) -> DataFrame:
    return rates(weighted_metrics(confusion(df, label=label, prediction=prediction, by=by)))


def class_report(conf: DataFrame, *, by: tuple[str, ...] = ("model_name",)) -> DataFrame:
    """Per-class rows plus accuracy, macro and weighted averages."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n0, n1 = tn + fp, fn + tp
    n = n0 + n1
    c0, c1 = class_scores(tn, tn + fn, n0), class_scores(tp, tp + fp, n1)
    acc = _ratio(tn + tp, n)

    def line(name, values, support):
        return F.struct(F.lit(name).alias("class"), *[v.alias(k) for k, v in
                        zip(("precision", "recall", "f1_score"), values)], support.alias("support"))

    lines = F.array(
        line("Legitimate", c0, n0), line("Spam", c1, n1), line("accuracy", (acc, acc, acc), n),
        line("macro avg", tuple((a + b) / 2 for a, b in zip(c0, c1)), n),
        line("weighted avg", tuple(_ratio(n0 * a + n1 * b, n) for a, b in zip(c0, c1)), n),
    )
    return conf.select(*by, F.explode(lines).alias("l")).select(*by, "l.*")


def train_accuracy(df: DataFrame, *, label: str = "label", prediction: str = "prediction",
                   by: tuple[str, ...] = ("model_name",)) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("train_accuracy"))


def label_counts(df: DataFrame, *, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))


def compare_models(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.desc("accuracy"), "model_name")


def composite_score(*, fnr: str = "spam") -> Column:
    """0.4 (1-FNR) + 0.3 accuracy + 0.2 F1 + 0.1 detection.

    ``spam`` uses the FNR and detection rate of the spam class, ``weighted`` takes both
    from the weighted recall.
    """
    if fnr == "spam":
        miss, detect = F.col("false_negative_rate"), F.col("spam_detection_rate")
    elif fnr == "weighted":
        detect = F.col("recall")
        miss = F.when(detect > 0, 1.0 - detect).otherwise(1.0)
    else:
        raise ValueError("fnr must be 'spam' or 'weighted'")
    return 0.4 * (1.0 - miss) + 0.3 * F.col("accuracy") + 0.2 * F.col("f1_score") + 0.1 * detect


def best_model(metrics: DataFrame, *, fnr: str = "spam") -> DataFrame:
    """The row with the highest composite score (model name decides ties)."""
    return (metrics.withColumn("composite_score", composite_score(fnr=fnr))
            .orderBy(F.desc("composite_score"), "model_name").limit(1))


FALLBACK_ORDER = ("decision_tree", "random_forest", "naive_bayes")


def fallback_model(models: DataFrame) -> DataFrame:
    """First available model in the fixed preference order, used without metrics."""
    order = F.array_position(F.array(*[F.lit(m) for m in FALLBACK_ORDER]), F.col("model_name"))
    return models.withColumn("_o", order).filter("_o > 0").orderBy("_o").limit(1).drop("_o")


def best_by_accuracy(metrics: DataFrame) -> DataFrame:
    """Best model overall with a display name, from the metrics table."""
    best = metrics.orderBy(F.desc("accuracy"), "model_name").limit(1)
    return best.withColumn("display_name", F.initcap(F.replace(F.col("model_name"), F.lit("_"), F.lit(" "))))


def summary(metrics: DataFrame) -> DataFrame:
    """Cross-model means and bests."""
    return metrics.agg(
        F.count(F.lit(1)).alias("total_models_evaluated"),
        F.avg("false_negative_rate").alias("average_false_negative_rate"),
        F.min("false_negative_rate").alias("best_false_negative_rate"),
        F.avg("accuracy").alias("average_accuracy"), F.max("accuracy").alias("best_accuracy"),
        F.avg("spam_detection_rate").alias("average_spam_detection_rate"),
        F.max("spam_detection_rate").alias("best_spam_detection_rate"),
    ).withColumn("target_fnr_achieved", F.col("best_false_negative_rate") < 0.05)


def balanced_summary(metrics: DataFrame) -> DataFrame:
    """Balanced / unbalanced model counts and names (one metrics row per model)."""
    flag = F.col("class_balancing_enabled")
    names = lambda keep: F.array_join(F.sort_array(F.collect_list(F.when(keep, F.col("model_name")))), ",")
    return metrics.agg(
        F.count(F.lit(1)).alias("total_models"),
        F.count_if(flag).alias("balanced_models_count"), F.count_if(~flag).alias("unbalanced_models_count"),
        names(flag).alias("balanced_models"), names(~flag).alias("unbalanced_models"),
        F.coalesce(F.avg(F.when(flag, F.col("false_negative_rate"))), F.lit(0.0)).alias("avg_fnr_balanced"),
    ).withColumn("coverage_percentage",
                 _ratio(F.col("balanced_models_count") * 100.0, F.col("total_models")))


MEASURES = ("accuracy", "precision", "recall", "f1_score", "false_negative_rate", "false_positive_rate")


def before_after(original: DataFrame, balanced: DataFrame, *, on: str = "model_name") -> DataFrame:
    """Inner join of two metric tables by model with the six changes."""
    a = original.select(on, *[F.col(m).alias(f"original_{m}") for m in MEASURES])
    b = balanced.select(on, *[F.col(m).alias(f"balanced_{m}") for m in MEASURES])
    gain = lambda m: F.col(f"balanced_{m}") - F.col(f"original_{m}")
    return a.join(b, on).withColumns({
        "accuracy_improvement": gain("accuracy"), "precision_improvement": gain("precision"),
        "recall_improvement": gain("recall"), "f1_improvement": gain("f1_score"),
        "fnr_reduction": -gain("false_negative_rate"), "fpr_change": gain("false_positive_rate"),
    })


def comparison_advice(deltas: DataFrame) -> DataFrame:
    """Direction words and the per-model recommendation of the before/after report."""
    acc, rec = F.col("accuracy_improvement"), F.col("recall_improvement")
    return deltas.withColumns({
        "accuracy_direction": F.when(acc > 0, "Improved").when(acc < 0, "Decreased").otherwise("No Change"),
        "recall_direction": F.when(rec > 0, "Better Spam Detection").when(rec < 0, "Worse Spam Detection")
        .otherwise("No Change"),
        "recommendation": F.when((rec > 0.01) & (acc > -0.02),
                                 "Use balanced model - improved spam detection with minimal accuracy loss")
        .when(rec > 0.02, "Consider balanced model - significant spam detection improvement")
        .when(acc < -0.05, "Use original model - balancing caused significant accuracy loss")
        .otherwise("Evaluate based on business requirements"),
    })


def effectiveness(deltas: DataFrame) -> DataFrame:
    """Effectiveness score in [0, 1] and whether it passes one half."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) + 0.5))
    terms = [clamp(k) * w for k, w in fv.EFFECTIVENESS_WEIGHTS.items()]
    total = sum(fv.EFFECTIVENESS_WEIGHTS.values())
    score = terms[0]
    for t in terms[1:]:
        score = score + t
    return deltas.withColumn("effectiveness_score", score / F.lit(total)).withColumn(
        "balancing_successful", F.col("effectiveness_score") > 0.5)


def target_reached(ratio: Column, target: Column, tolerance: float = 0.05) -> Column:
    return (target != 0.0) & (F.abs(ratio - target) <= tolerance)


def balancing_recommendations(df: DataFrame) -> DataFrame:
    """Rule messages from deltas plus target_achieved, synthetic_samples, original_samples."""
    fnr, acc = F.col("fnr_reduction"), F.col("accuracy_improvement")
    added = F.when((F.col("synthetic_samples") > 0) & (F.col("original_samples") > 0),
                   F.col("synthetic_samples") / F.col("original_samples") * 100)
    rules = F.array_compact(F.array(
        F.when(fnr > 0.02, "Excellent FNR reduction achieved. Consider using balanced model in production.")
        .when(fnr > 0.01, "Good FNR reduction. Monitor performance on new data before deployment.")
        .otherwise("Limited FNR improvement. Consider adjusting target ratio or trying different balancing method."),
        F.when(acc < -0.02, "Significant accuracy decrease detected. Consider reverting to unbalanced model.")
        .when(acc < 0, "Slight accuracy decrease. Evaluate if FNR improvement justifies the trade-off."),
        F.when(F.col("fpr_change") > 0.05,
               "High false positive rate increase. Consider adjusting class weights or target ratio."),
        F.when(F.col("target_achieved"), "Target spam ratio successfully achieved.")
        .otherwise("Target spam ratio not achieved. Consider adjusting SMOTE parameters."),
        F.when(added > 100, "Very high number of synthetic samples created. Validate sample quality.")
        .when(added > 50, "Moderate number of synthetic samples created. Monitor for overfitting."),
    ))
    return df.withColumn("recommendations", rules)


def effectiveness_verdict(deltas: DataFrame, *, target_fnr: float = fv.TARGET_FNR,
                          retention: float = fv.MIN_ACCURACY_RETENTION, quality: Column | None = None) -> DataFrame:
    """FNR target, accuracy retention and synthetic quality, all three needed to pass."""
    q = F.lit(fv.DEFAULT_SYNTHETIC_QUALITY) if quality is None else quality
    kept = _ratio(F.col("balanced_accuracy"), F.col("original_accuracy"))
    return deltas.withColumns({
        "fnr_target_met": F.col("balanced_false_negative_rate") <= target_fnr,
        "retention_ratio": kept,
        "accuracy_maintained": kept >= retention,
        "synthetic_quality_score": q,
        "synthetic_quality_passed": q >= fv.MIN_SYNTHETIC_QUALITY,
    }).withColumn("overall_passed",
                  F.col("fnr_target_met") & F.col("accuracy_maintained") & F.col("synthetic_quality_passed"))


def verdict_recommendations(verdict: DataFrame, *, target_fnr: float = fv.TARGET_FNR) -> DataFrame:
    three = lambda c: F.format_string("%.3f", F.col(c))
    rules = F.array(
        F.when(F.col("fnr_target_met"),
               F.concat(F.lit("Excellent: FNR target achieved ("), three("balanced_false_negative_rate"),
                        F.lit(f" ≤ {target_fnr:.3f})")))
        .when(F.col("fnr_reduction") > 0,
              F.concat(F.lit("FNR improved by "), three("fnr_reduction"),
                       F.lit(" but target not met. Consider adjusting target ratio or SMOTE parameters.")))
        .otherwise("FNR did not improve. Consider using class weights instead of SMOTE or adjusting balancing strategy."),
        F.when(F.col("accuracy_maintained"), "Good: Accuracy adequately maintained after balancing.")
        .otherwise(F.concat(F.lit("Accuracy retention below threshold ("), three("retention_ratio"),
                            F.lit("). Consider reducing synthetic sample ratio."))),
        F.when(F.col("synthetic_quality_passed"),
               "Excellent: Synthetic samples maintain good quality characteristics.")
        .otherwise(F.concat(F.lit("Synthetic sample quality below threshold ("), three("synthetic_quality_score"),
                            F.lit("). Consider adjusting k-neighbors or using different balancing method."))),
    )
    return verdict.withColumn("recommendations", rules)


def improvement_verdict(deltas: DataFrame) -> DataFrame:
    """Five improvement checks, the overall one and its recommendation."""
    return deltas.withColumns({
        "fnr_improved": F.col("fnr_reduction") > fv.MIN_FNR_REDUCTION,
        "accuracy_kept": F.col("accuracy_improvement") >= -0.02,
        "recall_improved": F.col("recall_improvement") > 0,
        "precision_acceptable": F.col("precision_improvement") >= -0.05,
        "fpr_acceptable": F.col("fpr_change") <= 0.05,
    }).withColumn("overall_improvement",
                  F.col("fnr_improved") & F.col("accuracy_kept") & F.col("fpr_acceptable")).withColumn(
        "recommendation",
        F.when(F.col("overall_improvement"), "Recommend using balanced model - significant improvement achieved")
        .when(F.col("fnr_improved") & F.col("accuracy_kept"),
              "Consider using balanced model - good FNR improvement with acceptable accuracy")
        .when(~F.col("accuracy_kept"), "Use original model - accuracy loss too significant")
        .otherwise("Evaluate based on business requirements - mixed results"))


def final_recommendations(checked: DataFrame) -> DataFrame:
    """Closing advice from verdict and improvement columns (``effectiveness_verdict`` and
    ``improvement_verdict``); an optional ``synthetic_valid`` column adds the sample check."""
    ok = F.col("overall_passed")
    synthetic = F.col("synthetic_valid") if "synthetic_valid" in checked.columns else F.lit(True)
    rules = F.array_compact(F.array(
        F.when(ok, "✓ Class balancing validation PASSED - recommend using balanced models in production")
        .otherwise("✗ Class balancing validation FAILED - consider adjustments before production deployment"),
        F.when(ok & F.col("fnr_target_met"),
               "✓ False negative rate target achieved - excellent spam detection performance"),
        F.when(ok & F.col("accuracy_maintained"),
               "✓ Accuracy adequately maintained - good balance between spam detection and overall performance"),
        F.when(~ok & ~F.col("fnr_target_met"),
               "• FNR target not met - consider increasing target spam ratio or adjusting SMOTE parameters"),
        F.when(~ok & ~F.col("accuracy_maintained"),
               F.concat(F.lit("• Accuracy loss too significant ("), F.format_string("%+.3f", "accuracy_improvement"),
                        F.lit(") - consider reducing synthetic sample ratio"))),
        F.when(~synthetic,
               "• Synthetic sample quality issues detected - consider adjusting k-neighbors or preprocessing"),
        F.when(F.col("overall_improvement"), "✓ Overall performance improvement confirmed")
        .otherwise("• Mixed performance results - evaluate based on business priorities"),
    ))
    return checked.withColumn("final_recommendations", rules)


def best_pair(metrics: DataFrame, *, balanced: str = "class_balancing_enabled") -> DataFrame:
    """Most accurate unbalanced and balanced model, compared with each other."""
    w = Window.partitionBy(balanced).orderBy(F.desc("accuracy"), "model_name")
    best = metrics.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    side = lambda flag, name: best.filter(F.col(balanced) == flag).withColumn("_k", F.lit(1)).withColumn(
        name, F.col("model_name"))
    a, b = side(False, "original_model"), side(True, "balanced_model")
    pair = before_after(a, b, on="_k")
    names = a.select("_k", "original_model").join(b.select("_k", "balanced_model"), "_k")
    return pair.join(names, "_k").drop("_k")


def quality_gates(n_rows: Column, best_accuracy: Column) -> list[Column]:
    return [(n_rows >= 100).alias("enough_rows"), (best_accuracy >= 0.95).alias("accuracy_reached")]
