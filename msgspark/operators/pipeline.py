"""From raw text to a probability as one ML pipeline, which is saved, loaded and applied to tables and streams alike.

Stages: any number of ``TextStep`` (a SQL expression of the user's), ``Tokens``, ``TfidfEstimator`` and ``BayesEstimator``. The fitted
models work row by row on expressions and Spark's own vocabulary lookup, without an exchange and without Python, so a
``PipelineModel`` of them can follow ``readStream``. Their tables (at most ``maxFeatures`` terms) are parameters and
are saved with them.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from . import features as feat
from .bayes import with_decision

_PERSISTED = (DefaultParamsReadable, DefaultParamsWritable)


def _param(name: str, doc: str, convert) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=convert)


def _constants(values: list[float]) -> Column:
    """An array of constants, sent to the JVM as one string."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values or [0.0])), ",").cast("array<double>")


def _weighted(values: list[float]):
    constants = _constants(values)
    return lambda i, w: w * F.get(constants, i)


class TextStep(Transformer, HasInputCol, HasOutputCol, *_PERSISTED):
    """A user's text step: ``expression`` is SQL in which ``{c}`` stands for the input column."""

    expression = _param("expression", "SQL expression of {c}", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol: str = "text", outputCol: str = "text", expression: str = "{c}"):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="text", expression="{c}")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), F.expr(self.getOrDefault("expression").replace("{c}", f"`{self.getInputCol()}`")))


class Tokens(Transformer, HasInputCol, HasOutputCol, *_PERSISTED):
    """The cleaned words of a text without stop words, and their n-grams up to ``maxGram``."""

    maxGram = _param("maxGram", "longest n-gram", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str = "text", outputCol: str = "grams", maxGram: int = 2):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="grams", maxGram=2)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        words = F.coalesce(T.tokens(self.getInputCol()), F.array().cast("array<string>"))
        return dataset.withColumn("_words", words).withColumn(
            self.getOutputCol(), T.ngrams("_words", 1, self.getOrDefault("maxGram"))).drop("_words")


class _Tfidf(HasInputCol, HasOutputCol):
    pass


class TfidfEstimator(Estimator, _Tfidf, *_PERSISTED):
    """Learns the vocabulary and its idf from arrays of terms, in one exchange on the term."""

    minDF = _param("minDF", "least number of rows with the term", TypeConverters.toInt)
    maxDF = _param("maxDF", "largest share of rows with the term", TypeConverters.toFloat)
    maxFeatures = _param("maxFeatures", "most terms", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str = "grams", outputCol: str = "features", minDF: int = 2, maxDF: float = 0.95,
                 maxFeatures: int = feat.MAX_FEATURES):
        super().__init__()
        self._setDefault(inputCol="grams", outputCol="features", minDF=2, maxDF=0.95, maxFeatures=feat.MAX_FEATURES)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "TfidfModel":
        grams = F.col(self.getInputCol())
        one = lambda cf, df: lambda x: F.struct(x.alias("term"), F.lit(cf).alias("cf"), F.lit(df).alias("df"))
        seen = F.concat(F.transform(grams, one(1, 0)), F.transform(F.array_distinct(grams), one(0, 1)))
        n = dataset.count()
        counts = dataset.select(F.explode(seen).alias("x")).groupBy("x.term").agg(F.sum("x.cf").alias("cf"), F.sum("x.df").alias("df"))
        kept = counts.filter((F.col("df") >= self.getOrDefault("minDF")) & (F.col("df") <= self.getOrDefault("maxDF") * n))
        top = kept.orderBy(F.desc("cf"), F.asc("term")).limit(self.getOrDefault("maxFeatures"))
        rows = sorted(top.select("term", feat.idf(F.lit(n), F.col("df")).alias("idf")).collect(),  # at most maxFeatures
                      key=lambda r: r.term.encode())
        return TfidfModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), vocabulary=[r.term for r in rows],
                          idf=[r.idf for r in rows])


class TfidfModel(Model, _Tfidf, *_PERSISTED):
    """Sub-linear, L2-normalised TF-IDF as a struct of ``indices`` and ``weights``."""

    vocabulary = _param("vocabulary", "terms by index", TypeConverters.toListString)
    idf = _param("idf", "idf by index", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol: str = "grams", outputCol: str = "features", vocabulary: list[str] = (), idf: list[float] = ()):
        super().__init__()
        self._setDefault(inputCol="grams", outputCol="features", vocabulary=[], idf=[])
        self._set(**{k: list(v) if isinstance(v, tuple) else v for k, v in self._input_kwargs.items()})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out, terms = self.getOutputCol(), self.getOrDefault("vocabulary")
        if not terms:
            none = F.array().cast("array<int>").alias("indices"), F.array().cast("array<double>").alias("weights")
            return dataset.withColumn(out, F.struct(*none))
        counter = CountVectorizerModel.from_vocabulary(terms, self.getInputCol(), "_counts")
        rows = counter.transform(dataset).withColumn("_v", F.unwrap_udt("_counts"))
        idf = _constants(self.getOrDefault("idf"))
        raw = F.zip_with("_v.indices", "_v.values", lambda i, tf: feat.raw_weight(tf, F.get(idf, i)))
        norm = F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda acc, x: acc + x * x))
        rows = rows.withColumn("_raw", raw).withColumn("_norm", norm)
        return rows.withColumn(out, F.struct(F.col("_v.indices").alias("indices"), F.transform("_raw", lambda x: x / F.col("_norm")).alias(
            "weights"))).drop("_counts", "_v", "_raw", "_norm")


class BayesEstimator(Estimator, HasInputCol, HasLabelCol, *_PERSISTED):
    """Multinomial naive Bayes of two classes on ``indices`` and ``weights``; ``size`` is the number of features."""

    size = _param("size", "number of features; 0: those of the vocabulary before it", TypeConverters.toInt)
    alpha = _param("alpha", "smoothing", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol: str = "features", labelCol: str = "label", size: int = 0, alpha: float = 1.0):
        super().__init__()
        self._setDefault(inputCol="features", labelCol="label", size=0, alpha=1.0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "BayesModel":
        x, label, alpha = self.getInputCol(), F.col(self.getLabelCol()), self.getOrDefault("alpha")
        n = {r[0]: r[1] for r in dataset.groupBy(label.cast("int")).count().collect()}  # two rows
        pairs = F.arrays_zip(F.col(f"{x}.indices").alias("i"), F.col(f"{x}.weights").alias("w"))
        sums = dataset.select(label.cast("int").alias("y"), F.explode(pairs).alias("p")).groupBy("p.i").agg(
            *[F.sum(F.when(F.col("y") == y, F.col("p.w")).otherwise(0.0)).alias(f"s{y}") for y in (0, 1)]).collect()  # a row a feature
        size = self.getOrDefault("size") or 1 + max((r.i for r in sums), default=-1)
        theta = []
        for y in (0, 1):
            s = [0.0] * size
            for r in sums:
                s[r.i] = r[f"s{y}"]
            total = sum(s) + alpha * size
            theta.append([_log((v + alpha) / total) for v in s])
        prior = [_log(n.get(y, 0) / max(1, n.get(0, 0) + n.get(1, 0))) for y in (0, 1)]
        return BayesModel(inputCol=x, theta0=theta[0], theta1=theta[1], prior=prior)


class BayesModel(Model, HasInputCol, *_PERSISTED):
    """Adds ``prediction`` (class 0 on a tie) and ``confidence``, its probability; rows without known terms get the prior."""

    theta0 = _param("theta0", "log likelihoods of class 0", TypeConverters.toListFloat)
    theta1 = _param("theta1", "log likelihoods of class 1", TypeConverters.toListFloat)
    prior = _param("prior", "log priors", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol: str = "features", theta0: list[float] = (), theta1: list[float] = (), prior: list[float] = ()):
        super().__init__()
        self._setDefault(inputCol="features", theta0=[], theta1=[], prior=[0.0, 0.0])
        self._set(**{k: list(v) if isinstance(v, tuple) else v for k, v in self._input_kwargs.items()})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x, rows = self.getInputCol(), dataset
        for y in (0, 1):
            parts = F.zip_with(f"{x}.indices", f"{x}.weights", _weighted(self.getOrDefault(f"theta{y}")))
            rows = rows.withColumn(f"l{y}", F.lit(self.getOrDefault("prior")[y]) + F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v))
        return with_decision(rows).drop("l0", "l1")


def _log(v: float) -> float:
    from math import inf, log

    return log(v) if v > 0 else -inf


def text_pipeline(*, text: str = "text", label: str = "label", max_features: int = feat.MAX_FEATURES, steps: list[str] = ()) -> Pipeline:
    """The pipeline from ``text`` to ``prediction`` and ``confidence``; ``steps`` are SQL expressions of ``{c}`` that come first."""
    column, stages = text, []
    for expression in steps:
        stages.append(TextStep(inputCol=column, outputCol="_text", expression=expression))
        column = "_text"
    return Pipeline(stages=[*stages, Tokens(inputCol=column), TfidfEstimator(maxFeatures=max_features), BayesEstimator(labelCol=label)])
