"""Choice and training of the match classifier on similarity vectors.

Families: a linear SVM, an SVM on random Fourier features (an approximation of the RBF kernel, which Spark ML lacks) and a
decision tree, each with classes weighted to balance and cross-validated over a grid. SVM margins get a logistic step,
so that every family gives probabilities.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import partial

import numpy as np
from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COSTS = (0.1, 1.0, 10.0, 100.0, 1000.0)
ROWS = 20_000  # training pairs of a partition
FITS = 8  # at a time


class RandomFourier(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """cos(w x + b) of an input vector for ``size`` random directions: column expressions only."""

    size = Param(Params._dummy(), "size", "number of features")
    inputs = Param(Params._dummy(), "inputs", "length of the input vector")
    gamma = Param(Params._dummy(), "gamma", "RBF kernel width")
    seed = Param(Params._dummy(), "seed", "seed of the directions")

    @keyword_only
    def __init__(self, inputCol="simvec", outputCol="fourier", inputs=1, size=64, gamma=1.0, seed=3):
        super().__init__()
        self._setDefault(inputCol="simvec", outputCol="fourier", size=64, gamma=1.0, seed=3, inputs=1)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        n, d = self.getOrDefault(self.size), self.getOrDefault(self.inputs)
        rng = np.random.default_rng(self.getOrDefault(self.seed))
        w = rng.normal(0, (2 * self.getOrDefault(self.gamma)) ** 0.5, (n, d))
        b = rng.uniform(0, 2 * np.pi, n)
        x = F.col(self.getInputCol())
        out = [F.cos(sum((x[j] * float(w[i, j]) for j in range(d)), F.lit(float(b[i])))) * (2 / n) ** 0.5 for i in range(n)]
        return df.withColumn(self.getOutputCol(), F.array(*out))


class ToVector(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCol="simvec", outputCol="features"):
        super().__init__()
        self._setDefault(inputCol="simvec", outputCol="features")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), array_to_vector(self.getInputCol()))


class Margin(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The SVM's margin as a vector of one number, for the logistic step."""

    @keyword_only
    def __init__(self, inputCol="rawPrediction", outputCol="margin"):
        super().__init__()
        self._setDefault(inputCol="rawPrediction", outputCol="margin")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), array_to_vector(F.array(vector_to_array(self.getInputCol())[1])))


def _evaluator(scoring: str) -> MulticlassClassificationEvaluator:
    names = {"f1": "fMeasureByLabel", "precision": "precisionByLabel", "recall": "recallByLabel", "accuracy": "accuracy"}
    return MulticlassClassificationEvaluator(metricName=names[scoring], metricLabel=1.0, labelCol="label")


def balanced(df: DataFrame) -> DataFrame:
    counts = {r.label: r["count"] for r in df.groupBy("label").count().collect()}
    weight = F.lit(1.0)
    for label, n in counts.items():
        weight = F.when(F.col("label") == label, sum(counts.values()) / (len(counts) * n)).otherwise(weight)
    return df.withColumn("weight", weight)


def best_model(train: DataFrame, fields: int, families=("linear", "rbf", "tree"), scoring="f1", folds=3, seed=17, costs=COSTS) -> tuple[str, PipelineModel]:
    """The first family with the highest cross-validated score, trained on all of ``train`` (simvec, label)."""
    made = train.select("simvec", F.col("label").cast("double").alias("label")).persist()
    df = balanced(made)
    least = df.groupBy("label").count().agg(F.min("count"), F.count("*")).first()
    if least[1] < 2:
        raise ValueError("training pairs of both classes are needed")
    folds = max(2, min(folds, least[0]))  # every fold has both classes
    deal = Window.partitionBy("label").orderBy(F.xxhash64("simvec", F.lit(seed)), "simvec")
    df = df.withColumn("fold", F.pmod(F.row_number().over(deal), F.lit(folds)).cast("int"))
    n = max(1, made.count())
    df = df.coalesce(-(-n // ROWS)).cache()  # each step of an optimiser is a job with a task a partition
    df.count()
    made.unpersist()
    ready, tried = {}, []
    for family in families:
        if family == "tree":
            model = DecisionTreeClassifier(weightCol="weight", seed=seed)
            grid = ParamGridBuilder().addGrid(model.maxDepth, [2, 5, 8]).build()
            steps = [ToVector()]
        else:
            model = LinearSVC(weightCol="weight", maxIter=50)
            grid = ParamGridBuilder().addGrid(model.regParam, [1 / (c * n) for c in costs]).build()
            steps = [RandomFourier(inputs=fields), ToVector(inputCol="fourier")] if family == "rbf" else [ToVector()]
        ready[family] = Pipeline(stages=steps).fit(df)
        tried += [(family, model.copy(params)) for params in grid]
    scores = cross_validated([(model, ready[family].transform(df)) for family, model in tried], folds, _evaluator(scoring))
    family, model = tried[int(np.argmax(scores))]
    made = ready[family].transform(df)
    found = model.fit(made)
    parts = [*ready[family].stages, found]
    if family != "tree":
        margins = Margin().transform(found.transform(made)).select("margin", "label", "weight")
        platt = LogisticRegression(featuresCol="margin", weightCol="weight", rawPredictionCol="logit", predictionCol="platt").fit(margins)
        parts += [Margin(), platt]
    df.unpersist()
    return family, PipelineModel(stages=parts)


def cross_validated(models: list, folds: int, evaluator: MulticlassClassificationEvaluator) -> list[float]:
    """The mean score over folds (column ``fold``) of each estimator with its table. Fits are small jobs that wait on the driver, so that
    several run at a time, of all estimators and folds together."""

    def score(model, df, i):
        return evaluator.evaluate(model.fit(df.where(F.col("fold") != i)).transform(df.where(F.col("fold") == i)))

    each = [inheritable_thread_target(df.sparkSession)(partial(score, model, df, i)) for model, df in models for i in range(folds)]
    with ThreadPoolExecutor(FITS) as pool:
        got = list(pool.map(lambda run: run(), each))
    return [float(np.mean(got[k : k + folds])) for k in range(0, len(got), folds)]


def classify(model: PipelineModel, vectors: DataFrame) -> DataFrame:
    """``vectors`` with ``match`` (0/1) and ``probability`` of a match."""
    got = model.transform(vectors)
    return got.select(*vectors.columns, F.col("prediction").cast("int").alias("match"), vector_to_array("probability")[1].alias("probability"))
