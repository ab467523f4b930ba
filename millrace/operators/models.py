"""A registry of Spark ML estimators, automatic choice, cross-validation and stacking."""

from __future__ import annotations

import itertools
import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import HashingTF, IDF, Imputer, PCA, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.storage import stored
from millrace.operators import metrics
from millrace.operators.split import folds

SEED = 42
#: Fits that run side by side.
PARALLEL = 4


@dataclass(frozen=True)
class Entry:
    """A model that may be chosen: tasks, priority, and the sample counts that it suits."""

    name: str
    tasks: tuple[str, ...]
    priority: int
    make: object
    least: int = 0
    most: int | None = None
    tags: tuple[str, ...] = ()


def _clf(cls, **params):
    return lambda features, label: cls(featuresCol=features, labelCol=label, **params)


def _boosted(features: str, label: str) -> Estimator:
    """One against the rest, so that any number of classes will do; classes are fitted side by side."""
    return C.OneVsRest(classifier=C.GBTClassifier(maxIter=100, stepSize=0.1, maxDepth=3, seed=SEED), featuresCol=features, labelCol=label, parallelism=4)


REGISTRY = {
    e.name: e
    for e in (
        Entry("random_forest_classifier", ("classification",), 8, _clf(C.RandomForestClassifier, numTrees=100, seed=SEED), tags=("tree",)),
        Entry("logistic_regression", ("classification",), 6, _clf(C.LogisticRegression, maxIter=100), tags=("linear",)),
        Entry("linear_svc", ("classification",), 5, _clf(C.LinearSVC), tags=("linear", "binary")),
        Entry("decision_tree_classifier", ("classification",), 4, _clf(C.DecisionTreeClassifier, seed=SEED), tags=("tree",)),
        Entry("naive_bayes", ("classification",), 3, _clf(C.NaiveBayes, modelType="gaussian"), tags=("bayes",)),
        Entry("multinomial_naive_bayes", ("classification",), 2, _clf(C.NaiveBayes, modelType="multinomial"), tags=("bayes", "counts")),
        Entry("bernoulli_naive_bayes", ("classification",), 2, _clf(C.NaiveBayes, modelType="bernoulli"), tags=("bayes", "flags")),
        Entry("factorization_machine_classifier", ("classification",), 1, _clf(C.FMClassifier, seed=SEED), tags=("factors", "binary")),
        Entry("gradient_boosting_classifier", ("classification",), 7, _boosted, least=100, tags=("tree",)),
        Entry("random_forest_regressor", ("regression",), 8, _clf(R.RandomForestRegressor, numTrees=100, seed=SEED), tags=("tree",)),
        Entry("gradient_boosting_regressor", ("regression",), 7, _clf(R.GBTRegressor, maxIter=100, stepSize=0.1, maxDepth=3, seed=SEED), least=100, tags=("tree",)),
        Entry("linear_regression", ("regression",), 6, _clf(R.LinearRegression, solver="normal"), tags=("linear",)),
        Entry("ridge", ("regression",), 5, _clf(R.LinearRegression, regParam=1.0, elasticNetParam=0.0), tags=("linear",)),
        Entry("lasso", ("regression",), 4, _clf(R.LinearRegression, regParam=0.1, elasticNetParam=1.0), tags=("linear",)),
        Entry("elastic_net", ("regression",), 4, _clf(R.LinearRegression, regParam=0.1, elasticNetParam=0.5), tags=("linear",)),
        Entry("huber_regressor", ("regression",), 4, _clf(R.LinearRegression, loss="huber", epsilon=1.35), tags=("linear",)),
        Entry("poisson_regressor", ("regression",), 2, _clf(R.GeneralizedLinearRegression, family="poisson", link="log"), tags=("linear", "counts")),
        Entry("isotonic_regression", ("regression",), 1, _clf(R.IsotonicRegression), tags=("monotone",)),
        Entry("decision_tree_regressor", ("regression",), 3, _clf(R.DecisionTreeRegressor, seed=SEED), tags=("tree",)),
    )
}


def register(entry: Entry) -> None:
    """Adds a model, or replaces the one of its name."""
    REGISTRY[entry.name] = entry


def registry_table(spark: SparkSession) -> DataFrame:
    rows = [(e.name, list(e.tasks), e.priority, list(e.tags), e.least, e.most, n) for n, e in enumerate(REGISTRY.values())]
    return spark.createDataFrame(rows, "name string, tasks array<string>, priority int, tags array<string>, least bigint, most bigint, place int")


def list_models(registry: DataFrame, task: str | None = None, tag: str | None = None) -> DataFrame:
    out = registry
    out = out.where(F.array_contains("tasks", task)) if task else out
    return out.where(F.array_contains("tags", tag)) if tag else out


def ranked_models(registry: DataFrame, task: str, samples: int, prefer: str | None = None) -> DataFrame:
    """(name, score) of suitable models: the priority, and 10 for the preferred tag; of ties the first registered leads."""
    able = list_models(registry, task).where((F.col("least") <= samples) & (F.col("most").isNull() | (F.col("most") >= samples)))
    score = F.col("priority") + (F.when(F.array_contains("tags", prefer), 10).otherwise(0) if prefer else F.lit(0))
    return able.select("name", score.alias("score"), "place").orderBy(F.desc("score"), "place").select("name", "score")


def registry_stats(registry: DataFrame) -> DataFrame:
    """(kind, value, n): models by task and by tag."""
    task = registry.select(F.lit("task").alias("kind"), F.explode("tasks").alias("value"))
    tag = registry.select(F.lit("tag").alias("kind"), F.explode("tags").alias("value"))
    return task.unionAll(tag).groupBy("kind", "value").agg(F.count("*").alias("n"))


def pipeline(name: str, features: list[str], label: str) -> Pipeline:
    """Missing features take their column's mean in the fitted data, so that no row is lost; then the model of that name."""
    known = [f"_known_{n}" for n in range(len(features))]
    filled = Imputer(inputCols=features, outputCols=known, strategy="mean")
    assembled = VectorAssembler(inputCols=known, outputCol="_features")
    return Pipeline(stages=[filled, assembled, REGISTRY[name].make("_features", label)])


def fit(df: DataFrame, name: str, features: list[str], label: str) -> PipelineModel:
    return pipeline(name, features, label).fit(df)


def text_classifier(text: str, label: str, features: int = 1 << 14) -> Pipeline:
    """Words, hashed counts, inverse document frequency, logistic regression."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[\p{L}\p{N}_]+", gaps=False),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_features"),
        C.LogisticRegression(featuresCol="_features", labelCol=label, maxIter=20),
    ])


def predict(model: PipelineModel, df: DataFrame, key: str, label: str | None = None) -> DataFrame:
    """(key, label, prediction, probability array where the model gives one)."""
    out = model.transform(df)
    columns = [key, *([label] if label else []), "prediction"]
    return out.select(*columns, vector_to_array("probability").alias("probability")) if "probability" in out.columns else out.select(*columns)


def importance(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Tree importances, or the mean absolute coefficient over classes."""
    last = next(s for s in reversed(model.stages) if any(hasattr(s, a) for a in ("featureImportances", "coefficientMatrix", "coefficients")))
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif hasattr(last, "coefficientMatrix"):
        values = abs(last.coefficientMatrix.toArray()).mean(0)
    else:
        values = abs(last.coefficients.toArray())
    return list(zip(features, map(float, values), strict=True))


def folded(df: DataFrame, key: str, k: int, features: list[str], label: str, stratify: bool) -> DataFrame:
    """(key, label, features, fold), ranked once and stored, so that no fit ranks or reads the table again."""
    return stored(folds(df.select(*dict.fromkeys([key, label, *features])), key, k, SEED, label if stratify else None))


def out_of_fold(df: DataFrame, name: str, features: list[str], label: str, key: str, k: int = 5, stratify: bool = True) -> DataFrame:
    """(key, label, fold, prediction[, probability]): each fold by a model that was fitted without it."""
    return predicted_by_fold(folded(df, key, k, features, label, stratify), name, features, label, key, k)


def predicted_by_fold(table: DataFrame, name: str, features: list[str], label: str, key: str, k: int) -> DataFrame:
    """As ``out_of_fold`` of a table that has folds; the fits run side by side."""

    def one(n: int) -> DataFrame:
        part = fit(table.where(F.col("fold") != n), name, features, label).transform(table.where(F.col("fold") == n))
        extra = [vector_to_array("probability").alias("probability")] if "probability" in part.columns else []
        return part.select(key, label, "fold", "prediction", *extra)

    with ThreadPoolExecutor(min(k, PARALLEL)) as pool:
        return reduce(DataFrame.unionAll, pool.map(one, range(k)))


def cross_validated(df: DataFrame, name: str, features: list[str], label: str, key: str, k: int = 5) -> DataFrame:
    """The table of metrics (mean, deviation, interval, ...) over folds, each scored by a model that was fitted without it."""
    task = REGISTRY[name].tasks[0]
    out = out_of_fold(df, name, features, label, key, k, stratify=task == "classification")
    return metrics.cv_summary(metrics.by_fold(out, task, label, "prediction"))


def searched(df: DataFrame, name: str, grid: dict[str, list], features: list[str], label: str, key: str, k: int = 5) -> DataFrame:
    """(params, metric, score, best): every combination of ``grid``'s values, by the mean over folds of RMSE or F1.

    The folds are the seeded ones of ``folds``; of equal scores the combination named first is best.
    """
    task = REGISTRY[name].tasks[0]
    table = folded(df, key, k, features, label, task == "classification")
    pipe = pipeline(name, features, label)
    combos = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    model = pipe.getStages()[-1]
    maps = [{model.getParam(p): v for p, v in c.items()} for c in combos]
    metric, judge = ("rmse", RegressionEvaluator(labelCol=label, metricName="rmse")) if task == "regression" else ("f1", MulticlassClassificationEvaluator(labelCol=label, metricName="f1"))
    judged = CrossValidator(estimator=pipe, estimatorParamMaps=maps, evaluator=judge, numFolds=k, foldCol="fold", parallelism=PARALLEL, seed=SEED).fit(table)
    scores = [float(v) for v in judged.avgMetrics]
    best = (max if judge.isLargerBetter() else min)(range(len(scores)), key=lambda n: scores[n])
    rows = [(json.dumps(c), metric, v, n == best) for n, (c, v) in enumerate(zip(combos, scores, strict=True))]
    return df.sparkSession.createDataFrame(rows, "params string, metric string, score double, best boolean")


def stacked(df: DataFrame, bases: list[str], meta: str, features: list[str], label: str, key: str, k: int = 5) -> PipelineModel:
    """The meta model on the bases' out-of-fold predictions."""
    parted = folded(df, key, k, features, label, stratify=True)
    table = parted.select(key, label)
    for b in bases:
        table = table.join(predicted_by_fold(parted, b, features, label, key, k).select(key, F.col("prediction").alias(b)), key)
    return fit(stored(table), meta, bases, label)


def clusters(df: DataFrame, features: list[str], k: int) -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features"), KMeans(featuresCol="_features", k=k, seed=SEED)]).fit(df)


def components(df: DataFrame, features: list[str], k: int) -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features"), PCA(k=k, inputCol="_features", outputCol="components")]).fit(df)
