"""From a table or a path to a fitted, evaluated model: ``train`` and ``deploy``.

The table is split first. What imputation and clipping learn from the training
part, and the classes' names, are stages of the saved pipeline: it takes raw rows
and gives what was evaluated, and the test part alone is evaluated.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import nan_to_null, numeric_columns
from millrace.functions.storage import stored
from millrace.operators import metrics, models, quality, split
from millrace.sources.readers import DataNotFound, EngineError, read

#: A numeric target with more distinct values than this is regressed.
CLASSES_AT_MOST = 20


class TaskError(EngineError):
    """The task can't be told, or doesn't suit the target."""


@dataclass
class TrainedModel:
    """A fitted pipeline with what is needed to use it."""

    task: str
    name: str
    features: list[str]
    target: str
    key: str
    pipeline: PipelineModel = field(repr=False)
    metrics: DataFrame = field(repr=False)
    issues: DataFrame = field(repr=False)

    def predict(self, df: DataFrame) -> DataFrame:
        """(key, prediction[, probability]) of raw rows, one for each; a class is given by its name, probabilities in the order of the names."""
        return predicted(self.pipeline, df, self.key)

    def save(self, path: str) -> None:
        self.pipeline.write().save(path)

    def importance(self) -> list[tuple[str, float]]:
        return models.importance(self.pipeline, self.features)


def detect_task(df: DataFrame, target: str) -> str:
    """``regression`` for a numeric target with a fraction or with many values, else ``classification``."""
    kind = df.schema[target].dataType
    if not isinstance(kind, T.NumericType):
        return "classification"
    y = F.col(target).cast("double")
    seen = df.agg(F.countDistinct(y).alias("n"), F.count_if(y != F.floor(y)).alias("parts")).first()
    return "regression" if seen.n > CLASSES_AT_MOST or seen.parts else "classification"


def predicted(pipeline: PipelineModel, df: DataFrame, key: str) -> DataFrame:
    """What a pipeline of ``train``, also one loaded again, makes of raw rows."""
    named = isinstance(pipeline.stages[-1], IndexToString)
    out = pipeline.transform(df)
    chance = [vector_to_array("probability").alias("probability")] if "probability" in out.columns else []
    return out.select(key, F.col("_named" if named else "prediction").alias("prediction"), *chance)


def _number(value: float | None, missing: float) -> str:
    return f"CAST('{missing if value is None else float(value)!r}' AS DOUBLE)"


def prepared(base: DataFrame, features: list[str], clip_outliers: bool) -> SQLTransformer:
    """A stage that fills each feature with its mean in ``base`` and holds it within the fences of the filled ``base``; one row of numbers is collected."""
    means = base.agg(*(F.avg(f).alias(f) for f in features)).first()
    filled = base.select(*(F.coalesce(F.col(f), F.lit(means[f]), F.lit(0.0)).alias(f) for f in features))
    ends = quality.fences(filled, features, 1.5).first() if clip_outliers else {}
    each = []
    for n, f in enumerate(features):
        quoted = "`" + f.replace("`", "``") + "`"
        # NaN is missing, as it is on reading.
        value = f"coalesce(nullif(CAST({quoted} AS DOUBLE), CAST('NaN' AS DOUBLE)), {_number(means[f], 0.0)})"
        if clip_outliers:
            value = f"greatest({_number(ends[f'lo_{f}'], float('-inf'))}, least({_number(ends[f'hi_{f}'], float('inf'))}, {value}))"
        each.append(f"{value} AS _ready_{n}")
    return SQLTransformer(statement=f"SELECT *, {', '.join(each)} FROM __THIS__")


def train(
    spark: SparkSession, data: DataFrame | str, target: str, key: str, task: str = "auto", model: str = "auto",
    features: list[str] | None = None, validation: float = 0.2, test: float = 0.1, seed: int = 42, clip_outliers: bool = True,
) -> TrainedModel:
    """Load, check, split, clean, fit, evaluate."""
    df = read(spark, data, "tabular") if isinstance(data, str) else data
    for c in (target, key):
        if c not in df.columns:
            raise DataNotFound(f"no column {c!r} among {df.columns}")
    df = df.where(F.col(target).isNotNull())
    task = detect_task(df, target) if task == "auto" else task
    if task not in ("classification", "regression"):
        raise TaskError(f"no task {task!r} for tables")
    features = features or [c for c in numeric_columns(df) if c not in (target, key)]
    issues = quality.missing(df, features).unionAll(quality.infinite(df, features)).unionAll(quality.constant(df, features))
    ratios = (1 - validation - test, validation, test)
    parts = split.stratified_split(df, key, target, *ratios, seed) if task == "classification" else split.random_split(df, key, *ratios, seed)
    parts = stored(nan_to_null(parts.select(key, target, "split", *(F.col(f).cast("double").alias(f) for f in features))))
    base = parts.where("split = 'train'")
    name = model
    if model == "auto":
        name = models.ranked_models(models.registry_table(spark), task, base.count()).first()["name"]
    ready = [f"_ready_{n}" for n in range(len(features))]
    stages = [prepared(base, features, clip_outliers), VectorAssembler(inputCols=ready, outputCol="_features"), models.REGISTRY[name].make("_features", "_label")]
    learn, truth = base.withColumn("_label", F.col(target).cast("double")), F.col(target)
    if task == "classification":
        learn = base.withColumn("_class", F.col(target).cast("string"))
        index = StringIndexer(inputCol="_class", outputCol="_label", stringOrderType="alphabetAsc").fit(learn)
        learn, truth = index.transform(learn), F.col(target).cast("string")
        stages.append(IndexToString(inputCol="prediction", outputCol="_named", labels=index.labels))
    fit = Pipeline(stages=stages).fit(learn.drop("_class"))
    scored = predicted(fit, parts.where("split = 'test'").withColumn("_key", F.struct(F.col(key), truth.alias("truth"))), "_key")
    scored = stored(scored.select(F.col(f"_key.{key}").alias(key), "_key.truth", "prediction"))
    return TrainedModel(task, name, features, target, key, fit, metrics.evaluate(scored, task, "truth", "prediction"), issues)


def deploy(trained: TrainedModel, path: str) -> str:
    """The fitted pipeline where ``PipelineModel.load`` finds it."""
    trained.save(path)
    return path
