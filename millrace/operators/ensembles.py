"""AdaBoost over MLlib's trees, and a kernel support vector machine by random Fourier features.

Both keep to what Spark fits: weighted trees, a linear machine and a logistic
curve. Boosting writes the rows with their weights once a round, so that a
round's plan doesn't hold all rounds before it.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.storage import drop, stored
from millrace.operators.split import folds

SEED = 42
#: Fits that run side by side.
PARALLEL = 4


def _inputs(df: DataFrame, features: list[str]) -> tuple[PipelineModel, DataFrame]:
    """A fitted stage from features (missing ones take the mean) to ``_features``."""
    known = [f"_known_{n}" for n in range(len(features))]
    model = Pipeline(stages=[Imputer(inputCols=features, outputCols=known), VectorAssembler(inputCols=known, outputCol="_features")]).fit(df)
    return model, model.transform(df)


@dataclass
class Boosted:
    """Trees with their say; ``rounds`` tells each round's (error, say)."""

    inputs: PipelineModel = field(repr=False)
    trees: list = field(repr=False)
    says: list[float]
    rounds: list[tuple[float, float]]
    classes: int  # 0 for a regressor

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``: the class with the most say (of ties the lesser), or the median by say."""
        out, votes = self.inputs.transform(df), []
        for n, t in enumerate(self.trees):
            out = t.copy({t.predictionCol: f"_vote_{n}"}).transform(out).drop("rawPrediction", "probability")
            votes.append(F.struct(F.col(f"_vote_{n}").alias("p"), F.lit(self.says[n]).alias("w")))
        prediction = most_say(votes, self.classes) if self.classes else median_say(votes)
        return out.select(*df.columns, prediction.alias("prediction"))


def most_say(votes: list[Column], classes: int) -> Column:
    say = [reduce(add, (F.when(v["p"] == k, v["w"]).otherwise(F.lit(0.0)) for v in votes)) for k in range(classes)]
    best = F.greatest(*say) if classes > 1 else say[0]
    return F.coalesce(*(F.when(s == best, F.lit(float(k))) for k, s in enumerate(say)))


def median_say(votes: list[Column]) -> Column:
    """The first prediction, from the least on, at which half of all say is reached."""
    ordered, zero = F.array_sort(F.array(*votes)), F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("p"))
    half = F.aggregate(ordered, F.lit(0.0), lambda s, v: s + v["w"]) / 2
    step = lambda s, v: F.struct((s["s"] + v["w"]).alias("s"), F.when(s["p"].isNull() & (s["s"] + v["w"] >= half), v["p"]).otherwise(s["p"]).alias("p"))
    return F.aggregate(ordered, zero, step, lambda s: s["p"])


def _begun(df: DataFrame, features: list[str], label: str) -> tuple[PipelineModel, DataFrame]:
    able = df.where(F.col(label).isNotNull())
    inputs, table = _inputs(able, features)
    return inputs, stored(table.select("_features", F.col(label).cast("double").alias("_label"), F.lit(1.0).alias("_weight")))


def ada_boost_classifier(df: DataFrame, features: list[str], label: str, rounds: int = 50, depth: int = 1, rate: float = 1.0, seed: int = SEED) -> Boosted:
    """Rounds of trees on rows weighted by how often they were missed; labels are 0, 1, ..., for any number of classes.

    A round's say is rate * (ln((1 - e) / e) + ln(classes - 1)) for its weighted error e. It ends with a round that misses
    nothing (whose say is that of an error of 1e-10), or that is no better than chance (which then doesn't count, unless it is the first).
    """
    inputs, table = _begun(df, features, label)
    classes = int((table.agg(F.max("_label").alias("k")).first()["k"] or 0) + 1)
    trees, says, told = [], [], []
    for n in range(rounds):
        tree = C.DecisionTreeClassifier(featuresCol="_features", labelCol="_label", weightCol="_weight", maxDepth=depth, seed=seed + n).fit(table)
        missed = (F.col("prediction") != F.col("_label")).cast("double")
        out = tree.transform(table).drop("rawPrediction", "probability").withColumn("_missed", missed)
        seen = out.agg((F.sum(F.col("_weight") * F.col("_missed")) / F.sum("_weight")).alias("e"), F.sum("_weight").alias("w"), F.count("*").alias("n")).first()
        error = seen["e"] or 0.0
        chance = 1 - 1 / max(classes, 2)
        if error >= chance and trees:
            break
        say = rate * (math.log((1 - max(error, 1e-10)) / max(error, 1e-10)) + math.log(max(classes, 2) - 1)) if error < chance else 1.0
        trees.append(tree)
        says.append(say)
        told.append((error, say))
        if error <= 0 or error >= chance:
            break
        # Weights keep a mean of about one, so that no sum overflows.
        grown = F.col("_weight") * F.exp(F.lit(say) * F.col("_missed"))
        mean = seen["w"] * (1 - error + error * math.exp(say)) / seen["n"]
        before, table = table, stored(out.select("_features", "_label", (grown / mean).alias("_weight")))
        drop(before)
    drop(table)
    return Boosted(inputs, trees, says, told, classes)


def ada_boost_regressor(df: DataFrame, features: list[str], label: str, rounds: int = 50, depth: int = 3, rate: float = 1.0, seed: int = SEED) -> Boosted:
    """Rounds of trees on weighted rows; a row's loss is its error over the largest.

    With mean loss e and b = e / (1 - e), weights are multiplied by b ** (rate * (1 - loss)) and the round's say is rate * ln(1 / b).
    It ends with a round without error or with a mean loss of a half or more (which doesn't count, unless it is the first).
    """
    inputs, table = _begun(df, features, label)
    trees, says, told = [], [], []
    for n in range(rounds):
        tree = R.DecisionTreeRegressor(featuresCol="_features", labelCol="_label", weightCol="_weight", maxDepth=depth, seed=seed + n).fit(table)
        out = tree.transform(table).withColumn("_off", F.abs(F.col("prediction") - F.col("_label")))
        seen = out.agg(F.max("_off").alias("most"), F.sum(F.col("_weight") * F.col("_off")).alias("off"), F.sum("_weight").alias("w"), F.count("*").alias("n")).first()
        most = seen["most"] or 0.0
        loss = seen["off"] / seen["w"] / most if most else 0.0
        if loss >= 0.5 and trees:
            break
        b = max(loss, 1e-10) / (1 - loss) if loss < 0.5 else 0.0
        say = rate * math.log(1 / b) if b else 1.0
        trees.append(tree)
        says.append(say)
        told.append((loss, say))
        if not most or not b:
            break
        grown = F.col("_weight") * F.pow(F.lit(b), rate * (1 - F.col("_off") / most))
        before, table = table, stored(out.select("_features", "_label", (grown * (seen["n"] / seen["w"])).alias("_weight")))
        drop(before)
    drop(table)
    return Boosted(inputs, trees, says, told, 0)


@dataclass
class KernelMachine:
    """Random Fourier features of standardised inputs, a linear machine on them, and a logistic curve over its margins."""

    inputs: PipelineModel = field(repr=False)
    waves: np.ndarray = field(repr=False)
    phases: np.ndarray = field(repr=False)
    machine: object = field(repr=False)
    slope: float
    offset: float

    def mapped(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_waves", fourier(F.col("_unit"), self.waves, self.phases))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with prediction (0.0 or 1.0), margin and probability (of 1)."""
        out = self.machine.transform(self.mapped(self.inputs.transform(df)))
        margin = F.get(vector_to_array("rawPrediction"), F.lit(1))
        chance = 1 / (1 + F.exp(-(self.slope * margin + self.offset)))
        return out.select(*df.columns, "prediction", margin.alias("margin"), chance.alias("probability"))


def fourier(unit: Column, waves: np.ndarray, phases: np.ndarray) -> Column:
    """sqrt(2 / D) cos(w.x + b) for each of D waves; their products near a Gaussian kernel of the inputs as D grows."""
    scale = math.sqrt(2 / len(waves))

    @F.arrow_udf("array<double>")
    def mapped(x: pa.Array) -> pa.Array:
        rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.empty((0, waves.shape[1]))
        out = scale * np.cos(rows @ waves.T + phases)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(waves), pa.int32()), pa.array(out.ravel()))

    return array_to_vector(mapped(vector_to_array(unit)))


def kernel_svc(df: DataFrame, features: list[str], label: str, key: str, components: int = 200, gamma: float | None = None, penalty: float = 0.001, k: int = 3, seed: int = SEED) -> KernelMachine:
    """A support vector classifier (labels 0 and 1) with a Gaussian kernel exp(-gamma |x - y|^2) of standardised features.

    ``gamma`` is one over the number of features by default. The probabilities come from margins that machines give on folds
    that they weren't fitted on. The waves are drawn once, by seed, whatever the rows.
    """
    rng = np.random.default_rng(seed)
    waves = rng.normal(0, math.sqrt(2 * (gamma if gamma is not None else 1 / len(features))), (components, len(features)))
    phases = rng.uniform(0, 2 * math.pi, components)
    able = df.where(F.col(label).isNotNull()).select(key, *features, F.col(label).cast("double").alias("_label"))
    inputs, table = _inputs(able, features)
    scaler = StandardScaler(inputCol="_features", outputCol="_unit", withMean=True, withStd=True).fit(table)
    inputs = PipelineModel([*inputs.stages, scaler])
    # Inputs are few and waves many: rows are stored before they are mapped, and the fits map them as they read.
    rows = stored(folds(able, key, k, seed, "_label"))
    mapped = inputs.transform(rows).withColumn("_waves", fourier(F.col("_unit"), waves, phases))
    svc = C.LinearSVC(featuresCol="_waves", labelCol="_label", regParam=penalty, maxIter=50)

    def margin(n: int) -> DataFrame:
        machine = svc.fit(mapped.where(F.col("fold") != n))
        return machine.transform(mapped.where(F.col("fold") == n)).select("_label", F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("margin"))

    with ThreadPoolExecutor(min(k + 1, PARALLEL)) as pool:
        whole = pool.submit(svc.fit, mapped)
        margins = list(pool.map(margin, range(k)))
        machine = whole.result()
    held = VectorAssembler(inputCols=["margin"], outputCol="_margin").transform(stored(reduce(DataFrame.unionAll, margins)))
    curve = C.LogisticRegression(featuresCol="_margin", labelCol="_label").fit(held)
    return KernelMachine(inputs, waves, phases, machine, float(curve.coefficients[0]), float(curve.intercept))
