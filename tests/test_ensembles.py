"""Boosting rounds replayed in numpy, the kernel machine on a ring, and models that keep every row."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import api
from millrace.operators import ensembles, metrics, models


def ring(spark, n=600):
    rng = random.Random(1)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(n)]
    return spark.createDataFrame([(i, a, b, float(a * a + b * b > 1.4)) for i, a, b in rows], "k long, a double, b double, y double")


def test_boosting_rounds_replayed(spark):
    rng = random.Random(2)
    rows = [(i, float(a := rng.randint(0, 9)), float(b := rng.randint(0, 9)), float((a + b > 5) + (a + b > 11))) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y double")
    model = ensembles.ada_boost_classifier(df, ["a", "b"], "y", rounds=6)
    x, y, weight = np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows]), np.ones(300)
    votes = []
    for tree, (error, say) in zip(model.trees, model.rounds, strict=True):
        got = np.array([tree.predict(v) for v in map(spark_vector, x)])
        missed = got != y
        want = (weight * missed).sum() / weight.sum()
        assert error == pytest.approx(want) and say == pytest.approx(math.log((1 - want) / want) + math.log(2))
        weight = weight * np.exp(say * missed)
        votes.append((got, say))
    assert len(votes) == 6
    totals = np.stack([sum(np.where(g == c, s, 0) for g, s in votes) for c in (0, 1, 2)])
    rows = {r["k"]: r["prediction"] for r in model.transform(df).collect()}
    assert [rows[i] for i in range(300)] == totals.argmax(0).tolist()
    assert (totals.argmax(0) == y).mean() > max((g == y).mean() for g, _ in votes)


def spark_vector(row):
    from pyspark.ml.linalg import Vectors

    return Vectors.dense(row)


def test_regression_rounds_replayed(spark):
    rng = random.Random(3)
    rows = [(i, float(a := rng.randint(0, 19)), math.sin(a / 3) * 5 + rng.gauss(0, 0.3)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, a double, y double")
    model = ensembles.ada_boost_regressor(df, ["a"], "y", rounds=5, depth=2)
    x, y, weight, votes = [r[1:2] for r in rows], np.array([r[2] for r in rows]), np.ones(300), []
    for tree, (loss, say) in zip(model.trees, model.rounds, strict=True):
        got = np.array([tree.predict(spark_vector(v)) for v in x])
        off = abs(got - y)
        want = (weight * off).sum() / weight.sum() / off.max()
        assert loss == pytest.approx(want) and say == pytest.approx(math.log((1 - want) / want))
        weight = weight * (want / (1 - want)) ** (1 - off / off.max())
        votes.append((got, say))
    rows = {r["k"]: r["prediction"] for r in model.transform(df).collect()}
    for i in range(300):
        order, reached = sorted((g[i], s) for g, s in votes), 0.0
        half = sum(s for _, s in order) / 2
        for p, s in order:
            reached += s
            if reached >= half:
                break
        assert rows[i] == pytest.approx(p)


def test_boosting_ends_with_a_perfect_or_a_useless_round(spark):
    df = spark.createDataFrame([(float(i), float(i > 4), 1.0) for i in range(10)], "a double, y double, c double")
    assert len(ensembles.ada_boost_classifier(df, ["a"], "y", 5).trees) == 1
    useless = ensembles.ada_boost_classifier(df.where("a > 0 AND a < 9"), ["c"], "y", 5)
    assert len(useless.trees) == 1 and useless.transform(df).count() == 10
    assert len(ensembles.ada_boost_regressor(df, ["a"], "y", 5).trees) == 1


def test_kernel_machine_tells_a_ring(spark):
    df = ring(spark)
    train, test = df.where("k < 400"), df.where("k >= 400")
    model = ensembles.kernel_svc(train, ["a", "b"], "y", "k")
    out = model.transform(test)
    right = out.where("prediction = y").count() / 200
    flat = models.fit(train, "linear_svc", ["a", "b"], "y").transform(test).where("prediction = y").count() / 200
    assert right > 0.9 and right > flat + 0.2
    rows = out.collect()
    brier = sum((r["probability"] - r["y"]) ** 2 for r in rows) / 200
    assert brier < 0.1 and all(0 <= r["probability"] <= 1 for r in rows)
    assert all((r["margin"] > 0) == (r["prediction"] == 1.0) for r in rows)


def test_no_row_is_lost_for_a_missing_feature(spark):
    rows = [(i, None if i % 3 == 0 else float(i % 10), float("nan") if i % 7 == 0 else float(i % 6), float(i % 10 > 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y double")
    model = models.fit(df, "logistic_regression", ["a", "b"], "y")
    assert models.predict(model, df, "k", "y").count() == 200
    out = models.out_of_fold(df, "decision_tree_classifier", ["a", "b"], "y", "k", 3)
    assert out.count() == 200 and out.select("k").distinct().count() == 200
    assert models.stacked(df, ["logistic_regression", "decision_tree_classifier"], "logistic_regression", ["a", "b"], "y", "k", 2).transform is not None


@pytest.mark.parametrize("kind", ["classification", "regression"])
def test_predictions_of_raw_rows_are_those_evaluated(spark, tmp_path, kind):
    rows = [(i, None if i % 3 == 0 else float(i % 10) + 100 * (i == 50), float(i % 7), "FOP"[i % 10 // 4] if kind == "classification" else 2.5 * (i % 10) + 0.25) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y " + ("string" if kind == "classification" else "double"))
    model = "decision_tree_" + ("classifier" if kind == "classification" else "regressor")
    got = api.train(spark, df, "y", "k", model=model)
    assert got.task == kind
    out = got.predict(df.drop("y"))
    assert out.count() == 400 and out.where("prediction IS NULL").isEmpty()
    if kind == "classification":
        assert {r["prediction"] for r in out.select("prediction").distinct().collect()} <= {"F", "O", "P"}
    split = api.split.stratified_split if kind == "classification" else api.split.random_split
    test = split(df, "k", *(["y"] if kind == "classification" else []), 0.7, 0.2, 0.1, 42).where("split = 'test'")
    joined = test.select("k", F.col("y").alias("truth")).join(out, "k")
    want = {r["metric"]: r["value"] for r in metrics.evaluate(joined, kind, "truth", "prediction").collect()}
    assert {r["metric"]: r["value"] for r in got.metrics.collect()} == pytest.approx(want)
    path = api.deploy(got, str(tmp_path / "model"))
    again = api.predicted(api.PipelineModel.load(path), df.drop("y"), "k")
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
    assert len(got.importance()) == 2


def test_waves_of_a_batch_are_one_product(spark):
    """Waves equal numpy's, and no row evaluates them one by one in an interpreted lambda."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(4)
    waves, phases, x = rng.normal(0, 1, (20, 3)), rng.uniform(0, 6, 20), rng.normal(0, 1, (50, 3))
    df = spark.createDataFrame([(n, list(map(float, r))) for n, r in enumerate(x)], "k int, x array<double>")
    out = df.select("k", vector_to_array(ensembles.fourier(array_to_vector("x"), waves, phases)).alias("v"))
    got = np.array([r["v"] for r in out.orderBy("k").collect()])
    assert got == pytest.approx(math.sqrt(2 / 20) * np.cos(x @ waves.T + phases), abs=1e-12)
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString() and out.where("k < 0").count() == 0
