"""Rounds and folds of the fitted models."""

import os

import pytest

from millrace.operators import models
from millrace.plans import catalogue

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_boosted_classifier_has_as_many_rounds_as_the_regressor(spark):
    boosted = models.REGISTRY["gradient_boosting_classifier"].make("x", "y").getClassifier()
    assert (boosted.getMaxIter(), boosted.getStepSize(), boosted.getMaxDepth()) == (100, 0.1, 3)
    assert models.REGISTRY["gradient_boosting_regressor"].make("x", "y").getMaxIter() == 100


@pytest.mark.parametrize("name", ["fit_random_forest", "fit_logistic", "stacking"])
def test_queries_fit_on_five_folds(spark, monkeypatch, name):
    def stop(df, key, k, *rest):
        raise StopIteration(k)

    monkeypatch.setattr(models, "folds", stop)
    with pytest.raises(StopIteration) as asked:
        catalogue.QUERIES[name](spark, SF_DIR)
    assert asked.value.value == 5


def test_metrics_of_each_fold_equal_a_plain_count(spark):
    from millrace.operators import metrics

    rows = [(n % 3, "abc"[n * 7 % 3], "abc"[n * 5 % 4 % 3]) for n in range(60)] + [(0, None, "a"), (1, "b", None)]
    got = {(r["fold"], r["metric"]): r["value"] for r in metrics.by_fold(spark.createDataFrame(rows, "fold int, y string, p string"), "classification", "y", "p").collect()}
    for fold in range(3):
        pairs = [(y, p) for f, y, p in rows if f == fold and y and p]
        mean = {"accuracy": sum(y == p for y, p in pairs) / len(pairs), "precision": 0.0, "recall": 0.0, "f1": 0.0}
        for c in {y for y, _ in pairs}:
            hit, support, predicted = sum(y == p == c for y, p in pairs), sum(y == c for y, _ in pairs), sum(p == c for _, p in pairs)
            share = support / len(pairs)
            mean["precision"] += share * (hit / predicted if predicted else 0)
            mean["recall"] += share * hit / support
            mean["f1"] += share * 2 * hit / (predicted + support)
        for metric, value in mean.items():
            assert got[fold, metric] == pytest.approx(value)
    assert metrics.by_fold(spark.createDataFrame([], "fold int, y double, p double"), "regression", "y", "p").count() == 0
