"""Samplers, pruning and search on plain functions, and a search over a fitted model."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import search
from millrace.operators.search import Param

SPACE = {"x": Param(0.0, 10.0), "n": Param(1, 9, whole=True), "r": Param(1e-4, 1e2, log=True), "c": Param(options=("a", "b", "c"))}


def loss(params, fold):
    return (params["x"] - 3) ** 2 + abs(params["n"] - 4) + abs(math.log10(params["r"]) + 1) + ("abc".index(params["c"])) + fold * 0.01


def test_draws_are_digests():
    for trial in range(20):
        got = search.drawn(SPACE, trial, 7)
        u = {k: int(hashlib.md5(f"7:{trial}:{k}".encode()).hexdigest()[:8], 16) / 2**32 for k in SPACE}
        assert got["x"] == pytest.approx(10 * u["x"]) and got["n"] == 1 + int(9 * u["n"]) and got["c"] == "abc"[int(3 * u["c"])]
        assert got["r"] == pytest.approx(10 ** (-4 + 6 * u["r"]))


def test_places_and_values_agree():
    for name in ("x", "r"):
        for u in (0.0, 0.3, 0.999):
            assert SPACE[name].place(SPACE[name].at(u)) == pytest.approx(u)
    assert all(SPACE["n"].at(SPACE["n"].place(v)) == v for v in range(1, 10))
    assert Param(5, 5).place(5) == 0.5


def test_densities_have_unit_mass():
    for places in ([], [0.5], [0.0, 0.1, 0.9], [0.3] * 4):
        assert sum(search.density(places, (i + 0.5) / 4000) for i in range(4000)) / 4000 == pytest.approx(1, abs=1e-3)


def test_densities_find_better_values_than_draws():
    better = 0
    for seed in range(12):
        best = lambda s: min(t.loss for t in search.optimise(SPACE, loss, 40, 2, s, prune=False, seed=seed))  # noqa: B023, E731
        better += best("tpe") < best("random")
    assert better >= 9
    one, two = (search.optimise(SPACE, loss, 12, 2, seed=1) for _ in range(2))
    assert [t.params for t in one] == [t.params for t in two]


def test_trials_worse_than_the_median_are_given_up():
    made = search.optimise(SPACE, loss, 30, 3, "random", seed=2)
    assert 0 < sum(t.pruned for t in made) < 30
    for n, t in enumerate(made):
        for f in range(1, len(t.losses) + 1):
            others = sorted(sum(o.losses[:f]) / f for o in made[:n] if len(o.losses) >= f)
            middle = (others[(len(others) - 1) // 2] + others[len(others) // 2]) / 2 if others else None
            gives_up = f < 3 and len(others) >= 3 and sum(t.losses[:f]) / f > middle
            assert gives_up == (t.pruned and f == len(t.losses))
    whole = search.optimise(SPACE, loss, 30, 3, "random", prune=False, seed=2)
    assert min(t.loss for t in made if not t.pruned) == min(t.loss for t in whole)
    stopped = search.optimise(SPACE, lambda p, f: 1.0, 30, 1, "random", seed=2, stop_after=4)
    assert len(stopped) == 5
    with pytest.raises(ValueError):
        search.optimise(SPACE, loss, 1, 1, "grid")


def test_search_over_a_model(spark):
    df = spark.createDataFrame([(i, float(i % 10), float(i % 10 > 4)) for i in range(120)], "k long, a double, y double")
    out = search.searched(df, "decision_tree_classifier", {"maxDepth": Param(0, 3, whole=True)}, ["a"], "y", "k", trials=4, k=2, sampler="random", prune=False).collect()
    assert [json.loads(r["params"])["maxDepth"] for r in out] == [search.drawn({"maxDepth": Param(0, 3, whole=True)}, n, 42)["maxDepth"] for n in range(4)]
    assert sum(r["best"] for r in out) == 1 and all((r["score"] == 1.0) == (json.loads(r["params"])["maxDepth"] > 0) for r in out)
    curve = search.learning_curve(df.withColumn("y", F.col("a") * 2), "linear_regression", ["a"], "y", "k", (0.2, 1.0)).collect()
    assert [(r["share"], r["n"], r["train"], r["validation"]) for r in curve] == [(0.2, 19, 0.0, 0.0), (1.0, 96, 0.0, 0.0)]
