"""Ranks, running sums, quantiles and rolling means against plain loops."""

import math
import random

import numpy as np
import pytest

from millrace.operators import metrics, ranges, serving


def bunched(n: int) -> list[float]:
    """Values of which most lie closely around one, with ties."""
    rng = random.Random(3)
    return [1e9 if rng.random() < 0.01 else round(0.5 + rng.gauss(0, 1e-6), 7) for _ in range(n)]


def test_quantiles_equal_numpy(spark):
    a = [None if n % 17 == 0 else v for n, v in enumerate(bunched(3000))]
    b = [float(n % 10) for n in range(3000)]
    df = spark.createDataFrame(list(zip(a, b, [None] * 3000, strict=True)), "a double, b double, c double")
    row = ranges.quantiles(df, ["a", "b", "c"], [0.0, 0.25, 0.5, 0.9, 1.0]).first()
    for got, values in ((row.a, [v for v in a if v is not None]), (row.b, b)):
        assert got == pytest.approx(list(np.quantile(values, [0, 0.25, 0.5, 0.9, 1])), rel=1e-12)
    assert row.c is None
    assert ranges.quantiles(df.limit(0), ["a"], [0.5]).first().a is None
    ends = spark.createDataFrame([(-math.inf,), (1.0,), (math.inf,)], "a double")
    assert ranges.quantiles(ends, ["a"], [0.5, 1.0]).first().a == [1.0, math.inf]


def test_bunched_values_fall_into_many_ranges(spark):
    df = spark.createDataFrame([(v,) for v in bunched(3000)], "a double")
    counts = [r["count"] for r in df.groupBy(ranges.place(df, "a")).count().collect()]
    assert len(counts) > 30 and max(counts) < 400


def test_ranks_in_groups(spark):
    rows = [(n, "xy"[n % 3 == 0] if n % 7 else None, None if n % 11 == 0 else n * 37 % 50) for n in range(400)]
    got = {r.k: r._rank for r in ranges.numbered(spark.createDataFrame(rows, "k int, g string, t int"), ["t", "k"], ["g"]).collect()}
    for g in ("x", "y", None):
        order = sorted((t is not None, t or 0, k) for k, h, t in rows if h == g)
        assert [got[k] for *_, k in order] == list(range(len(order)))


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_rolling_mean_equals_a_loop(spark, width):
    rng = random.Random(5)
    rows = [(n, "ab"[rng.random() < 0.1], n // 3, None if n % 13 == 0 else math.inf if n == 50 else rng.random() * 100) for n in range(500)]
    df = spark.createDataFrame(rows, "k int, g string, t int, v double")
    got = {r.k: r.rolling_mean for r in serving.rolling_mean(df, "v", ["t", "k"], width, ["g"]).collect()}
    assert len(got) == 500
    for g in "ab":
        own = [r for r in rows if r[1] == g]
        for n, (k, *_) in enumerate(own):
            seen = [v for *_, v in own[max(0, n + 1 - width) : n + 1] if v is not None]
            assert got[k] == (pytest.approx(sum(seen) / len(seen)) if seen else None)
    assert serving.rolling_mean(df.limit(0), "v", ["t", "k"], width).count() == 0


def test_quantiles_in_brackets_equal_numpy(spark):
    """More values than the accuracy, so that only those near each quantile are gathered."""
    rng = random.Random(8)
    a = [rng.gauss(0, 1) for _ in range(40_000)]
    b = [float(rng.randrange(5)) for _ in range(40_000)]
    c = [rng.random() ** 9 if n % 2 else None for n in range(40_000)]
    df = spark.createDataFrame(list(zip(a, b, c, strict=True)), "a double, b double, c double").repartition(4)
    shares = [0.0, 0.001, 0.25, 0.5, 0.77, 1.0]
    row = ranges.quantiles(df, ["a", "b", "c"], shares).first()
    for got, values in ((row.a, a), (row.b, b), (row.c, [v for v in c if v is not None])):
        assert got == pytest.approx(list(np.quantile(values, shares)), rel=1e-12)


def pairs_of(rows, scores=3):
    """(label, is, score) of each row and class, as plain tuples, and those of all classes as micro."""
    each = [(c, y == c, s[n]) for y, *s in rows for n, c in enumerate("FOP"[:scores])]
    return each + [("micro", p, s) for _, p, s in each]


def test_curves_and_areas_of_classes_equal_a_loop(spark):
    """Ties within and between classes, a score that most rows share, missing truths."""
    rng = random.Random(11)
    score = lambda: 0.5 if rng.random() < 0.6 else round(rng.random(), 2)
    rows = [(None if n % 17 == 0 else "FOP"[n % 3], score(), score(), score()) for n in range(700)]
    df = spark.createDataFrame(rows, "y string, s0 double, s1 double, s2 double")
    want, areas = {}, {}
    for label in ("F", "O", "P", "micro"):
        own = [(s, p) for c, p, s in pairs_of(rows) if c == label]
        pos, neg = [s for s, p in own if p], [s for s, p in own if not p]
        for t in {s for s, _ in own}:
            want[label, t] = (round(sum(s >= t for s in pos) / len(pos), 6), round(sum(s >= t for s in neg) / len(neg), 6))
        areas[label] = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    got = metrics.roc_curve_ovr(df, "y", list("FOP"), ["s0", "s1", "s2"]).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.tpr, r.fpr) == pytest.approx(want[r.label, r.threshold], abs=2e-6)
    auc = {r.average: r.auc for r in metrics.auc_ovr(df, "y", list("FOP"), ["s0", "s1", "s2"]).collect()}
    assert auc["micro"] == pytest.approx(areas["micro"], abs=2e-6) and auc["macro"] == pytest.approx(sum(areas[c] for c in "FOP") / 3, abs=2e-6)
    none = metrics.auc_ovr(df.limit(0), "y", list("FOP"), ["s0", "s1", "s2"]).collect()
    assert [(r.average, r.auc) for r in none] == [("macro", None), ("micro", None)]


def test_ranges_are_found_without_sorting_the_cuts(spark):
    """No row sorts the cuts, and the pairs of classes are grouped by score once, whatever is read from them."""
    df = spark.createDataFrame([("F", 0.1, 0.2, 0.3)], "y string, s0 double, s1 double, s2 double")
    for made in (metrics.roc_curve_ovr, metrics.auc_ovr):
        plan = made(df, "y", list("FOP"), ["s0", "s1", "s2"])._jdf.queryExecution().optimizedPlan().toString()
        assert "sort_array" not in plan
        assert sum("Aggregate [label" in line and " score#" in line.split("],")[0] for line in plan.splitlines()) == 1


def test_the_place_is_the_number_of_cuts_below(spark):
    values = [None, -math.inf, -1.0, 0.0, 0.0, 5.0, math.inf, math.nan] + [float(n) for n in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "a double")
    rows = ranges.placed(df.withColumn("column", ranges.place(df, "a")), "a").collect()
    assert all(r["column"] == r["_range"] for r in rows)
    held = sorted((r for r in rows if r["a"] is not None and not math.isnan(r["a"])), key=lambda r: r["a"])
    assert [r["_range"] for r in held] == sorted(r["_range"] for r in held) and len({r["_range"] for r in held}) > 200
    assert [r["_range"] for r in rows if r["a"] is None] == [0]
