"""Outlier forests, clustering scores, feature selection, forecasts and decomposition against plain loops, and on odd inputs."""

import datetime
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import special
from millrace.operators import anomaly, clustering, forecast, selection

DAY = datetime.datetime(2020, 1, 1)


# Isolation forest


def plain_tree(rows, tree, seed, height, node=1, level=0):
    """Nested (feature, cut, left, right), or the path length of a leaf."""
    varied = [f for f in range(len(rows[0])) if max(r[f] for r in rows) > min(r[f] for r in rows)]
    if level == height or not varied:
        n = len(rows)
        return level + (0 if n == 1 else 1 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n)
    d = hashlib.md5(f"{seed}:{tree}:{node}".encode()).hexdigest()
    f = varied[int(d[:8], 16) % len(varied)]
    low, high = min(r[f] for r in rows), max(r[f] for r in rows)
    cut = low + (high - low) * (int(d[8:16], 16) / 2**32)
    parts = [r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]
    return f, cut, *(plain_tree(p, tree, seed, height, 2 * node + n, level + 1) for n, p in enumerate(parts))


def plain_path(tree, row):
    while isinstance(tree, tuple):
        tree = tree[3] if row[tree[0]] > tree[1] else tree[2]
    return tree


def test_forest_agrees_with_plain_trees_and_finds_planted_outliers(spark):
    rng = random.Random(1)
    rows = [(n, rng.gauss(0, 1), rng.gauss(5, 2), 1.0) for n in range(3000)] + [(n, 9.0 + rng.random(), -9.0 - rng.random(), 1.0) for n in range(3000, 3030)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double").repartition(5)
    out = {r["k"]: r for r in anomaly.flagged(df, ["a", "b", "c"], F.col("k"), trees=20, sample=64).collect()}
    order = sorted(rows, key=lambda r: (hashlib.md5(f"42:{r[0]}".encode()).hexdigest(), r[0]))[: 20 * 64]
    trees = [plain_tree([r[1:] for r in order[t * 64 : t * 64 + 64]], t, 42, 6) for t in range(20)]
    for r in rows:
        want = 2 ** (-sum(plain_path(t, r[1:]) for t in trees) / 20 / anomaly.expected_path(64))
        assert out[r[0]]["score"] == pytest.approx(want, abs=1e-12)
        assert out[r[0]]["outlier"] == (out[r[0]]["score"] > 0.5)
    assert sum(out[n]["outlier"] for n in range(3000, 3030)) >= 27
    share = anomaly.flagged(df, ["a", "b", "c"], F.col("k"), contamination=0.01, trees=20, sample=64).where("outlier")
    found = {r["k"] for r in share.collect()}
    assert 28 <= len(found) <= 31 and len(found & set(range(3000, 3030))) >= 27


def test_forest_on_odd_rows(spark):
    rows = [(1, 1.0, None), (2, float("nan"), 1.0), (3, float("inf"), 1.0), (4, 1.0, 2.0), (5, 1.0, 2.0), (None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    out = {r["k"]: (r["score"], r["outlier"]) for r in anomaly.flagged(df, ["a", "b"], F.col("k")).collect()}
    assert [out[k] for k in (1, 2, 3)] == [(None, False)] * 3
    assert out[4] == out[5] == out[None] and out[4][0] == pytest.approx(0.5)
    assert anomaly.flagged(df.where("false"), ["a", "b"], F.col("k")).count() == 0


# Clustering scores


def test_clustering_scores_against_all_pairs(spark):
    rng = random.Random(2)
    points = [(n, "ab"[n % 2] if n < 40 else "c", rng.gauss(n % 2 * 3, 1), rng.gauss(0, 1)) for n in range(41)]
    df = spark.createDataFrame([*points, (99, None, 1.0, 1.0), (98, "a", None, 1.0)], "k long, c string, x double, y double")
    d2 = lambda p, q: (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2
    want = {}
    for p in points:
        means = {}
        for c in "abc":
            others = [d2(p, q) for q in points if q[1] == c and q[0] != p[0]]
            means[c] = sum(others) / len(others) if others else None
        a, b = means[p[1]], min(v for c, v in means.items() if c != p[1] and v is not None)
        want.setdefault(p[1], []).append(0.0 if a is None else (b - a) / max(a, b))
    got = {r["cluster"]: (r["n"], r["silhouette"]) for r in clustering.silhouette(df, ["x", "y"], "c").collect()}
    for c, v in want.items():
        assert got[c] == (len(v), pytest.approx(sum(v) / len(v), abs=1e-6))
    assert got[None][0] == 41 and got[None][1] == pytest.approx(sum(map(sum, want.values())) / 41, abs=1e-6)
    x = np.array([p[2:] for p in points])
    of = np.array([p[1] for p in points])
    within = sum(((x[of == c] - x[of == c].mean(0)) ** 2).sum() for c in "abc")
    between = ((x - x.mean(0)) ** 2).sum() - within
    r = clustering.spread(df, ["x", "y"], "c").first()
    assert (r["clusters"], r["n"]) == (3, 41) and r["calinski_harabasz"] == pytest.approx((between / 2) / (within / 38), abs=1e-3)


def test_clustering_scores_without_another_cluster(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "c string, x double")
    assert {(r["cluster"], r["silhouette"]) for r in clustering.silhouette(df, ["x"], "c").collect()} == {("a", 0.0), (None, 0.0)}
    assert clustering.spread(df, ["x"], "c").first()["calinski_harabasz"] is None
    assert clustering.silhouette(df.where("false"), ["x"], "c").count() == 0


# Selection


def integral(f, a, b, n=20_000):
    h = (b - a) / n
    return h * sum(f(a + (i + 0.5) * h) for i in range(n))


def test_tails_against_integrals():
    for d, x in ((1, 0.5), (2, 3.0), (5, 4.0), (5, 20.0), (40, 30.0)):
        density = lambda t: t ** (d / 2 - 1) * math.exp(-t / 2) / (2 ** (d / 2) * math.gamma(d / 2))  # noqa: E731, B023
        assert special.gamma_upper(d / 2, x / 2) == pytest.approx(integral(density, x, x + 120), abs=1e-6)
    assert special.gamma_upper(1.0, 3.0) == pytest.approx(math.exp(-3))
    for a, b, x in ((2, 3, 0.4), (5, 1.5, 0.9), (10, 0.5, 0.3), (30, 40, 0.5)):
        area = integral(lambda t: t ** (a - 1) * (1 - t) ** (b - 1), 0, x)  # noqa: B023
        assert special.beta_lower(a, b, x) == pytest.approx(area * math.gamma(a + b) / math.gamma(a) / math.gamma(b), abs=1e-6)
    assert special.beta_lower(1.0, 1.0, 0.25) == pytest.approx(0.25)
    assert special.beta_lower(3.0, 4.0, 0.0) == 0.0 and special.beta_lower(3.0, 4.0, 1.0) == 1.0


def test_selection_statistics_against_numpy(spark):
    rng = random.Random(3)
    rows = [(c := rng.choice("uvw"), rng.randint(0, 9) + 4 * (c == "u"), rng.gauss(0, 1), None if n % 7 == 0 else rng.random(), 2.0, -1.0) for n in range(400)]
    df = spark.createDataFrame([*rows, (None, 5, 1.0, 1.0, 2.0, -1.0)], "y string, a long, b double, c double, same double, low double")
    y, data = np.array([r[0] for r in rows]), {f: [r[n] for r in rows] for n, f in enumerate(["a", "b", "c", "same", "low"], 1)}
    got = {r["feature"]: r for r in selection.chi2(df, ["a", "c", "same", "low"], "y").collect()}
    for f in ("a", "c", "same"):
        keep = np.array([v is not None for v in data[f]])
        x, k = np.array([v for v in data[f] if v is not None], float), y[keep]
        e = {c: (k == c).mean() * x.sum() for c in "uvw"}
        statistic = sum((x[k == c].sum() - e[c]) ** 2 / e[c] for c in "uvw")
        assert got[f]["statistic"] == pytest.approx(statistic, abs=1e-9) and got[f]["p"] == pytest.approx(math.exp(-statistic / 2))
    assert got["low"]["statistic"] is None and got["low"]["p"] is None
    got = {r["feature"]: r for r in selection.f_classes(df, ["a", "b", "same"], "y").collect()}
    for f in ("a", "b"):
        x = np.array(data[f], float)
        between = sum((y == c).sum() * (x[y == c].mean() - x.mean()) ** 2 for c in "uvw")
        within = sum(((x[y == c] - x[y == c].mean()) ** 2).sum() for c in "uvw")
        assert got[f]["statistic"] == pytest.approx((between / 2) / (within / 397)) and 0 <= got[f]["p"] <= 1
    assert got["a"]["p"] < 1e-6 and got["same"]["statistic"] is None
    r = {x["feature"]: x for x in selection.f_regression(df, ["b", "same"], "a").collect()}
    whole = np.array([v for v in data["a"]] + [5], float), np.array(data["b"] + [1.0], float)
    c = np.corrcoef(*whole)[0, 1]
    assert r["b"]["statistic"] == pytest.approx(c * c * 399 / (1 - c * c)) and r["same"]["correlation"] is None
    ranks = [(x["feature"], x["rank"]) for x in selection.best(selection.f_classes(df, ["a", "b", "same"], "y"), 3).orderBy("rank").collect()]
    assert ranks == [("a", 1), ("b", 2), ("same", 3)]
    info = {x["feature"]: x["information"] for x in selection.mutual_information(df.withColumn("copy", F.col("y")), ["copy", "same"], "y").collect()}
    entropy = -sum((y == c).mean() * math.log((y == c).mean()) for c in "uvw")
    assert info["copy"] == pytest.approx(entropy) and info["same"] == pytest.approx(0.0, abs=1e-12)


# Forecasts


def plain_smoothing(values, alpha, beta, phi):
    level, trend, out = values[0], 0.0, []
    for v in values:
        ahead = level + phi * trend
        new = alpha * v + (1 - alpha) * ahead
        trend, level = beta * (new - level) + (1 - beta) * phi * trend, new
        out.append((ahead, level, trend))
    return out


def series(spark, lengths, seed=4):
    rng = random.Random(seed)
    rows = [(name, DAY + datetime.timedelta(days=n // 2), n, rng.gauss(n % 7, 1)) for name, count in lengths.items() for n in range(count)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "s string, t timestamp_ntz, k long, v double").repartition(3)


@pytest.mark.parametrize("block,phi", [(3, 0.9), (16, 1.0), (256, 0.8)])
def test_smoothing_in_blocks_equals_a_loop(spark, block, phi):
    """Blocks of three make blocks of blocks of blocks."""
    rows, df = series(spark, {"a": 100, "b": 1, None: 31, "c": 3})
    odd = spark.createDataFrame([("a", None, 1, 1.0), ("a", DAY, None, 1.0), ("a", DAY, 3, None)], df.schema)
    states = forecast.smoothed(df.unionAll(odd), "v", "t", "k", "s", 0.4, 0.2, phi, block)
    got = {}
    for r in states.orderBy("place").collect():
        got.setdefault(r["series"], []).append(r)
    assert {s: len(v) for s, v in got.items()} == {"a": 100, "b": 1, None: 31, "c": 3}
    last = {}
    for name, mine in got.items():
        values = [r[3] for r in sorted((r for r in rows if r[0] == name), key=lambda r: r[1:3])]
        want = plain_smoothing(values, 0.4, 0.2, phi)
        assert [r["place"] for r in mine] == list(range(len(values))) and mine[0]["forecast"] is None
        for r, (ahead, level, trend) in zip(mine, want, strict=True):
            assert (r["level"], r["trend"]) == (pytest.approx(level), pytest.approx(trend, abs=1e-9))
            assert r["place"] == 0 or r["forecast"] == pytest.approx(ahead)
        last[name] = want[-1]
    for r in forecast.forecasts(states, 4, phi).collect():
        _, level, trend = last[r["series"]]
        assert r["forecast"] == pytest.approx(level + sum(phi**i for i in range(1, r["h"] + 1)) * trend)


def test_backtest_equals_a_loop(spark):
    rows, df = series(spark, {"a": 60, "b": 12})
    got = {(r["series"], r["h"]): r for r in forecast.backtest(forecast.smoothed(df, "v", "t", "k", "s", 0.4, 0.2, 0.9, 8), 3, 0.9, 10).collect()}
    for name in "ab":
        values = [r[3] for r in sorted((r for r in rows if r[0] == name), key=lambda r: r[1:3])]
        states = plain_smoothing(values, 0.4, 0.2, 0.9)
        for h in (1, 2, 3):
            errors = [(abs(values[i + h] - states[i][1] - sum(0.9**j for j in range(1, h + 1)) * states[i][2]), values[i + h]) for i in range(9, len(values) - h)]
            r = got.get((name, h))
            assert (r["n"] if r else 0) == len(errors)
            if errors:
                assert r["mae"] == pytest.approx(sum(e for e, _ in errors) / len(errors))
                assert r["mape"] == pytest.approx(100 * sum(e / abs(v) for e, v in errors) / len(errors))


@pytest.mark.parametrize("period,ratio", [(7, False), (4, False), (5, True)])
def test_decomposition_in_blocks_equals_a_loop(spark, period, ratio):
    rows, df = series(spark, {"a": 50, "b": 3, None: 21})
    df, half = df.withColumn("v", F.col("v") + 20), period // 2
    got = {}
    for r in forecast.decomposed(df, "v", "t", "k", period, "s", ratio, block=6).orderBy("place").collect():
        got.setdefault(r["series"], []).append(r)
    for name, mine in got.items():
        v = [r[3] + 20 for r in sorted((r for r in rows if r[0] == name), key=lambda r: r[1:3])]
        weights = [1.0] * (2 * half + 1)
        if period % 2 == 0:
            weights[0] = weights[-1] = 0.5
        trend = [sum(w * x for w, x in zip(weights, v[i - half : i + half + 1], strict=True)) / period if half <= i < len(v) - half else None for i in range(len(v))]
        left = [None if t is None else x / t if ratio else x - t for x, t in zip(v, trend, strict=True)]
        means = {}
        for p in range(period):
            known = [x for i, x in enumerate(left) if i % period == p and x is not None]
            means[p] = sum(known) / len(known) if known else None
        known = [m for m in means.values() if m is not None]
        centre = sum(known) / len(known) if known else None
        assert len(mine) == len(v)
        for i, r in enumerate(mine):
            m = means[i % period]
            season = None if m is None or centre is None else m / centre if ratio else m - centre
            rest = None if left[i] is None else left[i] / season if ratio else left[i] - season
            for a, b in ((r["trend"], trend[i]), (r["season"], season), (r["rest"], rest)):
                assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-9))


def test_forecasts_of_no_rows(spark):
    none = spark.createDataFrame([], "s string, t timestamp_ntz, k long, v double")
    states = forecast.smoothed(none, "v", "t", "k", "s")
    assert states.count() == forecast.forecasts(states, 2).count() == forecast.backtest(states, 2).count() == forecast.decomposed(none, "v", "t", "k", 7).count() == 0
    with pytest.raises(ValueError):
        forecast.smoothed(none, "v", "t", "k", alpha=2)
    with pytest.raises(ValueError):
        forecast.decomposed(none, "v", "t", "k", 1)
