"""Image geometry against loops, failing rows, and metrics of one's own."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import images, metrics, robust


def looked_up(image, y, x, fill):
    top, left = math.floor(y), math.floor(x)

    def at(i, j):
        if fill is None:
            i, j = min(max(i, 0), len(image) - 1), min(max(j, 0), len(image[0]) - 1)
        return image[i][j] if 0 <= i < len(image) and 0 <= j < len(image[0]) else fill

    a, b = y - top, x - left
    return (at(top, left) * (1 - b) + at(top, left + 1) * b) * (1 - a) + (at(top + 1, left) * (1 - b) + at(top + 1, left + 1) * b) * a


@pytest.fixture(scope="module")
def pictures(spark):
    rng = random.Random(1)
    rows = [(n, [[rng.random() for _ in range(w)] for _ in range(h)]) for n, (h, w) in enumerate([(4, 6), (1, 1), (3, 3)])] + [(9, None), (10, []), (11, [[]])]
    return rows, spark.createDataFrame(rows, "k int, image array<array<double>>")


def near(got, want):
    assert (got is None) == (want is None)
    if want is not None:
        assert [len(r) for r in got] == [len(r) for r in want]
        assert [v for r in got for v in r] == pytest.approx([v for r in want for v in r])


def test_geometry_equals_loops(pictures):
    rows, df = pictures
    c, s = math.cos(math.radians(30)), math.sin(math.radians(30))
    out = df.select(
        "k", images.resized(F.col("image"), 5, 3).alias("small"), images.rotated(F.col("image"), 30, 4, 6).alias("turned"), images.translated(F.col("image"), 1, -0.5, 4, 6, 7.0).alias("moved"),
        images.scaled(F.col("image"), 2.0, 4, 6).alias("large"),
    )
    for r, (_, im) in zip(sorted(out.collect()), rows, strict=True):
        empty = not im or not im[0]
        h, w = (0, 0) if empty else (len(im), len(im[0]))
        make = lambda f, fill, a, b: None if empty else [[looked_up(im, *f(i, j), fill) for j in range(b)] for i in range(a)]  # noqa: B023, E731
        near(r["small"], make(lambda i, j: ((i + 0.5) * h / 5 - 0.5, (j + 0.5) * w / 3 - 0.5), None, 5, 3))  # noqa: B023
        near(r["turned"], make(lambda i, j: ((i - 1.5) * c + (j - 2.5) * s + 1.5, (j - 2.5) * c - (i - 1.5) * s + 2.5), 0.0, 4, 6))
        near(r["moved"], make(lambda i, j: (i - 1, j + 0.5), 7.0, 4, 6))
        near(r["large"], make(lambda i, j: ((i - 1.5) / 2 + 1.5, (j - 2.5) / 2 + 2.5), 0.0, 4, 6))


def test_crops_and_whole_turns(pictures):
    rows, df = pictures
    out = {r["k"]: r for r in df.select("k", images.cropped(F.col("image"), 1, 2, 2, 3).alias("c"), images.rotated(F.col("image"), 360, 4, 6).alias("r"), images.normalised(F.col("image"), 0.5, 2.0).alias("n")).collect()}
    im = rows[0][1]
    assert out[0]["c"] == [r[2:5] for r in im[1:3]]
    near(out[0]["r"], im)
    near(out[0]["n"], [[(v - 0.5) / 2 for v in r] for r in im])
    with pytest.raises(ValueError):
        images.affine(F.col("image"), (1, 1, 1, 1), (0, 0), 2, 2)


def test_a_failing_row_stands_alone(spark):
    def halves(values):
        return [10 // v for v in values]

    rows = [(n, n % 5 if n else None) for n in range(40)]
    df = spark.createDataFrame(rows, "k int, v int").coalesce(1)
    got = {r["k"]: (r["result"], r["error"]) for r in robust.mapped(df, "v", halves, "bigint").collect()}
    for n, v in rows:
        assert got[n] == ((10 // v, None) if v else (None, got[n][1])) and (v or got[n][1].startswith(("ZeroDivisionError: ", "TypeError: ")))
    calls = []
    robust.attempted(list(range(1024)), lambda vs: calls.append(len(vs)) or [1 // (v != 700) for v in vs])
    assert len(calls) == 21
    assert robust.attempted([1, 2], lambda vs: [0]) == [(0, None), (0, None)] and robust.attempted([], halves) == []
    counts = {r["error"]: r["n"] for r in robust.failures(robust.mapped(df, "v", halves, "bigint")).collect()}
    assert counts == {"ZeroDivisionError": 7, "TypeError": 1}


def test_registered_metrics_join_a_tasks_own(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.5)], "y double, p double")
    metrics.register("worst", lambda y, p: F.max(F.abs(y - p)), False)
    try:
        rows = {r["metric"]: r for r in metrics.evaluate(df, "regression", "y", "p", ["worst"]).collect()}
        assert rows["worst"]["value"] == 1.0 and not rows["worst"]["higher_is_better"] and not rows["worst"]["is_primary"]
        assert rows["mae"]["value"] == pytest.approx(0.5) and rows["rmse"]["is_primary"]
    finally:
        metrics.unregister("worst")
    with pytest.raises(ValueError):
        metrics.custom(df, "y", "p", ["worst"])
    with pytest.raises(ValueError):
        metrics.register("rmse", lambda y, p: F.max(y))
    r = metrics.timed(lambda d: d.withColumn("q", F.col("p") * 2), df).first()
    assert r["n"] == 3 and r["seconds"] > 0 and r["rows_per_second"] == pytest.approx(3 / r["seconds"])


def test_an_image_that_is_computed_is_computed_once(spark):
    """Spark moves the expression of an image to where it is looked up, which was at every pixel."""
    flat = spark.range(3).select(images.from_flat(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda v: v + F.col("id")), 8).alias("image"))
    for made in (images.resized(F.col("image"), 5, 12), images.rotated(F.col("image"), 25, 8, 8)):
        plan = flat.select(made.alias("image"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("slice(") == 1
