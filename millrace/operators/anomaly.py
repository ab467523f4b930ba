"""Outliers by isolation forest.

Trees cut random features at random places; a row that few cuts set apart from
all others is an outlier. Each tree grows on ``sample`` rows, whatever the size
of the table: that is the method. The rows are those of least hash, so the same
forest comes of any partitioning, and the trees take them in turn.

Growing sees trees * sample rows and runs on the driver. Scoring reads every
row once, in Arrow batches: as nested conditions a forest is some ten thousand
of them, more than Spark compiles.

A row with a missing or infinite feature has no score and is no outlier.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import hash_order, hash_unit, only_row
from millrace.functions.storage import stored
from millrace.operators.ranges import quantiles

TREES, SAMPLE, SEED = 100, 256, 42
EULER = 0.5772156649015329


def expected_path(n: int) -> float:
    """The mean path of a failing search among n rows: what a leaf of n rows stands for."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + EULER) - 2 * (n - 1) / n


@dataclass(frozen=True)
class Forest:
    """Trees as heaps (children of node i are 2i and 2i + 1): the feature that a node cuts (-1: a leaf), where, and a leaf's path."""

    features: tuple[str, ...]
    feature: np.ndarray = field(repr=False)
    cut: np.ndarray = field(repr=False)
    path: np.ndarray = field(repr=False)
    expected: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """From 0 (never set apart) to 1 (at once); NaN for rows that aren't finite."""
        finite = np.isfinite(x).all(1)
        x, rows, total = np.where(finite[:, None], x, 0.0), np.arange(len(x)), np.zeros(len(x))
        for feature, cut, path in zip(self.feature, self.cut, self.path, strict=True):
            node = np.ones(len(x), int)
            while (inner := feature[node] >= 0).any():
                beyond = x[rows, np.maximum(feature[node], 0)] > cut[node]
                node = np.where(inner, 2 * node + beyond, node)
            total += path[node]
        return np.where(finite, 2.0 ** (-total / len(self.path) / self.expected) if self.expected else 0.5, np.nan)


def grow(x: np.ndarray, tree: int, seed: int, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree. A node's draws come from a digest of seed, tree and node."""
    size = 2 << height
    feature, cut, path = np.full(size, -1), np.zeros(size), np.zeros(size)
    waiting = [(1, 0, x)]
    while waiting:
        node, level, part = waiting.pop()
        low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(0), np.zeros(0))
        varied = np.flatnonzero(high > low)
        if level == height or not len(varied):
            path[node] = level + expected_path(len(part))
            continue
        draw = hashlib.md5(f"{seed}:{tree}:{node}".encode()).hexdigest()
        f = varied[int(draw[:8], 16) % len(varied)]
        feature[node], cut[node] = f, low[f] + (high[f] - low[f]) * (int(draw[8:16], 16) / 2**32)
        beyond = part[:, f] > cut[node]
        waiting += [(2 * node, level + 1, part[~beyond]), (2 * node + 1, level + 1, part[beyond])]
    return feature, cut, path


def least_hashed(df: DataFrame, key: Column, values: list[Column], size: int, seed: int) -> np.ndarray:
    """The values of the ``size`` rows of least hash, in that order: the hash is cut where a little more than that is expected below it."""
    share, n = 1.0, df.count()
    if n > size:
        share = min(1.0, (size + 6 * math.sqrt(size) + 10) / n)
    columns = [*hash_order(key, seed), *(v.cast("double") for v in values)]
    while True:
        rows = df.where(hash_unit(key, f"{seed}:") < share).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).collect()
        if len(rows) >= min(size, n) or share >= 1:
            break
        share = min(1.0, 2 * share)
    return np.array([r[2:] for r in sorted(rows)[:size]], float).reshape(-1, len(values))


def fit(df: DataFrame, features: list[str], key: Column, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
    """A forest; trees take the least hashed rows in turn, and start over where there are fewer than trees * sample."""
    whole = [F.col(f).cast("double") for f in features]
    good = df.where(key.isNotNull() & F.forall(F.array(*whole), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    pool = least_hashed(good, key, whole, trees * sample, seed)
    each = min(sample, len(pool))
    height = max(1, math.ceil(math.log2(sample)))
    grown = [grow(pool[(t * sample + np.arange(each)) % max(1, len(pool))], t, seed, height) for t in range(trees)]
    return Forest(tuple(features), *(np.array(a) for a in zip(*grown, strict=True)), expected_path(each))


def scored(df: DataFrame, forest: Forest, out: str = "score") -> DataFrame:
    """``df`` with each row's score, null where a feature is missing or infinite."""
    shared = df.sparkSession.sparkContext.broadcast(forest)  # bounded by trees and sample

    def run(*columns: pa.Array) -> pa.Array:
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], 1).astype(float)
        return pa.array(shared.value.scores(x), pa.float64(), from_pandas=True)

    return df.withColumn(out, F.arrow_udf(run, "double")(*(F.col(f).cast("double") for f in forest.features)))


def flagged(df: DataFrame, features: list[str], key: Column, contamination: float | None = None, **params) -> DataFrame:
    """``df`` with ``score`` and ``outlier``: a score over one half, or, given ``contamination``, over the quantile that leaves this share."""
    out = scored(df, fit(df, features, key, **params))
    if contamination is None:
        return out.withColumn("outlier", F.coalesce(F.col("score") > 0.5, F.lit(False)))
    out = stored(out)
    limit = only_row(quantiles(out, ["score"], [1 - contamination]))["score"][0]
    return out.withColumn("outlier", F.coalesce(F.col("score") > limit, F.lit(False)))
