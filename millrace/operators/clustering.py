"""Scores of a clustering from each cluster's moments: no pairs of rows are made.

The sum of squared distances from a row to a cluster follows from the cluster's
size, its sum and its sum of squares, so one aggregate and one pass over the
rows give what a comparison of all pairs would.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import half_up, only_row

#: Clusters that a row is compared with; more are refused, as each row meets the moments of all.
MOST_CLUSTERS = 10_000


def _total(parts: list[Column]) -> Column:
    return reduce(add, parts)


def _known(df: DataFrame, features: list[str], cluster: str) -> DataFrame:
    """(cluster, x0, x1, ...) of rows with all features and a cluster."""
    whole = df.select(F.col(cluster).alias("cluster"), *(F.col(f).cast("double").alias(f"x{n}") for n, f in enumerate(features)))
    return whole.dropna("any")


def moments(df: DataFrame, features: list[str], cluster: str) -> DataFrame:
    """(cluster, n, s0, s1, ..., q): rows, sums of the features, and the sum of squares of all features."""
    x = [F.col(f"x{n}") for n in range(len(features))]
    sums = (F.sum(v).alias(f"s{n}") for n, v in enumerate(x))
    return _known(df, features, cluster).groupBy("cluster").agg(F.count("*").alias("n"), *sums, F.sum(_total([v * v for v in x])).alias("q"))


def silhouettes(df: DataFrame, features: list[str], cluster: str) -> DataFrame:
    """``df``'s complete rows as (cluster, x0, ..., silhouette), by squared Euclidean distance; 0 in a cluster of one row or without another cluster.

    (b - a) / max(a, b): a is the mean distance to the other rows of the row's cluster, b the least mean distance to another cluster.
    """
    of = moments(df, features, cluster)
    if (k := of.count()) > MOST_CLUSTERS:
        raise ValueError(f"{k} clusters are more than {MOST_CLUSTERS}")
    held = only_row(of.agg(F.collect_list(F.struct(*of.columns)).alias("all")))["all"]
    x = [F.col(f"x{n}") for n in range(len(features))]
    square = _total([v * v for v in x])
    # n |x|^2 - 2 x.s + q, never below 0 but for rounding.
    away = lambda m: F.greatest(m["n"] * square - 2 * _total([v * m[f"s{n}"] for n, v in enumerate(x)]) + m["q"], F.lit(0.0))
    each = F.transform("_all", lambda m: F.struct((m["cluster"] == F.col("cluster")).alias("own"), m["n"].alias("n"), away(m).alias("d")))
    rows = _known(df, features, cluster).withColumn("_all", held).withColumn("_each", each)
    mine = F.get(F.filter("_each", lambda e: e["own"]), F.lit(0))
    other = F.array_min(F.transform(F.filter("_each", lambda e: ~e["own"]), lambda e: e["d"] / e["n"]))
    a = F.try_divide(mine["d"], mine["n"] - 1)
    return rows.select("cluster", *x, F.coalesce(F.try_divide(other - a, F.greatest(a, other)), F.lit(0.0)).alias("silhouette"))


def silhouette(df: DataFrame, features: list[str], cluster: str) -> DataFrame:
    """(cluster, n, silhouette) means, and a row with a null cluster for all rows."""
    s = silhouettes(df, features, cluster).groupBy("cluster").agg(F.count("*").alias("n"), F.sum("silhouette").alias("s"))
    whole = s.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).select(F.lit(None).cast(s.schema["cluster"].dataType).alias("cluster"), "n", "s")
    return s.unionAll(whole.where("n IS NOT NULL")).select("cluster", "n", half_up(F.col("s") / F.col("n")).alias("silhouette"))


def spread(df: DataFrame, features: list[str], cluster: str) -> DataFrame:
    """(clusters, n, within, between, calinski_harabasz): sums of squares, and their ratio by degrees of freedom (null with one cluster or no spread)."""
    of = moments(df, features, cluster)
    size = [F.col(f"s{n}") for n in range(len(features))]
    own = _total([s * s for s in size]) / F.col("n")
    sums = of.agg(
        F.count("*").alias("clusters"), F.sum("n").alias("n"), F.sum(F.col("q") - own).alias("within"), F.sum(own).alias("own"), *(F.sum(s).alias(f"s{n}") for n, s in enumerate(size))
    )
    between = F.col("own") - _total([s * s for s in size]) / F.col("n")
    out = sums.select("clusters", "n", "within", between.alias("between"))
    score = F.try_divide(F.try_divide(F.col("between"), F.col("clusters") - 1), F.try_divide(F.col("within"), F.col("n") - F.col("clusters")))
    return out.select("clusters", "n", half_up(F.col("within"), 4).alias("within"), half_up(F.col("between"), 4).alias("between"), half_up(score, 4).alias("calinski_harabasz"))
