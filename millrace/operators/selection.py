"""Univariate feature selection: statistics of all features against a target, each in one aggregate over the rows.

Rows with a missing target don't count; a missing feature doesn't count for that feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.special import chi2_tail, f_tail


def _by_class(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, class, n, s, q, low): count, sum, sum of squares and least value of each feature in each class.

    One row a class with all features' figures, unpivoted afterwards: the rows are read and combined once.
    """
    x = {f: F.when(F.col(target).isNotNull(), F.col(f).cast("double")) for f in features}
    figures = lambda f: F.struct(F.lit(f).alias("feature"), F.count(x[f]).alias("n"), F.coalesce(F.sum(x[f]), F.lit(0.0)).alias("s"), F.sum(x[f] * x[f]).alias("q"), F.min(x[f]).alias("low"))
    wide = df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("class")).agg(F.array(*(figures(f) for f in features)).alias("all"))
    return wide.select("class", F.inline("all"))


def chi2(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, statistic, freedom, p): how far a count-like feature's sums by class are from the classes' shares of rows.

    Null for a feature with negative values, as its sums aren't counts, and for one that is 0 throughout.
    """
    every = W.partitionBy("feature")
    share = F.col("n") / F.sum("n").over(every)
    rows = _by_class(df, features, target).select("feature", "s", "low", (share * F.sum("s").over(every)).alias("e"))
    off = F.sum(F.when(F.col("e") > 0, (F.col("s") - F.col("e")) * (F.col("s") - F.col("e")) / F.col("e")))
    out = rows.groupBy("feature").agg(F.when(F.min("low") >= 0, off).alias("statistic"), (F.count("*") - 1).alias("freedom"))
    return out.withColumn("p", chi2_tail(F.col("statistic"), F.col("freedom")))


def f_classes(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, statistic, freedom, rest, p): variance of a feature between classes over that within them; null without spread within."""
    by = _by_class(df, features, target).where("n > 0")
    sums = by.groupBy("feature").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("own"))
    between, within = F.col("own") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("own")
    freedom, rest = F.col("k") - 1, F.col("n") - F.col("k")
    statistic = F.try_divide(F.try_divide(between, freedom), F.try_divide(F.greatest(within, F.lit(0.0)), rest))
    out = sums.select("feature", statistic.alias("statistic"), freedom.alias("freedom"), rest.alias("rest"))
    return out.withColumn("p", f_tail(F.col("statistic"), F.col("freedom"), F.col("rest")))


def f_regression(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, correlation, statistic, rest, p): how well a line through one feature fits a numeric target; null for a constant."""
    y = F.col(target).cast("double")
    figures = []
    for f in features:
        a = F.when(y.isNotNull(), F.col(f).cast("double"))
        b = F.when(a.isNotNull(), y)
        r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))  # null, not an error, without spread
        figures.append(F.struct(F.lit(f).alias("feature"), r.alias("correlation"), (F.count(b) - 2).alias("rest")))
    rows = df.agg(F.array(*figures).alias("all")).select(F.inline("all"))
    r2 = F.col("correlation") * F.col("correlation")
    out = rows.select("feature", "correlation", F.try_divide(r2 * F.col("rest"), 1 - r2).alias("statistic"), "rest")
    return out.withColumn("p", f_tail(F.col("statistic"), F.lit(1), F.col("rest")))


def mutual_information(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, information): nats that a categorical feature tells of the target; missing values are a category.

    Features and classes are counted together before the shuffle; the joint counts of all features are one table.
    """
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features)))
    joint = df.where(F.col(target).isNotNull()).select(F.col(target).alias("class"), each.alias("x")).groupBy("x.feature", "x.value", "class").agg(F.count("*").alias("n"))
    over = lambda *by: F.sum("n").over(W.partitionBy("feature", *by))
    part = F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("of_value") * F.col("of_class")))
    return joint.withColumns({"of_value": over("value"), "of_class": over("class"), "all": over()}).groupBy("feature").agg(F.greatest(F.sum(part), F.lit(0.0)).alias("information"))


def best(scores: DataFrame, k: int, by: str = "statistic") -> DataFrame:
    """The ``k`` features of highest score with their ``rank`` from 1; of ties the first by name, those without a score last."""
    order: list[Column] = [F.desc_nulls_last(by), F.asc("feature")]
    return scores.withColumn("rank", F.row_number().over(W.orderBy(*order))).where(F.col("rank") <= k)  # a row a feature
