"""Feature engineering: lags, rolling means, fills, encodings, weights, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.columns import half_up

LAGS, ROLLING = (1, 2, 3, 7, 14), (7, 14, 30)


def lags(df: DataFrame, value: str, order: list[str], by: list[str], steps=LAGS) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumns({f"{value}_lag_{n}": F.lag(value, n).over(w) for n in steps})


def rolling(df: DataFrame, value: str, order: list[str], by: list[str], widths=ROLLING) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumns({f"{value}_mean_{n}": half_up(F.avg(value).over(w.rowsBetween(1 - n, 0))) for n in widths})


def filled(df: DataFrame, value: str, order: list[str], by: list[str], forward: bool = True) -> DataFrame:
    """Missing values from the last one before (or the first one after)."""
    w = W.partitionBy(*by).orderBy(*order)
    last = F.last(value, True).over(w.rowsBetween(W.unboundedPreceding, 0)) if forward else F.first(value, True).over(w.rowsBetween(0, W.unboundedFollowing))
    return df.withColumn(value, last)


def calendar(df: DataFrame, time: str) -> DataFrame:
    t = F.col(time)
    return df.withColumns({"year": F.year(t), "month": F.month(t), "day": F.day(t), "weekday": F.weekday(t), "hour": F.hour(t)})


def one_hot(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def binary_codes(df: DataFrame, code: str, bits: int) -> DataFrame:
    return df.withColumns({f"{code}_bit_{b}": F.getbit(F.col(code), F.lit(b)).cast("int") for b in range(bits)})


def target_means(df: DataFrame, column: str, target: str) -> DataFrame:
    """(column, n, encoded): the target's mean for each category."""
    return df.groupBy(column).agg(F.count("*").alias("n"), half_up(F.avg(target)).alias("encoded"))


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """(class, n, weight): n_all / (classes * n)."""
    c = df.groupBy(F.col(target).alias("class")).agg(F.count("*").alias("n"))
    every = W.partitionBy()
    return c.withColumn("weight", half_up(F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))))


def polynomial(df: DataFrame, columns: list[str]) -> DataFrame:
    """Squares and products of pairs."""
    return df.withColumns({f"{a}__{b}": F.col(a) * F.col(b) for n, a in enumerate(columns) for b in columns[n:]})


def seasonal(df: DataFrame, value: str, period: Column) -> DataFrame:
    """(period, n, seasonal): each period's mean less the overall mean."""
    c = df.groupBy(period.alias("period")).agg(F.count(value).alias("n"), F.sum(value).alias("s"))
    every = W.partitionBy()
    return c.select("period", "n", half_up(F.col("s") / F.col("n") - F.sum("s").over(every) / F.sum("n").over(every)).alias("seasonal"))


def drift(counts: DataFrame, bin_: str, expected: str, actual: str, floor: float = 1e-4) -> DataFrame:
    """(psi): the population stability index of two binned counts."""
    every = W.partitionBy()
    e = F.greatest(F.col(expected) / F.sum(expected).over(every), F.lit(floor))
    a = F.greatest(F.col(actual) / F.sum(actual).over(every), F.lit(floor))
    return counts.select(((a - e) * F.log(a / e)).alias("part")).agg(half_up(F.sum("part")).alias("psi"))


def sparse_columns(df: DataFrame, most: float = 0.5) -> DataFrame:
    """(feature, ratio, dropped): features whose missing share is over ``most``."""
    n = F.count(F.lit(1))
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), half_up(F.try_divide(F.count_if(F.col(c).isNull()), n)).alias("ratio")) for c in df.columns))
    return df.agg(rows.alias("rows")).select(F.inline("rows")).withColumn("dropped", F.col("ratio") > most)
