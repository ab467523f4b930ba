"""Imputation, outlier handling and de-duplication of tables.

Statistics are one aggregate pass; they reach the rows as a scalar subquery, so
nothing is collected and no join is made. De-duplication keeps the first row by
an explicit key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import half_up, only_row
from millrace.operators.quality import fences
from millrace.operators.ranges import quantiles


def statistic(column: str, strategy: str) -> Column:
    """The aggregate that an imputation strategy fills in; the median is none (``fit_fill``)."""
    if strategy in ("mean", "auto"):
        return F.avg(column)
    if strategy == "mode":
        # The most frequent value, of ties the least.
        return F.mode(column, True)
    raise ValueError(f"no imputation strategy {strategy!r}")


def fit_fill(df: DataFrame, columns: list[str], strategy: str) -> Column:
    if strategy == "median":
        return only_row(quantiles(df, columns, [0.5]).select(*(F.col(c)[0].alias(c) for c in columns)))
    return only_row(df.agg(*(statistic(c, strategy).alias(c) for c in columns)))


def impute(df: DataFrame, columns: list[str], strategy: str = "mean", fitted_on: DataFrame | None = None) -> DataFrame:
    """Missing cells filled from statistics of ``fitted_on`` (``df`` itself by default)."""
    fill = fit_fill(df if fitted_on is None else fitted_on, columns, strategy)
    return df.withColumns({c: F.coalesce(F.col(c), fill[c]) for c in columns})


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna("any", subset=columns)


def z_bounds(df: DataFrame, columns: list[str], width: float = 3.0) -> DataFrame:
    """One row with ``lo_c`` and ``hi_c``: the mean less and plus ``width`` population deviations; null without spread."""
    out = []
    for c in columns:
        std = F.nullif(F.stddev_pop(c), F.lit(0.0))
        out += [(F.avg(c) - width * std).alias(f"lo_{c}"), (F.avg(c) + width * std).alias(f"hi_{c}")]
    return df.agg(*out)


def bounds(df: DataFrame, columns: list[str], method: str, width: float | None = None) -> Column:
    if method == "iqr":
        return only_row(fences(df, columns, 1.5 if width is None else width))
    if method == "zscore":
        return only_row(z_bounds(df, columns, 3.0 if width is None else width))
    raise ValueError(f"no outlier method {method!r}")


def is_outlier(column: str, at: Column) -> Column:
    return F.coalesce((F.col(column) < at[f"lo_{column}"]) | (F.col(column) > at[f"hi_{column}"]), F.lit(False))


def clip(df: DataFrame, columns: list[str], method: str = "iqr", width: float | None = None, fitted_on: DataFrame | None = None) -> DataFrame:
    at = bounds(df if fitted_on is None else fitted_on, columns, method, width)
    held = lambda c: F.when(F.col(c).isNotNull(), F.greatest(at[f"lo_{c}"], F.least(at[f"hi_{c}"], F.col(c).cast("double"))))
    return df.withColumns({c: held(c) for c in columns})


def outlier_counts(df: DataFrame, columns: list[str], method: str = "iqr", width: float | None = None) -> DataFrame:
    at = bounds(df, columns, method, width)
    each = F.array(*(F.struct(F.lit(c).alias("feature"), F.count_if(is_outlier(c, at)).alias("n"), F.count(c).alias("of")) for c in columns))
    return df.agg(each.alias("rows")).select(F.inline("rows"))


def flag_outliers(df: DataFrame, columns: list[str], method: str = "iqr", width: float | None = None) -> DataFrame:
    at = bounds(df, columns, method, width)
    return df.withColumns({f"{c}_outlier": is_outlier(c, at) for c in columns})


def remove_outliers(df: DataFrame, columns: list[str], method: str = "iqr", width: float | None = None) -> DataFrame:
    at = bounds(df, columns, method, width)
    return df.where(~F.greatest(*(is_outlier(c, at).cast("int") for c in columns), F.lit(0)).cast("boolean"))


def keep_first(df: DataFrame, same: list[Column], key: str) -> DataFrame:
    """Of rows that agree in ``same`` (nulls agree), the one with the least key.

    The least row meets in a combined minimum, not in a window, so a value that
    a third of all rows share makes no hot task.
    """
    names = [f"_same{n}" for n in range(len(same))]
    row = F.struct(*df.columns)
    return df.groupBy(*(s.alias(n) for s, n in zip(same, names, strict=True))).agg(F.min_by(row, F.col(key)).alias("_row")).select("_row.*")


def dedup_features(df: DataFrame, features: list[str], key: str) -> DataFrame:
    """First row of each distinct combination of features, whatever the target."""
    return keep_first(df, [F.col(c) for c in features], key)


def dedup_arrays(df: DataFrame, array: str, key: str) -> DataFrame:
    """First row of each distinct array: a digest groups, so wide arrays aren't shuffled as keys."""
    return keep_first(df, [F.sha2(F.to_json(F.struct(array)), 256)], key)


def rescale_array(array: Column) -> Column:
    """An array's values from 0 to 1 if any lie outside."""
    low, high = F.array_min(array), F.array_max(array)
    scaled = F.transform(array, lambda v: F.try_divide(v - low, high - low))
    return F.when((low < 0) | (high > 1), scaled).otherwise(array)


def valid_images(df: DataFrame, height: str, width: str, dims: str) -> DataFrame:
    sides = F.col(height).between(1, 10_000) & F.col(width).between(1, 10_000)
    return df.where(F.col(dims).between(2, 4) & sides)


def report(before: DataFrame, after: DataFrame, features_before: int, features_after: int) -> DataFrame:
    """One row: samples and features before and after, and what went."""
    b, a = only_row(before.agg(F.count("*").alias("n")))["n"], only_row(after.agg(F.count("*").alias("n")))["n"]
    one = before.sparkSession.range(1)
    return one.select(
        b.alias("samples_before"), a.alias("samples_after"), (b - a).alias("removed"),
        F.lit(features_before).alias("features_before"), F.lit(features_after).alias("features_after"), half_up(F.try_divide(b - a, b)).alias("removed_ratio"),
    )
