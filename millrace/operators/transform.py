"""Fitted transforms: statistics of one table applied to another, each a small model object."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.columns import only_row
from millrace.operators import clean
from millrace.operators.ranges import quantiles

LEAST_STD = 1e-8


class NotFitted(Exception):
    """A transform is used before it was fitted."""


@dataclass
class StandardScaler:
    """(x - mean) / population deviation, the deviation at least LEAST_STD."""

    columns: list[str]
    at: Column | None = field(default=None, repr=False)

    def fit(self, df: DataFrame) -> StandardScaler:
        self.at = only_row(df.agg(*(F.struct(F.avg(c).alias("mean"), F.greatest(F.stddev_pop(c), F.lit(LEAST_STD)).alias("std")).alias(c) for c in self.columns)))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.at is None:
            raise NotFitted("StandardScaler")
        return df.withColumns({c: (F.col(c) - self.at[c]["mean"]) / self.at[c]["std"] for c in self.columns})


@dataclass
class RangeScaler:
    """``minmax``: (x - min) / (max - min); ``robust``: (x - median) / interquartile range. No spread gives 0."""

    columns: list[str]
    kind: str = "minmax"
    at: Column | None = field(default=None, repr=False)

    def fit(self, df: DataFrame) -> RangeScaler:
        if self.kind == "minmax":
            low, high = (lambda c: F.min(c).cast("double")), (lambda c: F.max(c).cast("double"))
            self.at = only_row(df.agg(*(F.struct(low(c).alias("zero"), (high(c) - low(c)).alias("unit")).alias(c) for c in self.columns)))
        else:
            q = quantiles(df, self.columns, [0.25, 0.5, 0.75])
            self.at = only_row(q.select(*(F.struct(F.col(c)[1].alias("zero"), (F.col(c)[2] - F.col(c)[0]).alias("unit")).alias(c) for c in self.columns)))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.at is None:
            raise NotFitted("RangeScaler")
        scaled = lambda c: F.when(F.col(c).isNotNull(), F.coalesce(F.try_divide(F.col(c) - self.at[c]["zero"], self.at[c]["unit"]), F.lit(0.0)))
        return df.withColumns({c: scaled(c) for c in self.columns})


@dataclass
class LabelEncoder:
    """A category's place among the sorted categories; -1 for one that wasn't fitted."""

    column: str
    codes: DataFrame | None = field(default=None, repr=False)

    def fit(self, df: DataFrame) -> LabelEncoder:
        values = df.where(F.col(self.column).isNotNull()).select(F.col(self.column).alias("_value")).distinct()
        self.codes = values.select("_value", (F.row_number().over(W.orderBy("_value")) - 1).alias("_code"))
        return self

    def transform(self, df: DataFrame, out: str | None = None) -> DataFrame:
        if self.codes is None:
            raise NotFitted("LabelEncoder")
        joined = df.join(self.codes, F.col(self.column) == F.col("_value"), "left")
        code = F.coalesce("_code", F.lit(-1))
        target = out or self.column
        keep = [c for c in df.columns if c != target]
        return joined.select(*keep, code.alias(target))


@dataclass
class TabularPreprocessor:
    """Missing cells, encoding, scaling, clipping, in this order; everything is fitted on one table."""

    numeric: list[str]
    categorical: list[str]
    missing: str = "impute"
    clip_outliers: bool = True
    fitted: DataFrame | None = field(default=None, repr=False)

    def fit(self, df: DataFrame) -> TabularPreprocessor:
        self.fitted = df
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.fitted is None:
            raise NotFitted("TabularPreprocessor")
        base, out = self.fitted, df
        if self.missing == "impute":
            out, base = clean.impute(out, self.numeric, "mean", base), clean.impute(base, self.numeric, "mean")
        elif self.missing == "fill":
            out, base = out.fillna(0, self.numeric), base.fillna(0, self.numeric)
        elif self.missing == "drop":
            out, base = clean.drop_missing(out, self.numeric), clean.drop_missing(base, self.numeric)
        for c in self.categorical:
            out = LabelEncoder(c).fit(base).transform(out)
        scaler = StandardScaler(self.numeric).fit(base)
        out, base = scaler.transform(out), scaler.transform(base)
        return clean.clip(out, self.numeric, "iqr", fitted_on=base) if self.clip_outliers else out


def unit_pixels(image: Column) -> Column:
    """Byte pixels (rows of pixels of channels) from 0 to 1."""
    return F.transform(image, lambda row: F.transform(row, lambda pixel: F.transform(pixel, lambda v: v / 255.0)))
