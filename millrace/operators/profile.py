"""Profiles of tables, each one pass over the input whatever the number of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.columns import half_up, only_row


def melted(df: DataFrame, rows: list[list[Column]], names: list[str]) -> DataFrame:
    """Aggregates of one pass as rows: each list of columns is a row under ``names``."""
    return df.agg(F.array(*(F.struct(*(c.alias(n) for c, n in zip(r, names, strict=True))) for r in rows)).alias("rows")).select(F.inline("rows"))


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, std, min, max, missing): population standard deviation, missing cells left out."""
    rows = [[F.lit(c), half_up(F.avg(c)), half_up(F.stddev_pop(c)), F.min(c).cast("double"), F.max(c).cast("double"), F.count_if(F.col(c).isNull())] for c in columns]
    return melted(df, rows, ["feature", "mean", "std", "min", "max", "missing"])


def categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, categories, missing, first, last) of sorted distinct values."""
    rows = [[F.lit(c), F.countDistinct(c), F.count_if(F.col(c).isNull()), F.min(F.col(c).cast("string")), F.max(F.col(c).cast("string"))] for c in columns]
    return melted(df, rows, ["feature", "categories", "missing", "first", "last"])


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n_rows, missing, ratio)."""
    n = F.count(F.lit(1))
    rows = [[F.lit(c), n, F.count_if(F.col(c).isNull()), half_up(F.try_divide(F.count_if(F.col(c).isNull()), n))] for c in columns]
    return melted(df, rows, ["feature", "n_rows", "missing", "ratio"])


def missing_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(cells, missing, ratio) over all columns together."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in columns[1:]), F.count_if(F.col(columns[0]).isNull()))
    cells = F.count(F.lit(1)) * len(columns)
    return df.agg(cells.alias("cells"), nulls.alias("missing"), half_up(F.try_divide(nulls, cells)).alias("ratio"))


def schema_summary(df: DataFrame) -> DataFrame:
    """(feature, kind, missing) for every column."""
    rows = [[F.lit(c), F.lit(kind), F.count_if(F.col(c).isNull())] for c, kind in df.dtypes]
    return melted(df, rows, ["feature", "kind", "missing"])


def text_lengths(df: DataFrame, text: str) -> DataFrame:
    n = F.length(text)
    return df.agg(half_up(F.avg(n)).alias("mean"), half_up(F.stddev_pop(n)).alias("std"), F.min(n).alias("min"), F.max(n).alias("max"), F.count(n).alias("n"))


def histogram(df: DataFrame, value: Column, bins: int = 30) -> DataFrame:
    """(bin, n) for equal-width bins between least and most, the last one closed; empty bins have n 0.

    Least and most are one aggregate, the counts another; at most ``bins`` rows
    meet the list of bins.
    """
    values = df.select(value.cast("double").alias("v")).where("v IS NOT NULL")
    ends = only_row(values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))
    spread = ends["hi"] - ends["lo"]
    place = F.when(spread > 0, F.least(F.floor((F.col("v") - ends["lo"]) / F.when(spread > 0, spread) * bins) + 1, F.lit(bins))).otherwise(1)
    counts = values.select(place.cast("int").alias("b")).groupBy("b").agg(F.count("*").alias("c"))
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, F.col("bin") == F.col("b"), "left").select("bin", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def class_balance(df: DataFrame, target: str, by: list[str] = []) -> DataFrame:
    """(by..., class, n, ratio) with ratios within ``by``."""
    counts = df.groupBy(*by, F.col(target).alias("class")).agg(F.count("*").alias("n"))
    return counts.withColumn("ratio", half_up(F.col("n") / F.sum("n").over(W.partitionBy(*by))))


def class_discovery(df: DataFrame, target: str) -> DataFrame:
    """(n_rows, n_classes, is_classification, first_class, last_class): classes if distinct values are under half the rows."""
    n, d = F.count(F.lit(1)), F.countDistinct(target) + F.max(F.when(F.col(target).isNull(), 1).otherwise(0))
    return df.agg(n.alias("n_rows"), d.alias("n_classes"), (d < 0.5 * n).alias("is_classification"), F.min(target).alias("first_class"), F.max(target).alias("last_class"))


def resource_summary(df: DataFrame, value: str, time: str, by: str) -> DataFrame:
    """Mean, most, least, sample deviation (0 for one sample) and duration of a series' samples."""
    return df.groupBy(by).agg(
        half_up(F.avg(value)).alias("mean"), half_up(F.max(value)).alias("max"), half_up(F.min(value)).alias("min"),
        half_up(F.coalesce(F.stddev_samp(value), F.lit(0.0))).alias("std"),
        (F.unix_micros(F.max(F.col(time).cast("timestamp"))) - F.unix_micros(F.min(F.col(time).cast("timestamp")))).alias("duration_us"), F.count("*").alias("samples"),
    )


def channel_stats(df: DataFrame, image: str, least_std: float = 1e-8) -> DataFrame:
    """(channel, mean, std) of images held as rows of pixels of channels; every pixel counts."""
    pixels = df.select(F.explode(F.flatten(image)).alias("pixel")).select(F.posexplode("pixel").alias("channel", "v"))
    return pixels.groupBy("channel").agg(half_up(F.avg("v")).alias("mean"), half_up(F.greatest(F.stddev_pop("v"), F.lit(least_std))).alias("std"))


def durations(df: DataFrame, samples: str, rate: Column) -> DataFrame:
    """Mean, least and most seconds of sampled clips."""
    s = F.try_divide(F.size(samples), rate)
    return df.agg(half_up(F.avg(s)).alias("mean"), half_up(F.min(s)).alias("min"), half_up(F.max(s)).alias("max"))
