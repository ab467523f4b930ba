"""Comparing benchmark suites, as tables of (name, duration, memory)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import half_up


def summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("benchmarks"), half_up(F.sum("duration")).alias("total"), half_up(F.avg("duration")).alias("mean"), half_up(F.min("duration")).alias("fastest"), half_up(F.max("duration")).alias("slowest"))


def compare(baseline: DataFrame, current: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(name, duration_change, memory_change, verdict) for names in both: a regression in either outweighs an improvement."""
    b = baseline.select("name", F.col("duration").alias("d0"), F.col("memory").alias("m0"))
    c = current.select("name", F.col("duration").alias("d1"), F.col("memory").alias("m1"))
    d = F.coalesce(F.try_divide(F.col("d1") - F.col("d0"), F.col("d0")), F.lit(0.0))
    m = F.coalesce(F.try_divide(F.col("m1") - F.col("m0"), F.col("m0")), F.lit(0.0))
    verdict = F.when(F.greatest(d, m) > threshold, "regression").when(F.least(d, m) < -threshold, "improvement").otherwise("same")
    return b.join(c, "name").select("name", half_up(d).alias("duration_change"), half_up(m).alias("memory_change"), verdict.alias("verdict"))
