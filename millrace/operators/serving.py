"""Serving metrics and the sliding-window rate limiter over request logs."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.columns import half_up
from millrace.operators.ranges import numbered


def request_metrics(df: DataFrame, failed: str, duration: str) -> DataFrame:
    """(total, success, failed, success_percent, mean_duration)."""
    bad = F.count_if(F.col(failed))
    n = F.count(F.lit(1))
    return df.agg(n.alias("total"), (n - bad).alias("success"), bad.alias("failed"), half_up(F.try_divide(100.0 * (n - bad), n)).alias("success_percent"), half_up(F.avg(duration)).alias("mean_duration"))


def errors_by(df: DataFrame, kind: str) -> DataFrame:
    return df.groupBy(F.col(kind).alias("error")).agg(F.count("*").alias("n"))


def rolling_mean(df: DataFrame, value: str, order: list[str], width: int = 1000, by: list[str] = []) -> DataFrame:
    """``df`` with the mean of the last ``width`` rows, in each group of ``by``; the first of ``order`` is a number or a time.

    Ranks cut each group into blocks of ``width`` rows. The rows in view are the
    block's own up to here and the ones that the block before has beyond the same
    place, so two running sums give the mean, whatever the width, and a group's
    blocks are spread over all tasks.
    """
    home = F.floor(F.col("_rank") / width)
    dealt = numbered(df, order, by).select("*", F.explode(F.array(home, home + 1)).alias("_block")).withColumn("_own", F.col("_block") == home)
    dealt = dealt.repartition(*by, "_block")
    half, whole = W.partitionBy(*by, "_block", "_own"), W.partitionBy(*by, "_block").orderBy("_rank")
    upto, after = half.orderBy("_rank").rowsBetween(W.unboundedPreceding, 0), half.orderBy(F.desc("_rank")).rowsBetween(W.unboundedPreceding, -1)
    total = lambda w: F.struct(F.coalesce(F.sum(F.col(value).cast("double")).over(w), F.lit(0.0)).alias("s"), F.count(value).over(w).alias("n"))
    summed = dealt.withColumns({"_upto": total(upto), "_after": total(after)}).withColumn("_before", F.lag("_after", width).over(whole))
    both = lambda x: F.col(f"_upto.{x}") + F.coalesce(F.col(f"_before.{x}"), F.lit(0))
    return summed.where("_own").select(*df.columns, F.try_divide(both("s"), both("n")).alias("rolling_mean"))


def rate_limited(df: DataFrame, client: str, time: str, key: str, limit: int, window_s: float) -> DataFrame:
    """(key, allowed): a request passes if fewer than ``limit`` of its client's passed in the last ``window_s`` seconds.

    Whether one passes depends on which passed before, so each client's requests
    are walked in time order. Clients are spread over tasks and sorted by Spark;
    a task holds the passed times of one client's window, never its requests.
    """
    rows = df.select(F.col(client).alias("client"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(key).cast("long").alias("key"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "client").sortWithinPartitions("client", "at", "key")

    def walk(batches):
        last, passed = object(), deque()
        for pdf in batches:
            out = []
            for who, at in zip(pdf["client"].tolist(), pdf["at"].tolist(), strict=True):
                if who != last:
                    last, passed = who, deque()
                while passed and passed[0] <= at - window_s * 1e6:
                    passed.popleft()
                ok = len(passed) < limit
                if ok:
                    passed.append(at)
                out.append(ok)
            yield pd.DataFrame({key: pdf["key"], "allowed": pd.Series(out, dtype=bool)})

    return dealt.mapInPandas(walk, f"`{key}` bigint, allowed boolean")
