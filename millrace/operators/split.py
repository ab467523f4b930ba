"""Deterministic splits, folds and samples: the order is a hash of the row key.

``row_number`` over one global order would put all rows in one task. Ranks are
built in two steps instead: the hash order is cut into ``RANGES`` ranges by its
first hex digits, each range is counted, and a row's rank is the count of the
ranges before plus its rank within its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.columns import hash_int, hash_order, only_row

#: Hex digits of the hash that make a range: 16 ** 3 ranges.
RANGE_DIGITS = 3


def ranked(df: DataFrame, key: str, seed: int, by: list[str] = []) -> DataFrame:
    """``df`` with ``_rank`` (from 0) in the seeded order within ``by``, and ``_size`` of each group."""
    digest = hash_order(F.col(key), seed)[0]
    # Groups may be null; they are one group then.
    placed = df.withColumn("_digest", digest).withColumn("_range", F.substring("_digest", 1, RANGE_DIGITS))
    counts = placed.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_range")) - F.col("_n")
    counts = counts.select(*(F.col(c).alias(f"_by{n}") for n, c in enumerate(by)), F.col("_range").alias("_r"), before.alias("_before"), F.sum("_n").over(W.partitionBy(*by)).alias("_size"))
    same = F.col("_range") == F.col("_r")
    for n, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{n}"))
    inner = F.row_number().over(W.partitionBy(*by, "_range").orderBy("_digest", key)) - 1
    return placed.withColumn("_inner", inner).join(counts, same).select(*df.columns, (F.col("_before") + F.col("_inner")).alias("_rank"), "_size")


def check_ratios(train: float, validation: float, test: float) -> None:
    if min(train, validation, test) < 0 or abs(train + validation + test - 1) > 1e-6:
        raise ValueError("ratios must not be negative and must sum to 1")


def named(rank: Column, first: Column, second: Column) -> Column:
    return F.when(rank < first, "train").when(rank < first + second, "validation").otherwise("test")


def random_split(df: DataFrame, key: str, train: float = 0.7, validation: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """``df`` with ``split``; the sizes are exact: floor(n * ratio), and the rest."""
    check_ratios(train, validation, test)
    of = lambda r: F.floor(F.col("_size") * F.lit(float(r)))
    return ranked(df, key, seed).select(*df.columns, named(F.col("_rank"), of(train), of(validation)).alias("split"))


def stratified_split(df: DataFrame, key: str, target: str, train: float = 0.7, validation: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """As ``random_split`` in each class; every class has a row in train."""
    check_ratios(train, validation, test)
    of = lambda r: F.floor(F.col("_size") * F.lit(float(r)))
    return ranked(df, key, seed, [target]).select(*df.columns, named(F.col("_rank"), F.greatest(F.lit(1), of(train)), of(validation)).alias("split"))


def may_stratify(df: DataFrame, target: str, least: int = 2) -> DataFrame:
    """(stratify): classes at most half as many as rows, the smallest with ``least`` rows or more."""
    counts = df.groupBy(target).agg(F.count("*").alias("n"))
    return counts.agg(((F.count(F.lit(1)) <= 0.5 * F.sum("n")) & (F.min("n") >= least)).alias("stratify"))


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 42, target: str | None = None) -> DataFrame:
    """``df`` with ``fold`` from 0 to k - 1; with a target, in equal parts of each class."""
    return ranked(df, key, seed, [target] if target else []).select(*df.columns, F.pmod(F.col("_rank"), F.lit(k)).cast("int").alias("fold"))


def stride_sample(df: DataFrame, key: str, stride: int, seed: int = 42) -> DataFrame:
    """Every ``stride``-th row of the seeded order."""
    return ranked(df, key, seed).where(F.pmod(F.col("_rank"), F.lit(stride)) == 0).select(*df.columns)


def bootstrap(df: DataFrame, key: str, factor: float = 1.0, seed: int = 42) -> DataFrame:
    """floor(n * factor) draws with replacement: (draw, columns...).

    Row r of the seeded order is asked for by the draws whose hash leaves r; the
    draws are made by ``range``-like explosion of each row's own share, so the
    driver never needs the row count.
    """
    numbered = ranked(df, key, seed)
    n = only_row(df.agg(F.count("*").alias("n")))["n"]
    m = F.floor(n * F.lit(float(factor))).cast("long")
    # Row r starts the draws from floor(r * m / n) up to floor((r + 1) * m / n).
    first, last = F.floor(F.col("_rank") * m / n).cast("long"), F.floor((F.col("_rank") + 1) * m / n).cast("long") - 1
    draws = numbered.select(F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))).alias("draw"))
    chosen = draws.select("draw", F.pmod(hash_int(F.col("draw"), f"{seed}:", 15), n).alias("_pick"))
    return chosen.join(numbered, F.col("_pick") == F.col("_rank")).select("draw", *df.columns)
