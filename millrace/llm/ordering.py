"""Exact places of rows along an order, of which no task walks the whole.

The rows are dealt out by ranges of the order and written once, each with its
partition and its row there; what the partitions before hold is summed over
their counts, of which there are as many as partitions and groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.text import stored

#: monotonically_increasing_id counts a partition's rows in its lower bits.
ROW_BITS = (1 << 33) - 1


def places(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df``, stored, with ``place`` (from 0, in the order of ``order`` within ``by``) and ``of`` (rows of the group).

    Missing values go first; rows that agree in all of ``by`` and ``order`` follow each other in any order. ``df`` has no columns
    ``place``, ``of`` or beginning with ``_run``.
    """
    dealt = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    rows = stored(dealt.withColumns({"_run": F.spark_partition_id(), "_run_row": F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS))}))
    counts = rows.groupBy(*by, "_run").agg(F.count("*").alias("_n"), F.min("_run_row").alias("_first"))
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_run")) - F.col("_n")
    held = (F.col(c).alias(f"_run_by{n}") for n, c in enumerate(by))
    runs = stored(counts.select(*held, F.col("_run").alias("_run_r"), (before - F.col("_first")).alias("_run_less"), F.sum("_n").over(W.partitionBy(*by)).alias("of")))
    same = F.col("_run") == F.col("_run_r")
    for n, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_run_by{n}"))
    return rows.join(runs, same).select(*df.columns, (F.col("_run_row") + F.col("_run_less")).alias("place"), "of")
