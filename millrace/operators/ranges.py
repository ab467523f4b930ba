"""Work along an order (running sums, ranks, exact quantiles) of which no task walks the whole.

The order is cut at approximate quantiles, so that rows bunched around one value
still fall into many ranges; the ranges' own sums accumulate, rows accumulate
within their range, and the results are exact wherever the cuts lie.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.columns import only_row

#: Ranges that an order is cut into.
RANGES = 256
#: Accuracy of the cuts; its state is bounded by this, not by the rows.
ACCURACY = 10_000


def _cuts(df: DataFrame, order: str) -> Column:
    shares = F.array(*(F.lit(n / RANGES) for n in range(1, RANGES)))
    return only_row(df.agg(F.percentile_approx(order, shares, ACCURACY).alias("cuts")))["cuts"]


def _further(at: Column, step: int, cuts: Column, value: Column) -> Column:
    """One step of a binary search: on by ``step`` where as many more cuts lie below the value."""
    return at + F.when(F.get(cuts, at + (step - 1)) < value, step).otherwise(0)


#: The steps of the search, which end at the number of cuts below a value.
STEPS = [RANGES >> n for n in range(1, RANGES.bit_length())]


def place(df: DataFrame, order: str) -> Column:
    """The range of a row of ``df`` along ``order``, a number or a time; equal values share one, missing ones are in the first."""
    cuts = _cuts(df, order)
    return reduce(lambda at, step: _further(at, step, cuts, F.col(order)), STEPS, F.lit(0))


def placed(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``place`` as ``_range``; a column for each step keeps every step to one comparison."""
    begun = df.withColumns({"_cuts": _cuts(df, order), "_range": F.lit(0)})
    return reduce(lambda out, step: out.withColumn("_range", _further(F.col("_range"), step, F.col("_cuts"), F.col(order))), STEPS, begun).drop("_cuts")


def _same_range(by: list[str]) -> Column:
    same = F.col("_range") == F.col("_r")
    for n, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{n}"))
    return same


def cumulative(df: DataFrame, order: str, values: list[str], by: list[str] = []) -> DataFrame:
    """``df`` with ``upto_v`` (the sum of v over rows of ``order`` as low or lower) and ``all_v`` for each value."""
    rows = placed(df, order)
    sums = rows.groupBy(*by, "_range").agg(*(F.sum(v).alias(v) for v in values))
    return _accumulated(rows, sums, order, values, by).select(*df.columns, *(f"{at}_{v}" for at in ("upto", "all") for v in values))


def tallied(df: DataFrame, order: str, values: list[str], by: list[str] = []) -> DataFrame:
    """``cumulative`` of one row for each value of ``order`` within ``by``, which has the sums of ``values`` there.

    Cuts and the ranges' sums come from ``df`` itself, so that the grouped rows, nearly as many, are made once. No range holds
    more of them than rows between two cuts.
    """
    rows = placed(df.select(*by, order, *values), order)
    total = [F.sum(v).alias(v) for v in values]
    sums = rows.groupBy(*by, "_range").agg(*total)
    counts = rows.groupBy(*by, "_range", order).agg(*total)
    return _accumulated(counts, sums, order, values, by).drop("_range")


def _accumulated(rows: DataFrame, sums: DataFrame, order: str, values: list[str], by: list[str]) -> DataFrame:
    """``rows`` with ``upto_v`` and ``all_v``, from the ranges' sums and those within each."""
    along, every = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*by)
    before = sums.select(
        *(F.col(c).alias(f"_by{n}") for n, c in enumerate(by)), F.col("_range").alias("_r"),
        *(x for v in values for x in ((F.sum(v).over(along) - F.col(v)).alias(f"_before_{v}"), F.sum(v).over(every).alias(f"all_{v}"))),
    )
    inner = W.partitionBy(*by, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    held = rows.withColumns({f"_in_{v}": F.sum(v).over(inner) for v in values})
    upto = ((F.col(f"_before_{v}") + F.col(f"_in_{v}")).alias(f"upto_{v}") for v in values)
    return held.join(F.broadcast(before), _same_range(by)).select(*rows.columns, *upto, *(f"all_{v}" for v in values))


def numbered(df: DataFrame, order: list[str], by: list[str] = []) -> DataFrame:
    """``df`` with ``_rank`` (from 0) in the order of ``order`` within ``by``; the first of ``order`` is a number or a time."""
    rows = placed(df, order[0])
    counts = rows.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_range")) - F.col("_n")
    counts = counts.select(*(F.col(c).alias(f"_by{n}") for n, c in enumerate(by)), F.col("_range").alias("_r"), before.alias("_before"))
    inner = F.row_number().over(W.partitionBy(*by, "_range").orderBy(*order)) - 1
    return rows.withColumn("_inner", inner).join(counts, _same_range(by)).select(*df.columns, (F.col("_before") + F.col("_inner")).alias("_rank"))


#: How far beyond a share its bracket reaches on either side, in units of the cuts' accuracy; one unit is what they may be off by.
REACH = 4


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """One row with an array for each column: its exact quantiles, interpolated between neighbours; null without values.

    Approximate quantiles on both sides of a share bracket the values that it may fall on; they are a few numbers, collected
    at once. The rows below a bracket are counted, and only the values inside (2 * REACH / ACCURACY of the rows, and ties) are
    gathered; a column of fewer than ACCURACY values is its own bracket. So the columns are read three times, and hardly
    anything is shuffled.
    """
    x = [F.col(c).cast("double") for c in columns]
    ends = F.array(*(F.lit(min(1.0, max(0.0, p + side * REACH / ACCURACY))) for p in shares for side in (-1, 1)))
    whole = df.agg(*(F.struct(F.count(v), F.min(v), F.max(v), F.percentile_approx(v, ends, ACCURACY)).alias(f"c{n}") for n, v in enumerate(x))).first()
    bracket, place = {}, {}
    for n, (size, least, most, found) in enumerate(whole):
        for k, p in enumerate(shares if size else []):
            bracket[n, k] = (least, most) if size < ACCURACY else (found[2 * k], found[2 * k + 1])
            place[n, k] = float(p) * (size - 1)
    if not bracket:
        return df.sparkSession.createDataFrame([tuple(None for _ in columns)], ", ".join(f"c{n} array<double>" for n in range(len(columns)))).toDF(*columns)
    inside = {at: x[at[0]].between(*map(F.lit, ends)) for at, ends in bracket.items()}
    below = only_row(df.agg(*(F.count_if(x[n] < F.lit(low)).alias(f"b{n}_{k}") for (n, k), (low, _) in bracket.items())))
    held = F.array(*(F.when(i, F.struct(F.lit(n).alias("column"), F.lit(k).alias("share"), x[n].alias("value"))) for (n, k), i in inside.items()))
    counts = df.where(reduce(or_, inside.values())).select(F.inline(F.array_compact(held))).groupBy("column", "share", "value").agg(F.count("*").alias("n"))
    before = F.array(*(below[f"b{n}_{k}"] if (n, k) in bracket else F.lit(0).cast("long") for n in range(len(columns)) for k in range(len(shares))))
    before = F.get(before, F.col("column") * len(shares) + F.col("share"))
    upto = counts.withColumn("upto", F.sum("n").over(W.partitionBy("column", "share").orderBy("value")) + before)
    least = lambda n, k, rank: F.min(F.when((F.col("column") == n) & (F.col("share") == k) & (F.col("upto") > rank), F.col("value")))
    row = upto.agg(*(e for (n, k), p in place.items() for e in (least(n, k, math.floor(p)).alias(f"low{n}_{k}"), least(n, k, math.ceil(p)).alias(f"high{n}_{k}"))))

    def value(n: int, k: int) -> Column:
        low, high, part = F.col(f"low{n}_{k}"), F.col(f"high{n}_{k}"), place[n, k] - math.floor(place[n, k])
        return F.when(low == high, low).otherwise((1 - part) * low + part * high)

    of = lambda n: F.array(*(value(n, k) for k in range(len(shares)))) if (n, 0) in place else F.lit(None).cast("array<double>")
    return row.select(*(of(n).alias(c) for n, c in enumerate(columns)))
