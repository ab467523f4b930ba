"""Functions over rows of which some may fail: the others keep their results."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attempted(values: list, f: Callable[[list], list]) -> list[tuple[object, str | None]]:
    """(result, error) of each value, in order. A part that fails is halved until the failing values stand alone.

    ``f`` takes a list and returns as many results; it is called about 2 log2(n) times for each failing value.
    """
    if not values:
        return []
    try:
        found = list(f(values))
        if len(found) != len(values):
            raise ValueError(f"{len(found)} results for {len(values)} rows")
        return [(r, None) for r in found]
    except Exception as e:  # noqa: BLE001  whatever a user's function raises belongs to its row
        if len(values) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
    half = len(values) // 2
    return attempted(values[:half], f) + attempted(values[half:], f)


def mapped(df: DataFrame, value: str | Column, f: Callable[[list], list], kind: str, out: str = "result", error: str = "error") -> DataFrame:
    """``df`` with ``out`` (of the SQL type ``kind``) and ``error``: what ``f`` makes of the values batch by batch; a failing row has null and its error."""

    def run(values: pa.Array) -> pa.Array:
        rows = attempted(values.to_pylist(), f)
        return pa.array([{"result": r, "error": e} for r, e in rows], to)

    to = pa.struct([("result", _arrow(df, kind)), ("error", pa.string())])
    made = F.arrow_udf(run, f"struct<result:{kind},error:string>")(F.col(value) if isinstance(value, str) else value)
    keep = [c for c in df.columns if c not in (out, error)]
    return df.withColumn("_made", made).select(*(F.col(f"`{c}`") for c in keep), F.col("_made.result").alias(out), F.col("_made.error").alias(error))


def _arrow(df: DataFrame, kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.sparkSession.createDataFrame([], f"v {kind}").schema["v"].dataType)


def failures(df: DataFrame, error: str = "error") -> DataFrame:
    """(error, n): how often each error came, by what it says before the colon."""
    return df.where(F.col(error).isNotNull()).groupBy(F.substring_index(error, ":", 1).alias("error")).agg(F.count("*").alias("n"))
