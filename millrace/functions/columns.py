"""Column helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Names of the numeric columns, of those asked for."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and (columns is None or f.name in columns)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL everywhere: NaN of float columns becomes NULL, infinities stay."""
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))})


def only_row(df: DataFrame) -> Column:
    """The single row of ``df`` as a struct-valued scalar subquery: statistics reach expressions without a join."""
    return df.select(F.struct(*df.columns).alias("stats")).scalar()


def half_up(value: Column, digits: int = 6) -> Column:
    return F.round(value.cast("double"), digits)


def hash_unit(key: Column, salt: str) -> Column:
    """A number in [0, 1) from md5 of salt and key: the same on every engine and for every partitioning."""
    return hash_int(key, salt) / F.lit(4294967296.0)


def hash_int(key: Column, salt: str, digits: int = 8) -> Column:
    """A number of so many hexadecimal digits (15 at most) from md5 of salt and key."""
    digest = F.md5(F.concat(F.lit(salt), key.cast("string")))
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def hash_order(key: Column, seed: int) -> list[Column]:
    """Sort keys of a seeded random order, the key itself last."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), key]
