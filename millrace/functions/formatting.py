"""Sizes and durations for people, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def human_bytes(size: Column) -> Column:
    """``1536`` as ``1.5 KB``."""
    size = size.cast("double")
    out = F.format_string("%.1f " + UNITS[-1], size / 1024.0 ** (len(UNITS) - 1))
    for n in reversed(range(len(UNITS) - 1)):
        out = F.when(size < 1024.0 ** (n + 1), F.format_string("%.1f " + UNITS[n], size / 1024.0**n)).otherwise(out)
    return out


def human_duration(seconds: Column) -> Column:
    """``3725.5`` as ``1h 2m 5.5s``, ``65`` as ``1m 5.0s``, ``2.25`` as ``2.25s``."""
    s = seconds.cast("double")
    hours, minutes = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600.0)) / 60)
    rest = F.pmod(s, F.lit(60.0))
    return (
        F.when(s < 60, F.format_string("%.2fs", s))
        .when(s < 3600, F.format_string("%dm %.1fs", minutes, rest))
        .otherwise(F.format_string("%dh %dm %.1fs", hours, minutes, rest))
    )
