"""Data-quality rules: each gives issue rows (severity, category, feature, n, ratio)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import half_up, only_row
from millrace.operators.profile import melted
from millrace.operators.ranges import quantiles

NAMES = ["severity", "category", "feature", "n", "ratio"]
#: Fixed values of the rules.
FEW_MISSING, IMBALANCE, OUTLIER_SHARE, FENCE = 0.1, 10, 0.05, 1.5
LONG_TEXT, SHORT_TEXT, SHORT_SHARE = 100_000, 10, 0.1


def _issue(severity: Column, category: str, feature: str, n: Column, of: Column) -> list[Column]:
    return [severity, F.lit(category), F.lit(feature), n.cast("long"), half_up(F.try_divide(n, of))]


def issues(df: DataFrame, rows: list[list[Column]]) -> DataFrame:
    """Rows whose severity isn't null, from one pass."""
    return melted(df, rows, NAMES).where("severity IS NOT NULL")


def empty(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return issues(df, [_issue(F.when(n == 0, "error"), "empty", "*", n, n)])


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing cells over the whole table: a warning under a tenth, an error from there."""
    n = sum((F.count_if(F.col(c).isNull()) for c in columns[1:]), F.count_if(F.col(columns[0]).isNull()))
    cells = F.count(F.lit(1)) * len(columns)
    return issues(df, [_issue(F.when(n == 0, None).when(n < FEW_MISSING * cells, "warning").otherwise("error"), "missing", "*", n, cells)])


def infinite(df: DataFrame, columns: list[str]) -> DataFrame:
    rows = []
    for c in columns:
        n = F.count_if(F.abs(F.col(c).cast("double")) == F.lit(float("inf")))
        rows.append(_issue(F.when(n > 0, "error"), "infinite", c, n, F.count(F.lit(1))))
    return issues(df, rows)


def constant(df: DataFrame, columns: list[str]) -> DataFrame:
    """Features of one value; a missing cell makes two."""
    rows = []
    for c in columns:
        same = (F.min(c) == F.max(c)) & (F.count_if(F.col(c).isNull()) == 0)
        rows.append(_issue(F.when(same, "warning"), "constant", c, F.count(F.lit(1)), F.count(F.lit(1))))
    return issues(df, rows)


def fences(df: DataFrame, columns: list[str], width: float = FENCE) -> DataFrame:
    """One row with ``lo_c`` and ``hi_c`` for each column, from exact quartiles; null where the quartiles meet."""
    quartiles = quantiles(df, columns, [0.25, 0.75])
    out = []
    for c in columns:
        low, high = F.col(c)[0], F.col(c)[1]
        spread = F.when(high > low, high - low)
        out += [(low - width * spread).alias(f"lo_{c}"), (high + width * spread).alias(f"hi_{c}")]
    return quartiles.select(*out)


def outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Features with more than a twentieth of all rows beyond the quartile fences."""
    at = only_row(fences(df, columns))
    rows = []
    for c in columns:
        n = F.count_if((F.col(c) < at[f"lo_{c}"]) | (F.col(c) > at[f"hi_{c}"]))
        rows.append(_issue(F.when(n > OUTLIER_SHARE * F.count(F.lit(1)), "info"), "outliers", c, n, F.count(F.lit(1))))
    return issues(df, rows)


def missing_target(df: DataFrame, target: str) -> DataFrame:
    n = F.count_if(F.col(target).isNull())
    return issues(df, [_issue(F.when(n > 0, "error"), "missing_target", target, n, F.count(F.lit(1)))])


def imbalance(df: DataFrame, target: str) -> DataFrame:
    """Classes of which the largest is over ten times the smallest, where classes are under half the rows."""
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("c"))
    worst = (F.count(F.lit(1)) < 0.5 * F.sum("c")) & (F.max("c") > IMBALANCE * F.min("c"))
    return issues(counts, [_issue(F.when(worst, "warning"), "imbalance", target, F.max("c"), F.min("c"))])


def texts(df: DataFrame, text: str) -> DataFrame:
    """Empty, missing, very long and mostly short texts."""
    bare = F.length(F.regexp_replace(text, r"^\s+|\s+$", ""))
    all_, blank, null = F.count(F.lit(1)), F.count_if(bare == 0), F.count_if(F.col(text).isNull())
    long, short = F.count_if(F.length(text) > LONG_TEXT), F.count_if(F.length(text) < SHORT_TEXT)
    return issues(df, [
        _issue(F.when(blank > 0, "warning"), "empty_text", text, blank, all_),
        _issue(F.when(null > 0, "error"), "not_text", text, null, all_),
        _issue(F.when(long > 0, "warning"), "long_text", text, long, all_),
        _issue(F.when(short > SHORT_SHARE * all_, "warning"), "short_texts", text, short, all_),
    ])


def media(df: DataFrame, height: str, width: str, channels: str) -> DataFrame:
    """Image shapes: sides under 1 or over 10000, and shapes that differ."""
    bad = F.count_if(~F.col(height).between(1, 10_000) | ~F.col(width).between(1, 10_000))
    shapes = F.countDistinct(height, width, channels)
    all_ = F.count(F.lit(1))
    return issues(df, [_issue(F.when(bad > 0, "error"), "image_size", "*", bad, all_), _issue(F.when(shapes > 1, "warning"), "image_shapes", "*", shapes, all_)])


def audio(df: DataFrame, samples: str, rate: str) -> DataFrame:
    """Clips under a tenth of a second, and over five minutes."""
    seconds, all_ = F.try_divide(F.size(samples), F.col(rate)), F.count(F.lit(1))
    short, long = F.count_if(seconds < 0.1), F.count_if(seconds > 300)
    return issues(df, [_issue(F.when(short > 0, "warning"), "short_audio", "*", short, all_), _issue(F.when(long > 0, "info"), "long_audio", "*", long, all_)])


def summary(found: DataFrame) -> DataFrame:
    """(errors, warnings, infos, is_valid) of issue rows."""
    of = lambda s: F.count_if(F.col("severity") == s)
    return found.agg(of("error").alias("errors"), of("warning").alias("warnings"), of("info").alias("infos"), (of("error") == 0).alias("is_valid"))


def within(df: DataFrame, column: str, low=None, high=None, allowed: list | None = None) -> DataFrame:
    """Values under ``low``, over ``high`` or not among ``allowed``; missing values aren't judged."""
    bad = F.lit(False)
    bad = bad | (F.col(column) < low) if low is not None else bad
    bad = bad | (F.col(column) > high) if high is not None else bad
    bad = bad | ~F.col(column).isin(allowed) if allowed is not None else bad
    n = F.count_if(bad)
    return issues(df, [_issue(F.when(n > 0, "error"), "out_of_range", column, n, F.count(F.lit(1)))])


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows by key, for rules that are to look at no more."""
    return df.orderBy(key).limit(n)
