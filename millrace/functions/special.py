"""Tail probabilities of the chi-square and F distributions, for a few statistics at a time."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY, STEPS = 1e-300, 500


def _fraction(terms) -> float:
    """A continued fraction b0 + a1/(b1 + a2/(b2 + ...)) of (a, b), by forward evaluation of its convergents' ratio."""
    _, b = next(terms)
    value = numerator = b or TINY
    denominator = 0.0
    for a, b in terms:
        denominator = 1.0 / ((b + a * denominator) or TINY)
        numerator = (b + a / numerator) or TINY
        step = numerator * denominator
        value *= step
        if abs(step - 1) < 1e-15:
            break
    return value


def gamma_upper(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # the series of the lower function
        term = total = 1.0 / a
        for n in range(1, STEPS * 20):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1.0 - scale * total)
    terms = ((n * (a - n), x + 2 * n + 1 - a) if n else (0.0, x + 1 - a) for n in range(STEPS))
    return scale / _fraction(terms)


def beta_lower(a: float, b: float, x: float) -> float:
    """The regularised lower incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_lower(b, a, 1 - x)

    def terms():
        yield 0.0, 1.0
        for n in range(1, STEPS):
            m = n // 2
            yield (m * (b - m) * x / ((a + n - 1) * (a + n)) if n % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))), 1.0

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front / (a * _fraction(terms()))


def _each(f):
    def run(*columns: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in columns), strict=True)
        return pa.array([None if None in r else f(*r) for r in rows], pa.float64())

    return F.arrow_udf(run, "double")


def chi2_tail(statistic: Column, freedom: Column) -> Column:
    """P(X > statistic) for a chi-square variable; 1 without freedom."""
    return _each(lambda s, d: gamma_upper(d / 2, s / 2) if d > 0 else 1.0)(statistic, freedom.cast("double"))


def f_tail(statistic: Column, first: Column, second: Column) -> Column:
    """P(X > statistic) for an F variable; null without freedom."""
    tail = lambda s, d1, d2: beta_lower(d2 / 2, d1 / 2, d2 / (d2 + d1 * s)) if d1 > 0 and d2 > 0 else None
    return _each(tail)(statistic, first.cast("double"), second.cast("double"))
