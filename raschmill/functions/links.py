"""Links between raw and natural item parameters, safe for large arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inv_logit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.ln(p) - F.log1p(-p)


def softplus(x: Column) -> Column:
    """ln(1 + e**x): the slope of a raw a."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def softplus_inverse(a: Column) -> Column:
    return a + F.ln(-F.expm1(-a))


def lower_asymptote(c: Column) -> Column:
    return 0.5 * inv_logit(c)


def lower_asymptote_inverse(p: Column) -> Column:
    return logit(2 * p)


def upper_asymptote(d: Column) -> Column:
    return 0.5 * inv_logit(d) + 0.5


def upper_asymptote_inverse(p: Column) -> Column:
    return logit(2 * (p - 0.5))
