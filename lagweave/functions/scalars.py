"""Scalar rules of the expression language.  Empty is NULL, never NaN."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP = 1e6
TINY = 1e-6
LOGIT_LIMIT = math.log((1 - TINY) / TINY)


def clipped_product(a: Column, b: Column) -> Column:
    """Product held in [-1e6, 1e6]; null where either side is."""
    p = a * b
    return F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(-CLIP)), F.lit(CLIP)))


def safe_ratio(num: Column, den: Column) -> Column:
    """Float ratio; 1 where the denominator is empty or nearly 0."""
    return F.when(F.abs(den) >= TINY, num.cast("double") / den.cast("double")).otherwise(F.lit(1.0)).cast("float")


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def rate(part: Column, whole: Column) -> Column:
    """Float share; 0 where the whole is nearly 0 or empty."""
    return F.when(whole >= TINY, part / whole).otherwise(F.lit(0.0)).cast("float")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-LOGIT_LIMIT)), F.lit(LOGIT_LIMIT))))


def clip_probability(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(TINY)), F.lit(1 - TINY))


def logit(p: Column) -> Column:
    q = clip_probability(p)
    return F.ln(q / (1 - q))


def newton_weight(p: Column) -> Column:
    return F.greatest(p * (1 - p), F.lit(1e-4))


def newton_response(y: Column, p: Column) -> Column:
    return (y - p) / newton_weight(p)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def safe_corr(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation as an aggregate; null where a side is constant (the built-in one
    divides by zero there under ANSI rules)."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 0, F.covar_pop(a, b) / spread)
