"""Scores of counts, and of probability vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def precision(tp: Column, fp: Column) -> Column:
    return ratio_or_zero(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio_or_zero(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    p, r = precision(tp, fp), recall(tp, fn)
    return ratio_or_zero(2 * p * r, p + r)


def harmonic_f1(p: Column, r: Column) -> Column:
    """F1 of two percentages."""
    return 2 / (1 / r + 1 / p)


def argmax(p: Column) -> Column:
    """Place of the first maximum of an array, from 0."""
    return F.array_position(p, F.array_max(p)) - 1


def entropy(p: Column) -> Column:
    """Shannon entropy in bits; null if a probability is zero, as such bases are not averaged."""
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - x * F.log2(x))


def cross_entropy(p: Column, ref: Column, weight: Column | float = 1.0) -> Column:
    """Categorical cross-entropy of an unnormalised vector, clipped, times a weight."""
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return -F.ln(F.least(F.greatest(F.get(p, ref.cast("int")) / total, F.lit(1e-7)), F.lit(1 - 1e-7))) * weight


def pointwise_error(y: Column, p: Column) -> Column:
    """Absolute error by class."""
    return F.zip_with(y, p, lambda a, b: F.abs(a - b))
