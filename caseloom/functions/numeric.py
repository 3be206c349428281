"""Scalar expressions on labels, flags and probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PLANES


def known_label(value: Column) -> Column:
    """0 or 1 as DOUBLE; blanks, sentinels, NaN and text are unknown (NULL)."""
    number = value.try_cast("double")
    return F.when(number.isin(0.0, 1.0), number)


def is_finite(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))


def known(value: Column) -> Column:
    """The number, or NULL where it is NaN: an unknown score has one form only."""
    return F.when(~F.isnan(value), value)


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Limited to [low, high]; NULL and NaN are NULL."""
    return F.when(value.isNotNull() & ~F.isnan(value), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def binarise(value: Column) -> Column:
    return (value >= 0.5).cast("int")


def flag(value: Column) -> Column:
    """1 for the number one, 0 for anything else."""
    return F.coalesce((value.try_cast("double") == 1).cast("int"), F.lit(0))


def plane_name(value: Column) -> Column:
    plane = F.lower(F.trim(value))
    return F.when(plane.isin(*PLANES), plane)


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def confidence(p: Column) -> Column:
    return F.abs(2 * p - 1)


def unit_float(value: Column) -> Column:
    """Stored 0..255 as 0..1."""
    return value / 255.0


def error_text(message: Column, limit: int = 500) -> Column:
    return F.left(message, F.lit(limit))
