"""Piecewise-linear confidences of threshold tests. A null or NaN value has confidence 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ramp(value: Column, threshold: float, margin: float, rising: bool) -> Column:
    """1 a margin past the threshold, 0.5 at it, 0 a margin before it; a step that includes the threshold if the margin is 0."""
    past = value - F.lit(float(threshold)) if rising else F.lit(float(threshold)) - value
    if margin <= 1e-12:
        share = F.when(past >= 0, F.lit(1.0)).otherwise(F.lit(0.0))
    else:
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (past + F.lit(margin)) / F.lit(2 * margin)))
    return F.when(value.isNull() | F.isnan(value), F.lit(0.0)).otherwise(share)


def conf_le(value: Column, threshold: float, margin: float = 0.5) -> Column:
    """Confidence that the value is at most the threshold; the margin is a share of the threshold's size."""
    return _ramp(value, threshold, abs(threshold) * margin, rising=False)


def conf_ge(value: Column, threshold: float, margin: float = 0.5) -> Column:
    """Confidence that the value is at least the threshold; the margin is a share of the threshold's size."""
    return _ramp(value, threshold, abs(threshold) * margin, rising=True)


def linear_confidence(value: Column, threshold: float, margin: float) -> Column:
    """conf_ge with a margin in the value's own unit."""
    return _ramp(value, threshold, margin if margin > 0 else 0.0, rising=True)
