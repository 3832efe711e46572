"""Exact rounding of ratios: decimal and integer inputs never pass through a double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rounded_ratio(numerator: Column, denominator: Column, digits: int) -> Column:
    """``numerator / denominator`` rounded half away from zero, as decimal(18, digits).

    The numerator may carry at most ``digits`` decimals; the denominator is a positive
    integer.  Everything is integer arithmetic, so the result does not depend on the
    order in which partial sums were merged.
    """
    shifted = (numerator * F.lit(10**digits)).cast("decimal(38,0)")
    divisor = denominator.cast("decimal(18,0)")
    half_up = F.call_function("div", F.abs(shifted) * 2 + divisor, divisor * 2)
    signed = F.when(shifted < 0, -half_up).otherwise(half_up)
    return (signed.cast("decimal(18,0)") / F.lit(10**digits)).cast(f"decimal(18,{digits})")


def rounded_mean(value: Column, digits: int) -> Column:
    """Aggregate: exact mean of an integer or decimal column at ``digits`` decimals."""
    return rounded_ratio(F.sum(value), F.count(value), digits)
