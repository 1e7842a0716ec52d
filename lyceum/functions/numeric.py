"""Fixed-point arithmetic.

A sum of doubles depends on the order in which shuffle blocks arrive, so a re-run after a
lost executor may round differently.  Measures are therefore scaled to whole numbers before
they are summed, and ratios are rounded half-up in integer arithmetic: any partitioning gives
the same bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled(value: Column, digits: int) -> Column:
    """``value`` as a whole number of ``10^-digits`` units."""
    return F.rint(value.cast("double") * F.lit(float(10**digits))).cast("bigint")


def half_up(numerator: Column, denominator: Column, digits: int) -> Column:
    """``numerator / denominator`` of two whole numbers, rounded half away from 0; NULL when dividing by 0.

    ``denominator`` is a count and never negative; half of it is added with the sign of the numerator.
    """
    whole, top = denominator.cast("bigint"), numerator.cast("bigint")
    half = F.when(top < 0, -whole).otherwise(whole)
    twice = top * F.lit(2 * 10**digits).cast("bigint") + half
    units = F.call_function("div", twice, F.nullif(whole * F.lit(2).cast("bigint"), F.lit(0).cast("bigint")))
    return units / F.lit(float(10**digits))


def mean_of(value: Column, digits_in: int, digits_out: int) -> Column:
    """Aggregate: exact mean of a column that carries ``digits_in`` decimals."""
    return half_up(F.sum(scaled(value, digits_in)), F.count(value) * F.lit(10**digits_in), digits_out)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part`` as a percentage of ``whole``."""
    return half_up(part * F.lit(100), whole, digits)


def reround(value: Column, digits_in: int, digits_out: int) -> Column:
    """Shorten an already rounded value from ``digits_in`` to ``digits_out`` decimals."""
    return half_up(scaled(value, digits_in), F.lit(10**digits_in), digits_out)


def clamp(value: Column, low: float, high: float) -> Column:
    """Limit to ``[low, high]`` and keep NULL (``least``/``greatest`` alone would turn it into ``low``)."""
    return F.when(value.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), value)))


def count_where(condition: Column) -> Column:
    """Aggregate: number of rows for which ``condition`` is true."""
    return F.count_if(condition)


def sum_where(condition: Column, value: Column) -> Column:
    """Aggregate: sum of ``value`` over the rows for which ``condition`` is true, 0 when there is none."""
    return F.sum(F.when(condition, value).otherwise(F.lit(0))).cast("bigint")
