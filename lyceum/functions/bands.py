"""Threshold tables turned into one CASE expression."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Step = tuple[float, object]


def _fold(tests: Iterable[tuple[Column, object]], default: object) -> Column:
    cases = [(test, F.lit(result)) for test, result in tests]
    head, *rest = cases
    chain = reduce(lambda acc, case: acc.when(*case), rest, F.when(*head))
    return chain.otherwise(F.lit(default))


def at_least(value: Column, steps: Iterable[Step], default: object) -> Column:
    """First step whose floor ``value`` reaches; NULL falls to ``default``."""
    return _fold(((value >= floor, result) for floor, result in steps), default)


def below(value: Column, steps: Iterable[Step], default: object) -> Column:
    """First step whose ceiling ``value`` stays under; NULL falls to ``default``."""
    return _fold(((value < ceiling, result) for ceiling, result in steps), default)


def first_match(tests: Iterable[tuple[Column, object]], default: object) -> Column:
    """First result whose condition holds."""
    return _fold(tests, default)
