"""Letter grades, grade points and course scores."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from lyceum.functions.numeric import half_up, scaled

# Grade ladder and constants of the grading rules.
GRADE_POINTS = {
    "A+": 4.0, "A": 4.0, "A-": 3.7,
    "B+": 3.3, "B": 3.0, "B-": 2.7,
    "C+": 2.3, "C": 2.0, "C-": 1.7,
    "D+": 1.3, "D": 1.0, "D-": 0.7,
    "F": 0.0,
}
MAX_POINTS = 4.0
UNGRADED = ("W", "I", "AU")
VALID_GRADES = (*GRADE_POINTS, *UNGRADED)
PASSING_GRADES = tuple(g for g in GRADE_POINTS if g != "F")
GRADE_ORDER = ("A+", "A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D", "F", "W", "I")
DEFAULT_CREDIT_HOURS = 3
DEFAULT_ASSIGNMENTS_TOTAL = 12
SCORE_WEIGHTS = {"midterm": 35, "final": 45, "attendance": 20}
HONORS_GPA = 3.5
PROBATION_GPA = 2.0


def normal_grade(value: Column) -> Column:
    return F.upper(F.trim(value))


def points_for(letter: Column) -> Column:
    """Grade points of a letter, NULL for letters that carry none."""
    ladder = F.create_map(*(F.lit(x) for x in chain.from_iterable(GRADE_POINTS.items())))
    return F.try_element_at(ladder, letter)


def letter_for(points: Column) -> Column:
    """Nearest letter at or below ``points`` on the ladder (``A+`` shares its points with ``A``).

    Points above the ladder are an A and points below it an F.

    The ladder moves in tenths, so the letter is an array lookup by tenths: a CASE with one branch
    per letter would be copied into every filter on the letter and outgrow the size up to which
    the JVM compiles generated code.
    """
    ladder = sorted((value, letter) for letter, value in GRADE_POINTS.items() if letter != "A+")
    tenths = range(int(MAX_POINTS * 10) + 1)
    letters = [[letter for value, letter in ladder if round(value * 10) <= t][-1] for t in tenths]
    place = F.floor(F.rint(points * 100) / 10).cast("int")
    held = F.when(place < 0, 0).when(place > len(letters) - 1, len(letters) - 1).otherwise(place)
    return F.element_at(F.array(*(F.lit(x) for x in letters)), held + 1)


def grade_position(letter: Column) -> Column:
    """Display position of a letter; letters outside the ladder go last."""
    place = F.array_position(F.array(*(F.lit(g) for g in GRADE_ORDER)), letter)
    return F.when(place > 0, place).otherwise(F.lit(len(GRADE_ORDER) + 1)).cast("int")


def overall_score(midterm: Column, final: Column, attendance: Column) -> Column:
    """Weighted course score with two decimals; a missing part counts as 0."""
    parts = {"midterm": midterm, "final": final, "attendance": attendance}
    total = sum(
        (scaled(F.coalesce(parts[k], F.lit(0.0)), 2) * F.lit(w) for k, w in SCORE_WEIGHTS.items()),
        start=F.lit(0),
    )
    return half_up(total, F.lit(10_000), 2)
