"""GPA as additive sums, so it can be rolled up at any grain and in any number of steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lyceum.functions.calendar import semester_order
from lyceum.functions.numeric import clamp, half_up, scaled, sum_where

PERIOD = ["academic_year", "semester"]
SEMESTER_KEYS = ["student_key", "department_key", *PERIOD]
MAX_GPA = 4.0

_POINT_DIGITS = 4
_PCT_DIGITS = 2
_SUMS = [
    "quality_units", "credit_hours_attempted", "credit_hours_earned", "courses_taken", "courses_passed",
    "attendance_units", "attendance_n",
]


def gpa_eligible(facts: DataFrame) -> DataFrame:
    """Rows that count towards a GPA: neither withdrawn nor incomplete, and graded."""
    return facts.filter(~F.col("is_withdrawn") & ~F.col("is_incomplete") & F.col("grade_points").isNotNull())


def credit_sums(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Additive GPA sums of the eligible enrollments per ``keys``."""
    credits = F.col("credit_hours")
    return gpa_eligible(facts).groupBy(*keys).agg(
        F.sum(scaled(F.col("quality_points"), _POINT_DIGITS)).alias("quality_units"),
        F.sum(credits).cast("bigint").alias("credit_hours_attempted"),
        sum_where(F.col("is_passing"), credits).alias("credit_hours_earned"),
        F.count(F.lit(1)).alias("courses_taken"),
        F.count_if(F.col("is_passing")).alias("courses_passed"),
        F.sum(scaled(F.col("attendance_pct"), _PCT_DIGITS)).alias("attendance_units"),
        F.count("attendance_pct").alias("attendance_n"),
    )


def combine(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Roll sums up to coarser keys."""
    return sums.groupBy(*keys).agg(*(F.sum(name).alias(name) for name in _SUMS))


def finish(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ratios from sums: GPA with three decimals in [0, 4], attendance with two."""
    gpa = half_up(F.col("quality_units"), F.col("credit_hours_attempted") * F.lit(10**_POINT_DIGITS), 3)
    attendance = half_up(F.col("attendance_units"), F.col("attendance_n") * F.lit(10**_PCT_DIGITS), 2)
    return sums.select(
        *keys,
        clamp(gpa, 0.0, MAX_GPA).alias("semester_gpa"),
        "credit_hours_earned",
        "credit_hours_attempted",
        "courses_taken",
        "courses_passed",
        attendance.alias("avg_attendance_pct"),
    )


def semester_gpa(facts: DataFrame, keys: Sequence[str] = SEMESTER_KEYS) -> DataFrame:
    """One row per student and semester from enrollment facts."""
    return finish(credit_sums(facts, keys), keys)


def semester_scores(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``semester_gpa`` plus mean midterm and final scores, in the same aggregation."""
    eligible = gpa_eligible(facts)
    units = {"midterm_avg": "midterm_score", "final_avg": "final_score"}
    sums = eligible.groupBy(*keys).agg(
        F.sum(scaled(F.col("quality_points"), _POINT_DIGITS)).alias("quality_units"),
        F.sum("credit_hours").cast("bigint").alias("credit_hours_attempted"),
        sum_where(F.col("is_passing"), F.col("credit_hours")).alias("credit_hours_earned"),
        F.count(F.lit(1)).alias("courses_taken"),
        F.count_if(F.col("is_passing")).alias("courses_passed"),
        F.sum(scaled(F.col("attendance_pct"), _PCT_DIGITS)).alias("attendance_units"),
        F.count("attendance_pct").alias("attendance_n"),
        *(
            half_up(F.sum(scaled(F.col(source), 2)), F.count(source) * F.lit(100), 2).alias(name)
            for name, source in units.items()
        ),
    )
    return finish(sums, [*keys, *units])


def cumulative_gpa(semesters: DataFrame, student: str = "student_key") -> DataFrame:
    """Running credit-weighted GPA.

    The window holds one row per semester of a student, so its size is bounded by the number
    of semesters however many enrollments a student has.
    """
    history = (
        Window.partitionBy(student)
        .orderBy(semester_order(F.col("academic_year"), F.col("semester")))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    weighted = F.sum(scaled(F.col("semester_gpa"), 3) * F.col("credit_hours_attempted")).over(history)
    credits = F.sum("credit_hours_attempted").over(history)
    running = half_up(weighted, credits * F.lit(1000), 3)
    return semesters.withColumn("cumulative_gpa", clamp(running, 0.0, MAX_GPA))
