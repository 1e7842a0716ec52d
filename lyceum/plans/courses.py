"""Course difficulty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyceum.functions import bands, calendar
from lyceum.functions.numeric import count_where, mean_of, percent
from lyceum.operators import ranking
from lyceum.operators.gpa import PERIOD
from lyceum.operators.ranking import Rank
from lyceum.sources.staging import stage

# Difficulty by mean grade points.
DIFFICULTY = [(3.5, "Easy"), (2.5, "Moderate"), (2.0, "Challenging")]
HARDEST = "Very Hard"


def _term(rows: DataFrame) -> list[str]:
    """Columns of the semester: its integer key where the rows have one, since that is narrower in shuffles."""
    return ["term_key"] if "term_key" in rows.columns else list(PERIOD)


def _labelled(rows: DataFrame) -> DataFrame:
    return rows.withColumns(calendar.term_labels(F.col("term_key"))) if "term_key" in rows.columns else rows


def _stats(performance: DataFrame, keys: list[str]) -> DataFrame:
    letter = F.col("grade_letter")
    return (
        performance.groupBy(*keys, *_term(performance))
        .agg(
            F.count(F.lit(1)).alias("enrollment_count"),
            mean_of(F.col("grade_points"), 4, 3).alias("avg_grade_points"),
            mean_of(F.col("overall_score"), 2, 2).alias("avg_score"),
            mean_of(F.col("attendance_pct"), 2, 1).alias("avg_attendance"),
            F.round(F.stddev_samp("grade_points"), 3).alias("grade_stddev"),
            *(count_where(letter == g).alias(f"{g.lower()}_count") for g in "ABCDF"),
            count_where(F.col("is_withdrawn")).alias("w_count"),
        )
        .withColumns(
            {
                "fail_rate": percent(F.col("f_count"), F.col("enrollment_count"), 1),
                "withdrawal_rate": percent(F.col("w_count"), F.col("enrollment_count"), 1),
                "difficulty_tier": bands.at_least(F.col("avg_grade_points"), DIFFICULTY, HARDEST),
            }
        )
    )


def _with_rank(rows: DataFrame) -> DataFrame:
    """Rank 1 is the lowest mean grade of a department and semester.

    The aggregated rows feed the rank table and the result, so they are written once.
    """
    kept = stage(rows, "course-stats")
    rank = {"difficulty_rank": Rank("rank", ("department_key", *_term(rows)))}
    return ranking.add_ranks(kept, "avg_grade_points", rank, best="low")


def difficulty(performance: DataFrame, courses: DataFrame, departments: DataFrame) -> DataFrame:
    """Difficulty of each course and semester, ranked in the department that owns the course."""
    about = courses.select(
        "course_key", "course_code", "course_name", "credit_hours", "level", "category"
    )
    owner = courses.select("course_key", "department_key")
    ranked = _labelled(_with_rank(_stats(performance, ["course_key"]).join(owner, "course_key"))).join(about, "course_key")
    return ranked.join(departments.select("department_key", "department_name"), "department_key").select(
        "course_key", "department_key", *PERIOD, "enrollment_count", "avg_grade_points", "avg_score",
        "avg_attendance", "grade_stddev", "f_count", "w_count", "fail_rate", "withdrawal_rate", "course_code",
        "course_name", "credit_hours", "level", "category", "department_name", "difficulty_rank", "difficulty_tier",
    )


def grade_buckets(performance: DataFrame, courses: DataFrame, departments: DataFrame) -> DataFrame:
    """Grade counts of each course and semester within the department of the enrolled students."""
    ranked = _labelled(_with_rank(_stats(performance, ["course_key", "department_key"])))
    about = courses.select("course_key", "course_code", "course_name", "level")
    return (
        ranked.join(about, "course_key")
        .join(departments.select("department_key", "department_name"), "department_key")
        .select(
            "course_code", "course_name", "department_name", "level", *PERIOD, "enrollment_count",
            "avg_grade_points", "avg_score", "avg_attendance", "a_count", "b_count", "c_count", "d_count", "f_count",
            "w_count", "fail_rate", "withdrawal_rate", "difficulty_rank", "difficulty_tier",
        )
    )
