"""Student cleaning with quarantine, and grade enrichment."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyceum.functions import calendar, grades, text
from lyceum.operators.ranking import latest_per_key

# Contract of the student extract.
STUDENT_COLUMNS = (
    "student_id", "first_name", "last_name", "email", "date_of_birth", "gender", "nationality", "enrollment_date",
    "program", "major", "department_id", "student_type", "scholarship", "scholarship_amount",
)
STUDENT_TYPES = ("Full-Time", "Part-Time")
MIN_ENROLLMENT_YEAR = 2000
AGE_RANGE = (15, 80)
DEFAULT_GENDER = "Prefer not to say"
VERSIONED_COLUMNS = (
    "first_name", "last_name", "email", "program", "major", "department_id", "student_type", "scholarship",
    "scholarship_amount",
)


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def _student_errors(as_of: Column, email_pattern: str) -> Column:
    born, enrolled = F.col("date_of_birth"), F.col("enrollment_date")
    age = calendar.age_in_years(born, as_of)
    low, high = AGE_RANGE

    def shown(value: Column) -> Column:
        return F.coalesce(value, F.lit("NULL"))

    checks = [
        F.when(F.col("student_id").isNull(), F.lit("NULL student_id")),
        F.when(
            ~text.matches(F.col("email"), email_pattern), F.concat(F.lit("Invalid email: "), shown(F.col("email")))
        ),
        F.when(born.isNull(), F.lit("NULL date_of_birth")).when(
            ~age.between(low, high), F.format_string("Unrealistic age: %.1f years", age)
        ),
        F.when(enrolled.isNull(), F.lit("NULL enrollment_date")).when(
            ~F.year(enrolled).between(F.lit(MIN_ENROLLMENT_YEAR), F.year(as_of) + 1),
            F.concat(F.lit("Enrollment year out of range: "), F.year(enrolled).cast("string")),
        ),
        F.when(
            ~F.coalesce(F.col("student_type").isin(*STUDENT_TYPES), F.lit(False)),
            F.concat(F.lit("Invalid student_type: "), shown(F.col("student_type"))),
        ),
    ]
    return F.array_compact(F.array(*checks))


def check_students(
    raw: DataFrame,
    latest_by: Sequence[str],
    as_of: date | None = None,
    email_pattern: str = text.EMAIL_PATTERN,
) -> DataFrame:
    """Trim, parse, keep the last row per student and list each row's errors in ``validation_errors``.

    ``latest_by`` names the columns that order the arrivals of one student, since rows of a
    distributed extract have no order of their own.  Rows without an id are all kept (and rejected).
    """
    require_columns(raw, STUDENT_COLUMNS)
    # A row without an id forms a slot of its own, so such rows neither collapse nor pile up in one task.
    slot = F.when(F.col("student_id").isNull(), F.monotonically_increasing_id())
    rows = latest_per_key(
        text.trim_strings(raw).withColumn("_slot", slot),
        ["student_id", "_slot"],
        [F.col(c).desc() for c in latest_by],
    ).drop("_slot")
    parsed = rows.withColumns(
        {
            "date_of_birth": calendar.parse_date(F.col("date_of_birth").cast("string")),
            "enrollment_date": calendar.parse_date(F.col("enrollment_date").cast("string")),
            "scholarship": text.parse_flag(F.col("scholarship")),
            "scholarship_amount": text.parse_number(F.col("scholarship_amount"), 0.0),
        }
    )
    today = F.lit(as_of) if as_of else F.current_date()
    return parsed.withColumn("validation_errors", _student_errors(today, email_pattern))


def accepted(checked: DataFrame) -> DataFrame:
    """Valid rows, normalised, with the hash that detects a new version.

    The hash is taken after normalisation, so a change of letter case is not a new version, and
    over the amount as a decimal, whose text does not depend on the engine.
    """
    clean = checked.filter(F.size("validation_errors") == 0).drop("validation_errors").withColumns(
        {
            "email": F.lower("email"),
            "first_name": text.title_case(F.col("first_name")),
            "last_name": text.title_case(F.col("last_name")),
            "nationality": F.trim("nationality"),
            "gender": F.coalesce("gender", F.lit(DEFAULT_GENDER)),
        }
    )
    parts = [
        F.col(c).cast("decimal(18,2)") if c == "scholarship_amount" else F.col(c) for c in VERSIONED_COLUMNS
    ]
    return clean.withColumn("row_hash", text.row_digest(*parts))


def rejected(checked: DataFrame) -> DataFrame:
    """Quarantined rows with their errors joined by ``"; "``."""
    bad = checked.filter(F.size("validation_errors") > 0)
    return bad.withColumn("validation_errors", F.array_join("validation_errors", "; "))


def clean_students(
    raw: DataFrame, latest_by: Sequence[str], as_of: date | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(clean, rejected)``; together they hold every kept row once."""
    checked = check_students(raw, latest_by, as_of)
    return accepted(checked), rejected(checked)


def rejection_rate(checked: DataFrame) -> DataFrame:
    """One row: rows, rejected rows and the rejected share in percent with one decimal."""
    bad = F.size("validation_errors") > 0
    return checked.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(bad).alias("rejected_count"),
        F.round(F.try_divide(F.count_if(bad) * 100.0, F.count(F.lit(1))), 1).alias("rejection_pct"),
    )


def enrich_grades(enrollments: DataFrame) -> DataFrame:
    """Grade points, quality points and pass/withdraw/incomplete flags.

    A provided number overrides the ladder for graded letters only; W, I and AU never carry points.
    """
    letter = grades.normal_grade(F.col("grade"))
    ladder = grades.points_for(F.col("grade_letter"))
    provided = (
        F.col("grade_points").try_cast("double") if "grade_points" in enrollments.columns else F.lit(None)
    )
    credits = (
        F.coalesce(F.col("credit_hours").try_cast("int"), F.lit(grades.DEFAULT_CREDIT_HOURS))
        if "credit_hours" in enrollments.columns
        else F.lit(grades.DEFAULT_CREDIT_HOURS)
    )
    graded = F.col("grade_letter").isin(*grades.GRADE_POINTS)
    rows = enrollments.withColumn("grade_letter", letter).withColumns(
        {"grade_points": F.when(graded, F.coalesce(provided, ladder)), "credit_hours": credits}
    )
    derived = {
        "quality_points": F.col("grade_points") * F.col("credit_hours"),
        "is_passing": F.coalesce(F.col("grade_letter").isin(*grades.PASSING_GRADES), F.lit(False)),
        "is_withdrawn": F.coalesce(F.col("grade_letter") == "W", F.lit(False)),
        "is_incomplete": F.coalesce(F.col("grade_letter") == "I", F.lit(False)),
    }
    if {"midterm_score", "final_score", "attendance_pct"} <= set(enrollments.columns):
        derived["overall_score"] = grades.overall_score(
            F.col("midterm_score"), F.col("final_score"), F.col("attendance_pct")
        )
    return rows.withColumns(derived).drop("grade")
