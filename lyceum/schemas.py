"""Explicit schemas of the extracts, the star schema and the audit tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(),
    "b": T.BooleanType(), "date": T.DateType(), "ts": T.TimestampType(),
}


def _struct(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in columns.items()])


def as_landed(schema: T.StructType) -> T.StructType:
    """The same columns as text: staging lands first and parses later."""
    return T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])


RAW_STUDENTS = _struct(
    student_id="s", first_name="s", last_name="s", email="s", date_of_birth="s", gender="s", nationality="s",
    enrollment_date="s", program="s", major="s", department_id="s", student_type="s", scholarship="s",
    scholarship_amount="d",
)
RAW_ENROLLMENTS = _struct(
    enrollment_id="s", student_id="s", course_id="s", instructor_id="s", semester="s", academic_year="s",
    enrollment_date="s", grade="s", grade_points="d", attendance_pct="d", assignments_completed="i",
    assignments_total="i", midterm_score="d", final_score="d",
)
RAW_COURSES = _struct(
    course_id="s", course_code="s", course_name="s", credit_hours="i", level="s", category="s", department_id="s",
    is_active="b",
)
RAW_INSTRUCTORS = _struct(
    instructor_id="s", first_name="s", last_name="s", email="s", rank="s", tenure_status="s", department_id="s",
    hire_date="s", is_active="b",
)
RAW_ATTENDANCE = _struct(
    student_id="s", course_id="s", attendance_date="s", status="s", source_system="s", minutes_late="i",
)
RAW_DEPARTMENTS = _struct(department_id="s", department_name="s", college="s")

ATTENDANCE_EVENT = _struct(
    student_id="s", course_id="s", attendance_date="s", status="s", source_system="s", timestamp="s",
)

DIM_DATE = _struct(
    date_key="i", full_date="date", day_of_week="i", day_name="s", day_of_year="i", week_of_year="i", month="i",
    month_name="s", quarter="i", year="i", academic_year="s", semester="s", is_weekday="b", is_holiday="b",
)
DIM_DEPARTMENT = _struct(department_key="l", department_id="s", department_name="s", college="s")
DIM_INSTRUCTOR = _struct(
    instructor_key="l", instructor_id="s", first_name="s", last_name="s", email="s", rank="s", tenure_status="s",
    department_key="l", hire_date="date", is_active="b",
)
DIM_COURSE = _struct(
    course_key="l", course_id="s", course_code="s", course_name="s", credit_hours="i", level="s", category="s",
    department_key="l", is_active="b",
)
DIM_STUDENT = _struct(
    student_key="l", student_id="s", first_name="s", last_name="s", email="s", date_of_birth="date", gender="s",
    nationality="s", enrollment_date="date", program="s", major="s", department_key="l", student_type="s",
    scholarship="b", scholarship_amount="d", effective_date="date", expiry_date="date", is_current="b", row_hash="s",
)
FACT_PERFORMANCE = _struct(
    enrollment_id="s", student_key="l", course_key="l", instructor_key="l", department_key="l",
    enrollment_date_key="i", academic_year="s", semester="s", grade_letter="s", grade_points="d", credit_hours="i",
    quality_points="d", attendance_pct="d", assignments_completed="i", assignments_total="i", midterm_score="d",
    final_score="d", overall_score="d", is_passing="b", is_withdrawn="b", is_incomplete="b", row_hash="s",
)
FACT_ATTENDANCE = _struct(
    student_key="l", course_key="l", instructor_key="l", department_key="l", date_key="i", status="s",
    is_present="b", is_excused="b", minutes_late="i", source_system="s",
)
FACT_SEMESTER_GPA = _struct(
    student_key="l", department_key="l", academic_year="s", semester="s", semester_gpa="d", cumulative_gpa="d",
    credit_hours_earned="l", credit_hours_attempted="l", courses_taken="l", courses_passed="l",
    avg_attendance_pct="d",
)
# A student's sum of thousandths of a GPA times credits, and of credits, over all semesters.
SEMESTER_GPA_TOTALS = _struct(student_key="l", units="l", credits="l")

ETL_RUN_LOG = _struct(
    run_id="s", pipeline="s", status="s", started_at="ts", finished_at="ts", duration_secs="l", rows_extracted="l",
    rows_loaded="l", rows_rejected="l",
)
DATA_QUALITY_LOG = _struct(
    log_id="s", run_id="s", table_name="s", check_name="s", result="s", expected="s", actual="s", row_count="l",
    logged_at="ts",
)
ROW_ACCESS_LOG = _struct(
    log_id="s", session_user="s", session_role="s", table_name="s", filter_context="s", row_count="l",
    accessed_at="ts",
)
GRANTS = _struct(role_name="s", department_id="s", granted_by="s", granted_at="ts", is_active="b")
STUDENT_USER_MAP = _struct(username="s", student_id="s", created_at="ts")
